"""Python over groups of rows, many groups to a task: for a group of two rows a call of its own costs more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def solved(df: DataFrame, key: str, order: str, solve: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What solve gives for the rows of each value of key, in order; no more than one value's rows and one batch are held at once."""
    out_type = StructType.fromDDL(schema)
    names = out_type.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_type)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held: list[dict] = []
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if held and held[0][key] != row[key]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield packed(out)
        if held:
            yield packed(solve(held))

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)
