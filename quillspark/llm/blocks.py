"""Blocks of documents with a dictionary each, whose entries get their meaning by joins.

A task cuts its documents into blocks of about BLOCK_BYTES of text. A block is written as numbers into
its own dictionary of words (or of other units), and the dictionary's entries are rows beside it. What
the whole corpus knows of an entry comes back by joining those rows, of which a key has at most one a
block however often it occurs, so a key that makes up a third of all words is spread like any other,
nothing that grows with the corpus is broadcast, and no task holds more than a block and its dictionary.
A text isn't cut: one that is longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_IDS, arrow_schema, as_batch, entered, give_back

#: Bytes of text of a block.
BLOCK_BYTES = 1 << 25
#: Bits of a block's number that are free for parts of it.
PARTS = 20
#: Rows of a record batch that a block gives.
BATCH = 50_000


class Names(dict):
    """Numbers from 0 on for what is asked for, in the order of the first asking."""

    def __missing__(self, key) -> int:
        self[key] = out = len(self)
        return out


def in_blocks(df: DataFrame, f: Callable[[int, list[pa.RecordBatch]], Iterator[dict]], ddl: str, text: int) -> DataFrame:
    """mapInArrow where f gets a block's number and its record batches; column number `text` holds the texts. Store what comes out: the blocks' numbers depend on the input's splits."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        block, held, size = TaskContext.get().partitionId() << 40, [], 0
        for b in batches:
            held.append(b)
            size += b.column(text).nbytes
            if size >= BLOCK_BYTES:
                yield from (as_batch(x, schema) for x in f(block, held))
                block, held, size = block + (1 << PARTS), [], 0
        if held:
            yield from (as_batch(x, schema) for x in f(block, held))
        held.clear()
        give_back()

    return df.mapInArrow(run, ddl)


def cut(columns: dict, rows: int) -> Iterator[dict]:
    """Columns in batches of at most BATCH rows; what isn't a column is the same in all rows."""
    for i in range(0, rows, BATCH):
        n = min(BATCH, rows - i)
        yield {k: v[i : i + n] if hasattr(v, "__len__") and not isinstance(v, str | bytes) else [v] * n for k, v in columns.items()}


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, compressed."""
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(x.astype("<i4").tobytes(), asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * int.from_bytes(data[:8], "little"), asbytes=True), "<i4")


def rising(*columns: np.ndarray) -> bytes:
    """Columns of one length of whole numbers under 2 ** 62, best rising ones, as their differences; first all lowest bytes, then all second ones, ..., compressed."""
    step = np.stack([np.diff(np.asarray(x, "<i8"), prepend=0) for x in columns])
    step = step << 1 ^ step >> 63  # small numbers for small differences, falling ones too
    data = np.ascontiguousarray(step.view(np.uint8).reshape(*step.shape, 8).transpose(0, 2, 1))
    return len(columns[0]).to_bytes(8, "little") + pa.Codec("zstd").compress(data.tobytes(), asbytes=True)


def risen(data: bytes, columns: int) -> np.ndarray:
    """The columns of rising(), a row each."""
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * columns * n, asbytes=True), np.uint8)
    step = np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view("<u8").reshape(columns, n)
    return np.cumsum((step >> np.uint64(1)).astype(np.int64) ^ -(step & np.uint64(1)).astype(np.int64), axis=1)


def known(rows: DataFrame, answers: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined to answers, one a key; answers must be stored, as they are counted to choose the join: those of more than BROADCAST_IDS rows are shuffled."""
    return rows.join(F.broadcast(answers) if answers.count() <= BROADCAST_IDS else answers, on, how)
