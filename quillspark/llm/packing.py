"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Only lengths decide how pieces fit, so the plan is made from the count of each length: at
most `capacity` counts, whatever the number of documents. Pieces above a third of the
capacity pair at most twice per bin, each with the largest partner that fits; smaller ones
then go, longest first, to the bins with the least gap that still holds them. The plan maps
ranges of ranks within a length to ranges of sequences, and is broadcast: its rows are
bounded by the capacity, not by the data.

Null texts count as empty; their only token is the end mark. A document is cut only where
it is longer than the capacity. An empty table gives no rows. Rows with equal or null ids
are packed like any others, piece by piece. Only the named columns are read, whatever others
there are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.bpe import model, tokenizer_path, uncollected
from quillspark.llm.common import arrow_settings, map_batches, stored, table

CAPACITY = 4096
END_ID = 1
#: Rows of one counting bucket, on average.
BUCKET = 50_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first long, n long, copies long, sequence long, place long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, copies a bin, first sequence, offset in the sequence).

    Rank r of a length, in first to first + ranks - 1, goes to sequence first sequence + (r - first) // copies, at the offset plus (r - first) % copies lengths.
    """
    left = dict(counts)
    used = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    groups: list[tuple[int, int, int]] = []  # (gap, first sequence, number of bins), sorted
    sequences = 0

    def place(length: int, bins: int, copies: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], bins * copies, copies, sequence, offset))
        used[length] += bins * copies
        left[length] -= bins * copies

    large = sorted(x for x in counts if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            at = bisect_left(large, capacity - x + 1) - 1
            while at >= 0 and (large[at] > x or not left[large[at]] - (large[at] == x and left[x] < 2)):
                at -= 1
            y = large[at] if at >= 0 else None
            if y is None:
                bins = left[x]
                place(x, bins, 1, sequences, 0)
                gap = capacity - x
            elif y == x:
                bins = left[x] // 2
                place(x, bins, 2, sequences, 0)
                gap = capacity - 2 * x
            else:
                bins = min(left[x], left[y])
                place(x, bins, 1, sequences, 0)
                place(y, bins, 1, sequences, x)
                gap = capacity - x - y
            if gap:
                insort(groups, (gap, sequences, bins))
            sequences += bins
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect_left(groups, (x, -1, -1))
            if at == len(groups):
                groups.append((capacity, sequences, -(-left[x] // (capacity // x))))
                sequences += groups[at][2]
            gap, first, bins = groups.pop(at)
            copies = min(gap // x, left[x])
            take = min(bins, left[x] // copies)
            place(x, take, copies, first, capacity - gap)
            if gap - copies * x:
                insort(groups, (gap - copies * x, first, take))
            if bins > take:
                insort(groups, (gap, first + take, bins - take))
    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document's ids and end mark, of at most capacity tokens."""

    def run(b: pa.RecordBatch) -> dict:
        bpe = model(path)
        end = END_ID.to_bytes(4, "little")
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        with uncollected():
            for doc, ids in zip(b.column(0).to_pylist(), bpe.encoded(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(out.values(), (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
        return out

    return map_batches(docs.select(doc_id, text), run, PIECE, "bpe")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored rows of pieces(), with sequence_id and offset.

    A piece's rank within its length is its rank in a bucket plus the counts of that length in earlier buckets, so even a length that all pieces share is never gathered in one task.
    """
    spark = cut.sparkSession
    total = cut.count()
    buckets = max(1, -(-total // BUCKET))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = stored(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = spark.createDataFrame(plan(histogram, capacity), PLAN)
    before = counts.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("within", F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("within"))
    # ranges of one length, sorted by first rank: the last that starts at or before the rank holds it
    ranges = rows.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "copies", "sequence", "place"))).alias("ranges"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("r", F.element_at(F.filter("ranges", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"])), 1))
    step = F.col("rank") - F.col("r.first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r.sequence") + F.floor(step / F.col("r.copies"))).cast("long").alias("sequence_id"),
        (F.col("r.place") + (step % F.col("r.copies")) * F.col("length")).cast("long").alias("offset"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op8: all documents in sequences of at most 4096 tokens."""
    arrow_settings(spark)
    return pack(stored(pieces(table(spark, sf_dir, "documents"), tokenizer_path()), "pack-pieces"))
