"""Exact dedup: a minimal perfect hash over the historical distinct digests.

History and batch are reduced to one row a digest before any shuffle. Each bucket of
history digests gets a minimal perfect hash; a slot holds the full digest and the winner's
locator. A batch digest is looked up in its bucket, its bytes are compared with the slot's,
and members join the slot's group; nonmembers form groups of their own.

Nulls count as empty texts, which equal each other. Among equal rows the longest original
text wins, then the smallest id. A null id sorts last among the candidates of its group, and
a group whose ids are all null keeps null; an id of 2 ** 63 - 1 counts as null. An empty
table gives no rows. Only the named columns of the input are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_schema, arrow_settings, joined_small_hot, keyed, picked, stored, table

#: Digests that one bucket's function covers, on average.
BUCKET = 20_000
#: Keys in one displacement group, on average.
GROUP = 4
#: Stands for a null id, as it sorts after all others.
NO_ID = 2**63 - 1

INDEX = "bucket int, n int, displacement binary, digests binary, sizes binary, winners binary, lengths binary"
ANSWER = "digest binary, keep_id long, group_size long"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u = np.ascontiguousarray(digests).view("<u8").reshape(len(digests), 4)
    return u[:, 1], u[:, 2], u[:, 3]


def _mix(x):
    """A 64-bit finaliser, of an integer or of an array: without it the slots of an even n keep their parity whatever the displacement, and a search may never end."""
    if isinstance(x, int):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        return x ^ x >> 33
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(33)


def _slots(digests: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    u0, u1, u2 = _words(digests)
    d = displacement[(u0 % np.uint64(len(displacement))).astype(np.int64)].astype(np.int64)
    with np.errstate(over="ignore"):
        hashed = _mix(u1 + d.astype(np.uint64) * (u2 | np.uint64(1))) % np.uint64(n)
    return np.where(d < 0, -d - 1, hashed.astype(np.int64))


def perfect_hash(digests: np.ndarray) -> np.ndarray:
    """Displacements that send n distinct 32-byte digests to the slots 0 to n - 1, each to its own.

    Groups go from large to small; each takes the first displacement whose slots are all free. A group of one stores its slot, as a negative number.
    """
    n = len(digests)
    u0, u1, u2 = _words(digests)
    groups = max(1, -(-n // GROUP))
    group = (u0 % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    displacement = np.zeros(groups, np.int32)
    a, b = [int(x) for x in u1[order]], [int(x) | 1 for x in u2[order]]
    taken, mask = bytearray(n), (1 << 64) - 1
    singles = []
    for g in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[g])
        if size == 0:
            break
        if size == 1:
            singles.append(g)
            continue
        keys = list(zip(a[ends[g] - size : ends[g]], b[ends[g] - size : ends[g]], strict=True))
        d = 0
        while True:
            slots = {_mix(x + d * y & mask) % n for x, y in keys}
            if len(slots) == size and not any(taken[s] for s in slots):
                break
            d += 1
        displacement[g] = d
        for s in slots:
            taken[s] = 1
    free = (s for s in range(n) if not taken[s])
    for g, s in zip(singles, free, strict=False):
        displacement[g] = -s - 1
    return displacement


def _fixed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 32)


def build_index(distinct: DataFrame) -> DataFrame:
    """One row a bucket from (bucket, digest, keep_id, length, n), whose digests differ."""

    def build(t: pa.Table) -> pa.Table:
        digests = _fixed(t["digest"].combine_chunks())
        displacement = perfect_hash(digests)
        slot = np.argsort(_slots(digests, displacement, len(digests)))
        part = [digests[slot], *(t[c].to_numpy()[slot].astype("<i8") for c in ("n", "keep_id", "length"))]
        row = [[t["bucket"][0].as_py()], [len(digests)], [displacement.astype("<i4").tobytes()], *([x.tobytes()] for x in part)]
        schema = arrow_schema(INDEX)
        return pa.table([pa.array(x, k) for x, k in zip(row, schema.types, strict=True)], schema=schema)

    return distinct.groupBy("bucket").applyInArrow(build, INDEX)


def _resolve(key, index: pa.Table, batch: pa.Table) -> pa.Table:
    """The final groups of one bucket: the slots with what the batch adds, then the nonmembers."""
    if index.num_rows:
        r = index.to_pylist()[0]
        n = r["n"]
        digests = np.frombuffer(r["digests"], np.uint8).reshape(n, 32)
        size, keep, length = (np.frombuffer(r[c], "<i8").copy() for c in ("sizes", "winners", "lengths"))
    else:
        n, digests, size, keep, length = 0, np.zeros((0, 32), np.uint8), *(np.zeros(0, np.int64),) * 3
    if batch.num_rows:
        d, m, k, x = _fixed(batch["digest"].combine_chunks()), *(batch[c].to_numpy() for c in ("n", "keep_id", "length"))
        member = np.zeros(len(d), bool)
        if n:
            s = _slots(d, np.frombuffer(r["displacement"], "<i4"), n)
            member = (digests[s] == d).all(axis=1)
            s = s[member]
            size[s] += m[member]
            better = (x[member] > length[s]) | ((x[member] == length[s]) & (k[member] < keep[s]))
            keep[s[better]] = k[member][better]
        digests = np.concatenate([digests, d[~member]])
        size, keep = np.concatenate([size, m[~member]]), np.concatenate([keep, k[~member]])
    flat = digests.tobytes()
    return pa.table([pa.array([flat[i : i + 32] for i in range(0, len(flat), 32)], pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64())], schema=arrow_schema(ANSWER))


def digests(docs: DataFrame, history: F.Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, digest, length and whether the row is historical."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), F.length(t).cast("long").alias("length"), history.alias("history"))


def dedup(rows: DataFrame) -> DataFrame:
    """Groups of equal digests of rows as digests() gives them, stored: doc_id, digest, keep_id, group_size, length."""
    total = rows.count()
    buckets = max(1, -(-total // BUCKET))
    best = rows.groupBy("history", "digest").agg(F.max(F.struct("length", F.bitwise_not(F.coalesce("doc_id", F.lit(NO_ID))).alias("neg"))).alias("w"), F.count(F.lit(1)).alias("n"))
    best = best.select("history", "digest", "n", F.bitwise_not(F.col("w.neg")).alias("keep_id"), F.col("w.length").alias("length"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"))
    index = build_index(best.filter("history").drop("history"))
    batch = best.filter("not history").drop("history")
    answers = stored(index.groupBy("bucket").cogroup(batch.groupBy("bucket")).applyInArrow(_resolve, ANSWER).withColumn("keep_id", F.nullif("keep_id", F.lit(NO_ID))), "exact-groups")
    return joined_small_hot(rows, answers, "digest", "group_size", total)


def half(doc_id: str = "doc_id") -> F.Column:
    """Half of the rows, taken as the history of the other half."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id), F.lit(2)) == 0, F.lit(True))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op1: every row of documents with the row of its group that stays."""
    arrow_settings(spark)
    docs = table(spark, sf_dir, "documents")
    rows = stored(digests(docs, half()), "exact-digests")
    return dedup(rows).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows whose text repeats another's; the columns stay. Where ids are null or repeated, rows are told apart by a number of their own, which then decides between equally long texts."""
    arrow_settings(spark)
    rows, row = keyed(docs)
    groups = dedup(stored(digests(rows, half(row), doc_id=row), "exact-digests"))
    gone = stored(groups.filter("doc_id <> keep_id").select(F.col("doc_id").alias(row)), "exact-gone")
    return picked(rows, gone, row, anti=True).drop(row)


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""
