"""MinHash near-dedup by an inverted join of signature coordinates.

A document's signature has K coordinates, each the least hash of its shingles under a function of its own;
two documents agree in a coordinate with a probability of their Jaccard similarity. Documents are posted
under every (coordinate, value) pair, and pairs that agree in at least `matches` coordinates are wanted:
the largest number that a pair at the threshold falls short of with a probability of at most MISS.

Values that one document alone has can't agree with anything, so a document with fewer than `matches`
shared values has no partner. Of the c shared values of a document, ordered by the length of their
posting lists, the shortest c - matches + 1 are its prefix: two documents that agree in `matches` values
share one of their prefixes. Only prefixes' lists are merged; the long lists behind them are skipped,
and for the pairs that the short ones gave they are looked up in the signatures instead. What agrees often enough is
confirmed on the whole shingle sets.

A list's pairs aren't all made: in each of a few rounds a document is tried against one leader of another component
that its lists hold, so a group of copies costs about as many pairs as it has members. Then
lists whose documents are still in different components are dealt in squares of two parts of at most PART documents.
A task compares a square's signatures as arrays, each pair in the first of its common prefix values only, and of those that agree
often enough the parities of the sets, which bound their difference; only what passes both becomes a row.
A family of near copies of which many stay apart is therefore compared pair by pair, but in bounded tasks and memory.

Words are as the texts have them with A-Z lower-cased. A text with fewer words than a shingle has its whole
sequence as its one shingle; an empty or null text has none and links with nothing. Rows with a null id
have no component and stay. Rows with one id are one document with all their links. Equal sets are one document from the
start, so repeated rows cost one. A very long text is hashed in blocks. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_schema, arrow_settings, as_batch, entered, give_back, joined_small_hot, map_batches, mix64, picked, stored, table
from quillspark.llm.jaccard import _ids, _kept_pairs, components, least_difference, parity, shingles, verified

#: Coordinates of a signature.
K = 64
#: With what probability a pair at the threshold may agree in fewer coordinates than are asked for.
MISS = 1e-9
#: Rounds in which each document is tried against one leader.
ROUNDS = 3
#: Documents of a part of a list, and of a side of what is compared at a time.
PART, SIDE = 2048, 256

_TIMES = mix64(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_PLUS = mix64(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def matches(num: int, den: int, k: int = K, miss: float = MISS) -> int:
    """The largest number of agreeing coordinates that pairs of similarity num / den reach but for a probability of miss."""
    p, below = num / den, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signature(tokens: np.ndarray) -> np.ndarray:
    """The K posting keys of a set: a coordinate's least hash, with the coordinate's number in the lowest bits."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(tokens), 1024):
            least = np.minimum(least, ((tokens[None, i : i + 1024] ^ _PLUS[:, None]) * _TIMES[:, None]).min(axis=1))
    return least >> np.uint64(6) << np.uint64(6) | np.arange(K, dtype=np.uint64)


def signed(docs: DataFrame, n: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, the set's digest, its K posting keys, 32 bits of each and its parity, of every row; without keys where the set is empty."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n", "digest", "keys", "brief", "parity")}
        for t in b.column(1).to_pylist():
            s = shingles(t, n)
            keys = signature(s) if len(s) else s
            out["n"].append(len(s))
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            out["keys"].append(keys.view(np.int64))
            out["brief"].append(mix64(keys).astype("<u4").tobytes())
            out["parity"].append(parity(s))
        return {"doc_id": b.column(0)} | out

    return map_batches(docs.select(doc_id, text), run, "doc_id long, n long, digest binary, keys array<long>, brief binary, parity binary")


def prefixes(reps: DataFrame, total: int, least: int) -> DataFrame:
    """doc_id, n and key of the prefixes of documents that share at least `least` values with others; total is the number of documents.

    Lists of over a HOT_SHARE'th of all documents, of which there are at most K times HOT_SHARE, are broadcast; others are shuffled.
    """
    postings = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    lists = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "minhash-lists")
    shared = joined_small_hot(postings, lists, "key", "m", total)
    own = W.partitionBy("doc_id", "n")
    ranked = shared.select("doc_id", "n", "key", F.count(F.lit(1)).over(own).alias("c"), F.row_number().over(own.orderBy("m", "key")).alias("place"))
    return stored(ranked.filter((F.col("c") >= least) & (F.col("place") <= F.col("c") - least + 1)).select("doc_id", "n", "key"), "minhash-prefixes")


def colliding(reps: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """The pairs that agree in at least `least` coordinates; pairs must be stored."""

    def keep(x: tuple, y: tuple) -> bool:
        return int(np.count_nonzero(np.frombuffer(x[0], "<u4") == np.frombuffer(y[0], "<u4"))) >= least

    return _kept_pairs(picked(reps.select("doc_id", "brief"), _ids(pairs), "doc_id"), pairs, ("brief",), keep, "minhash-colliding")


_SQUARE = ("key", "i", "j", "part", "doc_id", "n", "component", "mask", "brief", "parity")


class Square:
    """The documents of two parts of a list (or of one), as arrays."""

    def __init__(self, columns: dict[str, list]) -> None:
        get = lambda c, kind=np.int64: np.array(columns[c], kind)
        self.part, self.doc, self.n, self.component = get("part"), get("doc_id"), get("n"), get("component")
        self.mask = get("mask").view(np.uint64)
        self.brief = np.frombuffer(b"".join(columns["brief"]), "<u4").reshape(-1, K)
        self.parity = columns["parity"]
        self.i, self.j, self.coordinate = columns["i"][0], columns["j"][0], np.uint64(columns["key"][0] & (K - 1))

    def pairs(self, least: int, num: int, den: int) -> list[tuple[int, int]]:
        """Pairs of different components that agree in `least` coordinates, meet here first, and aren't ruled out by their sizes or parities."""
        out = []
        left, right = (np.flatnonzero(self.part == x) for x in (self.i, self.j))
        for s in range(0, len(left), SIDE):
            x = left[s : s + SIDE]
            for t in range(0, len(right), SIDE):
                y = right[t : t + SIDE]
                apart = self.component[x][:, None] != self.component[y][None, :]
                if self.i == self.j:
                    apart &= x[:, None] < y[None, :]
                small, large = np.minimum(self.n[x][:, None], self.n[y][None, :]), np.maximum(self.n[x][:, None], self.n[y][None, :])
                p, q = np.nonzero(apart & (den * small >= num * large))
                if not len(p):
                    continue
                same = self.brief[x[p]] == self.brief[y[q]]
                often = np.count_nonzero(same, axis=1) >= least
                p, q, same = x[p[often]], y[q[often]], same[often]
                shared = np.packbits(same, axis=1, bitorder="little").view(np.uint64).ravel() & self.mask[p] & self.mask[q]
                first = (shared & (~shared + np.uint64(1))) == np.uint64(1) << self.coordinate
                out += self._bounded(p[first], q[first], num, den)
        return out

    def _bounded(self, p: np.ndarray, q: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
        out = []
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            total = int(self.n[a] + self.n[b])
            if (num + den) * (total - least_difference(self.parity[a], self.parity[b])) >= 2 * num * total:
                out.append((min(int(self.doc[a]), int(self.doc[b])), max(int(self.doc[a]), int(self.doc[b]))))
        return out


def across(rows: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the squares of rows (_SQUARE) give."""
    schema = arrow_schema("a long, b long")

    def solved(columns: dict[str, list]) -> pa.RecordBatch:
        found = Square(columns).pairs(least, num, den)
        return as_batch({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        held: dict[str, list] = {c: [] for c in _SQUARE}
        now = None
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _SQUARE}
            squares = list(zip(columns["key"], columns["i"], columns["j"], strict=True))
            start = 0
            while start < len(squares):
                if squares[start] != now and held["key"]:
                    yield solved(held)
                    held = {c: [] for c in _SQUARE}
                now, end = squares[start], start
                while end < len(squares) and squares[end] == now:
                    end += 1
                for c in _SQUARE:
                    held[c] += columns[c][start:end]
                start = end
        if held["key"]:
            yield solved(held)
        give_back()

    return rows.select(*_SQUARE).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame, reps: DataFrame, total: int, shape: tuple[int, int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame | None:
    """id and component of all documents that have a link; None where there is none."""
    _, num, den = shape
    least = matches(num, den)
    fits = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)
    posted = prefixes(reps, total, least)
    lists = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "minhash-merged")
    posted = stored(joined_small_hot(posted, lists, "key", "m", total), "minhash-posted")

    def named(label: DataFrame | None) -> DataFrame:
        """The lists with documents of more than one component."""
        whole = posted.withColumn("component", F.col("doc_id")) if label is None else posted.join(label, posted.doc_id == label.id, "left").select(*posted.columns, F.coalesce("component", "doc_id").alias("component"))
        ends = whole.groupBy("key").agg(F.min(F.struct("component", "doc_id", "n")).alias("lo"), F.max(F.struct("component", "doc_id", "n")).alias("hi"))
        ends = stored(ends.filter("lo.component <> hi.component").join(lists, "key"), "minhash-open")
        return joined_small_hot(whole.drop("m"), ends, "key", "m", total)

    def confirmed(pairs: DataFrame) -> DataFrame:
        return verified(docs, colliding(reps, pairs, least), shape, doc_id, text)

    label, links, tried = None, [], []
    for _ in range(ROUNDS):
        other = F.when(F.col("lo.component") != F.col("component"), F.col("lo")).otherwise(F.col("hi"))
        to = named(label).select("doc_id", "n", other.alias("x")).filter(fits(F.col("x.n"), F.col("n")))
        pairs = to.groupBy(F.least("doc_id", "x.doc_id").alias("a"), F.greatest("doc_id", "x.doc_id").alias("b"), "doc_id").agg(F.count(F.lit(1)).alias("k"))
        for x in tried:
            pairs = pairs.join(x, ["a", "b"], "left_anti")
        best = pairs.groupBy("doc_id").agg(F.max(F.struct("k", F.bitwise_not("a").alias("x"), F.bitwise_not("b").alias("y"))).alias("p"))
        tried.append(stored(best.select(F.bitwise_not("p.x").alias("a"), F.bitwise_not("p.y").alias("b")).distinct(), "minhash-pairs"))
        if tried[-1].isEmpty():
            return label
        links.append(confirmed(tried[-1]))
        label = components(reduce(DataFrame.unionByName, links))
    open_ = named(label).select("key", "doc_id", "n", "component", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    masks = posted.groupBy("doc_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("key").bitwiseAND(K - 1).cast("int"))).alias("mask"))
    sides = reps.select("doc_id", "n", "brief", "parity")
    dealt = open_.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).join(masks, "doc_id").join(sides, ["doc_id", "n"])
    more = across(dealt, least, num, den).distinct()
    more = stored(more, "minhash-more")
    return label if more.isEmpty() else components(reduce(DataFrame.unionByName, [*links, verified(docs, more, shape, doc_id, text)]))


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links of num / den or more reach) and kept of each row."""
    rows = stored(signed(docs, n, doc_id, text), "minhash-rows")
    some = rows.filter("n > 0 and doc_id is not null")
    alike = stored(some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "minhash-alike")
    total = rows.count()
    copies = joined_small_hot(some.select("doc_id", "digest"), alike.filter("m > 1"), "digest", "m", total).filter("doc_id <> rep").select("doc_id").distinct()
    reps = picked(some, stored(copies, "minhash-copies"), "doc_id", anti=True).dropDuplicates(["doc_id", "digest"])
    label = linked(docs, reps, total, (n, num, den), doc_id, text)
    final = alike.select("digest", "m", F.col("rep").alias("component_id"))
    if label is not None:
        final = alike.join(label, alike.rep == label.id, "left").select("digest", "m", F.coalesce("component", "rep").alias("component_id"))
    whole = joined_small_hot(some.select("doc_id", "n", "digest"), stored(final, "minhash-final"), "digest", "m", total).select("doc_id", "n", "component_id")
    none = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return whole.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op11: 3-word shingles, links from a Jaccard similarity of 0.85 on."""
    arrow_settings(spark)
    return classes(table(spark, sf_dir, "documents"), 3, 85, 100)


#: All links by an exact join of the shingles themselves.
SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM split
), sizes AS (
  SELECT doc_id, count(g) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)
), edges AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM least JOIN sizes USING (doc_id)
"""
