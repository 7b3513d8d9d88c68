"""N-gram Jaccard join by multiple-global-order filtering, and its link components.

Every document's set of word shingles is ordered by several global orders, each of which puts
common shingles last (by a sketch of fixed size that counts all documents) and breaks ties
by its own hash. Two sets that reach the threshold share a token of their prefixes under
every order, so candidates come from the first order's prefixes, must also meet in the
other orders' prefixes and must not be ruled out by a bound of the sets' difference (the bits
in which their parities by buckets differ), and are then verified on the whole sets. Only
the last step moves whole sets.

Equal sets are one representative from the start. Candidates of a prefix token are first
tried against one document only; further pairs of the token are made only between documents
whose components still differ, so a large group of copies costs as many pairs as it has
members, and no link between different components is missed.

Words are as the texts have them with A-Z lower-cased. A text with fewer words than a
shingle has its whole sequence as its one shingle; an empty or null text has none and links
with nothing. Rows with a null id have no component. Rows with one id are one document with all
their links. An empty table gives no rows. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_IDS, HOT_SHARE, arrow_schema, arrow_settings, as_batch, byte_view, entered, give_back, gram_hashes, joined_small_hot, keyed, map_batches, mix64, picked, stored, table, word_hashes, word_spans

#: Counters of the sketch of document frequencies, whatever the number of documents.
SKETCH = 1 << 22
#: Counters that one row of a task's sketch holds.
STRETCH = 1 << 16
#: Tasks that count, at most: each sends a sketch of its own, and one wave of a large cluster takes them all.
SKETCH_TASKS = 8192
ORDERS = 3
#: Tokens in counters above this, and above a HOT_SHARE'th of the documents, get their leaders by an aggregate that combines before the shuffle; others by a window.
HOT = 1000


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    b = byte_view((text or "").encode(), lower=True)
    h = word_hashes(b, *word_spans(b))
    if 0 < len(h) < n:
        return gram_hashes(h, len(h))
    return np.unique(gram_hashes(h, n))


def sketch(docs: DataFrame, n: int, doc_id: str, text: str) -> np.ndarray:
    """How many documents' shingles fall into each counter: SKETCH numbers.

    A task sends two bytes a counter, which stops at 65535, and at most SKETCH_TASKS tasks do, whatever the input's splits; stretches of counters are then added up batch by batch.
    """
    pieces = SKETCH // STRETCH
    schema = arrow_schema("stretch int, n binary")

    def count(batches):
        entered()
        total = np.zeros(SKETCH, np.uint32)
        for b in batches:
            at = [shingles(t, n) & np.uint64(SKETCH - 1) for t in b.column(0).to_pylist()]
            if at:
                seen, m = np.unique(np.concatenate(at), return_counts=True)
                total[seen.astype(np.int64)] += m.astype(np.uint32)
        parts = np.minimum(total, 65535).astype(np.uint16).reshape(pieces, STRETCH)
        yield as_batch({"stretch": np.arange(pieces), "n": [x.tobytes() for x in parts]}, schema)
        del total, parts
        give_back()

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals.setdefault(k, np.zeros(STRETCH, np.uint32))
                totals[k] += np.frombuffer(x, np.uint16)
        for k, x in totals.items():
            yield as_batch({"stretch": [k], "n": [x.tobytes()]}, schema)

    ddl = "stretch int, n binary"
    out = np.zeros((pieces, STRETCH), np.uint32)
    for r in docs.select(text).coalesce(SKETCH_TASKS).mapInArrow(count, ddl).repartition(pieces, "stretch").mapInArrow(add, ddl).collect():
        out[r["stretch"]] = np.frombuffer(r["n"], np.uint32)
    return out.reshape(-1)


def levels(counts: np.ndarray) -> np.ndarray:
    """How late a token of each counter comes: 0 up to four deviations above the median, then one more for each doubling of the square root.

    Tokens that share a counter by chance spread as the root of the median, so a token stands out by its documents beyond that, not beyond the median.
    """
    usual = max(1.0, float(np.median(counts)))
    beyond = (counts - usual) / (4 * usual**0.5)
    return np.clip(np.floor(2 * np.log2(np.maximum(beyond, 0.5))) + 1, 0, 63).astype(np.uint8)


def prefix_size(n: int, num: int, den: int) -> int:
    """How many tokens of a set of n must be looked at so that no partner is missed."""
    return n - -(-num * n // den) + 1 if n else 0


def prefix(tokens: np.ndarray, level: np.ndarray, size: int, order: int) -> np.ndarray:
    """The first tokens of a set under one global order."""
    place = mix64(tokens ^ np.uint64(0x9E3779B97F4A7C15 * (order + 1) & (1 << 64) - 1))
    key = level[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | place >> np.uint64(6)
    return tokens[np.argsort(key, kind="stable")[:size]]


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of 2 n to 4 n buckets: whether an odd number of the n tokens falls into it."""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    at = (tokens >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens that one of two sets has and the other hasn't, by their parities."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(u), len(v))
    u, v = (np.bitwise_xor.reduce(w.reshape(-1, size), axis=0) if len(w) > size else w for w in (u, v))
    return int(np.bitwise_count(u ^ v).sum())


def described(docs: DataFrame, n: int, num: int, den: int, level: np.ndarray, hot: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, the set's digest, its prefix under the first order and which of it fall into hot counters (whose numbers are sorted), 32 bits of the tokens of its other prefixes, and its parity."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n", "digest", "first", "hot", "orders", "parity")}
        for t in b.column(1).to_pylist():
            s = shingles(t, n)
            size = prefix_size(len(s), num, den)
            out["n"].append(len(s))
            out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            first = prefix(s, level, size, 0)
            out["first"].append(first.view(np.int64))
            out["hot"].append(np.isin(first & np.uint64(SKETCH - 1), hot))
            others = np.concatenate([prefix(s, level, size, k) for k in range(1, ORDERS)])
            out["orders"].append((others >> np.uint64(32)).astype("<u4").tobytes())
            out["parity"].append(parity(s))
        return {"doc_id": b.column(0)} | out

    return map_batches(docs.select(doc_id, text), run, "doc_id long, n long, digest binary, first array<long>, hot array<boolean>, orders binary, parity binary")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id that links (a, b) reach from it, for all ids that have a link."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")), "jaccard-labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels2 = stored(new.join(target, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "jaccard-labels")
        if labels2.filter("old <> component").isEmpty():
            return labels2.select("id", "component")
        labels = labels2.select("id", "component")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _kept_pairs(sides: DataFrame, pairs: DataFrame, columns: tuple[str, ...], keep: Callable[[list, list], bool], name: str) -> DataFrame:
    """The pairs (a, b) for which keep holds of both documents' columns in sides; pairs must be stored."""
    few = pairs.count() <= BROADCAST_IDS
    a, b = (sides.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns)) for c in "ab")
    joined = a.join(F.broadcast(pairs) if few else pairs, "a").join(b, "b").select("a", "b", *(f"{c}_{x}" for c in "ab" for x in columns))
    m = len(columns)

    def run(batch: pa.RecordBatch) -> dict:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 2 + 2 * m)), strict=True)
        kept = pa.array([keep(r[:m], r[m:]) for r in rows], pa.bool_())
        return {"a": batch.column(0).filter(kept), "b": batch.column(1).filter(kept)}

    return stored(map_batches(joined, run, "a long, b long"), name)


def _ids(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-needed")


def sieved(rows: DataFrame, pairs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The pairs that share enough of their prefixes under every other order and whose parities don't rule the threshold out.

    No link is lost: under any order, all common tokens beyond the prefixes lie in the rest of the larger set, and equal halves of tokens only add to the count.
    """
    _, num, den = shape

    def keep(x: tuple, y: tuple) -> bool:
        total = x[0] + y[0]
        if (num + den) * (total - least_difference(x[2], y[2])) < 2 * num * total:
            return False
        orders = [np.split(np.frombuffer(o, "<u4"), ORDERS - 1) for o in (x[1], y[1])]
        rest = max(x[0], y[0]) - prefix_size(max(x[0], y[0]), num, den)
        return all(k > 0 and (num + den) * (k + rest) >= num * total for k in map(_shared, *orders))

    return _kept_pairs(picked(rows.select("doc_id", "n", "orders", "parity"), _ids(pairs), "doc_id"), pairs, ("n", "orders", "parity"), keep, "jaccard-sieved")


def verified(docs: DataFrame, pairs: DataFrame, shape: tuple[int, int, int], doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold; pairs must be stored."""
    n, num, den = shape
    whole = picked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _ids(pairs), "doc_id")
    sets = map_batches(whole, lambda b: {"doc_id": b.column(0), "tokens": [shingles(t, n).astype("<u8").tobytes() for t in b.column(1).to_pylist()]}, "doc_id long, tokens binary")

    def keep(x: tuple, y: tuple) -> bool:
        s, t = np.frombuffer(x[0], "<u8"), np.frombuffer(y[0], "<u8")
        o = _shared(s, t)
        return den * o >= num * (len(s) + len(t) - o)

    return _kept_pairs(stored(sets, "jaccard-sets"), pairs, ("tokens",), keep, "jaccard-verified")


def linked(docs: DataFrame, rows: DataFrame, reps: DataFrame, shape: tuple[int, int, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Links (a, b), a < b, that hold all components together, between representatives: doc_id, n, first and hot, one a set."""
    _, num, den = shape
    fits = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)
    tokens = reps.select("doc_id", "n", F.posexplode(F.arrays_zip("first", "hot")).alias("place", "t")).select("doc_id", "n", "place", F.col("t.first").alias("token"), F.col("t.hot").alias("hot"))
    alone = W.partitionBy("token")
    w = alone.orderBy("place", "doc_id")
    usual = tokens.filter("not hot").select("token", "doc_id", "n", "place", F.count(F.lit(1)).over(alone).alias("m"), F.first("doc_id").over(w).alias("x"), F.first("n").over(w).alias("nx")).filter("m > 1")
    common = stored(tokens.filter("hot").select("token", "doc_id", "n", "place"), "jaccard-hot")
    lead = common.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("place", "doc_id", "n")).alias("lead")).filter("m > 1")
    lead = stored(lead.select("token", "m", F.col("lead.doc_id").alias("x"), F.col("lead.n").alias("nx")), "jaccard-leads")
    tokens = stored(usual.unionByName(joined_small_hot(common, lead, "token", "m", common.count())), "jaccard-shared")
    # first each document against the one that it shares most tokens with, of those that lead a token
    star = tokens.filter((F.col("x") != F.col("doc_id")) & fits(F.col("nx"), F.col("n"))).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("k"))
    star = star.groupBy("doc_id").agg(F.max(F.struct("k", F.bitwise_not("x").alias("x"))).alias("best"))
    star = star.select("doc_id", F.bitwise_not(F.col("best.x")).alias("x")).select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b")).distinct()
    tried = stored(star, "jaccard-pairs")
    links = verified(docs, sieved(rows, tried, shape), shape, doc_id, text)
    # then all pairs of a token's documents whose components still differ and that can share enough of what is left from the token on:
    # of two linked sets' common tokens, the first in the order has all others behind it in both
    label = components(links)
    named = tokens.join(label, tokens.doc_id == label.id, "left").select("token", "doc_id", "n", (F.col("n") - F.col("place")).alias("left"), F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    open_ = stored(named.join(mixed, "token", "left_semi"), "jaccard-open")
    x, y = open_.alias("x"), open_.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component")) & fits(F.col("x.n"), F.col("y.n"))
    enough = F.lit(num + den) * F.least("x.left", "y.left") >= F.lit(num) * (F.col("x.n") + F.col("y.n"))
    pairs = x.join(y, apart & enough).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = stored(pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-more")
    return links if more.isEmpty() else links.unionByName(verified(docs, sieved(rows, more, shape), shape, doc_id, text))


def classes(docs: DataFrame, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest id that links of num / den or more reach."""
    counts = sketch(docs, n, doc_id, text)
    hot = np.flatnonzero(counts > max(HOT, docs.count() // HOT_SHARE)).astype(np.uint64)
    rows = stored(described(docs, n, num, den, levels(counts), hot, doc_id, text), "jaccard-rows")
    alike = rows.filter("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    alike = stored(alike, "jaccard-alike")
    copies = stored(rows.filter("n > 0").join(alike.filter("m > 1"), "digest").filter("doc_id <> rep").select("doc_id").distinct(), "jaccard-copies")
    reps = picked(rows.filter("n > 0 and doc_id is not null").select("doc_id", "n", "first", "hot"), copies, "doc_id", anti=True)
    label = stored(components(linked(docs, rows, reps, (n, num, den), doc_id, text)), "jaccard-components")
    final = alike.join(label, alike.rep == label.id, "left").select("digest", "m", F.coalesce("component", "rep").alias("component_id"))
    some = joined_small_hot(rows.filter("n > 0 and doc_id is not null").select("doc_id", "n", "digest"), stored(final, "jaccard-final"), "digest", "m", rows.count())
    none = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none.withColumnRenamed("n", "n_shingles"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op7: 3-word shingles, Jaccard of 0.9 or more."""
    arrow_settings(spark)
    return classes(table(spark, sf_dir, "documents"), 3, 90, 100)


def keep_representatives(spark: SparkSession, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near copies: of each class the row with the smallest id stays; the columns stay. Where ids are null or repeated, the first row stays."""
    arrow_settings(spark)
    rows, row = keyed(docs)
    gone = stored(classes(rows, n, num, den, row).filter("doc_id <> component_id").select(F.col("doc_id").alias(row)), "jaccard-gone")
    return picked(rows, gone, row, anti=True).drop(row)
