"""Phrase collocations by hierarchical pair naming.

Words that are frequent in a language get ids. A phrase of k words is the pair of the ids of its first
and of its last k - 1 words, which stand at neighbouring places; the pairs of all blocks are counted by buckets
of their hashes, and frequent ones get ids in turn. A block sends its pairs of a bucket as one packed
row, as most pairs are rare, and one row a pair would be several times the input to shuffle. Such a pair is a pointer to both parents as well: the
frequencies of all cuts' parts come along it, and a phrase is inside a longer one exactly if it is a
parent of it, or a parent's parent.

Frequencies only fall from a phrase to a longer one, so every part of a frequent phrase is frequent, and
a phrase that any longer one subsumes is subsumed by one that is a single word longer.

A null language is `und`. A null or empty text has no words, rows with null, equal or clashing ids and
columns count like any others, as only the two named columns are read, and an empty table gives no rows.
A very long text is one block and costs memory in proportion. Equal scores are ordered by frequency, then
by the phrase's UTF-8 bytes, so ties have one order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.blocks import BATCH, Names, cut, in_blocks, known, packed, risen, rising, unpacked
from quillspark.llm.common import Tables, arrow_schema, arrow_settings, as_batch, entered, give_back, mix64, table

#: A phrase has at least so many occurrences and at most so many words.
LEAST, LONGEST = 30, 4
#: A longer phrase with this share of a phrase's occurrences (in hundredths) subsumes it.
SUBSUMES = 80
TOP = 2000
#: Words of the corpus for each bucket of pairs, which a task holds.
BUCKET_WORDS = 1_000_000

_SEPARATORS = b".,;:!?\n\v\f\r"
#: Lower case, and the one separator "." in place of all, which no word can hold.
_FOLD = bytes(ord(".") if x in _SEPARATORS else x + 32 if 65 <= x <= 90 else x for x in range(256))
_LEVEL_1 = "block long, lang string, ids binary, local int, word binary, n long"
_LEVEL_K = "block long, ids binary, bucket long, first long, pairs binary"
_COUNTED = "block long, local binary, names binary, id long, left long, right long, f long"


def words(text: str) -> list[bytes]:
    """A text's words, with "." between its pieces."""
    return text.encode().translate(_FOLD).replace(b".", b" . ").split()


def _numbered(block: int, batches: list[pa.RecordBatch]):
    """A block's words as numbers into a dictionary, each language's as a block of its own; 0 stands between pieces."""
    names: dict[str, Names] = {}
    series: dict[str, list[np.ndarray]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if lang not in names:
                names[lang] = Names({b".": 0})
                series[lang] = []
            found = words((text or "") + ".")
            series[lang].append(np.fromiter(map(names[lang].__getitem__, found), np.int32, len(found)))
    for i, (lang, own) in enumerate(names.items()):
        ids, key = np.concatenate(series.pop(lang)), block | i
        n = np.bincount(ids, minlength=len(own))
        yield {"block": [key], "lang": [lang], "ids": [packed(ids)], "local": [None], "word": [None], "n": [None]}
        yield from cut({"block": key, "lang": lang, "ids": None, "local": np.arange(1, len(n)), "word": list(own)[1:], "n": n[1:]}, len(n) - 1)


def _pairs(series: pa.Table, names: pa.Table, buckets: int) -> pa.Table:
    """Of a block's phrases of k - 1 words (by start), those at neighbouring places that are both frequent: the phrases of k words, numbered anew by bucket, and each bucket's left and right ids and numbers of occurrences."""
    schema = arrow_schema(_LEVEL_K)
    entered()
    if not series.num_rows or not names.num_rows:
        return schema.empty_table()
    block, at = series["block"][0].as_py(), unpacked(series["ids"][0].as_py())
    if pa.types.is_binary(names["local"].type):
        local, ids = (np.concatenate([risen(x, 1)[0] for x in names[c].to_pylist()]) for c in ("local", "id"))
    else:
        local, ids = names["local"].to_numpy(), names["id"].to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    slot = np.full(int(at.max(initial=0)) + 2, -1, np.int64)
    slot[local[order]] = np.arange(len(ids))
    x = slot[at]
    both = (x[:-1] >= 0) & (x[1:] >= 0)
    pairs, back, n = np.unique(x[:-1][both] * len(ids) + x[1:][both], return_inverse=True, return_counts=True)
    del x, slot
    if not len(pairs):
        return schema.empty_table()
    left, right = ids[pairs // len(ids)], ids[pairs % len(ids)]
    bucket = (mix64(mix64(left.view(np.uint64)) ^ right.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nxt = np.full(len(at), -1, "<i4")
    nxt[:-1][both] = place[back]
    del pairs, back, both, place
    left, right, n, bucket = left[order], right[order], n[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    sent = [rising(left[a:b], right[a:b], np.cumsum(n[a:b])) for a, b in zip(first, [*first[1:], len(bucket)], strict=True)]
    columns = [{"block": [block], "ids": [packed(nxt)], "bucket": [None], "first": [None], "pairs": [None]}]
    columns += cut({"block": block, "ids": None, "bucket": bucket[first], "first": first, "pairs": sent}, len(first))
    out = pa.Table.from_batches([as_batch(c, schema) for c in columns], schema)
    give_back()
    return out


def _counted(rows: pa.Table, least: int) -> pa.Table:
    """Of a bucket the frequent pairs (id, left, right, f), and by block the numbers and ids of those that it has."""
    schema = arrow_schema(_COUNTED)
    entered()
    bucket, parts = rows["bucket"][0].as_py(), [risen(x, 3) for x in rows["pairs"].to_pylist()]
    ends = np.cumsum([x.shape[1] for x in parts])
    left, right = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    n = np.concatenate([np.diff(x[2], prepend=0) for x in parts])
    del parts
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.ones(len(order), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    start = np.flatnonzero(new)
    f = np.add.reduceat(n[order], start)
    often = f >= least
    id_ = np.where(often, bucket << 32 | np.cumsum(often), -1)
    own = np.empty(len(order), np.int64)
    own[order] = id_[np.cumsum(new) - 1]
    at = start[often]
    none: dict = dict.fromkeys(schema.names)
    columns = list(cut(none | {"id": id_[often], "left": left[at], "right": right[at], "f": f[often]}, len(at)))
    del order, left, right, new, n
    found: list[tuple] = []
    for block, first, a, b in zip(rows["block"].to_pylist(), rows["first"].to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
        here = np.flatnonzero(own[a:b] >= 0)
        if len(here):
            found.append((block, rising(first + here), rising(own[a:b][here])))
    for i in range(0, len(found), BATCH):
        block, local, names = (list(x) for x in zip(*found[i : i + BATCH], strict=True))
        columns.append({c: [None] * len(block) for c in schema.names} | {"block": block, "local": local, "names": names})
    out = pa.Table.from_batches([as_batch(c, schema) for c in columns], schema)
    give_back()
    return out


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[list[DataFrame], DataFrame]:
    """For each number of words up to longest a stored table of the frequent phrases (id, lang, phrase, last, left, right, f, heads, tails), and all words' number by lang.

    heads has the frequencies of a phrase's first 1, 2, ... words, tails of its last ones; both end with its own.
    All blocks' pairs of a bucket are counted together, and what is frequent goes back to its blocks without another join. There are as many buckets as the corpus needs for each to stay small.
    """
    kept, none = Tables("phrase"), F.lit(None).cast("long")
    level = kept.put(in_blocks(docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text), _numbered, _LEVEL_1, 1), "pairs-1")
    own = level.filter("local is not null")
    sizes = kept.put(own.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    found = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    found = kept.put(found.withColumn("id", F.monotonically_increasing_id()), "counts-1")
    word = F.col("word").cast("string")
    out = [kept.put(found.select("id", "lang", word.alias("phrase"), word.alias("last"), none.alias("left"), none.alias("right"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")), "level-1")]
    names = known(own, found.select("lang", "word", "id"), ["lang", "word"]).select("block", "local", "id")
    buckets = 1 + (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS

    def pairs(series: pa.Table, names: pa.Table) -> pa.Table:
        return _pairs(series, names, buckets)

    def counted(rows: pa.Table) -> pa.Table:
        return _counted(rows, least)

    for k in range(2, longest + 1):
        series = level.filter("ids is not null").select(F.col("block").alias("block"), "ids")  # else both sides have one lineage's columns
        level = kept.put(series.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(pairs, _LEVEL_K), f"pairs-{k}")
        kept.drop(f"pairs-{k - 1}", f"counts-{k - 1}")
        rows = level.filter("bucket is not null").select("block", "bucket", "first", "pairs").groupBy("bucket").applyInArrow(counted, _COUNTED)
        rows = kept.put(rows, f"counts-{k}")
        names = rows.filter("block is not null").select("block", "local", F.col("names").alias("id"))
        left = out[-1].select("lang", F.col("id").alias("left"), F.col("phrase").alias("start"), "heads")
        right = out[-1].select(F.col("id").alias("right"), "last", "tails")
        named = rows.filter("id is not null").select("id", "left", "right", "f").join(left, "left").join(right, "right")
        named = named.select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "left", "right", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"))
        out.append(kept.put(named, f"level-{k}"))
    kept.drop(f"pairs-{longest}", f"counts-{longest}")
    return out, sizes


def scored(levels: list[DataFrame], subsumes: int = SUBSUMES) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more that no longer one subsumes."""
    out = None
    for k in range(2, len(levels) + 1):
        this = levels[k - 1].withColumnRenamed("f", "a")
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("longer"))
            this = this.join(longer, "id", "left").filter(F.coalesce(F.col("longer"), F.lit(0)).cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * subsumes)
        cuts = []
        for j in range(1, k):
            l, r = F.element_at("heads", j), F.element_at("tails", k - j)  # noqa: E741
            score = F.expr(f"cast(cast(a as decimal(20,0)) * 2000000 as decimal(38,0)) div cast(cast(heads[{j - 1}] as decimal(20,0)) + cast(tails[{k - j - 1}] as decimal(20,0)) as decimal(38,0))")
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("cut"), l.alias("l"), r.alias("r")))
        least = F.array_min(F.array(*cuts))
        rows = this.select("lang", "phrase", "a", least.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    levels, sizes = frequent(docs, least)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(levels).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op12."""
    arrow_settings(spark)
    return collocations(table(spark, sf_dir, "documents"))


#: Phrases as joined strings; every cut and every longer phrase looked up by its words.
SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, row_number() OVER () AS piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS p FROM split WHERE len(w) > 0
), sizes AS (
  SELECT lang, count(*) AS n FROM placed GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[p : p + k - 1], ' ') AS g FROM placed CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE p + k - 1 <= len(w)
), f AS (
  SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 30
), candidates AS (
  SELECT lang, k, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k >= 2
), halves AS (
  SELECT lang, k, g, a, j, array_to_string(w[1 : j], ' ') AS x, array_to_string(w[j + 1 : k], ' ') AS y FROM candidates CROSS JOIN (SELECT unnest([1, 2, 3]) AS j) WHERE j < k
), cuts AS (
  SELECT h.lang, h.k, h.g, h.a, h.j, x.f AS l, y.f AS r, (2000000::HUGEINT * h.a) // (x.f + y.f) AS score FROM halves h JOIN f x ON x.lang = h.lang AND x.g = h.x JOIN f y ON y.lang = h.lang AND y.g = h.y
), least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM cuts
), parts AS (
  SELECT lang, a, array_to_string(w[s : s + m - 1], ' ') AS part FROM candidates CROSS JOIN (SELECT unnest([1, 2, 3]) AS s) CROSS JOIN (SELECT unnest([2, 3]) AS m) WHERE m < k AND s + m - 1 <= k
), inside AS (
  SELECT DISTINCT c.lang, c.g FROM candidates c JOIN parts x ON x.lang = c.lang AND x.part = c.g WHERE 100 * x.a >= 80 * c.a
), ranked AS (
  SELECT lang, g AS phrase, a, l, r, score FROM least ANTI JOIN inside USING (lang, g) WHERE o = 1
), top AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM top JOIN sizes USING (lang) WHERE rank <= 2000
"""
