"""Page search: weighted ranking by substrings and by approximate occurrences (ours), hits by page, snippets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Documents that hold the query: 20 for the title, 20 for the section, 10 for the text; queries of one letter find nothing."""
    q = query.strip().lower()
    if len(q) < 2:
        return df.withColumn("score", F.lit(0)).limit(0)
    has = lambda c, w: F.when(F.contains(F.lower(c), F.lit(q)), w).otherwise(0)
    return df.withColumn("score", has("title", 20) + has("section", 20) + has("text", 10)).filter("score > 0").orderBy(F.desc("score"), "href").limit(limit)


def collapsed(hits: DataFrame, shown: int = 3) -> DataFrame:
    """Hits by page, the page's own first, then its sections by score; those past shown are marked hidden. Hits with one address and score follow a page_id if there is one."""
    base = F.substring_index("href", "#", 1)
    w = W.partitionBy("page").orderBy(F.col("href") != F.col("page"), F.desc("score"), "href", *[c for c in hits.columns if c == "page_id"])
    return hits.withColumn("page", base).withColumn("place", F.row_number().over(w)).withColumn("hidden", F.col("place") > shown)


def snippet(text: Column, query: str, before: int = 50, after: int = 200) -> Column:
    """The first hit in <mark> with the text around it; null without a hit."""
    q = query.lower()
    at = F.locate(q, F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.concat(F.substring(text, start, at - start), F.lit("<mark>"), F.substring(text, at, F.lit(len(q))), F.lit("</mark>"), F.substring(text, at + len(q), F.lit(after))))


#: Errors that a query may have, by its length: a tenth of its letters. Letters of a posting's term.
ALLOWED, GRAM = 0.1, 3
#: Letters of texts whose postings a task holds at once.
HELD = 1 << 18
#: What a hit in a field is worth.
WEIGHTS = {"title": 20, "section": 20, "text": 10}


def grams(query: str) -> list[str]:
    """The runs of GRAM letters of a query, in order, as postings() has them."""
    q = query.strip().lower()
    return [q[i : i + GRAM] for i in range(len(q) - GRAM + 1)]


def _places(text: str, terms: list[str] | None) -> dict[str, list[int]]:
    """Where each of the terms stands in a text, or each run of GRAM letters."""
    places: dict[str, list[int]] = {}
    if terms is None:
        for i in range(len(text) - GRAM + 1):
            places.setdefault(text[i : i + GRAM], []).append(i)
        return places
    for t in terms:
        i = text.find(t)
        while i >= 0:
            places.setdefault(t, []).append(i)
            i = text.find(t, i + 1)
    return places


def posted(batches: Iterator[pa.RecordBatch], key: str, fields: tuple[str, ...], terms: list[str] | None) -> Iterator[pa.RecordBatch]:
    """The postings of batches of texts, of HELD letters (or of one longer text) at a time."""
    for b in batches:
        keys = b.column(key)
        kinds, out, held = (pa.string(), pa.string(), keys.type, pa.list_(pa.int32())), ([], [], [], []), 0
        made = lambda out, kinds=kinds: pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["term", "field", key, "places"])
        for field in fields:
            for k, t in zip(keys, b.column(field), strict=True):
                text = t.as_py() or ""
                if held and held + len(text) > HELD:
                    yield made(out)
                    out, held = ([], [], [], []), 0
                held += len(text)
                places = _places(text, terms)
                out[0].extend(places)
                out[1].extend([field] * len(places))
                out[2].extend([k.as_py()] * len(places))
                out[3].extend(places.values())
        yield made(out)


def postings(df: DataFrame, key: str = "page_id", fields: tuple[str, ...] = tuple(WEIGHTS), terms: list[str] | None = None) -> DataFrame:
    """term, field, key and places (from 0): where each run of GRAM letters of a field's lower-cased text stands. An index for given terms has those only."""
    schema = f"term string, field string, {key} {df.schema[key].dataType.simpleString()}, places array<int>"
    wanted = None if terms is None else sorted(set(terms))
    return df.select(key, *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in fields]).mapInArrow(lambda batches: posted(batches, key, fields, wanted), schema)


def least_errors(text: str, query: str, most: int) -> int | None:
    """The least number of insertions, deletions and replacements that make the query from a part of the text, if that is at most `most`. A column of the table is two bit vectors."""
    n = len(query)
    masks: dict[str, int] = {}
    for i, c in enumerate(query):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, errors, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        carry = ((eq & plus) + plus ^ plus | eq) & full
        rise, fall = minus | ~(carry | plus) & full, plus & carry
        errors += bool(rise & top) - bool(fall & top)
        best = min(best, errors)
        rise, fall, low = rise << 1 & full, fall << 1 & full, eq | minus
        plus, minus = (fall | ~(low | rise)) & full, rise & low
    return best if best <= most else None


def approximate(df: DataFrame, index: DataFrame, query: str, limit: int = 50, key: str = "page_id", allowed: float = ALLOWED) -> DataFrame:
    """key and score of the documents (key, href, title, section, text) in which the query occurs but for a tenth of its letters, best first; queries of one letter find nothing.

    A field's score is its weight times the share of the query's letters that needn't be changed. An error changes at most GRAM of the query's runs of letters, so a field that has fewer of them
    than are left after all allowed errors can't hold it: only fields for which the index (postings()) has enough are read. A query too short for that reads all.
    """
    q = query.strip().lower()
    fields = list(WEIGHTS)
    if len(q) < 2:
        return df.select(key).withColumn("score", F.lit(0.0)).limit(0)
    most = int(allowed * len(q))
    terms = grams(q)
    needed = len(terms) - GRAM * most
    texts = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("body")) for f in fields])).alias("f")).select(key, "f.field", "f.body")
    if needed > 0:
        times = F.create_map(*[F.lit(x) for t in sorted(set(terms)) for x in (t, terms.count(t))])
        hits = index.filter(F.col("term").isin(sorted(set(terms)))).groupBy(key, "field").agg(F.sum(times[F.col("term")]).alias("n")).filter(F.col("n") >= needed)
        texts = texts.join(hits.select(key, "field"), [key, "field"], "left_semi")
    if most == 0:
        found = texts.filter(F.contains("body", F.lit(q))).select(key, "field", F.lit(0).alias("errors"))
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                errors = pa.array([least_errors(t.as_py(), q, most) for t in b.column("body")], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(key), b.column("field"), errors], [key, "field", "errors"])

        found = texts.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, field string, errors int").filter("errors is not null")
    weight = F.create_map(*[F.lit(x) for f in fields for x in (f, float(WEIGHTS[f]))])
    scores = found.groupBy(key).agg(F.sum(weight[F.col("field")] * (1 - F.col("errors") / F.lit(float(len(q))))).alias("score"))
    return df.select(key, "href").join(scores, key).orderBy(F.desc("score"), "href", key).limit(limit).select(key, "href", "score")
