"""Stable ids between two snapshots: equal rows first, then equal numbers, then equal normalised rows; the others get new ids.

Both snapshots are described once, by two digests, a number and the fields' keys. Each pass takes what the one before it
left, is stored as one table of pairs and rows without a partner, and so is never computed again.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import isbn, text
from quillspark.operators.groups import solved
from quillspark.sources.checkpoints import checkpointed

FIELDS = ("author", "title", "isbn", "publisher", "publication_date", "genre", "publication_year", "series")
#: Rows of one range of idx, which are numbered together.
SPAN = 65536


def _whole(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """df with all fields; absent columns are empty."""
    return df.withColumns({c: F.col(c) if c in df.columns else F.lit("") for c in fields})


def signature(loose: bool = False, fields: tuple[str, ...] = FIELDS) -> Column:
    """A digest of all fields, as they are or by their keys."""
    f = text.key if loose else (lambda c: F.coalesce(F.col(c), F.lit("")))
    return F.sha2(F.to_json(F.array(*[f(c) for c in fields])), 256)


def described(df: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """idx, exact and loose signature, cleaned number and the fields' keys of each row."""
    whole = _whole(df, fields).withColumn("keys", F.array(*[text.key(c) for c in fields]))
    return whole.select("idx", signature(fields=fields).alias("exact"), F.sha2(F.to_json("keys"), 256).alias("loose"), isbn.clean(F.col("isbn")).alias("number"), "keys")


def _placed(rows: DataFrame, sign: str) -> DataFrame:
    """rows with their place among those of one signature, in the order of idx. Rows are numbered by ranges of idx, so a signature that many rows share is spread over tasks."""
    span = F.floor(F.col("idx") / SPAN)
    own = W.partitionBy(sign, "span")
    ranked = rows.withColumn("span", span).withColumn("in_span", F.row_number().over(own.orderBy("idx")))
    sizes = ranked.groupBy(sign, "span").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select(sign, "span", (F.sum("m").over(W.partitionBy(sign).orderBy("span")) - F.col("m")).alias("before"))
    return ranked.join(before, [sign, "span"]).withColumn("place", F.col("in_span") + F.col("before")).drop("span", "in_span", "before")


def _matched(new: DataFrame, old: DataFrame, sign: str) -> DataFrame:
    """The first new row of a signature with the first old one and so on, and the rows of both sides that are left: structs new and old, either of which may be null."""
    a, b = (_placed(rows, sign).select(F.col(sign).alias("sign"), "place", F.struct(*rows.columns).alias(side)) for rows, side in ((new, "new"), (old, "old")))
    return a.join(b, ["sign", "place"], "full").select("new", "old")


def paired(new: DataFrame, old: DataFrame, sign: Column, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """idx and old_idx of rows with one signature, first with first."""
    a, b = (_whole(x, fields).select("idx", sign.alias("sign")) for x in (new, old))
    return _matched(a, b, "sign").filter("new is not null and old is not null").select(F.col("new.idx").alias("idx"), F.col("old.idx").alias("old_idx"))


def _chosen(new: list[dict], old: list[dict]) -> list[tuple]:
    """For the new and the old rows of one number, both in order: each new one with the free old row that agrees in most fields, then is the most complete, then is the first.

    Old rows with the same keys are one class, of which only the first free one can be chosen.
    """
    free: dict[tuple, deque] = defaultdict(deque)
    for row in old:
        free[tuple(row["keys"])].append(row["idx"])
    complete = {k: sum(map(bool, k)) for k in free}
    agreement: dict[tuple, dict[tuple, int]] = {}
    out = []
    for row in new:
        if not free:
            break
        own = tuple(row["keys"])
        if own not in agreement:
            agreement[own] = {k: sum(bool(a) and a == b for a, b in zip(own, k, strict=True)) for k in complete}
        best = max(free, key=lambda k, by=agreement[own]: (by[k], complete[k], -free[k][0]))
        out.append((row["idx"], free[best].popleft()))
        if not free[best]:
            del free[best]
    return out


def by_number(new: DataFrame, old: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """idx and old_idx of rows with one number."""
    return _numbered(described(new, fields), described(old, fields)).filter("idx is not null and old_idx is not null").select("idx", "old_idx")


def _numbered(new: DataFrame, old: DataFrame) -> DataFrame:
    """idx, loose, old_idx and old_loose of described rows that one number pairs, and of rows of either side that are left, with nulls for the other."""

    def solve(rows: list[dict]) -> list[tuple]:
        sides = [r for r in rows if r["fresh"]], [r for r in rows if not r["fresh"]]
        a, b = ({r["idx"]: r["loose"] for r in side} for side in sides)
        out = [(i, a.pop(i), j, b.pop(j)) for i, j in _chosen(*sides)]
        return out + [(i, v, None, None) for i, v in a.items()] + [(None, None, j, v) for j, v in b.items()]

    a, b = (d.filter("number <> ''").select("number", "idx", "loose", "keys", F.lit(fresh).alias("fresh")) for d, fresh in ((new, True), (old, False)))
    both = solved(a.unionByName(b), "number", "idx", solve, "idx long, loose string, old_idx long, old_loose string")
    none = [F.lit(None).cast("long"), F.lit(None).cast("string")]
    return both.union(new.filter("number = ''").select("idx", "loose", *none)).union(old.filter("number = ''").select(*none, "idx", "loose"))


def reconciled(new: DataFrame, old: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every new row (idx) with the old row whose id it keeps (old_idx), and the pass that found it; null for additions.

    Rows of one number that no earlier pass took are solved together, as each choice depends on those before it.
    """
    exact = checkpointed(_matched(described(new, fields), described(old, fields), "exact"))
    found = exact.filter("new is not null and old is not null").select("new.idx", F.col("old.idx").alias("old_idx"), F.lit("exact").alias("pass"))
    number = checkpointed(_numbered(exact.filter("old is null").select("new.*"), exact.filter("new is null").select("old.*")))
    found = found.unionByName(number.filter("idx is not null and old_idx is not null").select("idx", "old_idx", F.lit("isbn").alias("pass")))
    left = number.filter("old_idx is null").select("idx", "loose"), number.filter("idx is null").select(F.col("old_idx").alias("idx"), F.col("old_loose").alias("loose"))
    loose = _matched(*left, "loose").filter("new is not null")
    return found.unionByName(loose.select("new.idx", F.col("old.idx").alias("old_idx"), F.when(F.col("old").isNotNull(), "normalized").alias("pass")))


def identified(new: DataFrame, old: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """idx, old_idx, pass and id of every new row: the old row's id, or in the order of idx the numbers after the greatest of the old ones. An id given twice is an error."""
    rows = checkpointed(reconciled(new, old, fields))
    kept = rows.join(old.select(F.col("idx").alias("old_idx"), "id"), "old_idx")
    added = rows.filter("old_idx is null").withColumn("span", F.floor(F.col("idx") / SPAN))
    last = old.agg(F.coalesce(F.max(F.regexp_extract("id", "^book-([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("last"))
    sizes = added.groupBy("span").agg(F.count(F.lit(1)).alias("m"))
    before = sizes.select("span", (F.sum("m").over(W.orderBy("span")) - F.col("m")).alias("before")).crossJoin(F.broadcast(last))  # one row a range of idx, and one row in all
    place = F.row_number().over(W.partitionBy("span").orderBy("idx"))
    n = added.withColumn("place", place).join(before, "span").withColumn("n", (F.col("last") + F.col("before") + F.col("place")).cast("string"))
    ids = n.select("idx", "old_idx", "pass", F.concat(F.lit("book-"), F.lpad("n", F.greatest(F.lit(4), F.length("n")), F.lit("0"))).alias("id"))
    out = kept.select("idx", "old_idx", "pass", "id").unionByName(ids)
    times = F.count(F.lit(1)).over(W.partitionBy("id"))
    checked = out.withColumn("_ok", F.when(times > 1, F.raise_error("an id is given twice").cast("boolean")).otherwise(True))
    return checked.filter("_ok").drop("_ok")
