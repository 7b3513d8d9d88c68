"""Overrides, enrichment, prioritised lookups, classification and audit reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import isbn
from quillspark.functions.text import collapsed, key, parse_year, present, split_authors
from quillspark.operators import dedupe, report
from quillspark.sources.checkpoints import checkpointed

STATUSES = ("valid", "missing_unknown_year", "missing_pre_1970", "missing_1970_or_later")


def overridden(df: DataFrame, rules: DataFrame, field: str) -> DataFrame:
    """df with field replaced by the rule's value; a rule for an unknown id, or without high confidence, is an error.

    rules: id, confidence, value. Overrides replace given values too and are marked even where nothing changes.
    """
    checked = rules.join(df.select("id", F.lit(True).alias("_known")), "id", "left")
    checked = checked.withColumn("_ok", F.when((F.col("confidence") != "high") | F.col("_known").isNull(), F.raise_error("an override of low confidence or for an unknown id").cast("boolean")).otherwise(True)).filter("_ok")
    out = df.join(checked.select("id", "value"), "id", "left")
    return out.withColumn("changed", F.coalesce(F.col("value") != F.col(field), F.lit(False))).withColumn("source", F.when(F.col("value").isNotNull(), "override")).withColumn(field, F.coalesce("value", field)).drop("value")


def corrections(df: DataFrame, rules: DataFrame, field: str) -> DataFrame:
    """id, before and after of each value that overrides changed."""
    return overridden(df.withColumn("before", F.col(field)), rules, field).filter("changed").select("id", "before", F.col(field).alias("after"))


def enriched(df: DataFrame, cache: DataFrame, fields: list[str]) -> DataFrame:
    """df with empty fields filled from the cache's row for the same valid number, and where each came from."""
    side = cache.dropDuplicates(["isbn"]).select(F.col("isbn").alias("_isbn"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = df.join(side, isbn.valid(isbn.rescued(F.col("isbn"))) & (isbn.rescued(F.col("isbn")) == F.col("_isbn")), "left")
    for f in fields:
        fill = ~present(F.col(f)) & present(F.col(f"_{f}"))
        out = out.withColumn(f"{f}_from", F.when(fill, "cache")).withColumn(f, F.when(fill, F.col(f"_{f}")).otherwise(F.col(f)))
    return out.drop("_isbn", *[f"_{f}" for f in fields])


def from_entry() -> dict[str, Column]:
    """What a cache's entry (title, subtitle, authors, publishers, publish_date) offers for a record's fields."""
    whole = F.concat_ws(": ", *[F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("")) for c in ("title", "subtitle")])
    date = F.trim(F.coalesce(F.col("publish_date"), F.lit("")))
    return {
        "title": F.when(present(F.trim("title")), whole).otherwise(""), "author": F.array_join(F.filter(F.transform("authors", collapsed), lambda x: x != ""), " | "),
        "publisher": F.coalesce(F.trim(F.get("publishers", F.lit(0))), F.lit("")), "publication_date": date, "publication_year": F.coalesce(parse_year(date).cast("string"), F.lit("")),
    }


def _nowhere(df: DataFrame) -> Column:
    """A key that no table has, another one for rows that differ."""
    return F.concat(F.lit("\0"), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).cast("string"))


def cascade(df: DataFrame, levels: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """df with the first lookup that hits: (provider, table, key of df, key of the table); tables have a url. A hit without a url wins too. Of rows with one key in a table one counts.

    Lookups by the same column of df are one table, reduced to the first level of each key, so there are as many joins as columns. Rows without a key get one that no table has, which spreads them.
    """
    hits, spread = [], _nowhere(df)
    for i, own in enumerate(dict.fromkeys(x[2] for x in levels)):
        sides = [side.select(F.col(other).cast("string").alias(f"_k{i}"), F.struct(F.lit(place).alias("place"), F.lit(provider).alias("provider"), F.col("url").alias("url")).alias("hit")) for place, (provider, side, by, other) in enumerate(levels) if by == own]
        first = reduce(DataFrame.unionByName, sides).filter(present(F.col(f"_k{i}"))).groupBy(f"_k{i}").agg(F.min("hit").alias(f"_h{i}"))
        df = df.withColumn(f"_o{i}", F.when(present(F.col(own).cast("string")), F.col(own).cast("string")).otherwise(spread)).join(first.hint("merge"), F.col(f"_o{i}") == F.col(f"_k{i}"), "left").drop(f"_o{i}", f"_k{i}")
        hits.append(f"_h{i}")
    least = F.least(*hits) if len(hits) > 1 else F.col(hits[0])
    return df.withColumn("cover", F.when(least.isNotNull(), F.struct(least["provider"].alias("provider"), least["url"].alias("url")))).drop(*hits)


def _put(provenance: Column, new: Column) -> Column:
    """A map with another's entries in place of its own."""
    return F.map_zip_with(provenance, new, lambda _, old, now: F.coalesce(now, old))


def _map(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.col(c), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")) if c in df.columns else F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")


def applied(df: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """df with the fields that rules change, data_provenance (a map of where fields come from) and curation: confidence, reason, sources, changed_fields and verified_fields; and before, the fields' values until then.

    rules: id, confidence, reason, sources (a list), changes (a map from fields to values). A rule overwrites given values and marks all of its fields, while changed_fields has those only that it
    really changes. A rule for an unknown id, of other than high confidence or for an unknown field is an error.
    """
    known = rules.join(df.select("id", F.lit(True).alias("_known")), "id", "left")
    strange = F.size(F.array_except(F.map_keys("changes"), F.array(*map(F.lit, fields)))) > 0
    wrong = F.when(F.col("_known").isNull(), "an override for an unknown id").when(F.coalesce(F.col("confidence"), F.lit("")) != "high", "an override of low confidence").when(strange, "an override of an unknown field")
    checked = known.withColumn("_ok", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).filter("_ok")
    rule = checked.select("id", F.struct("confidence", "reason", "sources", "changes").alias("_rule"))
    out = df.withColumn("data_provenance", _map(df, "data_provenance")).join(rule, "id", "left")
    now = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]))
    changes, label = F.col("_rule.changes"), F.array_join("_rule.sources", ",")
    ruled = F.col("_rule").isNotNull()
    out = out.withColumn("before", F.when(ruled, F.map_filter(now, lambda k, _: F.map_contains_key(changes, k))))
    changed = F.filter(F.map_keys(changes), lambda k: F.element_at(F.col("before"), k) != F.element_at(changes, k))
    curation = F.struct(F.col("_rule.confidence").alias("confidence"), F.col("_rule.reason").alias("reason"), F.col("_rule.sources").alias("sources"), changed.alias("changed_fields"), F.map_keys(changes).alias("verified_fields"))
    out = out.withColumn("curation", F.when(ruled, curation)).withColumn("data_provenance", F.when(ruled, _put(F.col("data_provenance"), F.transform_values(changes, lambda k, v: label))).otherwise(F.col("data_provenance")))
    return out.withColumns({f: F.when(ruled & F.map_contains_key(changes, F.lit(f)), F.element_at(changes, f)).otherwise(F.col(f)) for f in fields}).drop("_rule")


def filled_from(df: DataFrame, entries: DataFrame, label: str = "openlibrary_exact") -> DataFrame:
    """df with empty fields filled from the entry of the same number, which data_provenance gets the label for; matched tells whether there is one.

    entries: isbn and what from_entry() reads. Where the year is empty, the entry's date gives it.
    """
    offered = entries.select(F.col("isbn").alias("_isbn"), *[c.alias(f"_{f}") for f, c in from_entry().items()]).dropDuplicates(["_isbn"])
    number = isbn.rescued(F.col("isbn"))
    own = F.when(isbn.valid(number), number).otherwise(_nowhere(df))  # rows without a number are spread
    out = df.withColumn("data_provenance", _map(df, "data_provenance")).withColumn("_own", own).join(offered.hint("merge"), F.col("_own") == F.col("_isbn"), "left")
    fill = {f: ~present(F.col(f)) & present(F.col(f"_{f}")) for f in from_entry()}
    filled = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in fill.items()]))
    new = F.map_from_arrays(filled, F.transform(filled, lambda _: F.lit(label)))
    out = out.withColumns({"data_provenance": _put(F.col("data_provenance"), new), "matched": F.col("_isbn").isNotNull()})
    return out.withColumns({f: F.when(c, F.col(f"_{f}")).otherwise(F.col(f)) for f, c in fill.items()}).drop("_own", "_isbn", *[f"_{f}" for f in fill])


def absent(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that the cache doesn't have yet: what an incremental load asks for."""
    return df.filter(present(F.col(key))).select(key).distinct().join(cache.select(key), key, "left_anti")


def status() -> Column:
    """valid, invalid, or why a number is missing."""
    y = parse_year(F.col("publication_year"))
    return (
        F.when(isbn.valid(F.col("isbn")), "valid").when(isbn.clean(F.col("isbn")) != "", "invalid").when(y.isNull(), "missing_unknown_year").when(y < 1970, "missing_pre_1970").otherwise("missing_1970_or_later")
    )


#: The quality flags, in their order. Those of SHARED depend on other rows.
FLAGS = (
    "invalid_isbn", "missing_isbn_unknown_year", "missing_isbn_1970_or_later", "missing_title", "missing_author", "missing_publisher", "missing_or_invalid_year",
    "shared_isbn_possible_multiple_copy", "same_title_author_related_editions",
)
SHARED = FLAGS[-2:]


def _cleaned(df: DataFrame) -> DataFrame:
    """df with its status; valid numbers are cleaned."""
    s = df.withColumn("isbn_status", status())
    return s.withColumn("isbn", F.when(F.col("isbn_status") == "valid", isbn.clean(F.col("isbn"))).otherwise(F.col("isbn")))


def _flags(more: dict[str, Column]) -> Column:
    """A row's flags: those that it has by itself, and more by their conditions."""
    is_ = lambda name: F.col("isbn_status") == name
    own = {
        "invalid_isbn": is_("invalid"), "missing_isbn_unknown_year": is_("missing_unknown_year"), "missing_isbn_1970_or_later": is_("missing_1970_or_later"), "missing_title": ~present(F.col("title")),
        "missing_author": ~present(F.col("author")), "missing_publisher": ~present(F.col("publisher")), "missing_or_invalid_year": parse_year(F.col("publication_year")).isNull(),
    }
    when = own | more
    return F.array_compact(F.array(*[F.when(when[x], F.lit(x)) for x in FLAGS if x in when]))


def flagged_alone(df: DataFrame) -> DataFrame:
    """df as flagged() gives it, without the flags of SHARED: no row is compared with others and nothing is kept, so this is one pass."""
    s = _cleaned(df).withColumn("quality_flags", _flags({}))
    return s.select(*df.columns, "isbn_status", "quality_flags")


def flagged(df: DataFrame) -> DataFrame:
    """df with its status and quality flags, in a fixed order; valid numbers are cleaned. author_normalized stands for author where it is given.

    Copies of a number and rows of one title and author are counted before they are joined back, so a common one isn't gathered.
    """
    author = F.when(present(F.col("author_normalized")), F.col("author_normalized")).otherwise(F.col("author")) if "author_normalized" in df.columns else F.col("author")
    s = checkpointed(_cleaned(df).withColumns({"_title": key("title"), "_author": key(author)}))  # read three times
    shared = s.filter("isbn_status = 'valid'").groupBy("isbn").agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    related = s.filter("_title <> '' and _author <> ''").groupBy("_title", "_author").agg(F.count(F.lit(1)).alias("_related")).filter("_related > 1")
    s = s.join(shared, "isbn", "left").join(related, ["_title", "_author"], "left")
    more = dict(zip(SHARED, ((F.col("isbn_status") == "valid") & (F.col("_copies") > 1), F.col("_related") > 1), strict=True))
    return s.withColumn("quality_flags", _flags(more)).select(*df.columns, "isbn_status", "quality_flags")


def shortened(df: DataFrame) -> DataFrame:
    """Flagged rows with the six flags that flag_counts' given SQL knows: all missing numbers are one flag, and titles have none."""
    flags = F.transform(F.filter("quality_flags", lambda x: ~x.startswith("missing_isbn") & ~x.isin("missing_title", "same_title_author_related_editions")), lambda x: F.when(x == "missing_or_invalid_year", "missing_year").otherwise(x))
    return df.withColumn("quality_flags", F.when(F.col("isbn_status").startswith("missing"), F.array_append(flags, F.lit("missing_isbn"))).otherwise(flags))


def flag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def by_status(df: DataFrame) -> DataFrame:
    """Rows of each of the reported statuses, zero too; `invalid` isn't among them."""
    labels = df.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "place int, isbn_status string")
    counts = df.groupBy("isbn_status").agg(F.count(F.lit(1)).alias("n"))
    return labels.join(counts, "isbn_status", "left").select("place", "isbn_status", F.coalesce("n", F.lit(0)).alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row of audit figures; rates are null for an empty table."""
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("isbn_status") == "valid").alias("valid"), F.bround(F.count_if(F.col("isbn_status") == "valid") / n, 4).alias("valid_rate"), F.countDistinct(F.when(F.col("isbn_status") == "valid", isbn.clean(F.col("isbn")))).alias("distinct_isbns"))


def link_status() -> Column:
    """ok, warning or failed, of status (null: no answer), required and warning_statuses."""
    s = F.col("status")
    return F.when(F.array_contains("warning_statuses", s), "warning").when(s.between(200, 399), "ok").when(~F.col("required"), "warning").otherwise("failed")


def distinct_authors(df: DataFrame) -> DataFrame:
    """Names of each row without later repeats of the same key, in order, packed with bars again."""
    names = df.select("idx", F.posexplode(split_authors(F.col("author"))).alias("place", "name")).withColumn("k", key("name"))
    first = names.withColumn("r", F.row_number().over(W.partitionBy("idx", "k").orderBy("place"))).filter("r = 1")
    return first.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), " | ").alias("authors"))


def themed(title: Column, themes: list[tuple[str, list[str]]], fallback: str) -> Column:
    """The first theme of which a pattern is found in the title."""
    return F.coalesce(*[F.when(title.rlike("|".join(p)), F.lit(name)) for name, p in themes], F.lit(fallback))


@dataclass
class Curation:
    """All steps of a curation in their order: overrides, enrichment, covers, labels, themes, quality, merging, quality again.

    rules: as applied() takes them, which may change `fields`. entries: as filled_from() takes them. covers: levels as cascade() takes them, whose key columns are the records' isbn or id.
    authors and publishers map variants to labels; themes are (name, patterns of titles) in order.
    """

    rules: DataFrame
    fields: list[str]
    entries: DataFrame
    covers: list[tuple[str, DataFrame, str, str]]
    themes: list[tuple[str, list[str]]]
    fallback: str = "other"
    authors: dict[str, str] | None = None
    publishers: dict[str, str] | None = None

    def described(self, raw: DataFrame) -> DataFrame:
        """raw with all that curation adds to a row by itself; before tells the values that overrides have replaced."""
        rows = cascade(filled_from(applied(raw, self.rules, self.fields), self.entries), self.covers)
        rows = dedupe.normalized(rows, self.authors, self.publishers).withColumn("theme", themed(F.lower(F.coalesce("title", F.lit(""))), self.themes, self.fallback))
        return flagged(rows.withColumn("data_provenance", F.when(F.size("data_provenance") > 0, F.col("data_provenance"))))

    def records(self, described: DataFrame) -> DataFrame:
        """The canonical records of described rows, classified anew, with source_record_ids, source_record_count and reason."""
        return flagged(dedupe.filled(described.drop("isbn_status", "quality_flags", "before")))

    def report(self, raw: DataFrame, described: DataFrame, records: DataFrame) -> DataFrame:
        """The quality report as rows (metric, value)."""
        cover = F.struct(F.col("cover.provider").alias("provider"), F.lit(None).cast("string").alias("match_method"), F.col("cover.url").alias("medium"))
        told = records.withColumns({"cover": cover, "provenance": _map(records, "data_provenance")})
        groups = records.filter(F.size("source_record_ids") > 1).select("reason", "source_record_ids")
        return report.quality(raw, told, groups, described.filter("curation is not null").select("id", F.size("curation.changed_fields").alias("changed")))

    def run(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The curated records and the report; what several steps read is kept between them."""
        described = checkpointed(self.described(raw))
        records = checkpointed(self.records(described))
        return records, self.report(raw, described, records)
