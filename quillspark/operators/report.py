"""The quality report, and the figures and checks that it is made of; every figure is a row (metric, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.functions.text import present
from quillspark.sources.checkpoints import checkpointed

FIELDS = ("author", "title", "isbn", "publisher", "publication_date", "publication_year", "genre", "series")
#: Flags that ask for a look at the record.
REVIEW = ("invalid_isbn", "missing_isbn_1970_or_later", "missing_isbn_unknown_year", "missing_title", "missing_author", "missing_or_invalid_year")


def rate(a: Column, b: Column) -> Column:
    """a of b with four decimals, halves to even; null where b is 0."""
    return F.bround(a / F.nullif(b, F.lit(0)), 4)


def figures(df: DataFrame, **columns: Column) -> DataFrame:
    """One pass over df for all figures, as rows."""
    row = df.agg(*[c.cast("double").alias(f"_{i}") for i, c in enumerate(columns.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"_{i}").alias("value")) for i, name in enumerate(columns)])))


def counts(df: DataFrame, prefix: str, by: Column) -> DataFrame:
    """Rows by a value, as figures named prefix.value; nulls don't count."""
    g = df.select(by.alias("_v")).filter("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return g.select(F.concat(F.lit(prefix + "."), F.col("_v")).alias("metric"), "value")


def map_counts(df: DataFrame, column: str, value: str) -> DataFrame:
    """How many rows' maps give a value, by the map's keys."""
    return df.select(F.explode(column).alias("field", "_v")).filter(F.col("_v") == value).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    """One row: how many names, by their keys, a column of packed names holds."""
    labels = df.select(F.explode(text.split_authors(F.col(column))).alias("name")).distinct()
    return labels.select(text.key("name").alias("k")).filter("k <> ''").agg(F.countDistinct("k").alias("names"))


def review_cases(df: DataFrame) -> DataFrame:
    """Flagged records with a flag that asks for a look."""
    return df.filter(F.arrays_overlap("quality_flags", F.array(*map(F.lit, REVIEW)))).select("id", "author", "title", "publication_year", "isbn_status", "quality_flags")


def kept_apart(df: DataFrame) -> DataFrame:
    """Titles, by their keys, of records with two or more valid numbers: the first title, the ids and the numbers."""
    keyed = df.withColumn("_k", text.key("title")).filter("_k <> ''")
    valid = F.when(F.col("isbn_status") == "valid", F.col("isbn"))
    several = keyed.groupBy("_k").agg(F.array_sort(F.collect_set(valid)).alias("isbns"), F.min_by("title", "idx").alias("title")).filter(F.size("isbns") > 1)
    ids = keyed.join(several.select("_k"), "_k", "left_semi").groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("record_ids"))
    return several.join(ids, "_k").select("title", "record_ids", "isbns")


def normalization(df: DataFrame) -> DataFrame:
    """How many records' author and publisher the aliases changed, and how many repeated names went."""
    changed = lambda c: F.count_if(present(F.col(f"{c}_normalized")) & (F.col(f"{c}_normalized") != F.col(c)))
    names = lambda c: F.size(text.split_authors(F.col(c)))
    return figures(df, author_record_change_count=changed("author"), publisher_record_change_count=changed("publisher"), duplicate_author_name_count_removed=F.sum(names("author") - names("author_normalized")))


def quality(raw: DataFrame, records: DataFrame, groups: DataFrame, applied: DataFrame) -> DataFrame:
    """The whole report: raw and curated records, groups of duplicates (reason, source_record_ids), applied overrides (id, changed: the number of fields).

    Records have the columns that curation adds: isbn_status, quality_flags, the normalised labels, theme, cover (provider, match_method, medium), matched, provenance (a map) and source_record_count.
    """
    raw, records, groups = (checkpointed(x) for x in (raw, records, groups))  # each is read several times
    n, valid = F.count(F.lit(1)), F.col("isbn_status") == "valid"
    covered = present(F.col("cover.medium"))
    isbns, matched = F.countDistinct(F.when(valid, F.col("isbn"))), F.countDistinct(F.when(valid & F.col("matched"), F.col("isbn")))
    missing = lambda df: {f"missing_fields.{c}": F.count_if(~present(F.col(c))) for c in FIELDS if c in df.columns}
    source = F.sum(F.coalesce("source_record_count", F.lit(1)))
    parts = [
        figures(
            records, record_count=n, source_record_count=source, duplicate_records_collapsed_count=source - n, openlibrary_exact_match_count=F.count_if("matched"), openlibrary_exact_match_rate=rate(F.count_if("matched"), n),
            unique_valid_isbn_count=isbns, openlibrary_unique_isbn_match_count=matched, openlibrary_unique_isbn_match_rate=rate(matched, isbns), cover_record_count=F.count_if(covered), cover_record_rate=rate(F.count_if(covered), n),
            normalized_publisher_count=F.countDistinct(F.when(present(F.col("publisher_normalized")), F.col("publisher_normalized"))), remaining_review_count=F.count_if(F.arrays_overlap("quality_flags", F.array(*map(F.lit, REVIEW)))), **missing(records),
        ),
        figures(raw, raw_record_count=n, raw_publisher_label_count=F.countDistinct(F.nullif(F.trim("publisher"), F.lit(""))), **{f"raw_{k}": v for k, v in missing(raw).items()}),
        figures(groups, duplicate_group_count=n, duplicate_source_record_count=F.coalesce(F.sum(F.size("source_record_ids")), F.lit(0))),
        figures(applied, manual_override_count=n, manual_field_change_count=F.coalesce(F.sum("changed"), F.lit(0))),
        distinct_names(raw, "author").select(F.lit("raw_author_label_count").alias("metric"), F.col("names").cast("double").alias("value")),
        distinct_names(records, "author_normalized").select(F.lit("normalized_author_count").alias("metric"), F.col("names").cast("double").alias("value")),
        kept_apart(records).agg(n.cast("double").alias("value")).select(F.lit("preserved_distinct_isbn_group_count").alias("metric"), "value"),
        normalization(records),
        counts(records, "isbn_status", F.col("isbn_status")), counts(records.select(F.explode("quality_flags").alias("flag")), "quality_flags", F.col("flag")), counts(records, "theme_counts", F.col("theme")),
        counts(records.filter(covered), "cover_providers", F.col("cover.provider")), counts(records.filter(covered), "cover_match_methods", F.col("cover.match_method")), counts(groups, "duplicate_reason_counts", F.col("reason")),
        counts(records.select(F.explode("provenance").alias("field", "source")).filter("source = 'openlibrary_exact'"), "openlibrary_filled_fields", F.col("field")),
    ]
    return reduce(DataFrame.unionByName, parts)


def collection(df: DataFrame, covered: Column) -> DataFrame:
    """One row of the collection's figures: all nine; the cover rate in per cent with one decimal, halves up."""
    y = text.numeric_year(F.col("publication_year"))
    n = F.count(F.lit(1))
    review = F.col("isbn_status").isin("missing_1970_or_later", "missing_unknown_year", "invalid")
    return df.agg(
        n.alias("total"), F.sum(F.coalesce("source_record_count", F.lit(1))).cast("long").alias("source_total"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.floor(F.percentile(y, 0.5) + 0.5).cast("int").alias("median_year"),
        F.countDistinct(F.when(present(F.col("publisher")), F.col("publisher"))).alias("publishers"), F.count_if(~present(F.col("isbn"))).alias("missing_isbn"), F.count_if(F.col("isbn_status") == "missing_pre_1970").alias("missing_pre_1970"),
        F.count_if(review).alias("review_isbn"), F.count_if(covered).alias("covers"), (F.floor(1000 * F.count_if(covered) / F.nullif(n, F.lit(0)) + 0.5) / 10).alias("cover_rate"),
    )


def link_counts(df: DataFrame) -> DataFrame:
    """One row: links by result, zeros too."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("result") == r).alias(r) for r in ("ok", "warning", "failed")])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks, rows of b that a lacks (repeats count), and whether there are none."""
    count = lambda x, y, name: x.exceptAll(y).agg(F.count(F.lit(1)).alias(name))
    return count(a, b, "only_a").crossJoin(count(b, a, "only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))  # one row each
