"""Search, facets, sorts, pages, aggregates and order-dependent picks of a catalogue. Every order ends in idx."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.functions.text import decade, fnv1a32, holds, numeric_year, parse_year, present

#: What a record without an author is searched under, as it is shown.
NO_AUTHOR = "Auteur non renseigné"


def year() -> Column:
    return numeric_year(F.col("publication_year"))


def shown_author(between: str = " | ") -> Column:
    """The names as they are shown, or the label of a missing author."""
    return F.when(present(F.col("author")), F.regexp_replace("author", r"\s*\|\s*", between)).otherwise(NO_AUTHOR)


@dataclass(frozen=True)
class CatalogueQuery:
    """A search with optional facets, an order and a number of rows."""

    query: str = ""
    decade: int | None = None
    publisher: str = ""
    sort: str = "catalogue"
    limit: int | None = 24

    def filtered(self, df: DataFrame) -> DataFrame:
        shown = F.when(present(F.col("author")), F.col("author")).otherwise(NO_AUTHOR)
        if self.decade is not None:
            df = df.filter(decade(year()) == self.decade)
        if self.publisher:
            df = df.filter(F.lower(F.trim("publisher")) == self.publisher.strip().lower())
        if self.query.strip():  # the dear condition comes last
            df = df.filter(holds(F.concat_ws(" ", "title", "author", shown, "isbn", "publisher"), self.query))
        return df

    def remaining(self, df: DataFrame) -> DataFrame:
        """One row: how many rows match, and how many of them lie beyond the limit."""
        n = F.count(F.lit(1))
        return self.filtered(df).agg(n.alias("matches"), F.greatest(F.lit(0), n - F.lit(self.limit or 0)).alias("remaining"))

    def run(self, df: DataFrame) -> DataFrame:
        orders = {"catalogue": [], "title": [text.fold("title")], "author": [text.fold("author")], "newest": [year().desc_nulls_last()], "oldest": [year().asc_nulls_last()]}
        out = self.filtered(df).orderBy(*orders[self.sort], "idx")
        return out if self.limit is None else out.limit(self.limit)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Rows of one page, counted from 1, in catalogue order."""
    return df.orderBy("idx").offset((number - 1) * size).limit(size)


def shuffled(df: DataFrame, seed: str, k: int) -> DataFrame:
    """The first k rows in an order that only the seed and the ids decide."""
    return df.withColumn("h", fnv1a32(F.concat(F.lit(seed + "|"), "id"))).orderBy("h", "idx").limit(k)


def decades(df: DataFrame) -> DataFrame:
    """Rows by decade, with the share of the largest decade and the neighbouring ones. The few groups are windowed, not the rows."""
    g = df.select(decade(year()).alias("decade")).filter("decade is not null").groupBy("decade").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("decade")
    return g.select("decade", "n", (F.col("n") / F.max("n").over(W.partitionBy())).alias("scale"), F.lag("decade").over(w).alias("before"), F.lead("decade").over(w).alias("after"))


def groups(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by)


def publishers(df: DataFrame) -> DataFrame:
    """Groups by lower-case trimmed label; the first spelling is the label."""
    given = df.filter(present(F.trim("publisher")))
    return given.groupBy(F.lower(F.trim("publisher")).alias("key")).agg(F.min_by("publisher", "idx").alias("label"), F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame) -> DataFrame:
    """One row of totals; the median of an even number of years is rounded up, and all years are null without one."""
    y = year()
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.floor(F.percentile(y, 0.5) + 0.5).cast("int").alias("median_year"),
        F.countDistinct(F.when(present(F.col("publisher")), F.lower(F.trim("publisher")))).alias("publishers"), F.count_if(~present(F.col("isbn"))).alias("missing_isbn"),
    )


def missing_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """For each field how many rows lack it, and the share, by one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.trim(f) == "").alias(f) for f in fields])
    long = counts.unpivot("total", fields, "field", "missing")
    return long.select("field", "missing", F.bround(F.col("missing") / F.nullif("total", F.lit(0)), 4).alias("rate"))


def split_titles(df: DataFrame, valid: Column) -> DataFrame:
    """Titles that stand over two or more different valid numbers."""
    g = df.filter(valid).groupBy("title").agg(F.array_sort(F.collect_set("isbn")).alias("isbns"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.size("isbns") > 1).select("title", "n", F.array_join("isbns", " ").alias("isbns"))


def first_of_each(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group."""
    w = W.partitionBy(by).orderBy(*order, "idx")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sample_by_year(df: DataFrame, k: int = 5) -> DataFrame:
    """k rows evenly spaced in the order of years; rows are numbered by year counts, so no task sorts them all."""
    dated = df.withColumn("y", parse_year(F.col("publication_year"))).filter("y is not null")
    per_year = dated.groupBy("y").agg(F.count(F.lit(1)).alias("m"))
    before = per_year.select("y", (F.sum("m").over(W.orderBy("y")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy()).alias("n"))
    wanted = before.groupBy().agg(F.max("n").alias("n")).select(F.explode(F.array_distinct(F.array([F.floor(F.lit(i) * (F.col("n") - 1) / (k - 1) + 0.5).cast("long") for i in range(k)]))).alias("place"))
    held = per_year.join(F.broadcast(before), "y").join(F.broadcast(wanted), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m"))).select("y", (F.col("place") - F.col("before") + 1).alias("r"), "place")
    ranked = dated.join(F.broadcast(held.select("y").distinct()), "y").withColumn("r", F.row_number().over(W.partitionBy("y").orderBy("idx")))
    return ranked.join(F.broadcast(held), ["y", "r"]).select("place", "id", "y")


def _old(df: DataFrame) -> DataFrame:
    """Rows from before 1970 without a number, and whether their other fields are given."""
    given = present(F.col("title")) & present(F.col("author")) & present(F.col("publisher"))
    return df.withColumn("y", year()).filter((F.col("y") < 1970) & ~present(F.col("isbn"))).withColumn("given", given)


def rank_label(n: Column) -> Column:
    """At least two digits; larger numbers stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(2), F.length(s)), F.lit("0"))


def rarities(df: DataFrame, k: int = 5) -> DataFrame:
    """The k oldest rows from before 1970 without a number whose other fields are given."""
    old = _old(df).filter("given").orderBy("y", "idx").limit(k)
    return old.withColumn("label", rank_label(F.row_number().over(W.orderBy("y", "idx")))).select("label", "id", "y")


def rarity_excluded(df: DataFrame, k: int = 5) -> DataFrame:
    """One row: the year of the last rarity, and how many rows of the kind are older but lack a field; null and 0 without a rarity."""
    last = _old(df).filter("given").orderBy("y", "idx").limit(k).agg(F.max("y").alias("cutoff"))
    older = _old(df).filter("not given").join(F.broadcast(last), F.col("y") < F.col("cutoff")).agg(F.count(F.lit(1)).alias("excluded"))
    return last.crossJoin(older)  # one row each


def theme_shares(df: DataFrame, by: str) -> DataFrame:
    """Rows by theme, with their share of all in whole per cent, 1 at least."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.greatest(F.lit(1), F.floor(100 * F.col("n") / F.sum("n").over(W.partitionBy()) + 0.5)).cast("int"))


def random_row(df: DataFrame, seed: int) -> DataFrame:
    """One row by chance; a seed makes it the same over the same partitions."""
    return df.orderBy(F.rand(seed)).limit(1)


def timeline_sample(df: DataFrame, covered: Column, k: int = 5) -> DataFrame:
    """k rows evenly spaced in the order of years among those with a cover; among all, in catalogue order, where fewer than k have one. Ranks come from counts by year, or by range of idx."""
    enough = df.filter(covered).limit(k).count() >= k
    pool = df.filter(covered).withColumn("g", F.coalesce(year(), F.lit(0)).cast("long")) if enough else df.withColumn("g", F.floor(F.col("idx") / 65536))
    sizes = pool.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    spans = sizes.select("g", "m", (F.sum("m").over(W.orderBy("g")) - F.col("m")).alias("before"), F.sum("m").over(W.partitionBy()).alias("n"))
    places = [F.floor(F.lit(i) * (F.col("n") - 1) / (k - 1) + 0.5).cast("long") for i in range(k)]
    wanted = F.when(F.col("n") <= k, F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)))).otherwise(F.array_distinct(F.array(*places)))
    held = spans.select("g", "before", "m", F.explode(wanted).alias("place")).filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("m")))
    held = F.broadcast(held.select("g", (F.col("place") - F.col("before") + 1).alias("r"), "place"))
    return pool.join(F.broadcast(held.select("g").distinct()), "g").withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("idx"))).join(held, ["g", "r"]).select("place", "id")


def picked_titles(df: DataFrame, wanted: list[str]) -> DataFrame:
    """For each wanted title the first row that starts with it, no row twice; wanted is a short list."""
    w = df.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, want string")
    hit = df.join(F.broadcast(w), F.startswith("title", "want"))
    first = hit.groupBy("place").agg(F.min("idx").alias("idx"), F.min_by("title", "idx").alias("title"))
    return first.groupBy("idx").agg(F.min("place").alias("place"), F.first("title").alias("title")).select("place", "idx", "title")
