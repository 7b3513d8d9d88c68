"""The graph of themes, authors and publishers that stand together. Edges are keyed by two columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import fold, holds, present, split_authors


def mentions(df: DataFrame) -> DataFrame:
    """idx, kind, label of every theme (genre), author and publisher of a row, each label once."""
    one = lambda kind, c: df.filter(present(F.col(c))).select("idx", F.lit(kind).alias("kind"), F.col(c).alias("label"))
    authors = df.select("idx", F.lit("author").alias("kind"), F.explode(F.array_distinct(split_authors(F.col("author")))).alias("label"))
    return one("theme", "genre").unionByName(authors).unionByName(one("publisher", "publisher")).withColumn("key", fold("label"))


def nodes(df: DataFrame) -> DataFrame:
    return mentions(df).groupBy("kind", "key").agg(F.min_by("label", "idx").alias("label"), F.count(F.lit(1)).alias("n"))


def edges(df: DataFrame) -> DataFrame:
    """Theme to author and theme to publisher, with the number of rows. A row's own labels meet in the row, without a join."""
    authors = F.transform(F.array_distinct(split_authors(F.col("author"))), lambda x: F.struct(F.lit("author").alias("kind"), x.alias("label")))
    publisher = F.when(present(F.col("publisher")), F.array(F.struct(F.lit("publisher").alias("kind"), F.col("publisher").alias("label")))).otherwise(F.array().cast("array<struct<kind:string,label:string>>"))
    pairs = df.filter(present(F.col("genre"))).select("idx", "genre", F.explode(F.concat(authors, publisher)).alias("to"))
    # labels are counted as they are spelt first, so only the distinct pairs are folded
    spelt = pairs.groupBy("genre", "to.kind", "to.label").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return spelt.groupBy(fold("genre").alias("theme"), "kind", fold("label").alias("key")).agg(F.sum("n").alias("weight"), F.min("first").alias("first_idx"))


def ego(df: DataFrame, theme: str, k: int = 11) -> DataFrame:
    """The heaviest edges of one theme; of equals the first met."""
    return edges(df.filter(holds(F.col("genre"), theme))).filter(F.col("theme") == theme).orderBy(F.desc("weight"), "first_idx", "kind", "key").limit(k)


def overview(df: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent nodes of each kind."""
    w = W.partitionBy("kind").orderBy(F.desc("n"), "label")
    return nodes(df).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
