"""Scored matching of records with candidates, ties rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import isbn, text

#: Words of publishers' names that don't tell them apart.
STOP = ("and", "de", "des", "du", "editions", "edition", "et", "la", "le", "les", "of", "press", "the")
#: Rows of one block that meet in one task; records of larger blocks are dealt over several.
HOT = 1000


def tokens(key: Column) -> Column:
    """Distinct words of a normalised name, of two letters or more, without STOP."""
    return F.filter(F.array_distinct(F.split(key, " ")), lambda x: (F.length(x) > 1) & ~x.isin(*STOP))


def publishers_match(a: Column, b: Column) -> Column:
    """One name's words among the other's, or half of all words shared."""
    x, y = tokens(a), tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) > 0) & (F.size(y) > 0) & (inside | (F.lit(2) * both >= either))


def authors_match(a: Column, b: Column) -> Column:
    """Equal keys, the same two or more words in any order, or the same last word and first letter."""
    x, y = F.split(a, " "), F.split(b, " ")
    words = (F.size(F.array_distinct(x)) > 1) & (F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)))
    last = (F.element_at(x, -1) == F.element_at(y, -1)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    return (a != "") & (b != "") & ((a == b) | words | last)


def _described(df: DataFrame) -> DataFrame:
    """The normalised parts of a record, and its blocks: two records that share one have one title, authors that match, and one number or year.

    Names match just where they share a key: the last word and the first letter, or two or more words in any order.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    d = df.withColumns({"_title": text.key("title"), "_names": text.keys(text.split_authors(F.col("author"))), "_publisher": text.key("publisher"), "_isbn": given("isbn"), "_year": text.parse_year(given("publication_year"))})
    words = lambda n: F.array_sort(F.array_distinct(F.split(n, " ")))
    last = F.transform("_names", lambda n: F.concat(F.substring(n, 1, 1), F.lit("."), F.element_at(F.split(n, " "), -1)))
    bags = F.transform(F.filter("_names", lambda n: F.size(words(n)) > 1), lambda n: F.array_join(words(n), " "))
    block = lambda kind, value: F.when(value, F.transform(F.array_distinct(F.concat(last, bags)), lambda n: F.concat_ws("|", F.lit(kind), F.col("_isbn" if kind == "isbn" else "_year"), "_title", n))).otherwise(F.array().cast("array<string>"))
    blocks = F.concat(block("isbn", F.col("_isbn") != ""), block("year", F.col("_year").isNotNull()))
    return d.withColumn("_blocks", F.when(F.col("_title") != "", blocks)).filter(F.size("_blocks") > 0)


def candidates(records: DataFrame, docs: DataFrame) -> DataFrame:
    """id and target of the records and documents that have one title and matching authors, with what else agrees; pairs without a number or year in common can't score and are left out.

    Both have id, title, author, isbn, publisher and publication_year, documents a boolean edition too.
    """
    cols = ("id", "_blocks", "_publisher", "_isbn", "_year")
    a = _described(records).select(*[F.col(c).alias(f"a{c}") for c in cols], F.explode("_blocks").alias("block"))
    b = _described(docs).select("edition", *[F.col(c).alias(f"b{c}") for c in cols], F.explode("_blocks").alias("block"))
    hot = F.broadcast(b.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("block", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(hot, "block", "left").withColumn("salt", F.pmod(F.xxhash64("aid"), parts).cast("int")).drop("parts")
    b = b.join(hot, "block", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    pairs = a.join(b, ["block", "salt"]).filter(F.col("block") == F.element_at(F.array_intersect("a_blocks", "b_blocks"), 1))
    return pairs.select(
        F.col("aid").alias("id"), F.col("bid").alias("target"), "edition", ((F.col("a_isbn") != "") & (F.col("a_isbn") == F.col("b_isbn"))).alias("isbn_equal"),
        F.coalesce(F.col("a_year") == F.col("b_year"), F.lit(False)).alias("year_equal"), publishers_match(F.col("a_publisher"), F.col("b_publisher")).alias("publisher_equal"),
    )


def by_alias(df: DataFrame, cache: DataFrame) -> DataFrame:
    """idx and the title that a cache (form, title) has for the first of a number's forms, the long one and the short one."""
    forms = df.select("idx", F.posexplode(F.array_compact(F.array("isbn", isbn.to10(F.col("isbn"))))).alias("place", "form"))
    return forms.join(cache, "form").groupBy("idx").agg(F.min_by("title", "place").alias("found"))


def scored(pairs: DataFrame) -> DataFrame:
    """Scores by what agrees: 120 an edition's number, 115 a work's, 95 an edition's year and publisher, 85 a work's; other pairs go."""
    s = F.when(F.col("isbn_equal") & F.col("edition"), 120).when(F.col("isbn_equal"), 115).when(F.col("year_equal") & F.col("publisher_equal") & F.col("edition"), 95).when(F.col("year_equal") & F.col("publisher_equal"), 85)
    return pairs.withColumn("score", s).filter("score is not null")


def best_unless_tied(df: DataFrame, record: str = "id", target: str = "target") -> DataFrame:
    """The best target of each record; none where two different targets share the best score."""
    top = df.withColumn("_r", F.rank().over(W.partitionBy(record).orderBy(F.desc("score")))).filter("_r = 1")
    return top.groupBy(record).agg(F.min(target).alias(target), F.max("score").alias("score"), F.countDistinct(target).alias("_n")).filter("_n = 1").drop("_n")


def name_keys(names: Column) -> Column:
    """Keys of normalised names: two names match just where they share one, the last word with the first letter or two or more words in any order."""
    words = lambda n: F.array_sort(F.array_distinct(F.split(n, " ")))
    last = F.transform(names, lambda n: F.concat(F.substring(n, 1, 1), F.lit("."), F.element_at(F.split(n, " "), -1)))
    bags = F.transform(F.filter(names, lambda n: F.size(words(n)) > 1), lambda n: F.array_join(words(n), " "))
    return F.array_distinct(F.concat(last, bags))


def evidence(docs: DataFrame) -> DataFrame:
    """What each work offers to a record: a row for each title, name key and number or year of its covered editions and of itself.

    docs: key, title, author_name, isbn, publish_year, publisher (lists), cover_i, cover_edition_key and editions, a list of key, title, isbn, publish_date, publisher and cover_i.
    An edition counts if its title is the work's. Years score with one of the publishers only, numbers alone.
    """
    lists = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    offer = lambda key, title, isbn, dates, publisher, cover, source, number, year: F.struct(
        title.alias("title"), lists(isbn).alias("numbers"), text.years(lists(dates.cast("array<string>"))).alias("years"), lists(publisher).alias("publishers"), cover.cast("long").alias("cover_id"), source.alias("source_url"), F.lit(number).alias("by_number"), F.lit(year).alias("by_year")
    )
    own = F.when(text.present(F.col("cover_edition_key")), F.concat(F.lit("/books/"), "cover_edition_key")).otherwise(F.col("key"))
    work = F.array(offer(F.col("key"), F.col("title"), F.col("isbn"), F.col("publish_year"), F.col("publisher"), F.col("cover_i"), own, 115, 85))
    editions = F.transform(F.coalesce("editions", F.array().cast(docs.schema["editions"].dataType)), lambda e: offer(e["key"], e["title"], e["isbn"], e["publish_date"], e["publisher"], e["cover_i"], e["key"], 120, 95))
    each = docs.select("key", text.key("title").alias("work_title"), name_keys(text.keys(F.col("author_name"))).alias("names"), F.explode(F.concat(work, editions)).alias("o"))
    each = each.select("key", "work_title", "names", "o.*").filter("cover_id is not null and cover_id <> 0 and work_title <> ''").withColumn("title", text.key("title")).filter("title = work_title")
    each = each.withColumn("publishers", F.transform(text.keys(F.col("publishers")), tokens))
    way = "array<struct<kind:string,value:string,score:int,publishers:array<array<string>>>>"
    numbers = F.transform(F.array_distinct("numbers"), lambda n: F.struct(F.lit("isbn"), n, F.col("by_number"), F.array().cast("array<array<string>>"))).cast(way)
    ways = F.concat(numbers, F.transform("years", lambda y: F.struct(F.lit("year"), y.cast("string"), F.col("by_year"), F.col("publishers"))).cast(way))
    out = each.select("key", "title", "cover_id", "source_url", F.explode("names").alias("name"), F.col("years"), ways.alias("ways")).select("key", "title", "name", "cover_id", "source_url", "years", F.explode("ways").alias("w"))
    return out.filter("w.value <> ''").select("title", "name", "w.kind", "w.value", "w.score", F.array_sort("w.publishers").alias("publishers"), "cover_id", "source_url")


def _best(df: DataFrame, *by: str) -> DataFrame:
    """Of each group the best score, its least and its greatest cover: a combining aggregate, as the best of several groups' best is the best of all."""
    one = F.struct("cover_id", "source_url")
    top = df.groupBy(*by, "score").agg(F.min(F.col("lo") if "lo" in df.columns else one).alias("lo"), F.max(F.col("hi") if "hi" in df.columns else F.col("cover_id")).alias("hi"))
    best = top.groupBy(*by).agg(F.max(F.struct("score", "lo", "hi")).alias("b"))
    return best.select(*by, "b.score", "b.lo", "b.hi")


def edition_matches(records: DataFrame, docs: DataFrame) -> DataFrame:
    """id, score, cover_id and source_url of each record's best cover; none where two covers share the best score.

    records: id, title, author (packed), isbn, publisher, publication_year. 120 and 115 stand for a number of an edition or of the work, 95 and 85 for a year and a publisher of either.
    What many works offer alike under one title, name and number is reduced to its best and whether that is tied before records meet it; under a year, to the best of each set of publishers.
    """
    offers = _best(evidence(docs), "title", "name", "kind", "value", "publishers")
    names = name_keys(text.keys(text.split_authors(F.col("author"))))
    given = records.select("id", text.key("title").alias("title"), names.alias("names"), F.coalesce("isbn", F.lit("")).alias("isbn"), text.parse_year(F.coalesce("publication_year", F.lit(""))).cast("string").alias("year"), tokens(text.key("publisher")).alias("own"))
    kinds = F.array(F.struct(F.lit("isbn").alias("kind"), F.col("isbn").alias("value")), F.struct(F.lit("year").alias("kind"), F.col("year").alias("value")))
    asked = given.filter("title <> ''").withColumn("k", F.explode(kinds)).filter("k.value <> ''").select("id", "title", F.explode("names").alias("name"), "k.kind", "k.value", "own")
    inside = lambda p, o: (F.size(F.array_except(p, o)) == 0) | (F.size(F.array_except(o, p)) == 0) | (2 * F.size(F.array_intersect(p, o)) >= F.size(F.array_union(p, o)))
    publisher = (F.size("own") > 0) & F.exists("publishers", lambda p: (F.size(p) > 0) & inside(p, F.col("own")))
    met = asked.join(offers, ["title", "name", "kind", "value"]).filter((F.col("kind") == "isbn") | publisher)
    best = _best(met.select("id", "score", "lo", "hi"), "id")
    return best.filter(F.col("lo.cover_id") == F.col("hi")).select("id", "score", F.col("hi").alias("cover_id"), "lo.source_url")
