"""What to ask external sources for, and what their answers give: targets, batches, resumption, identifiers, approved matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import isbn, web
from quillspark.functions.text import present

#: Rows of one range of idx, which are numbered together.
SPAN = 65536


def of_publisher(df: DataFrame, publisher: str) -> DataFrame:
    """Records with a valid number of one publisher (publisher_normalized), by number."""
    return df.filter((F.col("publisher_normalized") == publisher) & isbn.valid(F.col("isbn"))).select("id", "isbn", "title").orderBy("isbn", "id")


def uncovered(df: DataFrame, covered: Column, books: DataFrame) -> DataFrame:
    """Records with a title and an author that have no cover and whose number no book of another source has."""
    asked = df.filter(present(F.col("title")) & present(F.col("author")) & ~F.coalesce(covered, F.lit(False)))
    return asked.join(books.select("isbn"), "isbn", "left_anti").select(*df.columns)


def first_uncovered(df: DataFrame, covered: Column) -> DataFrame:
    """The first record without a cover of each valid number."""
    open_ = df.filter(isbn.valid(F.col("isbn")) & ~F.coalesce(covered, F.lit(False)))
    return open_.groupBy("isbn").agg(F.min_by("id", "idx").alias("id"), F.min_by("title", "idx").alias("title"))


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """The last row of each value of a key, as an index that is overwritten keeps it."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "idx").alias("r")).select(key, "r.*")


def batches(df: DataFrame, size: int) -> DataFrame:
    """df with the number of the batch of size rows that each is in, in order of idx; ranges of idx are counted first, so no task orders all rows."""
    spans = df.groupBy(F.floor(F.col("idx") / SPAN).alias("_span")).agg(F.count(F.lit(1)).alias("_m"))
    before = spans.select("_span", (F.sum("_m").over(W.orderBy("_span")) - F.col("_m")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_span").orderBy("idx")) - 1 + F.col("_before")
    numbered = df.withColumn("_span", F.floor(F.col("idx") / SPAN)).join(before, "_span")
    return numbered.withColumn("batch", F.floor(place / size)).drop("_span", "_before")


def queries(df: DataFrame, size: int) -> DataFrame:
    """A query for each batch: the records' conditions, any of which may hold, and their ids."""
    rows = batches(df, size).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("idx", "id", web.clause(F.col("title"), F.col("author")).alias("q")))).alias("r"))
    return rows.select("batch", F.array_join(F.transform("r", lambda x: x["q"]), " OR ").alias("query"), F.transform("r", lambda x: x["id"]).alias("ids"))


def resumed(done: DataFrame, partial: DataFrame) -> DataFrame:
    """All responses so far (response_id, record_ids): those done, and of an interrupted run those with a record that isn't."""
    ids = done.select(F.explode("record_ids").alias("record_id")).distinct()
    new = partial.select("response_id", F.explode("record_ids").alias("record_id")).join(ids, "record_id", "left_anti").select("response_id").distinct()
    return done.unionByName(partial.join(new, "response_id", "left_semi").select(*done.columns))


def remaining(df: DataFrame, responses: DataFrame) -> DataFrame:
    """Records that no response answers."""
    return df.join(responses.select(F.explode("record_ids").alias("id")).distinct(), "id", "left_anti").select(*df.columns)


def entries(responses: DataFrame, key: str, body: str) -> DataFrame:
    """Rows (key, name, value) of the entries of JSON objects; a body that isn't an object gives none."""
    return responses.select(key, F.explode(F.from_json(body, "map<string,string>")).alias("name", "value"))


def probed(attempts: DataFrame) -> DataFrame:
    """One result a url of its attempts (url, method, status, final_url, error): HEAD's if it succeeded, else GET's, else a null status."""
    head = F.max_by(F.struct("status", "final_url", "method", "error"), F.when((F.col("method") == "HEAD") & (F.col("status") < 400), 1))
    get = F.max_by(F.struct("status", "final_url", "method", "error"), F.when(F.col("method") == "GET", 1))
    none = F.struct(F.lit(None).cast("int").alias("status"), F.col("url").alias("final_url"), F.lit("HEAD/GET").alias("method"), F.col("last").alias("error"))
    g = attempts.groupBy("url").agg(head.alias("head"), get.alias("get"), F.max("error").alias("last"))
    return g.select("url", F.coalesce("head", "get", none).alias("r")).select("url", "r.*")


def identifiers(found: DataFrame) -> DataFrame:
    """record_id and the identifiers of its best edition: editions (record_id, score, source_url, oclc, lccn) without any identifier don't count, and two sources with the best score cancel each other."""
    usable = found.filter((F.size(F.coalesce("oclc", F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce("lccn", F.array().cast("array<string>"))) > 0))
    best = usable.withColumn("_r", F.rank().over(W.partitionBy("record_id").orderBy(F.desc("score")))).filter("_r = 1")
    g = best.groupBy("record_id").agg(F.max("score").alias("score"), F.min("source_url").alias("source_url"), F.countDistinct("source_url").alias("_n"), F.min_by(F.struct("oclc", "lccn"), "source_url").alias("x"))
    return g.filter("_n = 1").select("record_id", "score", "source_url", F.array_sort("x.oclc").alias("oclc"), F.array_sort("x.lccn").alias("lccn"))


def by_identifier(ids: DataFrame, books: DataFrame) -> DataFrame:
    """The first of a record's identifiers that books (key, title) have: OCLC numbers in order, then LCCN."""
    keys = lambda kind: F.transform(F.coalesce(kind, F.array().cast("array<string>")), lambda v: F.concat(F.lit(kind.upper() + ":"), v))
    tried = ids.select("record_id", F.posexplode(F.concat(keys("oclc"), keys("lccn"))).alias("place", "key"))
    return tried.join(books, "key").groupBy("record_id").agg(F.min_by("key", "place").alias("key"), F.min_by("title", "place").alias("title"))


def approved(df: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """id and url of approved matches (id, url, the fields); an unknown id, or a record whose fields have changed, is an error."""
    now = df.select("id", F.lit(True).alias("_known"), *[F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in fields])
    joined = rules.join(now, "id", "left")
    same = F.lit(True)
    for c in fields:
        same = same & (F.coalesce(F.col(c), F.lit("")) == F.col(f"_{c}"))
    wrong = F.when(F.col("_known").isNull(), F.raise_error("an approved record is absent")).when(~same, F.raise_error("an approved record's fields have changed"))
    return joined.withColumn("_ok", F.coalesce(wrong.cast("boolean"), F.lit(True))).filter("_ok").select("id", "url")


def source_ids(df: DataFrame) -> DataFrame:
    """source_id and record_id of all ids that a record stands for (id, source_record_ids); one that two records claim is an error."""
    all_ids = df.select(F.explode(F.array_distinct(F.concat(F.array("id"), F.coalesce("source_record_ids", F.array().cast("array<string>"))))).alias("source_id"), F.col("id").alias("record_id"))
    g = all_ids.groupBy("source_id").agg(F.min("record_id").alias("record_id"), F.max("record_id").alias("_other"))
    clash = F.when(F.col("record_id") != F.col("_other"), F.raise_error("a source id stands for two records").cast("boolean"))
    return g.withColumn("_ok", F.coalesce(clash, F.lit(True))).filter("_ok").select("source_id", "record_id")


def routed(pages: DataFrame, pairs: DataFrame, english: DataFrame) -> DataFrame:
    """page (a path; those in en/ are English) and target, its counterpart: by the special pairs (fr, en), else the same name if an English page (path) has it, else the index. The lists are short."""
    here = pages.select("page", F.startswith("page", F.lit("en/")).alias("is_en"), F.regexp_replace("page", "^en/", "").alias("name"))
    sides = pairs.select(F.lit(False).alias("is_en"), F.col("fr").alias("name"), F.concat(F.lit("en/"), "en").alias("special")).unionByName(pairs.select(F.lit(True).alias("is_en"), F.col("en").alias("name"), F.col("fr").alias("special")))
    known = english.select(F.col("path").alias("name")).distinct().withColumn("known", F.lit(True))
    j = here.join(F.broadcast(sides), ["is_en", "name"], "left").join(F.broadcast(known), "name", "left")
    same = F.when(F.col("known"), F.col("name")).otherwise("index.html")
    return j.select("page", F.coalesce("special", F.when(F.col("is_en"), same).otherwise(F.concat(F.lit("en/"), same))).alias("target"))
