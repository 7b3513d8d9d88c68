"""The catalogue fixtures, in SQL that Spark and DuckDB share, and JSON readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK = "CAST((10 - (" + " + ".join(f"{'3 * ' if i % 2 == 0 else ''}CAST(substr(b, {i}, 1) AS INT)" for i in range(1, 13)) + ") % 10) % 10 AS STRING)"

CATALOGUE = f"""
SELECT p_partkey AS idx, 'book-' || lpad(CAST(p_partkey + 1 AS STRING), 6, '0') AS id, p_name AS title,
       CASE WHEN p_partkey % 11 = 0 THEN '' ELSE coalesce(author, '') END AS author,
       CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS publisher,
       CASE WHEN p_partkey % 23 = 0 THEN '' ELSE CAST(1920 + 2 * p_size AS STRING) END AS publication_year,
       p_type AS genre,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN b || '?' ELSE b || {CHECK} END AS isbn
FROM (SELECT *, '978' || lpad(CAST(CAST(floor(p_partkey / 2) AS BIGINT) AS STRING), 9, '0') AS b FROM part) base
LEFT JOIN (SELECT l_partkey, concat_ws(' | ', max(CASE WHEN rn = 1 THEN s_name END), max(CASE WHEN rn = 2 THEN s_name END), max(CASE WHEN rn = 3 THEN s_name END)) AS author
           FROM (SELECT l_partkey, s_name, row_number() OVER (PARTITION BY l_partkey ORDER BY s_name) AS rn
                 FROM (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) d) r
           WHERE rn <= 3 GROUP BY l_partkey) packed ON l_partkey = p_partkey
"""

COPIES = f"""
SELECT p_partkey AS idx, 'book-' || lpad(CAST(p_partkey + 1 AS STRING), 6, '0') AS id,
       CASE WHEN p_partkey % 3 = 1 THEN 'RECUEIL NO. ' ELSE 'Recueil, no ' END || CAST(grp AS STRING) AS title,
       CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 1 THEN 'Auteur ' || CAST(grp % 97 AS STRING) || ' | Second Nom' ELSE 'Auteur ' || CAST(grp % 97 AS STRING) END AS author,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Brand ' || CAST(grp % 25 AS STRING) END AS publisher,
       CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '2001' ELSE CAST(1950 + grp % 60 AS STRING) END AS publication_year,
       '' AS series, CASE WHEN b = '' THEN '' ELSE b || {CHECK} END AS isbn
FROM (SELECT p_partkey, grp,
             CASE WHEN p_partkey % 6 IN (0, 1) THEN '9781' || lpad(CAST(grp AS STRING), 8, '0')
                  WHEN p_partkey % 6 = 2 THEN '9782' || lpad(CAST(grp AS STRING), 8, '0')
                  WHEN p_partkey % 30 = 5 THEN '9783' || lpad(CAST(CAST(floor(p_partkey / 60) AS BIGINT) AS STRING), 8, '0') ELSE '' END AS b
      FROM (SELECT p_partkey, CAST(floor(p_partkey / 6) AS BIGINT) AS grp FROM part) g) c
"""


def oracle(body: str, base: str = CATALOGUE, name: str = "catalogue") -> str:
    """body over a fixture, in DuckDB's SQL."""
    return f"WITH {name} AS ({base.replace('AS STRING', 'AS VARCHAR')}) {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = sql.replace("FROM part)", "FROM {part})").replace("FROM lineitem JOIN supplier", "FROM {lineitem} JOIN {supplier}")
    return spark.sql(sql, **{x: table(spark, sf_dir, x) for x in ("part", "lineitem", "supplier") if "{" + x + "}" in sql})


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with identifiers, authors, publishers and years, derived from parts and suppliers."""
    return _fixture(spark, sf_dir, CATALOGUE)


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books in small groups of likely copies."""
    return _fixture(spark, sf_dir, COPIES)


def whole_ids(df: DataFrame) -> DataFrame:
    """A fixture with ids that no two rows share: the SQL cuts numbers to six digits, so from a million rows on its ids repeat and are no key."""
    n = (F.col("idx") + 1).cast("string")
    return df.withColumn("id", F.concat(F.lit("book-"), F.lpad(n, F.greatest(F.lit(6), F.length(n)), F.lit("0"))))


def given_id(c: Column | str) -> Column:
    """A text that ends in a whole id, with the id as the fixture's SQL has it."""
    return F.regexp_replace(c, "(book-[0-9]{6})[0-9]+$", "$1")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file of one object or a list; an absent optional file is an empty table if a schema is given."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if schema and not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)
