"""A table of what sources have answered so far, by key: each batch is written once, the last one wins, and an interrupted load goes on where it stopped.

A version is a manifest that names the folders that make it up, oldest first, and the batches in them. Folders are
never changed. A manifest is made under a name that must not exist yet, so of two writers one fails, and a batch whose manifest
was never made is simply written again into another folder. Works on any file system that the session reaches.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CacheTable:
    """The table at path, with a key column; columns are those of the first batch."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _at(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _manifest(self) -> dict:
        """The latest version; an empty one where there is none."""
        fs, where = self._at("versions")
        names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
        if not names:
            return {"version": 0, "folders": [], "batches": []}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        fs, where = self._at(f"versions/{manifest['version']:012d}")
        out = fs.create(where, False)  # fails if another writer has made this version
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def version(self) -> int:
        return self._manifest()["version"]

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key, at the latest or an earlier version. Of rows with one key in a batch one counts."""
        manifest = self._manifest()
        if version is not None and version != manifest["version"]:
            manifest = json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).first()[0])
        if not manifest["folders"]:
            raise ValueError("the cache has no batch yet")
        parts = [self.spark.read.parquet(f"{self.path}/{x}") for x in manifest["folders"]]
        if len(parts) == 1:
            return parts[0]
        rows = reduce(DataFrame.unionByName, [p.withColumn("_place", F.lit(i)) for i, p in enumerate(parts)])
        rest = [c for c in parts[0].columns if c != self.key]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_place").alias("_r")).select(self.key, "_r.*").select(*parts[0].columns)

    def upsert(self, rows: DataFrame, batch: str) -> bool:
        """Adds a batch of rows under a name of its own; False, and nothing is written, if a batch of that name is in the table."""
        manifest = self._manifest()
        if batch in manifest["batches"]:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        rows.dropDuplicates([self.key]).write.parquet(f"{self.path}/{folder}")
        self._commit({"version": manifest["version"] + 1, "folders": [*manifest["folders"], folder], "batches": [*manifest["batches"], batch]})
        return True

    def compact(self) -> None:
        """One folder with the last row of each key; earlier versions can be read as before."""
        manifest = self._manifest()
        if len(manifest["folders"]) > 1:
            folder = f"data/{uuid.uuid4().hex}"
            self.read().write.parquet(f"{self.path}/{folder}")
            self._commit(manifest | {"version": manifest["version"] + 1, "folders": [folder]})

    def missing(self, asked: DataFrame) -> DataFrame:
        """Keys of asked that no batch has answered yet."""
        keys = asked.select(self.key).filter(F.col(self.key).isNotNull()).distinct()
        return keys.join(self.read().select(self.key), self.key, "left_anti") if self._manifest()["folders"] else keys
