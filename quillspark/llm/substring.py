"""Substring dedup: a log-structured index of window fingerprints.

Every window of words is fingerprinted by its least gram's hash (see anchors); consecutive
windows with one such hash are one entry, a stretch, with a digest of all its words' bytes.
The log keeps sorted immutable runs of (gram, print, counts, locator). A batch becomes a
sorted run and is merge-joined on the gram with each run of history; what meets is verified:
a stretch whose 64-bit BLAKE2 digest of its bytes is met too, under the same 64-bit gram, is
repeated as a whole, and where a gram has several digests one document of each gives digests
of its single windows, of which those that two stretches share are repeated. Then the batch's
run joins the log, which is compacted when it has RUNS runs. The runs are Parquet in one
folder, so a later session opens the log and goes on.

A null or empty text has no words. Texts shorter than a window keep everything. Rows with a
null or repeated id are rows like others: they are told apart by a number of their own, and
count as occurrences. An empty table gives no rows. Only the named columns are read;
keep_unrepeated() passes the others through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.anchors import covered, digest64, marks_by_doc, stretches
from quillspark.llm.common import HOT_SHARE, arrow_settings, byte_view, entered, free_name, give_back, joined_small_hot, keyed, map_batches, picked, scratch_path, stored, table, word_hashes, word_spans

WINDOW = 35
DOUBLINGS = 3

STRETCH = "doc_id long, gram long, print long, start long, m long"
#: c consecutive stretches of one fingerprint, m windows together.
SERIES = STRETCH + ", c long"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def cut(text: str | None, size: int = WINDOW) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by spaces, the places where they start, and grams, first windows and numbers of windows of the stretches."""
    joined = b" ".join(words_of(text))
    b = byte_view(joined)
    starts, ends = word_spans(b)
    gram, first, m, _ = stretches(word_hashes(b, starts, ends), size, DOUBLINGS)
    return joined, np.append(starts, len(joined) + 1), gram.view(np.int64), first, m


def found(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stretches of all documents; equal ones in a row, as of a line that a text repeats, are one row."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in SERIES.split(", ")}
        for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            joined, at, gram, first, m = cut(t, size)
            prints = np.array([digest64(joined[x : y - 1]) for x, y in zip(at[first].tolist(), at[first + m + size - 1].tolist(), strict=True)], np.int64)
            lead = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (prints[1:] != prints[:-1]))) if len(gram) else np.zeros(0, np.int64)
            c = np.diff(lead, append=len(gram))
            for column, v in zip(out.values(), ([doc] * len(lead), gram[lead], prints[lead], first[lead], m[lead] * c, c), strict=True):
                column += v if isinstance(v, list) else v.tolist()
        return out

    return map_batches(docs.select(doc_id, text), run, SERIES)


#: Entries of runs: how many windows' stretches and how many rows had them, and the least row that did.
ENTRY = "gram long, print long, n long, k long, rep long"
#: A log of so many runs is compacted into one.
RUNS = 4


class FingerprintLog:
    """Sorted immutable runs of ENTRY rows in one folder. A run's name tells which batches it covers; one that others cover too is what a compaction left behind."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        """The log at a path, or a new one in the session's shared folder."""
        self.spark = spark
        self.path = path or scratch_path(spark, "fingerprint-log")
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of each run that is whole and that no other covers, in order."""
        if not self._files.exists(self._root):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._root)]
        done = [tuple(map(int, x.split("-")[1:])) for x in names if x.startswith("run-") and self._files.exists(self._at(x, "_SUCCESS"))]
        return sorted(x for x in done if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in done))

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def read(self, run: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/run-{run[0]}-{run[1]}")

    def _write(self, entries: DataFrame, run: tuple[int, int]) -> None:
        # ranges of (gram, print), so that a gram with very many digests is dealt over several files
        entries.repartitionByRange("gram", "print").sortWithinPartitions("gram", "print").write.mode("overwrite").parquet(f"{self.path}/run-{run[0]}-{run[1]}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Appends a batch's stretches as a run; gives the entries of all grams of the batch that occurred twice by now, in history or in it, with the number of digests of the gram; stored."""
        history = self.runs()
        here = history[-1][1] + 1 if history else 0
        self._write(batch.groupBy("gram", "print").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("rep")), (here, here))
        run = self.read((here, here))
        grams = run.groupBy("gram").agg(F.sum("n").alias("n"))
        met = run
        for h in history:  # both sides are sorted runs
            met = met.unionByName(self.read(h).hint("merge").join(grams.select("gram"), "gram", "left_semi"))
        both = met.groupBy("gram", "print").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("rep").alias("rep")) if history else met
        both = stored(both, "fingerprint-met")
        total = both.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("prints")).filter("total > 1")
        out = stored(joined_small_hot(both, stored(total, "fingerprint-grams"), "gram", "prints", both.count()).drop("total"), "fingerprint-repeated")
        if len(history) + 1 >= RUNS:
            self.compact()
        return out

    def compact(self) -> None:
        """Merges all runs into one; the runs that it covers are dropped once it is whole."""
        runs = self.runs()
        if len(runs) < 2:
            return
        merged = self.read(runs[0])
        for r in runs[1:]:
            merged = merged.unionByName(self.read(r))
        merged = merged.groupBy("gram", "print").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.min("rep").alias("rep"))
        self._write(merged, (runs[0][0], runs[-1][1]))
        for r in runs:
            self._files.delete(self._at(f"run-{r[0]}-{r[1]}"), True)


def joined_by_pair(rows: DataFrame, entries: DataFrame, total: int) -> DataFrame:
    """rows with the entry of their (gram, print); entries of over total / HOT_SHARE rows, fewer than HOT_SHARE of them, are broadcast."""
    limit = max(1, total // HOT_SHARE)
    hot = F.broadcast(entries.filter(F.col("n") > limit))
    rest = rows.join(F.broadcast(entries.filter(F.col("n") > limit).select("gram", "print")), ["gram", "print"], "left_anti")
    return rows.join(hot, ["gram", "print"]).unionByName(rest.hint("merge").join(entries.filter(F.col("n") <= limit), ["gram", "print"]))


def wanted_texts(docs: DataFrame, entries: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts of the entries' representatives, one a document, with the entries to take from each: doc_id, text, prints, n, prints_of_gram."""
    ids = stored(entries.select(F.col("rep").alias("doc_id")).distinct(), "wanted-ids")
    per_doc = entries.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_list(F.struct("print", "n", "prints")).alias("e"))
    whole = picked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ids, "doc_id")
    return whole.join(per_doc, "doc_id").select("doc_id", "text", F.col("e.print").alias("taken"), F.col("e.n").alias("n"), F.col("e.prints").alias("prints"))


def windows(texts: DataFrame, size: int) -> DataFrame:
    """Hashes of the single windows of the wanted stretches, each stretch once."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "gram", "window", "start", "n")}
        for doc, t, taken, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            joined, at, gram, first, m = cut(t, size)
            want = dict(zip(taken, n, strict=True))
            for g, f, k in zip(gram.tolist(), first.tolist(), m.tolist(), strict=True):
                count = want.pop(digest64(joined[at[f] : at[f + k + size - 1] - 1]), None)
                if count is None:
                    continue
                for p in range(f, f + k):
                    for column, v in zip(out.values(), (doc, g, digest64(joined[at[p] : at[p + size] - 1]), p, count), strict=True):
                        column.append(v)
        return out

    return map_batches(texts, run, "doc_id long, gram long, window long, start long, n long")


def repeated_windows(docs: DataFrame, batch: F.Column | None = None, batches: int = 2, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Marks (doc_id, start, m) of all windows that occur twice; ids must tell the rows apart.

    The log takes the batches 0 to batches - 1, which the column batch tells of a doc_id, one after the other; a gram's last entries are those that count.
    """
    rows = stored(found(docs, size, doc_id, text), "substring-stretches")
    log = FingerprintLog(docs.sparkSession)
    number = F.pmod(F.xxhash64("doc_id"), F.lit(batches)) if batch is None else batch
    entries = None
    for i in range(batches):
        new = log.add(rows.filter(number == i)).withColumn("batch", F.lit(i))
        entries = new if entries is None else entries.unionByName(new)
    log.compact()
    # a gram that comes again comes with all its digests, so each digest's last entry is the one that counts; a gram of many digests is spread over tasks
    entries = entries.groupBy("gram", "print").agg(*[F.max_by(c, "batch").alias(c) for c in entries.columns if c not in ("gram", "print", "batch")])
    entries = stored(entries, "substring-entries")
    whole = joined_by_pair(rows, entries.filter("n > 1").select("gram", "print", F.col("k").alias("n")), rows.count()).select("doc_id", "start", "m")
    single = stored(windows(wanted_texts(docs, entries.filter("prints > 1"), doc_id, text), size), "substring-windows")
    shared = single.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram", "window")
    part = single.filter("n = 1").join(shared, ["gram", "window"], "left_semi").select("doc_id", "start", F.lit(1).cast("long").alias("m"))
    return stored(whole.unionByName(part), "substring-marks")


def with_marks(docs: DataFrame, marks: DataFrame, row: str) -> tuple[DataFrame, str, str]:
    """docs with two more columns, arrays of the marks' starts and lengths, null without a mark, and their names; row tells docs' rows apart. Only texts with marks are shuffled."""
    s, m = free_name(docs, "_starts"), free_name(docs, "_lengths")
    ids = stored(marks.select(F.col("doc_id").alias(row)).distinct(), "marked-ids")
    some = picked(docs, ids, row).join(marks_by_doc(marks).toDF(row, s, m), row).select(*docs.columns, s, m)
    none = picked(docs, ids, row, anti=True)
    empty = F.lit(None).cast("array<bigint>")
    return some.unionByName(none.select("*", empty.alias(s), empty.alias(m))), s, m


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op2: 35-word windows; a half of the rows is the history of the other."""
    arrow_settings(spark)
    docs, row = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(b: pa.RecordBatch) -> dict:
        n, removed, kept = [], [], []
        for t, starts, lengths in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            w = words_of(t)
            n.append(len(w))
            gone = covered(len(w), WINDOW, starts, lengths)
            removed.append(int(gone.sum()))
            if removed[-1]:
                w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
            kept.append(hashlib.sha256(b" ".join(w)).hexdigest())
        return {"doc_id": b.column(0), "n_words": n, "n_removed": removed, "kept_sha256": kept}

    marked, s, m = with_marks(docs, repeated_windows(docs, doc_id=row), row)
    return map_batches(marked.select("doc_id", "text", s, m), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def keep_unrepeated(spark: SparkSession, docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with the words of repeated windows taken out of their texts; the rows and columns stay."""
    arrow_settings(spark)
    rows, row = keyed(docs)
    marked, starts, lengths = with_marks(rows, repeated_windows(rows.select(row, "text"), size=size, doc_id=row), row)
    names, at = docs.columns, docs.columns.index("text")

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        for b in batches:
            out = []
            for t, s, m in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                if t is not None and s is not None:
                    w = t.encode().split()
                    t = b" ".join([x for x, g in zip(w, covered(len(w), size, s, m).tolist(), strict=True) if not g]).decode()
                out.append(t)
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return marked.select(*names, starts, lengths).mapInArrow(without, docs.schema)
