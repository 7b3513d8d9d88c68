"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk toward the pooled covariance and its
diagonal. A score is the logistic of the difference of the classes' log densities, whose
Mahalanobis distances use Cholesky factors computed once. Only the text decides a score.
Sums for the fit are taken over all labelled training rows.

A null or empty text has the statistics of an empty text and gets a score like any other.
Rows whose label is null don't train, nor do rows with a null id, which no label marks; they are scored. Columns
beyond the named ones may have any name; where a class has no rows, the score is the share of
the other among the training rows, or 0.5 without any. Repeated ids are scored row by row
and train once per label row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_settings, byte_view, entered, give_back, held_out, map_batches, stored, table, word_hashes, word_spans

#: How far a class's covariance moves to the pooled one, and that to its diagonal.
TO_POOLED, TO_DIAGONAL = 0.2, 0.05
THRESHOLD = 0.3

STATISTICS = ("size", "words", "word_length", "capitals", "symbols", "digits", "breaks", "variety", "echoes", "commonest", "bars", "stops", "other", "shouts")
_DDL = "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS)


def _class_of_bytes() -> np.ndarray:
    kind = np.zeros((256, 7))
    for column, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*+<=>@[]\\^_`{}~/;:", b"0123456789", b"\n", b"|{}<>", b".,", b"!?")):
        kind[list(chars), column] = 1
    return kind


_KIND = _class_of_bytes()


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text: logarithms of sizes, square roots of shares."""
    b = byte_view((text or "").encode())
    n = max(1, len(b))
    counts = np.bincount(b, minlength=256)
    capitals, symbols, digits, breaks, bars, stops, shouts = counts @ _KIND
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    starts, ends = word_spans(b)
    h = word_hashes(b, starts, ends)
    w = max(1, len(h))
    _, repeats = np.unique(h, return_counts=True)
    same = np.count_nonzero(h[1:] == h[:-1]) + np.count_nonzero(h[2:] == h[:-2])
    return np.array([
        np.log1p(len(b)), np.log1p(len(h)), np.log1p((len(b) - len(h)) / w), np.sqrt(capitals / letters), np.sqrt(symbols / n), np.sqrt(digits / n), np.sqrt(breaks / w),
        np.log1p(len(repeats)) / np.log1p(w), np.sqrt(same / w), np.sqrt((repeats.max() if len(repeats) else 0) / w), np.sqrt(bars / n), np.sqrt(stops / w), np.sqrt(counts[128:].sum() / n), np.sqrt(shouts / n),
    ])


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        x = np.array([statistics(t) for t in b.column(1).to_pylist()])
        return {"doc_id": b.column(0)} | {name: x[:, i] for i, name in enumerate(STATISTICS)}

    return map_batches(docs.select(doc_id, text), run, _DDL)


class Discriminant:
    """The two classes' means, Cholesky factors and log determinants."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        """moments: by class the number of rows, the sums and the sums of products."""
        k = len(STATISTICS)
        self.total = {c: moments[c][0] if c in moments else 0 for c in (0, 1)}
        self.ready = min(self.total.values()) > 0
        if not self.ready:
            return
        mean = {c: moments[c][1] / moments[c][0] for c in (0, 1)}
        scatter = {c: moments[c][2] - moments[c][0] * np.outer(mean[c], mean[c]) for c in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / max(1, self.total[0] + self.total[1] - 2)
        self.parts = {}
        for c in (0, 1):
            own = scatter[c] / max(1, self.total[c] - 1)
            s = (1 - TO_POOLED) * own + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(k)
            root = np.linalg.cholesky(s)
            self.parts[c] = mean[c], np.linalg.inv(root), np.log(np.diag(root)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            n = sum(self.total.values())
            return np.full(len(x), self.total[1] / n if n else 0.5)
        density = {c: -0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - log_det + np.log(self.total[c]) for c, (mean, inverse, log_det) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Moments of all rows of stats that labels marks, summed by Spark; two rows reach the driver."""
    k = len(STATISTICS)
    rows = stats.join(labels.select("doc_id", F.col(label).alias("_label")).filter("_label in (0, 1)"), "doc_id")
    products = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(STATISTICS)] + [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in products]
    moments = {}
    for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        second = np.zeros((k, k))
        for i, j in products:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        moments[int(r["_label"])] = r["n"], np.array([r[f"s{i}"] for i in range(k)]), second
    return Discriminant(moments)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    def run(b: pa.RecordBatch) -> dict:
        x = np.column_stack([b.column(i + 1).to_numpy() for i in range(len(STATISTICS))])
        s = model.score(x)
        return {"doc_id": b.column(0), "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)}

    return map_batches(stats.select("doc_id", *STATISTICS), run, "doc_id long, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op3: rows with crc32(doc_id) mod 5 of 0 don't train."""
    arrow_settings(spark)
    out = held_out("doc_id", 5, 0)
    stats = stored(described(table(spark, sf_dir, "documents")), "quality-statistics")
    model = fit(stats.filter(~out), table(spark, sf_dir, "labels"))
    return scored(stats, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; the columns stay. Texts are described once more where they lie, so no text is shuffled."""
    arrow_settings(spark)
    model = fit(described(docs).filter(~held_out("doc_id", 5, 0)), labels)

    at = docs.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(model.score(np.array([statistics(t) for t in b.column(at).to_pylist()])) >= THRESHOLD))
        give_back()

    return docs.mapInArrow(good, docs.schema)
