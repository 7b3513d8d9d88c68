"""Suffix-array dedup: two-stage suffix sorting and adjacent common prefixes.

The suffixes smaller than their successors are sorted directly, the others are induced by
scanning the buckets of first bytes in order. Only as many bytes as a window has decide
the order, and of the suffixes too short for a window only those are sorted that others are
induced from. Neighbours with a common prefix of a window's length are repeated strings.

A corpus is sorted in many small arrays: windows that are equal lie in stretches with the
same gram (see anchors), so the distinct stretches of one gram go to one array. Of a stretch
that occurs several times, by its digest, two occurrences go there, and what the array finds
of the first holds for all; a stretch whose gram occurs once needs no array. Grams with more
than WIDE distinct stretches are dealt by the bytes that the windows of a narrow cell share,
of which equal ones collapse, so no array grows with the corpus.

Null texts count as empty; matches never cross texts. Texts shorter than a window keep
everything. Rows with a null or repeated id are rows like others, told apart by a number of
their own. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.anchors import covered, digest64, stretches
from quillspark.llm.common import _BYTE, arrow_schema, arrow_settings, as_batch, byte_view, entered, give_back, keyed, map_batches, picked, stored, table
from quillspark.llm.substring import STRETCH, joined_by_pair, with_marks

SIZE = 400
DOUBLINGS = 5
#: Distinct stretches of a gram that one array takes at most.
WIDE = 4000
#: Window starts of one cell of a wider gram.
CELL = 4
#: Bytes of stretches that are sorted together, at least, unless the task has no more.
ARRAY_BYTES = 1 << 20
#: Neighbours whose bytes are compared together.
PAIRS = 4096
#: Ends a stretch; UTF-8 has no such byte.
END = b"\xff"


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't, as the empty suffix is the least."""
    step = np.sign(np.diff(t.astype(np.int16), append=-1))
    at = np.where(step != 0, np.arange(len(t)), len(t))
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def chained(small: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The positions that the order of those `of` follows from: each up to the next suffix that is sorted directly."""
    direct = np.append(np.flatnonzero(small), len(small) - 1)
    at = np.flatnonzero(of)
    change = np.bincount(at, minlength=len(small) + 1)
    change -= np.bincount(direct[np.searchsorted(direct[:-1], at)] + 1, minlength=len(small) + 1)
    return np.cumsum(change[:-1]) > 0


def suffix_array(text: bytes, depth: int, of: np.ndarray | None = None) -> np.ndarray:
    """The suffixes in the order of their first depth bytes, at least; of: only those at these positions (a mask) are wanted, and no more are sorted than their order follows from."""
    t = np.frombuffer(text, np.uint8)
    small = smaller(t)
    need = np.ones(len(t), bool) if of is None else chained(small, of)
    induced = need & ~small
    direct = _sorted(text, t, np.flatnonzero(need & small), depth)
    head = t[direct]
    edge = np.searchsorted(head, np.arange(257)).tolist()
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[-1]:
        larger[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        done = 0
        while done < len(larger[c]):  # bytes equal to the bucket's own lengthen its list while it is scanned
            part = larger[c][done]
            done += 1
            out.append(part)
            _induce(part, t, induced, larger)
        part = direct[edge[c] : edge[c + 1]]
        if len(part):
            out.append(part)
            _induce(part, t, induced, larger)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order if of is None else order[of[order]]


def _sorted(text: bytes, t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, one bucket of equal first two bytes at a time, so that few keys are held at once."""
    two = t[at].astype(np.uint16) << 8 | t[np.minimum(at + 1, len(t) - 1)]
    order = np.argsort(two, kind="stable")
    at, two = at[order], two[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(two)) + 1, [len(at)]]).tolist()
    places, out = at.tolist(), []
    for a, b in zip(edges, edges[1:], strict=False):
        out += places[a:b] if b - a < 2 else sorted(places[a:b], key=lambda i: text[i : i + depth])
    return np.array(out, np.int64)


def _induce(part: np.ndarray, t: np.ndarray, induced: np.ndarray, larger: list[list[np.ndarray]]) -> None:
    """Puts the predecessors of a bucket's part that are to be induced into their buckets, in order."""
    before = part[part > 0] - 1
    before = before[induced[before]]
    if not len(before):
        return
    byte = t[before]
    order = np.argsort(byte, kind="stable")
    before, byte = before[order], byte[order]
    cuts = [0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(byte)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        larger[byte[x]].append(before[x:y])


def common_prefixes(text: bytes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, counted up to most."""
    words = -(-most // 8)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(8 * words), np.uint8), 8 * words)
    lcp = np.full(len(a), most, np.int64)
    for k in range(0, len(a), PAIRS):
        x, y = (rows[c[k : k + PAIRS]].view(np.uint64) for c in (a, b))
        apart = x != y
        at = apart.argmax(axis=1)
        some = np.flatnonzero(apart[np.arange(len(at)), at])
        last = (x[some, at[some]] ^ y[some, at[some]]).view(np.uint8).reshape(-1, 8)
        lcp[k + some] = 8 * at[some] + (last != 0).argmax(axis=1)
    return np.minimum(lcp, most)


def repeated_starts(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each text the starts of strings of size bytes that start anywhere else in the texts too, by one suffix array over all."""
    lengths = np.array([len(x) + 1 for x in texts])
    whole = END.join(texts) + END
    ends = np.cumsum(lengths)
    window = np.zeros(len(whole), bool)
    for x, n in zip((ends - lengths).tolist(), lengths.tolist(), strict=True):
        window[x : x + max(0, n - size)] = True
    order = suffix_array(whole, size, window)
    twice = np.zeros(len(whole), bool)
    if len(order) > 1:
        pair = np.flatnonzero(common_prefixes(whole, order[:-1], order[1:], size) >= size)
        twice[order[pair]] = twice[order[pair + 1]] = True
    return [np.flatnonzero(twice[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def cut(text: str | None, size: int = SIZE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and grams, first windows, numbers of windows and places of the grams of the stretches."""
    raw = (text or "").encode()
    gram, first, m, at = stretches(_BYTE[byte_view(raw)], size, DOUBLINGS)
    return raw, gram.view(np.int64), first, m, at


def found(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stretches of all documents."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in STRETCH.split(", ")}
        for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw, gram, first, m, _ = cut(t, size)
            out["doc_id"] += [doc] * len(gram)
            out["gram"] += gram.tolist()
            out["start"] += first.tolist()
            out["m"] += m.tolist()
            out["print"] += [digest64(raw[f : f + k + size - 1]) for f, k in zip(first.tolist(), m.tolist(), strict=True)]
        return out

    return map_batches(docs.select(doc_id, text), run, STRETCH)


_PART = "doc_id long, key long, start long, n long, bytes binary, gram long, print long, first long"


def wanted(docs: DataFrame, entries: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text of the documents whose stretches enter arrays, and lists of these: print, n (0 of a stretch's second occurrence), prints of the gram."""
    one = entries.select(F.col("rep").alias("doc_id"), "print", "n", "prints")
    two = entries.filter("n > 1").select(F.col("other").alias("doc_id"), "print", F.lit(0).cast("long").alias("n"), "prints")
    per_doc = stored(one.unionByName(two).groupBy("doc_id").agg(F.collect_list(F.struct("print", "n", "prints")).alias("e")), "suffix-wanted")
    whole = picked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), per_doc.select("doc_id"), "doc_id")
    return whole.join(per_doc, "doc_id").select("doc_id", "text", F.col("e.print").alias("print"), F.col("e.n").alias("n"), F.col("e.prints").alias("prints"))


def parts(texts: DataFrame, size: int, wide: int = WIDE) -> DataFrame:
    """The bytes of the wanted stretches, with the key of the array that they go to, their first window and that of the whole stretch."""

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {x.split()[0]: [] for x in _PART.split(", ")}
        for doc, t, taken, n, prints in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            raw, gram, first, m, at = cut(t, size)
            place: dict[int, list[int]] = {}
            for i, (f, k) in enumerate(zip(first.tolist(), m.tolist(), strict=True)):
                place.setdefault(digest64(raw[f : f + k + size - 1]), []).append(i)
            for print_, count, several in zip(taken, n, prints, strict=True):
                i = place[print_][0 if count else -1]
                g, f, k, x = (int(c[i]) for c in (gram, first, m, at))
                if several <= wide:
                    made = [(g, f, f + k - 1)]
                else:
                    made = []
                    for cell in range((x - f - k + 1) // CELL, (x - f) // CELL + 1):
                        low, high = x - cell * CELL - CELL + 1, x - cell * CELL
                        core = raw[max(0, high) : low + size]
                        made.append((digest64(b"%d %d " % (g, cell) + core), max(f, low), min(f + k - 1, high)))
                for key, low, high in made:
                    for column, v in zip(out.values(), (doc, key, low, count, raw[low : high + size], g, print_, f), strict=True):
                        column.append(v)
        return out

    return map_batches(texts, run, _PART)


_MARK = "doc_id long, start long, m long, n long, gram long, print long"


def repeated_parts(rows: DataFrame, size: int) -> DataFrame:
    """The windows of parts() that are repeated among those with the same key, as runs: of a stretch that occurs once by its document, of others by gram and print, counted from the stretch's first window."""
    schema = arrow_schema(_MARK)

    def solve(groups: list[dict[bytes, list[tuple]]]) -> pa.RecordBatch:
        texts, owners = [], []
        for g in groups:
            for data, own in g.items():
                texts.append(data)
                owners.append(own)
                if len(own) > 1:  # two occurrences of one stretch, or equal parts of different ones
                    texts.append(data)
                    owners.append([])
        out: dict[str, list] = {c: [] for c in schema.names}
        for starts, own in zip(repeated_starts(texts, size) if texts else [], owners, strict=True):
            cuts = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
            m = np.diff(cuts, append=len(starts)).tolist()
            for doc, start, n, gram, print_, first in own:
                if n:
                    k = len(m)
                    out["doc_id"] += [doc if n == 1 else None] * k
                    out["start"] += (start - (first if n > 1 else 0) + starts[cuts]).tolist()
                    out["m"] += m
                    out["n"] += [n] * k
                    out["gram"] += [gram] * k
                    out["print"] += [print_] * k
        return as_batch(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entered()
        groups: list[dict[bytes, list[tuple]]] = []
        key, held = None, 0
        names = ("key", "bytes", "doc_id", "start", "n", "gram", "print", "first")
        for b in batches:
            for k, data, *own in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if k != key:
                    if held >= ARRAY_BYTES:
                        yield solve(groups)
                        groups, held = [], 0
                    groups.append({})
                    key = k
                if data not in groups[-1]:
                    held += len(data)
                groups[-1].setdefault(data, []).append(tuple(own))
        yield solve(groups)
        give_back()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _MARK)


def repeated_windows(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """Marks (doc_id, start, m) of all strings of size bytes that start twice; ids must tell the rows apart."""
    rows = stored(found(docs, size, doc_id, text), "suffix-stretches")
    entries = rows.groupBy("gram", "print").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"))
    grams = entries.groupBy("gram").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("prints")).filter("total > 1")
    entries = stored(entries.join(grams, "gram").select("print", "n", "rep", "other", "prints"), "suffix-repeated")
    found_ = stored(repeated_parts(parts(wanted(docs, entries, doc_id, text), size, wide), size), "suffix-found")
    whole = joined_by_pair(rows, found_.filter("n > 1").select("gram", "print", "n", F.col("start").alias("offset"), F.col("m").alias("run")), rows.count())
    once = found_.filter("n = 1").select("doc_id", "start", "m")
    return stored(whole.select("doc_id", (F.col("start") + F.col("offset")).alias("start"), F.col("run").alias("m")).unionByName(once), "suffix-marks")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op6: strings of 400 bytes."""
    arrow_settings(spark)
    docs, row = keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for t, starts, lengths in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = byte_view((t or "").encode())
            gone = covered(len(raw), SIZE, starts, lengths)
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
            out["kept_sha256"].append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
        return {"doc_id": b.column(0)} | out

    marked, s, m = with_marks(docs, repeated_windows(docs, doc_id=row), row)
    return map_batches(marked.select("doc_id", "text", s, m), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
