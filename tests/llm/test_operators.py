import array
import collections
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, exact_dedup, jaccard, language, media, packing, quality, substring, suffix, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n long, digest string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(400)] + ["naïve", "Σχ", "日本", "don't", "<|endoftext|>"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(300), make(60)
    texts = [None, "", " \t\n", "one", "one two", "ONE two", make(5000), base, base, base + " ", base.replace("w1 ", "w2 ", 2), "a " * 200, "a " * 200]
    texts += [make(50) + " " + passage + " " + make(50) for _ in range(12)] + [make(rng.randint(1, 120)) for _ in range(30)]
    texts += [" ".join(w if rng.random() > 0.01 else "edit%d" % rng.randint(0, 9**6) for w in base.split()) for _ in range(15)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", 1, "x", 2, "y") for i, t in corpus], SCHEMA)


def test_exact(docs, corpus):
    rows = exact_dedup.digests(docs, exact_dedup.half()).cache()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup(rows).collect()}
    groups = collections.defaultdict(list)
    for i, t in corpus:
        groups["".join((t or "").split())].append((-len(t or ""), i))
    assert got == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_perfect_hash():
    for n in (1, 2, 7, 500):
        d = np.frombuffer(os.urandom(32 * n), np.uint8).reshape(n, 32)
        assert sorted(exact_dedup._slots(d, exact_dedup.perfect_hash(d), n)) == list(range(n))


@pytest.mark.parametrize("n", range(1, 65))
def test_perfect_hash_of_few(n):
    for seed in range(30):
        d = np.frombuffer(random.Random(seed).randbytes(32 * n), np.uint8).reshape(n, 32)
        assert sorted(exact_dedup._slots(d, exact_dedup.perfect_hash(d), n)) == list(range(n))


def test_substrings(docs, corpus):
    size = 20
    marks = substring.repeated_windows(docs, size=size)
    got = {r["doc_id"]: r for r in substring.marks_by_doc(marks).collect()}
    count, split = collections.Counter(), {i: (t or "").encode().split() for i, t in corpus}
    for w in split.values():
        count.update(tuple(w[p : p + size]) for p in range(len(w) - size + 1))
    for i, w in split.items():
        want = {p for p in range(len(w) - size + 1) if count[tuple(w[p : p + size])] > 1}
        have = {s + k for s, m in zip(got[i]["starts"], got[i]["lengths"], strict=True) for k in range(m)} if i in got else set()
        assert have == want
    kept = substring.keep_unrepeated(docs.sparkSession, docs, size)
    assert kept.columns == docs.columns
    assert kept.count() == docs.count()


@pytest.mark.parametrize("wide", [suffix.WIDE, 2])
def test_suffixes(docs, corpus, wide):
    size = 90
    marks = suffix.repeated_windows(docs, size, wide=wide)
    got = collections.defaultdict(set)
    for r in marks.collect():
        got[r["doc_id"]] |= set(range(r["start"], r["start"] + r["m"]))
    count, raw = collections.Counter(), {i: (t or "").encode() for i, t in corpus}
    for b in raw.values():
        count.update(b[p : p + size] for p in range(len(b) - size + 1))
    for i, b in raw.items():
        assert got[i] == {p for p in range(len(b) - size + 1) if count[b[p : p + size]] > 1}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(100):
        x = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(1, 40))) * rng.randint(1, 3)
        assert suffix.suffix_array(x, 999).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_array_of_some_places(monkeypatch):
    rng, directly = random.Random(1), []
    sort = suffix._sorted
    monkeypatch.setattr(suffix, "_sorted", lambda text, t, at, depth: directly.append(len(at)) or sort(text, t, at, depth))
    for _ in range(300):
        x = bytes(rng.choice(b"ab\x00c") for _ in range(rng.randint(1, 40))) * rng.randint(1, 3)
        of = np.array([rng.random() < 0.3 for _ in x])
        assert suffix.suffix_array(x, 999, of).tolist() == sorted(np.flatnonzero(of).tolist(), key=lambda i: x[i:])
        assert directly[-1] <= of.sum()


@pytest.mark.parametrize(("n", "num", "hot"), [(3, 90, 1000), (5, 80, 1000), (3, 90, 1)])
def test_jaccard(docs, corpus, monkeypatch, n, num, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    sets, parent = {}, {}
    for i, t in corpus:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs, n, num, 100).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_bound():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (5, 5, 5), (40, 45, 39), (300, 310, 250), (2000, 90, 80), (33, 32, 0), (5000, 5000, 4700)]:
        x = np.unique(rng.integers(0, 2**64, n + m - both, dtype=np.uint64))
        a, b = x[:n], x[n - both :]
        apart = len(np.setxor1d(a, b))
        least = jaccard.least_difference(jaccard.parity(a), jaccard.parity(b))
        assert least <= apart and (apart - least) % 2 == 0
        assert least == jaccard.least_difference(jaccard.parity(b), jaccard.parity(a))
        assert least > 0 or apart == 0 or n + m < 100


def test_bpe_and_packing(docs, corpus):
    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in corpus}
    for r in bpe.encoded(docs, path).collect():
        assert r["ids"] == want[r["doc_id"]]
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    for r in bpe.digested(docs, path).collect():
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[r["doc_id"]])).encode()).hexdigest()
        assert r["n_tokens"] == len(want[r["doc_id"]])
    rows = packing.pack(packing.pieces(docs, path).cache()).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        ids = [*want[r["doc_id"]], 1][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(array.array("I", ids).tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in want.values())
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:k]) for k, (o, _) in enumerate(b))
        assert sum(n for _, n in b) <= 4096


def test_plan_is_whole():
    rng = random.Random(3)
    for cap in (12, 100):
        for _ in range(50):
            counts = collections.Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 300)))
            seen, bins = collections.Counter(), collections.Counter()
            for length, first, n, copies, sequence, _ in packing.plan(dict(counts), cap):
                assert first == seen[length]
                seen[length] += n
                for r in range(n):
                    bins[sequence + r // copies] += length
            assert seen == counts
            assert max(bins.values()) <= cap


def test_gif(docs):
    for data in (os.urandom(192 * 300), b"ab" * 96 * 400, b"a" * 192):
        frames = list(media.decode(media.encode(data)))
        assert b"".join(f["samples"].tobytes() for f in frames) == data
    rows = {r["doc_id"]: r for r in media.digested(docs).collect()}
    assert rows[0]["payload_bytes"] == 192
    assert {k: v for k, v in rows[7].asDict().items() if k != "doc_id"} == {k: v for k, v in rows[8].asDict().items() if k != "doc_id"}
    assert media.stored_media(docs).filter("size(colours) > 0").count() == len(rows)


def test_gif_disposal_and_transparency():
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes([10, 20, 30, 40, 50, 60])

    def frame(samples, disposal, clear):
        codes = [4, *samples, 5]
        bits = sum(c << 3 * k for k, c in enumerate(codes))
        data = bits.to_bytes(2, "little")
        return b"!\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0]) + b"," + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2, len(data)]) + data + b"\0"

    frames = [f | {"canvas": f["canvas"].copy()} for f in media.decode(head + frame([0, 1], 1, None) + frame([1, 0], 3, 0) + frame([0, 1], 2, 0) + frame([0, 1], 1, 0) + b";")]
    assert [f["at_ms"] for f in frames] == [0, 50, 100, 150]
    px = [[tuple(int(v) for v in p) for p in f["canvas"][0]] for f in frames]
    a, b, none = (10, 20, 30, 255), (40, 50, 60, 255), (0, 0, 0, 0)
    assert px == [[a, b], [b, b], [a, b], [none, b]]


def test_warc(spark, tmp_path):
    long = "é" * 800
    pages = [(1, "u1", long), (2, "u\n2", long), (3, None, "short"), (4, "u4", "short"), (5, "u5", None), (6, "u6", "WARC/1.0\r\n" * 200), (7, "u7", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(spark, df, str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 7), 2: ("revisit", 7)} | {i: ("response", None) for i in (3, 4, 5, 6, 7)}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload"] in (None, raw)


def test_warc_of_large_pages_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000_000)
    long, huge = "x" * 1500, "y" * 1_200_000
    pages = [(None, "u", long), (None, None, None), (3, "u", long), (3, "u", long), (3, "v", "z" * 1200), (9, "u", huge), (10, "u", huge), (11, "u", huge[:-1])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("check", F.lit("clash")).withColumn("n", F.lit(1))
    path = str(tmp_path / "w")
    warc.write(spark, df, path)
    got = warc.read_logged(spark, path, str(tmp_path / "log"))
    rows = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect())
    assert rows == [(0, "response", None, 0), (0, "response", None, 1500), (3, "response", None, 1200), (3, "response", None, 1500), (3, "response", None, 1500), (9, "revisit", 10, 1200000), (10, "response", None, 1200000), (11, "response", None, 1199999)]
    assert not (tmp_path / "log").exists()
    damaged = next((tmp_path / "w" / "large").glob("part-*"))
    damaged.with_name("part-damaged").write_bytes(b"junk\n" + damaged.read_bytes())
    damaged.unlink()
    assert warc.read_logged(spark, path, str(tmp_path / "log")).count() == 8
    assert [(r["start"], r["size"]) for r in spark.read.json(str(tmp_path / "log")).collect()] == [(0, 5)]
    assert warc.read(spark, path).count() == 9


def test_warc_of_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(spark, df, str(tmp_path / "w"))
    assert warc.read_logged(spark, str(tmp_path / "w"), str(tmp_path / "log")).count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage(spark, zipped):
    df = spark.createDataFrame([(i, "u", "body %d" % i * 50) for i in range(5)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "page_id long, check long, refers_to long")
    raw = [r["value"].encode() for r in warc.records(df, none).collect()]
    parts = [warc.member(r) if zipped else r + b"\r\n\r\n" for r in raw]
    parts[2] = parts[2][: len(parts[2]) // 2] + b"\0\1\2" + parts[2][len(parts[2]) // 2 + 9 :]
    items = list(warc.salvage(b"".join(parts)))
    assert [x["kind"] for x in items] == ["record", "record", "gap", "record", "record"]
    assert items[2]["start"] == len(parts[0] + parts[1])
    assert items[2]["size"] == len(parts[2])


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(80)]
        rows.append((i, " ".join(w) if good else " ".join([w[0] + "!!"] * 80).upper()))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, "")]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.described(df)
    got = {r["doc_id"]: r for r in quality.scored(stats, quality.fit(stats, lab)).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    assert got[1000]["score"] == got[1001]["score"]
    alone = quality.fit(stats, lab.limit(0))
    assert {r["score"] for r in quality.scored(stats, alone).collect()} == {0.5}
    assert quality.keep_good(spark, df, lab).count() >= 300


def test_language(spark):
    words = {"en": "the of and house water people", "fr": "le des château être peuple où", "ru": "дом вода люди и не что"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(30)), x) for i in range(60) for x in [list(words)[i % 3]]]
    rows += [(100, None, None), (101, "123 !!", None), (102, words["en"] * 3 + " " + words["ru"] * 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.labelled(df, language.fit(df)).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows if x)
    assert (got[100]["lang_pred"], got[101]["lang_pred"]) == ("und", "und")
    assert got[102]["span_lang"] == ["en", "ru"]


def test_empty_tables(docs):
    none = docs.limit(0)
    spark = docs.sparkSession
    assert exact_dedup.keep_first(spark, none).count() == 0
    assert jaccard.classes(none, 3, 90, 100).count() == 0
    assert substring.keep_unrepeated(spark, none).count() == 0
    assert suffix.repeated_windows(none).count() == 0
    assert packing.pack(packing.pieces(none, bpe.tokenizer_path())).count() == 0
    assert language.labelled(none, language.fit(none)).count() == 0


def test_null_ids_and_repeats(spark):
    text = " ".join("w%d" % i for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "x y z")], "doc_id long, text string")
    assert jaccard.classes(df, 3, 90, 100).filter(F.col("doc_id").isNull() & F.col("component_id").isNotNull()).count() == 0
    assert exact_dedup.keep_first(spark, df).count() == 2
    assert jaccard.keep_representatives(spark, df).count() == 2
    assert substring.keep_unrepeated(spark, df).count() == 4
