"""The contract queries and the pipeline's stages at their production sizes against brute force, over tables made here."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillspark.llm import bpe, exact_dedup, jaccard, language, media, packing, quality, substring, suffix, warc

SPACE = " \t\n\v\f\r"


def split(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)] + ["été", "naïve", "日本"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage, line = make(250), make(80), "une ligne qui revient souvent. "
    texts = [None, "", " \n ", "seul", make(9000), line * 60, base, base, base + "\n", base.replace(" ", "  ", 3), base.upper(), passage, passage + " x"]
    texts += [make(40) + " " + passage + " " + make(45) for _ in range(8)] + [make(rng.randint(1, 90)) for _ in range(25)]
    texts += [" ".join(w if rng.random() > 0.008 else "edit%d" % rng.randint(0, 9**6) for w in base.split()) for _ in range(10)]
    texts += ["!!! ### " * rng.randint(5, 40) for _ in range(12)]
    return [(i * 7, t, ["en", "fr", None][i % 3], "hot" if i % 3 else "s%d" % i, len(t or "")) for i, t in enumerate(texts)]


def save(folder, name, columns):
    pq.write_table(pa.table(columns), f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def sf(corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    ids, texts, langs, sources, sizes = map(list, zip(*corpus, strict=True))
    save(folder, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": sources, "n_chars": pa.array(sizes, pa.int64())})
    labelled = [(i, 0 if (t or "").startswith("!!!") else 1) for i, t, *_ in corpus if t and len(t) > 30]
    save(folder, "labels", {"doc_id": pa.array([i for i, _ in labelled], pa.int64()), "quality": pa.array([q for _, q in labelled], pa.int32()), "toxic": pa.array([0] * len(labelled), pa.int32())})
    save(folder, "pages", {"page_id": pa.array([1, 2], pa.int64()), "url": ["u", None], "html": ["h" * 1200, None]})
    return folder


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    none = lambda *kinds: [pa.array([], k) for k in kinds]
    save(folder, "documents", dict(zip(("doc_id", "text", "lang", "source", "n_chars"), none(pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)))
    save(folder, "labels", dict(zip(("doc_id", "quality", "toxic"), none(pa.int64(), pa.int32(), pa.int32()), strict=True)))
    save(folder, "pages", dict(zip(("page_id", "url", "html"), none(pa.int64(), pa.string(), pa.string()), strict=True)))
    return folder


def removed_units(units, size):
    """Per text which units a window of size units covers that starts anywhere else too."""
    count = collections.Counter(bytes(u[p : p + size]) if isinstance(u, bytes) else tuple(u[p : p + size]) for u in units.values() for p in range(len(u) - size + 1))
    out = {}
    for i, u in units.items():
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - size + 1):
            if count[bytes(u[p : p + size]) if isinstance(u, bytes) else tuple(u[p : p + size])] > 1:
                gone[p : p + size] = True
        out[i] = gone
    return out


def test_op2(spark, sf, corpus):
    words = {i: split(t) for i, t, *_ in corpus}
    gone = removed_units(words, 35)
    want = {i: (len(w), int(gone[i].sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone[i], strict=True) if not g)).hexdigest()) for i, w in words.items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op2_substring_dedup(spark, sf).collect()} == want
    assert sum(w[1] > 0 for w in want.values()) > 15


def test_op6(spark, sf, corpus):
    raw = {i: (t or "").encode() for i, t, *_ in corpus}
    gone = removed_units(raw, 400)
    want = {}
    for i, b in raw.items():
        g = gone[i]
        spans = int(np.count_nonzero(np.diff(g.astype(int), prepend=0) == 1))
        want[i] = (len(b), int(g.sum()), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest())
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.op6_suffix_array(spark, sf).collect()} == want
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_batches_of_the_log_equal_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = [sorted({(r["doc_id"], r["start"] + k) for r in substring.repeated_windows(docs, batches=n, size=12).collect() for k in range(r["m"])}) for n in (1, 3, 6)]
    assert marks[0] and marks[0] == marks[1] == marks[2]


def test_log_goes_on_in_a_folder(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), substring.SERIES)
    path = str(tmp_path / "log")
    log = substring.FingerprintLog(spark, path)
    assert log.add(rows((1, 10, 100, 0, 3, 1), (1, 11, 101, 3, 3, 1))).count() == 0
    again = substring.FingerprintLog(spark, path)  # another session would open it like this
    assert sorted(tuple(r) for r in again.add(rows((2, 10, 100, 5, 3, 1), (2, 11, 999, 8, 1, 1), (2, 12, 102, 9, 1, 1))).select("gram", "print", "n", "prints").collect()) == [(10, 100, 2, 1), (11, 101, 1, 2), (11, 999, 1, 2)]
    assert again.runs() == [(0, 0), (1, 1)]
    again.compact()
    assert again.runs() == [(0, 1)]
    assert sorted(tuple(r) for r in again.read((0, 1)).collect()) == [(10, 100, 2, 2, 1), (11, 101, 1, 1, 1), (11, 999, 1, 1, 2), (12, 102, 1, 1, 2)]
    assert again.add(rows((3, 12, 102, 0, 1, 1))).collect()[0]["n"] == 2


def discriminant(x, y, test):
    """A plain regularised quadratic discriminant."""
    parts = {}
    pooled = sum((np.cov(x[y == c].T) * ((y == c).sum() - 1) for c in (0, 1))) / (len(y) - 2)
    for c in (0, 1):
        s = (1 - quality.TO_POOLED) * np.cov(x[y == c].T) + quality.TO_POOLED * pooled
        s = (1 - quality.TO_DIAGONAL) * s + quality.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(s))
        d = test - x[y == c].mean(axis=0)
        parts[c] = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log((y == c).sum())
    return 1 / (1 + np.exp(np.clip(parts[0] - parts[1], -500, 500)))


def test_op3(spark, sf, corpus):
    labels = dict(zip(*pq.read_table(f"{sf}/labels.parquet").select(["doc_id", "quality"]).to_pydict().values(), strict=True))
    x = {i: quality.statistics(t) for i, t, *_ in corpus}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in x}
    train = [i for i in labels if not out[i]]
    score = discriminant(np.array([x[i] for i in train]), np.array([labels[i] for i in train]), np.array(list(x.values())))
    got = {r["doc_id"]: r for r in quality.op3_quality(spark, sf).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == out
    assert np.allclose([got[i]["score"] for i in x], score, atol=1e-6)
    assert all(got[i]["predicted"] == int(s >= 0.3) for i, s in zip(x, score, strict=True) if abs(s - 0.3) > 1e-6)


def plain_gif(data):
    """Samples of a GIF's frames, code by code."""
    at, out = 13 + 3 * (2 << (data[10] & 7)), []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            assert data[at] == 0x2C
            at += 10
            least, at = data[at], at + 1
        block = b""
        while data[at]:
            block += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if len(block) > 4 or block and block[0] != 4:
            bits, place, width = int.from_bytes(block, "little"), 0, least + 1
            known, prev, samples = {}, None, b""
            while True:
                code, place = bits >> place & (1 << width) - 1, place + width
                if code == 1 << least:
                    known, prev, width = {k: bytes([k]) for k in range(1 << least)}, None, least + 1
                    new = (1 << least) + 2
                    continue
                if code == (1 << least) + 1:
                    break
                entry = known.get(code) or prev + prev[:1]
                samples += entry
                if prev is not None and new < 4096:
                    known[new] = prev + entry[:1]
                    new += 1
                    if new == 1 << width and width < 12:
                        width += 1
                prev = entry
            out.append(samples)
    return out


def test_op9(spark, sf, corpus):
    got = {r["doc_id"]: r for r in media.op9_gif_media(spark, sf).collect()}
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r, gif = got[i], media.encode(payload)
        if len(payload) < 9000:
            assert b"".join(plain_gif(gif)) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(gif), hashlib.sha256(gif).hexdigest())
        grey = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16).tolist()
        assert f";grey={','.join(map(str, grey))};shown={','.join(map(str, grey))};" in r["feature"]


def test_frames_of_a_column(spark):
    head = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0, 10, 20, 30, 250, 50, 60])
    frame = lambda disposal, clear, body: b"!\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0]) + b"," + bytes([0, 0, 0, 0, 2, 0, 1, 0, 0, 2, 2]) + body + b"\0"
    codes = lambda *s: sum(c << 3 * k for k, c in enumerate([4, *s, 5])).to_bytes(2, "little")
    gif = head + frame(1, None, codes(0, 1)) + frame(2, 0, codes(0, 1)) + frame(1, 1, codes(0, 1)) + b";"
    df = spark.createDataFrame([(1, gif), (2, None), (3, b"no"), (4, gif[:30])], "k long, g binary")
    rows = media.frames(df, "k", "g").orderBy("id", "frame").collect()
    assert [(r["id"], r["frame"], r["at_ms"], r["error"] is None) for r in rows] == [(1, 0, 0, True), (1, 1, 50, True), (1, 2, 100, True), (3, None, None, False), (4, None, None, False)]
    a, b, none = bytes([10, 20, 30, 255]), bytes([250, 50, 60, 255]), bytes(4)
    assert [bytes(r["canvas"]) for r in rows[:3]] == [a + b, a + b, a + none]
    assert [sum(r["colours"]) for r in rows[:3]] == [2, 1, 1]


def test_op10(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.filter(~language.held_out("doc_id", 4, 2)))
    got = {r["doc_id"]: r for r in language.op10_language_id(spark, sf).collect()}
    k = len(model.langs)
    for i, t, *_ in corpus:
        words = (t or "").lower().split()
        model.learn(words)
        emit, letters = [model.scores[model.words[w]] for w in words], [model.sizes[model.words[w]] for w in words]
        paths = [[(emit[0][j], [j]) for j in range(k)]] if words else []
        for e in emit[1:]:
            last, now = paths[-1], []
            for j in range(k):
                best = max(range(k), key=lambda m: last[m][0] - (language.SWITCH if m != j else 0))
                if last[j][0] >= last[best][0] - language.SWITCH:
                    best = j
                now.append((last[best][0] - (language.SWITCH if best != j else 0) + e[j], last[best][1] + [j]))
            paths = [now]
        share = np.zeros(k)
        if words:
            for j, n in zip(max(paths[-1], key=lambda p: p[0])[1], letters, strict=True):
                share[j] += n
        want = (model.langs[int(share.argmax())], share.max() / share.sum()) if share.sum() else ("und", 0.0)
        assert (got[i]["lang_pred"], pytest.approx(got[i]["score"])) == want
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_pipeline(spark, sf, corpus):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good, exact, near, left = seen
    score = {r["doc_id"]: r["predicted"] for r in quality.op3_quality(spark, sf).collect()}
    assert set(good) == {i for i, p in score.items() if p}
    groups = collections.defaultdict(list)
    for i, t in good.items():
        groups["".join(c for c in t or "" if c not in SPACE)].append((-len(t or ""), i))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()} for i, t in exact.items() for w in [split(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).decode())]}
    leader = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    leader[i] = leader[j] = min(leader[i], leader[j])
        if all(leader[leader[i]] == leader[i] for i in leader):
            break
    assert set(near) == {i for i in leader if leader[i] == i}
    words = {i: split(t) for i, t in near.items()}
    gone = removed_units(words, 35)
    assert {i: split(t) for i, t in left.items()} == {i: [x for x, g in zip(w, gone[i], strict=True) if not g] for i, w in words.items()}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    model = bpe.model(bpe.tokenizer_path())
    size = collections.Counter()
    for r in rows:
        size[r["doc_id"]] += r["length"]
    assert size == {i: len(model.encode(t or "")) + 1 for i, t in left.items()}
    whole = corpus_pipeline.run(spark, sf)
    key = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert key(whole.collect()) == key(rows)


QUERIES = (exact_dedup.op1_exact_dedup, substring.op2_substring_dedup, quality.op3_quality, bpe.op4_bpe, warc.op5_warc, suffix.op6_suffix_array, jaccard.op7_jaccard_join, packing.op8_best_fit_packing, media.op9_gif_media, language.op10_language_id, corpus_pipeline.run)


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.__name__)
def test_empty(spark, empty, query):
    assert query(spark, empty).count() == 0


def test_repeated_and_null_ids_with_clashing_names(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("w%d" % rng.randint(0, 300) for _ in range(n))
    passage, long = make(60), make(900)
    texts = [(5, "a b " + passage), (5, long + " " + passage), (None, passage + " c"), (None, None), (None, "d " + passage), (7, ""), (7, "e f")]
    names = "doc_id long, text string, starts string, lengths long, _starts int, _row string, digest string, bucket int, m int, n long"
    df = spark.createDataFrame([(i, t, "x", 1, 2, "r", "d", 3, 4, 5) for i, t in texts], names)
    kept = substring.keep_unrepeated(spark, df)
    assert kept.columns == df.columns
    assert sorted((r["text"] is None, r["text"]) if r["text"] else (r["text"] is None, "") for r in kept.collect()) == sorted([(False, "a b"), (False, long), (False, "c"), (True, ""), (False, "d"), (False, ""), (False, "e f")])
    assert jaccard.keep_representatives(spark, df).columns == df.columns
    more = df.unionByName(df)
    first = exact_dedup.keep_first(spark, more)
    assert first.columns == df.columns
    assert sorted(r["text"] or "" for r in first.collect()) == sorted({t or "" for _, t in texts})
    groups = exact_dedup.dedup(exact_dedup.digests(more, exact_dedup.half()).cache())
    by_text = {(r["digest"], r["keep_id"], r["group_size"]) for r in groups.collect()}
    assert len(by_text) == 6 and sum(k is None for _, k, _ in by_text) == 2
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    assert quality.keep_good(spark, df, labels).columns == df.columns
    assert packing.pack(packing.pieces(df, bpe.tokenizer_path()).cache()).count() == 7
    assert language.labelled(df, language.fit(df.withColumn("lang", df.digest))).count() == 7
    assert bpe.encoded(df, bpe.tokenizer_path()).count() == media.stored_media(df).count() == 7
