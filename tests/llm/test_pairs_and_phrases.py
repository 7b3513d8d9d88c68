"""op11, op12 and op13 against brute force, and the bounds of caches and decoders."""

import collections
import hashlib
import random
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment, blocks, bpe, collocation, jaccard, language, media, minhash

A, B = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model")


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 9**6)}" for w in words.split())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["日本", "1,234.5", "don't", "A_b", "😀"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = make(120)
    out = [None, "", " ", "one", "Two words", "two  WORDS", "\n\ta  b   c\n", "a ▁ b", "x\x00y", "<|endoftext|> <s> <0x41>", "a" * 3000, make(3000), "né. né! né, né; né: né? né\nné\rné"]
    out += [base, base, base.upper(), base + "\n"] + [edited(rng, base, s) for s in (0.004, 0.01, 0.02, 0.03, 0.05) for _ in range(8)]
    out += ["New York, new york. new york city! in new york city " * 4, "of the of the of the. of the"] * 4 + [make(rng.randint(1, 60)) for _ in range(30)]
    return out


@pytest.fixture(scope="module")
def sf(texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pairs"))
    langs = [["en", "fr", None][i % 3] for i in range(len(texts))]
    pq.write_table(pa.table({"doc_id": pa.array([3 * i for i in range(len(texts))], pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "id": ["clash"] * len(texts), "block": ["clash"] * len(texts)}), f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def none(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string())}), f"{folder}/documents.parquet")
    return folder


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near(texts, n, num, den):
    """doc id, set size and least reachable id by comparing all sets."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    return {3 * i: (len(s), 3 * label[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("rounds,part", [(3, 2048), (0, 2), (1, 3)])
def test_op11(spark, sf, texts, monkeypatch, rounds, part):
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "PART", part)
    want = near(texts, 3, 85, 100)
    rows = minhash.op11_minhash_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert 5 < len(want) - len({c for _, c in want.values()})


def test_op11_takes_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "p q r s"), (2, "p q r s"), (3, None), (None, "")]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_matches_leave_out_next_to_none():
    assert minhash.matches(85, 100, 64, 1e-9) in range(30, 42)
    assert minhash.matches(1, 1) == minhash.K
    rng = np.random.default_rng(3)
    worst = minhash.K
    for _ in range(300):
        shared, own = rng.integers(0, 2**63, 850, dtype=np.uint64), rng.integers(0, 2**63, 150, dtype=np.uint64)
        x, y = (minhash.signature(np.concatenate([shared, o])) for o in (own[:75], own[75:]))
        worst = min(worst, int((x == y).sum()))
    assert worst >= minhash.matches(85, 100)


def phrases(rows, least, top):
    """Everything by counting tuples."""
    count, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in range(1, 5):
                count[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        part = collections.defaultdict(list)
        for g in found:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    part[g[i : i + k]].append(g)
        ranked = []
        for g, a in found.items():
            if not any(100 * found[x] >= 80 * a for x in part[g]):
                score, _, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))  # noqa: E741
                ranked.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 25, 500])
def test_op12(spark, sf, texts, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    rows = [(["en", "fr", "und"][i % 3], t) for i, t in enumerate(texts)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    got = sorted(map(tuple, collocation.collocations(docs, top=25, least=4).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    want = phrases(rows, 4, 25)
    assert got == want and len(want) == 75
    if size > 500:
        assert sorted(map(tuple, collocation.op12_phrase_collocation(spark, sf).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == phrases(rows, 30, 2000)


def aligned(texts):
    """Groups, links and counts by walking along both vocabularies' tokens of whole texts."""
    t, out, count = alignment.tokenizers(A, B), [], collections.Counter()
    for x in texts:
        a, b = (t.a.encode(" " + x, add_special_tokens=False).ids, t.b.encode(x)) if x else ([], [])
        left, right = [t.bytes_a[i] for i in a], [t.bytes_b[i] for i in b]
        if b"".join(left) != (raw := (" " + (x or "")).encode()) or b"".join(right) != raw:
            out.append(([], [], [], []))
            continue
        ends = [list(np.cumsum([len(v) for v in side])) for side in (left, right)]
        groups, i, j = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        out.append((a, b, groups, [(v, w) for g, h in groups for v in g for w in h]))
        count.update(set(out[-1][3]))
    best = collections.Counter()
    for (v, _), n in count.items():
        best[v] = max(best[v], n)
    text = lambda groups: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return [(len(a), len(b), len(g), len(n), sum(count[x] == best[x[0]] for x in n), sum(count[x] for x in n), text(g)) for a, b, g, n in out]


@pytest.mark.parametrize("size", [1 << 25, 300])
def test_op13(spark, sf, texts, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    want = aligned(texts)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    rows = {r["doc_id"]: tuple(r)[1:] for r in alignment.op13_cross_tokenizer(spark, sf).collect()}
    assert rows == {3 * i: (*w[:-1], digest(w[-1])) for i, w in enumerate(want)}
    assert sum(w[0] == 0 for w in want) == 3  # null, empty, and the sign that stands for a space
    if size == 300:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        assert {r["doc_id"]: r["groups"] for r in alignment.aligned(docs, A, B).collect()} == {3 * i: w[-1] for i, w in enumerate(want)}


@pytest.mark.parametrize("groups", [1, 7, 10**6])
def test_links_of_few_groups_at_a_time(monkeypatch, groups):
    monkeypatch.setattr(alignment, "GROUPS", groups)
    rng = np.random.default_rng(1)
    n_a, n_b = rng.integers(1, 4, 50), rng.integers(1, 4, 50)
    first = np.cumsum(n_a + n_b) - n_a - n_b
    tokens = rng.integers(0, 9, int((n_a + n_b).sum())).astype(np.int32)
    pairs, dense = alignment._pairs(tokens, first, n_a, n_b, 100_000)
    want = [int(x) * 100_000 + int(y) for f, a, b in zip(first, n_a, n_b, strict=True) for x in tokens[f : f + a] for y in tokens[f + a : f + a + b]]
    assert pairs[dense].tolist() == want and pairs.tolist() == sorted(set(want))


def test_cuts_change_no_token():
    t, rng = alignment.tokenizers(A, B), random.Random(9)
    assert t.cuts
    parts = [" ", "  ", "\n", "\t", "\r", " ", " ", "\x1c", "\x00", "a", "Zé", "the", "ing", "12", "²", ".", ",", "!", "'s", "'", "-", "_", "“", "…", "日本", "😀", "<s>", "<|endoftext|>", "<0x41>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        names = alignment.Names()
        numbers = alignment.Pieces(names).numbers(text)
        found = [list(names)[i] for i in numbers]
        assert found == alignment.chunks(text) and "".join(found) == " " + text
        assert sum(t.encode_a(found), []) == t.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(t.encode_b(found), []) == t.b.encode(text)


def test_uncut_texts_give_the_same(spark, sf, texts, monkeypatch):
    monkeypatch.setattr(alignment.tokenizers(A, B), "cuts", False)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2000 or text is null")
    want = {3 * i: w for i, w in enumerate(aligned([x if len(x or "") < 2000 else None for x in texts])) if len(texts[i] or "") < 2000}
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.aligned(docs, A, B).collect()}
    assert got == want


def test_empty_tables(spark, none):
    assert minhash.op11_minhash_near_dedup(spark, none).count() == 0
    assert collocation.op12_phrase_collocation(spark, none).count() == 0
    assert alignment.op13_cross_tokenizer(spark, none).count() == 0


def test_joins_by_shuffle_give_the_same(spark, sf, texts, monkeypatch):
    for module in (jaccard, blocks):
        monkeypatch.setattr(module, "BROADCAST_IDS", 0)
    monkeypatch.setattr("quillspark.llm.common.BROADCAST_IDS", 0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op11_minhash_near_dedup(spark, sf).collect()} == near(texts, 3, 85, 100)
    assert [tuple(r)[1:6] for r in alignment.op13_cross_tokenizer(spark, sf).orderBy("doc_id").collect()] == [w[:5] for w in aligned(texts)]


def test_a_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    path = bpe.tokenizer_path()
    bpe.forget()
    model, rng = bpe.model(path), random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(400)] + ["a" * 5000, "b" * 200_000]
    first = [model.encode(w) for w in words]
    assert first == [model.encode(w) for w in words]
    assert first[-1] == bpe.BPE(path).word(words[-1])
    held = sum(len(k) for c in (model.met, model.met.older) for k in c)
    assert held < 2 * 20_000 and max(map(len, model.met)) <= bpe.CACHED
    bpe.forget()


def test_rare_pairs_of_a_block_are_few_packed_bytes():
    rng = np.random.default_rng(3)
    at = np.minimum(rng.zipf(1.3, 200_000), 5000).astype(np.int32)
    local = np.unique(at)
    ids = rng.permutation(len(local)) + (7 << 33)
    series, names = pa.table({"block": [5], "ids": [blocks.packed(at)]}), pa.table({"block": [5] * len(local), "local": local, "id": ids})
    rows = collocation._pairs(series, names, 10).slice(1)
    by_id = dict(zip(local.tolist(), ids.tolist(), strict=True))
    wanted = collections.Counter(zip([by_id[x] for x in at[:-1].tolist()], [by_id[x] for x in at[1:].tolist()], strict=True))
    sent = [blocks.risen(x, 3) for x in rows["pairs"].to_pylist()]
    assert {(a, b): n for x in sent for a, b, n in zip(*x[:2].tolist(), np.diff(x[2], prepend=0).tolist(), strict=True)} == wanted
    assert rows.num_rows == 10 and sum(map(len, rows["pairs"].to_pylist())) < 5 * len(wanted)
    odd = np.array([5, 5, 2**61, 0, 3])
    assert blocks.risen(blocks.rising(odd, odd[::-1]), 2).tolist() == [odd.tolist(), odd[::-1].tolist()]
    assert blocks.risen(blocks.rising(odd[:0]), 1).tolist() == [[]]


def test_new_words_are_merged_side_by_side(monkeypatch):
    monkeypatch.setattr(bpe, "ROWS", 100)
    monkeypatch.setattr(bpe, "LETTERS", 3000)
    bpe.forget()
    model, rng = bpe.model(bpe.tokenizer_path()), random.Random(2)
    letters = "aaaeeetthhnnoorrssiiélüßñ" + "漢😀'.,-1"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice((3, 12, 90))))) for _ in range(150)) for _ in range(8)]
    texts += [None, "", "a", "é", "aaaaaaaaaaaaaaaa eeee <|endoftext|>'s don't", "b" * 5000]
    one_by_one = [array("I", [i for x in model.pieces(t or "") for w in ([x] if x[0] == bpe.MARK else model.words(x)) for i in ([model.special[w[1:]]] if w[0] == bpe.MARK else model.word(w))]).tobytes() for t in texts]
    asked, word = [], bpe.BPE.word
    monkeypatch.setattr(bpe.BPE, "word", lambda self, w: asked.append(w) or word(self, w))
    assert list(model.encoded(texts)) == one_by_one and list(model.encoded([None, ""])) == [b"", b""]
    assert all(len(w) > bpe.CACHED for w in asked)
    assert [array("I", model.encode(t or "")).tobytes() for t in texts] == one_by_one
    bpe.forget()


def test_long_and_many_words_of_languages_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(language, "CACHE_WORDS", 20)
    rows = [(i, " ".join(f"w{j}the{i}" for j in range(40)) + " " + "x" * 500, "en") for i in range(6)] + [(10 + i, " ".join(f"ü{j}und{i}" for j in range(40)), "de") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    small, _ = model.paths([t for _, t, _ in rows])
    assert not model.words or max(map(len, model.words)) <= language.CACHED
    monkeypatch.setattr(language, "CACHE_WORDS", 400_000)
    fresh = language.fit(docs)
    assert [x.tolist() for x in small] == [x.tolist() for x in fresh.paths([t for _, t, _ in rows])[0]]


def test_gifs_that_ask_for_too_much(spark, monkeypatch):
    huge = b"GIF89a" + bytes([255, 255, 255, 255, 0x80, 0, 0]) + bytes(6) + b";"
    frame = b"GIF89a" + bytes([2, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"," + bytes([0, 0, 0, 0, 255, 255, 255, 255, 0, 2, 0]) + b";"
    rows = media.frames(spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(frame)), (3, None)], "k long, g binary"), "k", "g").collect()
    assert sorted((r["id"], "bound" in r["error"]) for r in rows) == [(1, True), (2, True)]
    data = random.Random(2).randbytes(192 * 300)
    stream = media.lzw(data)
    assert len(media.unlzw(stream, 8, 100)) < len(data) and media.unlzw(stream, 8, len(data)) == data


def test_a_payload_of_several_frames(spark, monkeypatch):
    monkeypatch.setattr(media, "FRAME_ROWS", 4)
    text = "lorem ipsum " * 300
    n, payload = media.padded(text)
    shown = list(media.decode(media.encode(payload)))
    assert len(shown) == -(-len(payload) // (4 * media.WIDTH)) > 3
    assert b"".join(f["samples"].tobytes() for f in shown) == payload


def test_frequencies_by_level(spark):
    docs = spark.createDataFrame([(i, "a b c d. a b c, a b x", "en") for i in range(3)], "doc_id long, text string, lang string")
    levels, sizes = collocation.frequent(docs, 3)
    told = {r["phrase"]: (r["f"], r["heads"], r["tails"]) for level in levels for r in level.collect()}
    assert told["a b c d"] == (3, [9, 9, 6, 3], [3, 3, 3, 3]) and told["b c"] == (6, [9, 6], [6, 6])
    assert sizes.first()["n"] == 30 and docs.select(F.lit(1)).count() == 3
