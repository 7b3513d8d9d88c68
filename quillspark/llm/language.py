"""Language ID: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Languages are learned from labelled texts as log probabilities of the letter trigrams of
words. A word scores each language that its script allows; Viterbi over a text's words,
with a penalty for each switch, gives spans. A text's language is the one with most letters
in its spans, the score that language's share of the letters.

The fit uses about FIT_TEXTS texts of each language, or all if there are fewer; the rows
are taken by a hash of the id. A null text or one without a letter is `und` with score 0;
without any training row every text is. Ties go to the language first in the alphabet.
Repeated and null ids are labelled row by row; a row with a null id doesn't train, as
its held-out share is unknown. An empty table gives no rows. Only the named columns are read,
whatever others there are. A very long text costs memory in proportion to its words, and nothing of it is kept.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_settings, held_out, map_batches, table

#: About so many texts of each language train.
FIT_TEXTS = 5000
#: Added to each count of a trigram.
SMOOTHING = 0.5
#: Log probability that a switch of language costs.
SWITCH = 12.0
#: A language may have a script that makes up this share of its training letters.
SCRIPT_SHARE = 0.01
#: Words whose scores a worker keeps between batches, and the letters of the longest of them; what a batch has beyond that is dropped after it.
CACHE_WORDS, CACHED = 400_000, 64

#: Upper ends of ranges of code points, and the scripts up to them.
_ENDS = np.array([0x40, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0x110000])
_SCRIPTS = ("other", "latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "indic", "thai", "other", "georgian", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other")


def script(letter: str) -> str:
    return _SCRIPTS[int(np.searchsorted(_ENDS, ord(letter), "right"))]


def letters_of(chunk: str) -> str:
    return "".join(filter(str.isalpha, chunk))


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def counted(rows: DataFrame) -> DataFrame:
    """lang, trigram, n and, with an empty trigram's place taken by a script's name after a blank, letters by script; of (lang, text)."""

    def run(b: pa.RecordBatch) -> dict:
        words: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update((text or "").lower().split())
        found: Counter = Counter()
        for lang, chunks in words.items():
            for chunk, n in chunks.items():
                if w := letters_of(chunk):
                    found[lang, " " + script(w[0])] += n * len(w)
                    for g in trigrams(w):
                        found[lang, g] += n
        return {"lang": [k[0] for k in found], "gram": [k[1] for k in found], "n": list(found.values())}

    return map_batches(rows, run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log probabilities by trigram (row 0: unseen) and language, and the languages of each script."""

    def __init__(self, counts: list[tuple[str, str, int]]) -> None:
        self.langs = sorted({x[0] for x in counts})
        at = {x: i for i, x in enumerate(self.langs)}
        grams = sorted({g for _, g, _ in counts if g[0] != " "})
        self.grams = {g: i + 1 for i, g in enumerate(grams)}
        n = np.full((len(grams) + 1, len(self.langs)), SMOOTHING)
        scripts: dict[str, np.ndarray] = {}
        for lang, g, k in counts:
            if g[0] == " ":
                scripts.setdefault(g[1:], np.zeros(len(self.langs)))[at[lang]] += k
            else:
                n[self.grams[g], at[lang]] += k
        self.table = np.log(n / n.sum(axis=0))
        total = sum(scripts.values()) if scripts else 1
        self.allowed = {s: x >= SCRIPT_SHARE * total for s, x in scripts.items()}
        self.words: dict[str, int] = {}
        self.long = False
        self.scores = np.zeros((1024, len(self.langs)))
        self.sizes = np.zeros(1024, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Scores of words not met before go to the worker's cache."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.words]
        if not new:
            return
        if len(self.words) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(dict.fromkeys(chunks))
        self.long = self.long or any(len(c) > CACHED for c in new)
        words = [letters_of(c) for c in new]
        get = self.grams.get
        ids = [[get(g, 0) for g in trigrams(w)] if w else [0] for w in words]
        flat = np.array([i for x in ids for i in x])
        first = np.cumsum([0, *map(len, ids)])[:-1]
        score = np.add.reduceat(self.table[flat], first, axis=0)
        sizes = np.array([len(w) for w in words])
        score[sizes == 0] = 0
        for i, w in enumerate(words):
            if w and not w.isascii():
                ok = self.allowed.get(script(w[0]))
                if ok is not None and ok.any():
                    score[i, ~ok] -= 1e3
            elif w and (ok := self.allowed.get("latin")) is not None and ok.any():
                score[i, ~ok] -= 1e3
        start, end = len(self.words), len(self.words) + len(new)
        if end > len(self.sizes):
            size = max(end, 2 * len(self.sizes))
            self.scores = np.resize(self.scores, (size, len(self.langs)))
            self.sizes = np.resize(self.sizes, size)
        self.scores[start:end], self.sizes[start:end] = score, sizes
        self.words.update(zip(new, range(start, end), strict=True))

    def forget(self) -> None:
        """Drops all words, and the arrays of a batch that had far more of them than are kept."""
        self.words.clear()
        self.long = False
        if len(self.sizes) > 2 * CACHE_WORDS:
            self.scores, self.sizes = np.zeros((1024, len(self.langs))), np.zeros(1024, np.int64)

    def paths(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the number of the language of each word, and the words' letters. Texts are stepped through together, longest first."""
        split = [(t or "").lower().split() for t in texts]
        order = sorted(range(len(texts)), key=lambda i: -len(split[i]))
        sizes = np.array([len(split[i]) for i in order])
        flat = [c for i in order for c in split[i]]
        self.learn(flat)
        ids = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        emit, letters = self.scores[ids], self.sizes[ids]
        if self.long or len(self.words) > CACHE_WORDS:  # long words aren't kept, nor is a batch of more words than that
            self.forget()
        first = np.cumsum(sizes) - sizes
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(steps), "left") if steps else []
        k = len(self.langs)
        switched = np.zeros((len(flat), k), bool)
        source = np.zeros(len(flat), np.int64)
        d = np.zeros((len(order), k))
        final = np.zeros(len(order), np.int64)
        for t in range(steps):
            a = active[t]
            rows = first[:a] + t
            e = emit[rows]
            if t:
                p = d[:a]
                best = p.argmax(axis=1)
                other = p[np.arange(a), best][:, None] - SWITCH
                sw = other > p
                source[rows], switched[rows] = best, sw
                d[:a] = np.where(sw, other, p) + e
            else:
                d[:a] = e
        final = d.argmax(axis=1)
        path = np.zeros(len(flat), np.int64)
        state = final.copy()
        for t in range(steps - 1, -1, -1):
            a = active[t]
            rows = first[:a] + t
            path[rows] = state[:a]
            if t:
                state[:a] = np.where(switched[rows, state[:a]], source[rows], state[:a])
        out_p: list = [None] * len(texts)
        out_n: list = [None] * len(texts)
        for place, i in enumerate(order):
            part = slice(first[place], first[place] + sizes[place])
            out_p[i], out_n[i] = path[part], letters[part]
        return out_p, out_n


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """A model of the labelled rows; counts of trigrams of a bounded number of texts reach the driver."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    share = rows.groupBy(F.col(lang).alias("_lang")).agg(F.least(F.lit(1.0), F.lit(float(FIT_TEXTS)) / F.count(F.lit(1))).alias("_share"))
    place = F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) / F.lit(1e6)
    taken = rows.join(F.broadcast(share), F.col(lang) == F.col("_lang")).filter(place < F.col("_share"))
    return Model([tuple(r) for r in counted(taken.select(lang, text)).collect()])


def labelled(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and the spans: languages, first words and numbers of words."""
    langs = [*model.langs]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("lang_pred", "score", "span_lang", "span_start", "span_words")}
        texts = b.column(1).to_pylist()
        paths, sizes = sent.value.paths(texts) if langs else ([np.zeros(0, np.int64)] * len(texts),) * 2
        for path, n in zip(paths, sizes, strict=True):
            share = np.bincount(path, weights=n, minlength=max(1, len(langs)))
            total = share.sum()
            best = int(share.argmax())
            out["lang_pred"].append(langs[best] if total else "und")
            out["score"].append(float(share[best] / total) if total else 0.0)
            cut = np.flatnonzero(np.diff(path, prepend=-1)) if total else np.zeros(0, np.int64)
            out["span_lang"].append([langs[i] for i in path[cut]])
            out["span_start"].append(cut.tolist())
            out["span_words"].append(np.diff(cut, append=len(path)).tolist() if total else [])
        return {"doc_id": b.column(0)} | out

    return map_batches(docs.select(doc_id, text), run, "doc_id long, lang_pred string, score double, span_lang array<string>, span_start array<long>, span_words array<long>")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op10: rows with crc32(doc_id) mod 4 of 2 don't train."""
    arrow_settings(spark)
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = fit(docs.filter(~out))
    return labelled(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
