"""BPE encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

A word's symbols form a doubly linked list; a heap holds (rank, position) of the pairs that
can merge. An entry whose pair has changed since is stale and skipped. Decoding concatenates
the vocabulary's strings, by a space, as a tokenizer file without a decoder asks.

Null texts count as empty and have no ids; rows with null, equal or clashing ids and columns
are encoded like any others, as only the named columns are read, and an empty table gives no
rows. Words are cached by worker, in two generations of about CACHE_BYTES each (ids: of twice as many), and words of more
than CACHED letters aren't, which bounds memory and changes no result. A very long text costs memory in proportion to itself. Code points newer than the Unicode data of
Python's unicodedata module may be folded or split otherwise than the library does.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import arrow_settings, caches, map_batches, table

#: Bytes of one generation of a worker's cache, of which it has two, and what an entry needs beside its contents.
CACHE_BYTES, ENTRY_BYTES = 40_000_000, 200
#: Longer words are made anew each time.
CACHED = 64
#: Bits of a queue entry that hold the position, of words with at most 2 ** SHORT symbols: entries then are one machine digit.
SHORT, LONG = 12, 40
#: Words that are merged side by side, letters of texts whose words are, and what stands for no rank.
ROWS, LETTERS, NONE = 4096, 1 << 22, 1 << 30
END = "</w>"
#: Stands before a special token; no chunk holds white space.
MARK = "\n"
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BPE:
    """The word-end BPE model of a tokenizer file: NFC, white space and case folding, splitting, merging."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {v: k for k, v in (self.ids | self.special).items()}
        #: By the left id a dictionary from the right id to the rank of their merge; the last, empty one stands for no symbol (-1).
        self.rank: list[dict[int, int]] = [{} for _ in range(max(self.strings) + 2)]
        #: By rank the two ids that merge and the id that they give.
        self.pairs: tuple[list[int], list[int], list[int]] = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = self.ids[a], self.ids[b]
            self.rank[x].setdefault(y, len(self.pairs[0]))
            for column, v in zip(self.pairs, (x, y, self.ids[a + b]), strict=True):
                column.append(v)
        #: The pairs as numbers, in order, and their ranks. No id is the greatest below `many`, so a pair with -1 is none of them.
        self.many = len(self.rank)
        keys = np.array([x * self.many + y for x, row in enumerate(self.rank) for y in row], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for row in self.rank for r in row.values()], np.int32)[order]
        self.made = np.array(self.pairs[2], np.int32)
        self.assigned: set[str] = set()
        #: By chunk and by pre-token, which is a chunk that stays whole, its ids as little-endian unsigned 32-bit numbers.
        self.met = Cache(self.piece_ids, 2)
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + END] for x in letters]
        self.inner_ids, self.last_ids = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        #: By two bytes of a word the rank of their merge, or -1.
        self.start = [[self.rank[x].get(y, -1) for y in self.inner] for x in self.inner]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"))
        self.marks = re.compile("|".join(map(re.escape, self.special)))

    def word(self, word: str) -> list[int]:
        """The ids of one pre-token. A queue entry is a rank over a position; past the ends of the list stands the symbol -1."""
        data = word.encode()
        inner, rank, start = self.inner, self.rank, self.start
        sym = [inner[x] for x in data]
        n = len(sym)
        sym[-1] = self.last[data[-1]]
        shift = SHORT if n <= 1 << SHORT else LONG
        heap = [r << shift | i for i, (x, y) in enumerate(zip(data, data[1:-1])) if (r := start[x][y]) >= 0]  # noqa: B905
        if n > 1 and (r := rank[sym[-2]].get(sym[-1])) is not None:
            heap.append(r << shift | n - 2)
        if not heap:
            return sym
        heapq.heapify(heap)
        sym.append(-1)
        right, left = list(range(1, n + 2)), list(range(-1, n))
        (first, second, made), pop, push, mask = self.pairs, heapq.heappop, heapq.heappush, (1 << shift) - 1
        while heap:
            e = pop(heap)
            i, r = e & mask, e >> shift
            j = right[i]
            if sym[i] != first[r] or sym[j] != second[r]:
                continue  # stale: one of the two has merged with another since
            sym[i] = new = made[r]
            sym[j] = -1
            right[i] = k = right[j]
            left[k] = i
            if (r := rank[new].get(sym[k])) is not None:
                push(heap, r << shift | i)
            if (r := rank[sym[h := left[i]]].get(new)) is not None:
                push(heap, r << shift | h)
        return [x for x in sym if x >= 0]

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NONE where they don't merge; -1 is no id."""
        key = left.astype(np.int64) * self.many + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(NONE))

    def merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens of similar lengths, as little-endian unsigned 32-bit numbers. A row has a word's symbols, then -1; each step merges one pair of each row."""
        n = np.array([len(x) for x in words])
        width, row = int(n.max()), np.arange(len(words))
        data = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in words]), np.uint8).reshape(len(words), width)
        column = np.arange(width)
        sym = np.where(column < n[:, None], self.inner_ids[data], np.int32(-1))
        sym[row, n - 1] = self.last_ids[data[row, n - 1]]
        whole, live = sym.copy(), row
        rank = np.hstack([self.ranked(sym[:, :-1], sym[:, 1:]), np.full((len(words), 1), NONE, np.int32)])
        while True:
            at = rank.argmin(axis=1)
            r = rank[row, at]
            some = r < NONE
            if not some.all():
                whole[live[~some]] = sym[~some]
                live, sym, rank, at, r = live[some], sym[some], rank[some], at[some], r[some]
                row = np.arange(len(live))
            if not len(live):
                break
            later = column[:-1] > at[:, None]
            sym[:, :-1] = np.where(later, sym[:, 1:], sym[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            sym[:, -1] = -1
            sym[row, at] = new = self.made[r]
            after = np.flatnonzero(at < width - 1)
            rank[row, at] = NONE
            rank[after, at[after]] = self.ranked(new[after], sym[after, at[after] + 1])
            before = np.flatnonzero(at)
            rank[before, at[before] - 1] = self.ranked(sym[before, at[before] - 1], new[before])
        kept = whole >= 0
        ids, ends = whole[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the pre-tokens of those chunks that aren't cached yet into the cache."""
        met, older = self.met, self.met.older
        words = {w for x in pieces if x not in met and x not in older and x[0] != MARK for w in self.words(x)}
        new = [(w.encode(), w) for w in words if w not in met and w not in older and len(w) <= CACHED]
        new.sort(key=lambda x: len(x[0]))
        for i in range(0, len(new), ROWS):
            part = new[i : i + ROWS]
            for (_, w), ids in zip(part, self.merged([x[0] for x in part]), strict=True):
                met.put(w, ids)

    def chunks(self, text: str) -> list[str]:
        """The folded text of a stretch without special tokens, cut at white space, which no pre-token crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _SEPARATORS.search(text):  # str.split() takes these four for white space, the tokenizer doesn't
            return [x for x in regex.split(r"\s+", text.lower()) if x]
        return text.lower().split()

    def words(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk. Code points that the Unicode data at hand doesn't assign are neither letters nor digits."""
        if chunk.isalpha():
            return [chunk]
        if chunk.isascii():
            return self.split_ascii.findall(chunk)
        if not self.assigned.issuperset(chunk):
            self.assigned.update(c for c in chunk if unicodedata.category(c) != "Cn")
        if self.assigned.issuperset(chunk):
            return self.split.findall(chunk)
        known = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in chunk)
        return [chunk[m.start() : m.end()] for m in self.split.finditer(known)]

    def pieces(self, text: str) -> list[str]:
        """All chunks; special tokens, which are found in the raw text, stay whole."""
        if "<|" not in text or not self.marks.search(text):
            return self.chunks(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append(MARK + m[0])
            at = m.end()
        return out + self.chunks(text[at:])

    def piece_ids(self, piece: str) -> bytes:
        """The ids of a chunk, or of a special token after MARK, as little-endian unsigned 32-bit numbers."""
        if piece[0] == MARK:
            return array("I", [self.special[piece[1:]]]).tobytes()
        words = self.words(piece)
        return array("I", self.word(piece)).tobytes() if len(words) == 1 else b"".join(map(self.met.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(map(self.met.__getitem__, self.pieces(text)))).tolist()

    def encoded(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        held, size = [], 0
        for i, text in enumerate(texts):
            held.append(self.pieces(text or ""))
            size += len(text or "")
            if size >= LETTERS or i == len(texts) - 1:
                yield from self.joined(held)
                held, size = [], 0

    def joined(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of chunks. Each distinct chunk is looked up once; its ids are then copied by its number."""
        number: defaultdict[str, int] = defaultdict(count().__next__)
        ends = np.cumsum([len(x) for x in texts])
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(ends[-1]))
        self.learn(number)
        found = list(map(self.met.__getitem__, number))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(n) - n
        many = n[at]
        last = np.concatenate([[0], np.cumsum(many)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[at] - last[:-1], many) + np.arange(last[-1])].tobytes()
        cuts = [0, *(4 * last[ends]).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class Cache(dict):
    """What a function gave for each word so far: the latest words, of CACHE_BYTES times share in all, and those of the generation before them. Values are bytes or tuples of them."""

    def __init__(self, make, share: int = 1) -> None:
        super().__init__()
        self.make, self.share = make, share
        self.older: dict = {}
        self.bytes = 0

    def __missing__(self, word: str):
        if len(word) > CACHED:
            return self.make(word)
        out = self.older.get(word)
        return self.put(word, self.make(word) if out is None else out)

    def put(self, word: str, out):
        size = ENTRY_BYTES + 4 * len(word) + (len(out) if isinstance(out, bytes) else sum(map(len, out)))
        if self.bytes + size > CACHE_BYTES * self.share:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += size
        self[word] = out
        return out


def forget() -> None:
    for x in (model, word_texts):
        x.cache_clear()


@lru_cache(maxsize=4)
def model(path: str) -> BPE:
    caches["bpe"] = forget
    return BPE(path)


@lru_cache(maxsize=4)
def word_texts(path: str) -> Cache:
    """Per word its ids in decimals and its decoded strings, each followed by a space."""
    bpe = model(path)

    def make(word: str) -> tuple[bytes, bytes]:
        ids = array("I", bpe.met[word]).tolist()
        return b"".join([b"%d " % i for i in ids]), "".join([bpe.strings[i] + " " for i in ids]).encode()

    return Cache(make)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the search for garbage in cycles: a batch makes none, and the caches are large to go through."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded text of each row; equal to the library's encode and decode."""

    def run(b: pa.RecordBatch) -> dict:
        bpe = model(path)
        ids = [bpe.encode(x or "") for x in b.column(1).to_pylist()]
        return {"doc_id": b.column(0), "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    return map_batches(docs.select(doc_id, text), run, "doc_id long, ids array<int>, decoded string", "bpe")


def digested(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encoded(), but with digests in place of the ids and the decoded text."""

    def run(b: pa.RecordBatch) -> dict:
        bpe, cache = model(path), word_texts(path)
        n, ids, decoded = [], [], []
        with uncollected():
            for x in b.column(1).to_pylist():
                made = list(map(cache.__getitem__, bpe.pieces(x or "")))
                line = b"".join([m[0] for m in made])
                n.append(line.count(b" "))
                ids.append(hashlib.sha256(line[:-1]).hexdigest())
                decoded.append(hashlib.sha256(b"".join([m[1] for m in made])[:-1]).hexdigest())
        return {"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_batches(docs.select(doc_id, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op4, with the public word-end vocabulary."""
    arrow_settings(spark)
    return digested(table(spark, sf_dir, "documents"), tokenizer_path())
