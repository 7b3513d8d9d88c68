"""Cross-tokenizer alignment, relationally: which tokens of two vocabularies cover the same bytes.

Both tokenizers' tokens are exploded with their places, windows add up their byte lengths, and an
equi-join on the text and the end finds the offsets where tokens of both end. How many of those lie before
a token is its group; tokens of a group are linked by a join on the text and the group.

Texts are cut first, before a space or line feed that follows other than white space and between a letter
and a following mark of punctuation, where the byte-level vocabulary's pattern always splits and no piece
of the other spans; CUTS are tested against the two files, and where they don't hold a text stays whole.
As such a cut is an end of both, groups never cross it, and a distinct chunk is encoded and aligned once
for the whole corpus, not once an occurrence. Documents are blocks of chunk numbers (see blocks), which get
each chunk's groups and links by joins.

A null or empty text has no tokens, and neither has one that either vocabulary doesn't give back byte by
byte; such rows have zeros and an empty string and count for no pair. Rows with null, equal or clashing ids
and columns are rows like any others, as only the two named columns are read; each row is a document. A
very long text without a cut is one chunk, and costs memory in proportion to itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.blocks import Names, cut, in_blocks, known, packed, unpacked
from quillspark.llm.bpe import byte_letters, tokenizer_path
from quillspark.llm.common import Tables, arrow_schema, arrow_settings, as_batch, caches, entered, give_back, map_batches, table

_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
#: A chunk: a plain word with the space before it, else all up to the next cut.
_CHUNK = re.compile(rf"[ \n]?[{_LETTER}]+(?=[{_MARK} \n]|\Z)|(?s:.)+?(?=(?<=\S)[ \n]|(?<=[{_LETTER}])[{_MARK}]|\Z)")
#: What no piece of the second vocabulary may hold, so that texts can be cut: a space after other than a space, a line feed, a mark after a letter.
CUTS = re.compile(rf"[^▁]▁|\n|[{_LETTER}][{_MARK}]")
#: Ids below SMALL are kept in 16 bits, less HALF.
SMALL, HALF = 1 << 16, 1 << 15
#: Groups whose links a task makes at a time, numbers of chunks that it adds up at a time, and chunks whose groups it writes as text at a time.
GROUPS, ADDED, TOLD = 1 << 16, 1 << 20, 1 << 14

_COUNTED = "pair long, n long, block long, place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_BLOCKS = "block long, ids array<long>, sizes array<int>, series binary, local int, chunk string"


class Tokenizers:
    """A byte-level file of the tokenizers library (A) and a sentencepiece model (B), with their tokens' bytes."""

    def __init__(self, a: str, b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        special = {x["content"] for x in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.bytes_a = [b""] * size
        for piece, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = piece.encode() if piece in special else b"".join(map(byte.__getitem__, piece))
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in y], np.int32) for y in (self.bytes_a, self.bytes_b)]
        splits = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        same = self.b.encode("a  ﬁ b ", out_type=str) and "".join(self.b.encode("a  ﬁ b ", out_type=str)) == "▁a▁▁ﬁ▁b▁"
        self.cuts = bool(plain and same and not any(CUTS.search(p) for p in pieces))

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """The tokens as they are in the middle of a text: B sets a space before what it gets, which is a chunk's own or goes with a line feed again."""
        own = [x[0] == " " and len(x) > 1 for x in chunks]
        made = self.b.encode([x[1:] if o else "\n" + x for x, o in zip(chunks, own, strict=True)], num_threads=1)
        return [ids if o else ids[2:] for ids, o in zip(made, own, strict=True)]


def chunks(text: str) -> list[str]:
    """The chunks of space + text."""
    return _CHUNK.findall(" " + text)


@lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> Tokenizers:
    caches["alignment"] = tokenizers.cache_clear
    return Tokenizers(a, b)


class Pieces(dict):
    """What stands between two spaces as the numbers of its chunks, the space before it included; an error where the space after it is no cut."""

    def __init__(self, names: Names) -> None:
        super().__init__()
        self.names = names

    def __missing__(self, piece: str) -> list[int]:
        if not piece or piece[-1].isspace():
            raise ValueError(piece)
        self[piece] = out = [self.names[x] for x in chunks(piece)]
        return out

    def numbers(self, text: str) -> list[int]:
        """All chunks of a text; texts with other cuts than before single spaces are cut as a whole."""
        pieces = text.split(" ")
        try:
            out = list(chain.from_iterable(map(self.__getitem__, pieces[:-1])))
        except ValueError:
            return [self.names[x] for x in chunks(text)]
        last = pieces[-1]
        return out + (self[last] if last and not last[-1].isspace() else [self.names[x] for x in chunks(last)])


def _numbered(cuts: bool):
    def run(block: int, batches: list[pa.RecordBatch]):
        """A block's texts as numbers into a dictionary of chunks, or of whole texts."""
        names = Names()
        pieces = Pieces(names)
        numbers = pieces.numbers if cuts else lambda text: [names[" " + text]]
        ids, series = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            series += [np.array(numbers(text) if text else [], "<i4") for text in batch.column(1).to_pylist()]
        pieces.clear()
        none = {"local": [None], "chunk": [None]}
        yield {"block": [block], "ids": [ids], "sizes": [[len(x) for x in series]], "series": [packed(np.concatenate(series))]} | none
        del series
        empty = {"ids": None, "sizes": None, "series": None}
        yield from cut({"block": block, "local": np.arange(len(names)), "chunk": list(names)} | empty, len(names))

    return run


def _lists(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return np.fromiter((x for p in parts for x in p), np.int32, int(ends[-1])), ends


def encoded(chunks: DataFrame, a: str, b: str) -> DataFrame:
    """chunk_id, chunk and both vocabularies' ids and byte lengths; without tokens where either doesn't give the chunk back."""

    def run(batch: pa.RecordBatch) -> dict:
        t = tokenizers(a, b)
        texts = batch.column(1).to_pylist()
        both = [t.encode_a(texts), t.encode_b(texts)]
        for i, x in enumerate(texts):
            raw = x.encode()
            if b"".join([t.bytes_a[k] for k in both[0][i]]) != raw or b"".join([t.bytes_b[k] for k in both[1][i]]) != raw:
                both[0][i] = both[1][i] = []
        out = {"chunk_id": batch.column(0), "chunk": batch.column(1)}
        for name, parts, lengths in zip("ab", both, t.lengths, strict=True):
            flat, ends = _lists(parts)
            out[name] = pa.ListArray.from_arrays(ends, flat)
            out[f"{name}_bytes"] = pa.ListArray.from_arrays(ends, lengths[flat])
        return out

    return map_batches(chunks.select("chunk_id", "chunk"), run, "chunk_id long, chunk string, a array<int>, a_bytes array<int>, b array<int>, b_bytes array<int>", "alignment")


def groups(tokens: DataFrame) -> DataFrame:
    """chunk_id, group, a and b: the ids of both vocabularies between two neighbouring common ends, in their order.

    tokens: chunk_id, a, a_bytes, b, b_bytes. Everything after the repartition stays in its partition, as all joins have the chunk among their keys.
    """
    tokens.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own = tokens.select("chunk_id", "a", "a_bytes", "b", "b_bytes").repartition("chunk_id")
    placed = W.partitionBy("chunk_id").orderBy("pos")
    ends = {}
    for x in "ab":
        each = own.select("chunk_id", F.posexplode(F.arrays_zip(x, f"{x}_bytes")).alias("pos", "t"))
        ends[x] = each.select("chunk_id", F.col(f"t.{x}").alias("id"), F.sum(f"t.{x}_bytes").over(placed).alias("end"))
    before = W.partitionBy("chunk_id").orderBy("end").rowsBetween(W.unboundedPreceding, -1)
    sides = {}
    for x, y in ("ab", "ba"):
        met = ends[x].join(ends[y].select("chunk_id", "end", F.lit(1).alias("met")), ["chunk_id", "end"], "left")
        grouped = met.select("chunk_id", "end", "id", F.coalesce(F.sum(F.coalesce("met", F.lit(0))).over(before), F.lit(0)).alias("group"))
        sides[x] = grouped.groupBy("chunk_id", "group").agg(F.array_sort(F.collect_list(F.struct("end", "id"))).alias("t")).select("chunk_id", "group", F.col("t.id").alias(x))
    return sides["a"].join(sides["b"], ["chunk_id", "group"])


def gathered(groups: DataFrame, width: int, small: bool) -> DataFrame:
    """chunk_id, the sizes of its groups (of a and b by turns), the ids of all groups (of a, then of b), and its links as numbers: A's id times width, plus B's.

    small: ids are below SMALL and are kept less HALF, as 16 bits.
    """
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: x.cast("long") * width + y)))
    whole = groups.select("chunk_id", F.struct("group", "a", "b", pairs.alias("links")).alias("g")).groupBy("chunk_id").agg(F.array_sort(F.collect_list("g")).alias("g"))
    ids = F.flatten(F.transform("g", lambda g: F.concat(g["a"], g["b"])))
    if small:
        ids = F.transform(ids, lambda x: (x - HALF).cast("short"))
    sizes = F.flatten(F.transform("g", lambda g: F.array(F.size(g["a"]), F.size(g["b"]))))
    return whole.select("chunk_id", sizes.alias("sizes"), ids.alias("ids"), F.flatten("g.links").alias("links"))


def _series(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids, and where each document starts and ends among its chunks' numbers."""
    ids, sizes = table["ids"][0].as_py(), np.array(table["sizes"][0].as_py(), np.int64)
    ends = np.cumsum(sizes)
    return ids, ends - sizes, ends, unpacked(table["series"][0].as_py())


def _by_documents(starts: np.ndarray, ends: np.ndarray, series: np.ndarray, local: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The sums of a column of chunks over each document's chunks."""
    by = np.zeros(int(series.max(initial=0)) + 1, np.int64)
    by[local] = column
    so_far = np.zeros(len(series) + 1, np.int64)
    for k in range(0, len(series), ADDED):
        part = so_far[k + 1 : k + 1 + ADDED]
        np.cumsum(by[series[k : k + ADDED]], out=part)
        part += so_far[k]
    return so_far[ends] - so_far[starts]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _pairs(tokens: np.ndarray, first: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct links of groups as numbers, and which of them each link is; the links of GROUPS groups are made at a time."""
    made, found = [np.zeros(0, np.int64)], []
    for k in range(0, len(first), GROUPS):
        f, a, b = first[k : k + GROUPS], n_a[k : k + GROUPS], n_b[k : k + GROUPS]
        n = a * b
        within, by_b = np.arange(int(n.sum())) - np.repeat(_starts(n), n), np.repeat(b, n)
        links = tokens[np.repeat(f, n) + within // by_b].astype(np.int64) * width + tokens[np.repeat(f + a, n) + within % by_b]
        some, which = np.unique(links, return_inverse=True)
        made.append(some)
        found.append(which.astype(np.int32))
    pairs = np.unique(np.concatenate(made))
    dense = [np.searchsorted(pairs, some).astype(np.int32)[which] for some, which in zip(made[1:], found, strict=True)]
    return pairs, np.concatenate(dense) if dense else np.zeros(0, np.int32)


class Chunks:
    """A block's chunks: their groups, links and texts, as arrays over all of them."""

    def __init__(self, names: pa.Table, width: int, small: bool) -> None:
        sizes, ids = names["sizes"].combine_chunks(), names["ids"].combine_chunks()
        flat, tokens = sizes.flatten().to_numpy(), ids.flatten().to_numpy().astype(np.int32) + np.int32(HALF if small else 0)
        n_a, n_b = flat[0::2].astype(np.int64), flat[1::2].astype(np.int64)
        per = sizes.value_lengths().to_numpy().astype(np.int64) // 2
        self.local = names["local"].to_numpy()
        first = _starts(n_a + n_b)
        n = n_a * n_b
        self.pairs, self.dense = _pairs(tokens, first, n_a, n_b, width)
        group = _starts(per)
        sums = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[group + per] - c[group]
        self.counts = {"n_a": sums(n_a), "n_b": sums(n_b), "n_groups": per, "n_links": sums(n)}
        at, self.text = _starts(n), []
        for k in range(0, len(per), TOLD):
            self.text += self._told(tokens, first, n_a, n_b, n, at, group[k : k + TOLD], per[k : k + TOLD], width)

    def _told(self, tokens: np.ndarray, first: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, per: np.ndarray, width: int) -> list[bytes]:
        """The texts of some neighbouring chunks."""
        low, high = int(group[0]), int(group[-1] + per[-1])
        text = [b""] * (high - low)
        one = np.flatnonzero(n[low:high] == 1)
        for g, x in zip(one.tolist(), self.pairs[self.dense[at[low:high][one]]].tolist(), strict=True):
            text[g] = b"%d|%d" % divmod(x, width)
        for g in np.flatnonzero(n[low:high] != 1).tolist():
            f, a, b = int(first[low + g]), int(n_a[low + g]), int(n_b[low + g])
            own = tokens[f : f + a + b].tolist()
            text[g] = b",".join([b"%d" % x for x in own[:a]]) + b"|" + b",".join([b"%d" % x for x in own[a:]])
        return [b";".join(text[x:y]) for x, y in zip((group - low).tolist(), (group + per - low).tolist(), strict=True)]


def _counted(width: int, small: bool, digest: bool):
    def run(docs: pa.Table, names: pa.Table) -> pa.Table:
        """A block's documents with their counts and groups (or these' digest), and how many of them hold each pair linked."""
        entered()
        schema = arrow_schema(_COUNTED)
        if not docs.num_rows:
            return schema.empty_table()
        block = docs["block"][0].as_py()
        ids, starts, ends, series = _series(docs)
        chunks = Chunks(names, width, small)
        give_back()
        summed = lambda column: _by_documents(starts, ends, series, chunks.local, column)
        whole = summed(np.ones(len(chunks.local), np.int64)) == ends - starts
        counts = {x: np.where(whole, summed(y), 0) for x, y in chunks.counts.items()}
        m = int(series.max(initial=0)) + 1
        text: list[bytes] = [b""] * m
        size, first = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i, x in zip(chunks.local.tolist(), chunks.text, strict=True):
            text[i] = x
        size[chunks.local], first[chunks.local] = chunks.counts["n_links"], _starts(chunks.counts["n_links"])
        total, place, made = np.zeros(len(chunks.pairs), np.int64), np.zeros(m, np.int64), []
        for s, e, ok in zip(starts.tolist(), ends.tolist(), whole.tolist(), strict=True):
            if not ok or s == e:
                made.append("")
                continue
            own = series[s:e]
            joined = b";".join([text[i] for i in own.tolist()])
            made.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            order = np.arange(e - s)
            place[own] = order
            own = own[place[own] == order]  # each chunk once
            n = size[own]
            at = np.arange(int(n.sum())) + np.repeat(first[own] - _starts(n), n)
            total[chunks.dense[at]] += 1  # a number that is there several times gets one only
        some = total > 0
        none = {"pair": None, "n": None}
        empty = {x: None for x in schema.names if x not in none}
        parts = [*cut(none | {"block": block, "place": np.arange(len(ids)), "doc_id": ids, "groups": made} | counts, len(ids)), *cut(empty | {"pair": chunks.pairs[some], "n": total[some]}, int(some.sum()))]
        out = pa.Table.from_batches([as_batch(x, schema) for x in parts], schema)
        give_back()
        return out

    return run


def _ranked(docs: pa.Table, names: pa.Table) -> pa.Table:
    """The sums of a block's documents over what the corpus says of their chunks' pairs."""
    entered()
    schema = arrow_schema("block long, place long, n_best long, count_sum long")
    if not docs.num_rows:
        return schema.empty_table()
    _, starts, ends, series = _series(docs)
    sums = {x: _by_documents(starts, ends, series, names["local"].to_numpy(), names[x].to_numpy()) for x in ("n_best", "count_sum")}
    return pa.table({"block": np.full(len(starts), docs["block"][0].as_py()), "place": np.arange(len(starts))} | sums, schema)


def aligned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Each row's doc_id, counts and groups: `a1,a2|b1;a3|b2,b3`, the ids of A and B that share each group, or the SHA-256 digest of that.

    n_best counts the links whose pair is linked in as many documents as any of its A id's, count_sum adds up those numbers over the links.
    """
    kept, (n_a, n_b) = Tables("align"), (len(x) for x in (tokenizers(a, b).bytes_a, tokenizers(a, b).bytes_b))
    width, small = n_b, max(n_a, n_b) <= SMALL
    blocks = kept.put(in_blocks(docs.select(F.col(doc_id).cast("long"), text), _numbered(tokenizers(a, b).cuts), _BLOCKS, 1), "blocks")
    series = lambda: blocks.filter("series is not null").select(F.col("block").alias("block"), "ids", "sizes", "series").groupBy("block")
    own = blocks.filter("chunk is not null").select("block", "local", "chunk")
    tokens = kept.put(encoded(own.select("chunk").distinct().withColumn("chunk_id", F.monotonically_increasing_id()), a, b), "tokens")
    found = gathered(groups(tokens.filter(F.size("a") > 0)), width, small).join(tokens.select("chunk_id", "chunk"), "chunk_id")
    found = kept.put(found, "chunks")
    kept.drop("tokens")
    held = own.join(found.select("chunk", "sizes", "ids"), "chunk").select("block", "local", "sizes", "ids")
    counted = kept.put(series().cogroup(held.groupBy("block")).applyInArrow(_counted(width, small, digest), _COUNTED), "documents")
    counts = counted.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("count"))
    most = F.max("count").over(W.partitionBy(F.floor(F.col("pair") / width)))  # at most one row a B id
    counts = kept.put(counts.select("pair", "count", (F.col("count") == most).cast("int").alias("best")), "counts")
    stats = known(found.select("chunk", F.explode("links").alias("pair")), counts, ["pair"]).groupBy("chunk").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    sums = series().cogroup(own.join(stats, "chunk").drop("chunk").groupBy("block")).applyInArrow(_ranked, "block long, place long, n_best long, count_sum long")
    told = counted.filter("place is not null").join(sums, ["block", "place"])
    aligned_ = F.col("n_a") > 0
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.when(aligned_, F.col(x)).otherwise(F.lit(0)).cast("long").alias(x) for x in ("n_best", "count_sum")], "groups")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of op13: the byte-level vocabulary as A, the one of pieces as B."""
    arrow_settings(spark)
    out = aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")
