"""Conservative merging: blocks of rows that could be one, then the ordered greedy procedure in each block.

Rows with one valid number are united first. Then, title by title in the order of first
appearance, pairs in row order are united if their whole combined component agrees. Pairs
that contradict each other can never meet, so a block is a component of the others.

Blocks are found without comparing rows: of two rows of a title that don't contradict each other, what both
give is equal, so they meet under a key of the fields that both give and these fields' values. Each
distinct combination of fields stands once for all its rows, under a key for each set of fields that a partner may give.
Combinations of a title that has no more than FEW are compared directly instead, which is the same and cheaper.

Whether two components agree is told from a summary of each, kept at the root of a union-find, and
only components that share what both give are tried at all.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import isbn, text
from quillspark.operators.components import components
from quillspark.operators.groups import solved
from quillspark.sources.checkpoints import checkpointed

_OUT = "idx long, canonical_idx long, size long, reason string, rank int"
_FIELDS = ("publication_year", "publisher", "series")
#: Fields in which no two rows of a component may differ, and all sets of them.
_APART = ("good", *_FIELDS)
_SETS = tuple(x for n in range(len(_APART) + 1) for x in combinations(_APART, n))
#: Distinct combinations of one title that are compared pair by pair.
FEW = 32
#: Several values of a field that may have them.
MIXED = object()
#: What counts for completeness, and what a merged row takes from the others where it is empty.
_COUNTED = ("author", "title", "isbn", "publisher", "publication_date", "publication_year", "genre", "series")
_FILLED = (*_COUNTED, "author_normalized", "publisher_normalized", "cover", "openlibrary", "data_provenance", "curation")


def alias_map(rules: dict[str, str]) -> dict[str, str]:
    """Labels by the keys of their variants, and by their own; empty and conflicting rules are errors."""
    out: dict[str, str] = {}
    for raw, label in rules.items():
        k, label = text._key(raw), re.sub(r"\s+", " ", label).strip()
        if not k or not label:
            raise ValueError("an empty normalisation rule")
        if out.get(k, label) != label:
            raise ValueError(f"conflicting normalisation rules for {raw!r}")
        out[k] = label
        out.setdefault(text._key(label), label)
    return out


def normalized(df: DataFrame, authors: dict[str, str] | None = None, publishers: dict[str, str] | None = None) -> DataFrame:
    """df with author_normalized and publisher_normalized: labels by the rules, and of names with one key the first."""
    names, houses = alias_map(authors or {}), alias_map(publishers or {})
    label = lambda value, rules: rules.get(text._key(value), value)

    @F.pandas_udf("string")
    def author(t: pd.Series) -> pd.Series:
        def one(x) -> str:
            first: dict[str, str] = {}
            for n in () if x is None else x:
                first.setdefault(text._key(label(n, names)), label(n, names))
            return " | ".join(first.values())

        return t.map(one)

    @F.pandas_udf("string")
    def publisher(t: pd.Series) -> pd.Series:
        return t.map(lambda x: label(x, houses) if x else "")

    return df.withColumns({"author_normalized": author(text.split_authors(F.col("author"))), "publisher_normalized": publisher(text.clean_cell(F.col("publisher")))})


def _given(df: DataFrame, c: str) -> Column:
    """Whether a field has a value; absent columns have none."""
    if c not in df.columns:
        return F.lit(False)
    return text.present(F.col(c)) if dict(df.dtypes)[c] == "string" else F.col(c).isNotNull()


def prepared(df: DataFrame) -> DataFrame:
    """df with title_key, a valid number or an empty string, the set of author keys, the keys of the compared fields, null where there is no value, and how it ranks."""
    if not {"author_normalized", "publisher_normalized"} <= set(df.columns):
        df = normalized(df)
    good = F.when(isbn.valid(F.col("isbn")), isbn.clean(F.col("isbn"))).otherwise("")
    name = F.when(text.present(F.col("author_normalized")), F.col("author_normalized")).otherwise(F.col("author"))
    compared = {"isbn": "isbn", "publication_year": "publication_year", "publisher": "publisher_normalized", "series": "series"}
    keys = [F.when(text.present(F.trim(v)), text.key(v)).alias(c) if v in df.columns else F.lit(None).cast("string").alias(c) for c, v in compared.items()]
    number = F.coalesce(F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long"), F.lit(10**9)) if "id" in df.columns else F.lit(0)
    flag = lambda c: _given(df, c).cast("int")
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    full = sum((flag(c) for c in _COUNTED), F.lit(0))
    d = df.select("idx", text.key("title").alias("title_key"), good.alias("good"), text.keys(text.split_authors(name)).alias("authors"), *keys, F.array(*[x.cast("long") for x in (flag("curation"), flag("cover"), full)]).alias("score"), length(F.col("title")).alias("title_length"), length(name).alias("author_length"), number.alias("number"))
    return d.withColumn("score", F.concat("score", F.array(*[x.cast("long") for x in (F.size("authors"), F.col("title_length"), F.col("author_length"), -F.col("number"))]))).drop("title_length", "author_length", "number")


def _compatible(df: DataFrame) -> DataFrame:
    """Edges (a, b) that connect rows of one title exactly as pairs that don't contradict each other would."""
    rows = df.filter((F.col("title_key") != "") & (F.size("authors") > 0)).withColumn("authors", F.array_sort("authors")).withColumn("good", F.nullif("good", F.lit("")))
    alike = checkpointed(rows.groupBy("title_key", *_APART, "authors").agg(F.min("idx").alias("rep"), F.count(F.lit(1)).alias("m")))
    same = rows.join(alike.filter("m > 1"), [rows.title_key == alike.title_key, rows.authors == alike.authors, *[rows[c].eqNullSafe(alike[c]) for c in _APART]]).select(F.col("idx").alias("a"), F.col("rep").alias("b"))
    given = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(_APART)), F.lit(0))
    # titles of few combinations: all pairs of them; those of more go on by keys
    wide = alike.groupBy("title_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FEW).select("title_key")
    few, many = (checkpointed(alike.join(wide, "title_key", kind)) for kind in ("left_anti", "left_semi"))
    a, b = few.alias("a"), few.alias("b")
    inside = lambda s, t: F.size(F.array_except(f"{s}.authors", f"{t}.authors")) == 0
    agree = inside("a", "b") | inside("b", "a")
    for c in _APART:
        agree = agree & F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(True))
    direct = a.hint("merge").join(b, (F.col("a.title_key") == F.col("b.title_key")) & (F.col("a.rep") < F.col("b.rep")) & agree).select(F.col("b.rep").alias("a"), F.col("a.rep").alias("b"))
    if many.isEmpty():
        return same.union(direct)
    masks = many.select("title_key", "authors", "rep", *_APART, given.alias("own"))
    pairs = masks.withColumn("other", F.explode(F.array(*map(F.lit, range(1 << len(_APART))))))
    shared = [F.when(F.col("other").bitwiseAND(1 << i) > 0, F.col(c)) for i, c in enumerate(_APART)]
    key = F.xxhash64("title_key", F.least("own", "other"), F.greatest("own", "other"), F.to_json(F.struct(*[x.alias(c) for x, c in zip(shared, _APART, strict=True)]), {"ignoreNullFields": "false"}))
    side = F.col("own").cast("int")
    classes = checkpointed(pairs.groupBy("title_key", key.alias("key"), side.alias("own"), "other", "authors").agg(F.min("rep").alias("class"), F.count(F.lit(1)).alias("m")))
    # two classes with one key are whole partners if one's authors are among the other's; the first of the fewer is among the more
    x, y = classes.select("*", F.col("authors")[0].alias("name")).alias("x"), classes.select("*", F.explode("authors").alias("name")).alias("y")
    facing = (F.col("x.title_key") == F.col("y.title_key")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.name") == F.col("y.name")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    nested = (F.size(F.array_except("x.authors", "y.authors")) == 0) & ((F.col("x.own") != F.col("y.own")) | (F.col("x.authors") != F.col("y.authors")))
    met = checkpointed(x.join(y, facing & nested).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("title_key", "key", "own", "other", "authors", "class")]))
    across = met.select(F.col("x_class").alias("a"), F.col("y_class").alias("b"))
    on = ["title_key", "key", "own", "other", "authors"]
    partnered = met.select(*[F.col(f"x_{c}").alias(c) for c in on]).union(met.select(*[F.col(f"y_{c}").alias(c) for c in on])).distinct()
    # members of a class that has a partner meet through it
    members = pairs.withColumn("key", key).withColumn("own", side).join(classes.filter("m > 1").join(partnered, on, "left_semi"), on).select(F.col("rep").alias("a"), F.col("class").alias("b"))
    return same.union(direct).union(across).union(members)


def blocks(df: DataFrame) -> DataFrame:
    """idx and block of each row: components of equal numbers and of titles whose rows don't contradict each other."""
    df = checkpointed(df.select("idx", "title_key", "good", "authors", *_FIELDS))
    numbered = df.filter("good <> ''").select("good", F.col("idx").alias("a"))
    first = numbered.groupBy("good").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = numbered.join(first, "good").select("a", "b").union(_compatible(df))
    label = components(edges)
    return df.select("idx").join(label, df.idx == label.id, "left").select("idx", F.coalesce("component", "idx").alias("block"))


def numbers(df: DataFrame) -> DataFrame:
    """Valid numbers that several rows have: the number, the first row and how many there are."""
    good = df.filter(isbn.valid(F.col("isbn"))).select(isbn.clean(F.col("isbn")).alias("isbn"), "idx")
    return good.groupBy("isbn").agg(F.min("idx").alias("canonical_idx"), F.count(F.lit(1)).alias("size")).filter("size > 1")


def merged(df: DataFrame) -> DataFrame:
    """idx, canonical_idx, size and reason of each row's component; reason is null for single rows."""
    return _ranked(df).drop("rank")


def filled(df: DataFrame) -> DataFrame:
    """The canonical row of each component, its empty fields filled from the others in the order of their ranks, with the ids, pages and number of its source rows.

    source_pages are united where df has them; a row without source_record_count counts once.
    """
    if not {"author_normalized", "publisher_normalized"} <= set(df.columns):
        df = normalized(df)
    rows = df.join(_ranked(df), "idx")
    first = {c: F.min_by(c, F.when(_given(df, c), F.col("rank"))) if c in _FILLED else F.min_by(c, "rank") for c in df.columns if c not in ("idx", "source_pages", "source_record_count")}
    # where no row has a value, the canonical row's own stays
    cols = [F.coalesce(x, F.min_by(c, "rank")).alias(c) for c, x in first.items()]
    count = F.coalesce(F.col("source_record_count"), F.lit(1)) if "source_record_count" in df.columns else F.lit(1)
    pages = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages")))).alias("source_pages")] if "source_pages" in df.columns else []
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("source_record_ids")
    return rows.groupBy(F.col("canonical_idx").alias("idx")).agg(*cols, *pages, F.sum(count).alias("source_record_count"), ids, F.first("reason").alias("reason"))


def _ranked(df: DataFrame) -> DataFrame:
    """merged() with each row's rank in its component: what was curated, has a cover, is complete, has more authors, longer texts and the smaller id."""
    rows = checkpointed(prepared(df))
    label = checkpointed(blocks(rows))
    several = label.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("block")
    labelled = rows.join(label.join(several, "block"), "idx")
    single = label.join(several, "block", "left_anti").select("idx", F.col("idx").alias("canonical_idx"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("rank"))

    def solve(rows: list[dict]) -> list[tuple]:
        root = Merging(rows).roots()
        members: dict[int, list[int]] = {}
        for i, r in enumerate(root):
            members.setdefault(r, []).append(i)
        out = []
        for own in members.values():
            ranked = sorted(own, key=lambda i: ([-int(v) for v in rows[i]["score"]], rows[i]["idx"]))
            numbers = {rows[i]["good"] for i in own}
            reason = None if len(own) == 1 else "same_valid_isbn" if len(numbers) == 1 and "" not in numbers else "compatible_metadata"
            out += [(rows[i]["idx"], rows[ranked[0]]["idx"], len(own), reason, place) for place, i in enumerate(ranked)]
        return out

    return solved(labelled, "block", "idx", solve, _OUT).unionByName(single)


class _Summary:
    """What a component's rows say together."""

    __slots__ = ("changed", "chain", "count", "lone", "places", "scanned", "sound", "value")

    def __init__(self, row: dict) -> None:
        given = {c: None if row[c] is None else row[c] for c in ("isbn", *_FIELDS)}
        #: By field the one value that rows give; a raw number may have several, which is MIXED.
        self.value = given | {"good": row["good"] or None}
        self.count = {c: int(v is not None) for c, v in given.items()}
        #: Distinct author sets, each inside the next.
        self.chain = [frozenset(row["authors"])]
        self.sound = bool(self.chain[0])
        self.lone = not any(self.count.values())
        self.places: list[int] = []
        self.scanned, self.changed = -1, 0

    def joined(self, other: _Summary) -> _Summary:
        out = object.__new__(_Summary)
        out.value = {c: v if (w := other.value[c]) is None or v == w else w if v is None else MIXED for c, v in self.value.items()}
        out.count = {c: n + other.count[c] for c, n in self.count.items()}
        out.chain = sorted({*self.chain, *other.chain}, key=len)
        out.sound = self.sound and other.sound and all(a < b for a, b in zip(out.chain, out.chain[1:], strict=False)) and all(out.value[c] is not MIXED for c in _APART)
        out.lone = self.lone or other.lone
        return out

    def holds(self) -> bool:
        """No conflict, nested authors, and shared evidence or a row with none."""
        return self.sound and (self.lone or any(n > 1 and self.value[c] is not MIXED for c, n in self.count.items()))

    def keys(self) -> list[tuple]:
        """For every set of fields that a partner may give, what both give then."""
        own = [c for c in _APART if self.value[c] is not None]
        return [tuple((c, self.value[c]) for c in own if c in other) for other in _SETS]

    def posts(self) -> list[tuple]:
        """Where others find this component: its own set of fields and every part of it with its values."""
        own = tuple(c for c in _APART if self.value[c] is not None)
        return [(own, tuple((c, self.value[c]) for c in part)) for n in range(len(own) + 1) for part in combinations(own, n)]


class Merging:
    """The greedy procedure over the rows of a block, which are in order."""

    def __init__(self, rows: list[dict]) -> None:
        self.parent = list(range(len(rows)))
        self.summary = [_Summary(r) for r in rows]
        self.unions = 0
        first: dict[str, int] = {}
        titles: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            if r["good"]:
                self._unite(first.setdefault(r["good"], i), i)
            if r["title_key"]:
                titles.setdefault(r["title_key"], []).append(i)
        for rows_of_title in titles.values():
            if len(rows_of_title) > 1:
                self._title(rows_of_title)

    def roots(self) -> list[int]:
        return [self._root(i) for i in range(len(self.parent))]

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _unite(self, a: int, b: int, both: _Summary | None = None) -> None:
        x, y = self._root(a), self._root(b)
        if x != y:
            new = both or self.summary[x].joined(self.summary[y])
            self.parent[y] = x
            self.summary[x] = new
            self.unions += 1
            new.changed = self.unions

    def _title(self, rows: list[int]) -> None:
        """Pairs of a title's rows in order. A component is tried from its first row on against all others, and again from a later row only if a union came in between."""
        at: dict[tuple, set[int]] = {}
        places: dict[int, list[int]] = {}
        for place, i in enumerate(rows):
            places.setdefault(self._root(i), []).append(place)
        for r, own in places.items():
            s = self.summary[r]
            s.places, s.scanned = own, -1
            if s.sound:
                for k in s.posts():
                    at.setdefault(k, set()).add(r)
        for place, i in enumerate(rows):
            r, now = self._root(i), place
            s = self.summary[r]
            if not s.sound or s.scanned == self.unions:
                continue
            while s.sound:
                tried = sorted((self.summary[o].places[k], o) for own, key in zip(_SETS, s.keys(), strict=True) for o in at.get((own, key), ()) if o != r and (k := bisect_right(self.summary[o].places, now)) < len(self.summary[o].places))
                found = next(((p, o, both) for p, o in tried if (both := s.joined(self.summary[o])).holds()), None)
                if found is None:
                    break
                now, o, both = found
                for x in (r, o):
                    for k in self.summary[x].posts():
                        at[k].discard(x)
                both.places = sorted(self.summary[r].places + self.summary[o].places)
                self._unite(r, o, both)
                s = both
                for k in s.posts():
                    at.setdefault(k, set()).add(r)
            s.scanned = self.unions
