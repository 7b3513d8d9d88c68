"""Components, merging of wide blocks, editions, provenance, the cache table and approximate search against plain procedures."""

import collections
import os
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import isbn, web
from quillspark.operators import curate, dedupe, match, reconcile, search
from quillspark.operators.components import components
from quillspark.plans import curation as plans
from quillspark.sources.cache import CacheTable
from quillspark.sources.checkpoints import checkpointed
from quillspark.sources.tables import copies
from tests.test_catalogue import plain_merge

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    part = {}
    for a, b in edges:
        part.setdefault(a, {a}), part.setdefault(b, {b})
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[a]:
                part[x] = part[a]
    want = {x: min(p) for x, p in part.items() if len(p) > 1}
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def merging(n, make):
    rows = [make(i) | {"idx": i} for i in range(n)]
    for r in rows:
        r["good"], r["isbn"] = r.get("good", ""), r.get("good") or None
    return rows


def test_a_wide_block_takes_seconds():
    """20,000 rows of one title that a row without any field holds together."""
    row = lambda i: {"title_key": "t", "authors": ["a"], "publication_year": None if i == 0 else str(1800 + i % 200), "publisher": None if i % 3 else f"p{i % 500}", "series": None}
    began = time.time()
    roots = dedupe.Merging(merging(20_000, row)).roots()
    assert time.time() - began < 60
    assert 200 <= len(set(roots)) < 20_000


def test_blocks_of_a_common_title(spark):
    """Blocks connect just the rows that pairs without contradiction connect."""
    rng = random.Random(4)
    rows = [(i, f"t{i % 3}", rng.choice(["", "g", "h"]), rng.choice([["a"], ["a", "b"], ["b"], ["c"], []]), *[rng.choice([None, None, "x", "y", "z"]) for _ in range(3)]) for i in range(90)]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            agree = all(p in ("", None) or q in ("", None) or p == q for p, q in zip(x[2:3] + x[4:], y[2:3] + y[4:], strict=True))
            s, t = set(x[3]), set(y[3])
            if (x[2] and x[2] == y[2]) or (x[1] == y[1] and agree and s and t and (s <= t or t <= s)):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    df = spark.createDataFrame(rows, "idx long, title_key string, good string, authors array<string>, publication_year string, publisher string, series string")
    assert {r["idx"]: r["block"] for r in dedupe.blocks(df).collect()} == {i: root(i) for i in range(len(rows))}


def test_reconciliation_of_random_snapshots(spark):
    """All passes against the plain order of matching, with signatures that many rows share."""
    rng = random.Random(6)
    make = lambda i: (i, f"book-{i + 1:04d}", rng.choice(["T", "t.", "U"]), rng.choice(["", "A", "a"]), rng.choice(["", "1", "2", "3"]), rng.choice(["", "1950"]))
    new, old = [make(i) for i in range(70)], [make(i) for i in range(60)]
    key = lambda r: tuple(v.lower().strip(".") for v in r[2:])
    free, want = {r[0]: r for r in old}, {}
    for r in new:
        if (o := next((o for o in free.values() if o[2:] == r[2:]), None)) is not None:
            want[r[0]] = ("exact", free.pop(o[0])[0])
    for r in new:
        if r[0] not in want and r[4]:
            o = max((o for o in free.values() if o[4] == r[4]), key=lambda o: (sum(bool(x) and x == y for x, y in zip(key(r), key(o), strict=True)), sum(map(bool, key(o))), -o[0]), default=None)
            if o is not None:
                want[r[0]] = ("isbn", free.pop(o[0])[0])
    for r in new:
        if r[0] not in want and (o := next((o for o in free.values() if key(o) == key(r)), None)) is not None:
            want[r[0]] = ("normalized", free.pop(o[0])[0])
    schema = "idx long, id string, title string, author string, isbn string, publication_year string"
    got = reconcile.reconciled(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert {r["idx"]: (r["pass"], r["old_idx"]) for r in got} == {r[0]: want.get(r[0], (None, None)) for r in new}
    assert {p for p, _ in want.values()} == {"exact", "isbn", "normalized"}


def test_a_signature_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "SPAN", 4)
    rows = spark.createDataFrame([(3 * i, "T", "") for i in range(20)], "idx long, title string, isbn string")
    got = reconcile.reconciled(rows, rows.filter("idx > 5")).orderBy("idx").collect()
    assert [r["old_idx"] for r in got] == [3 * i + 6 for i in range(18)] + [None, None]


def test_editions(spark):
    edition = "struct<key:string,title:string,isbn:array<string>,publish_date:array<string>,publisher:array<string>,cover_i:long>"
    schema = f"key string, title string, author_name array<string>, isbn array<string>, publish_year array<string>, publisher array<string>, cover_i long, cover_edition_key string, editions array<{edition}>"
    docs = [
        ("/w/1", "La Peste", ["Albert Camus"], ["9", "8"], ["1947", "1950"], ["Gallimard"], 11, "OL1", [("/e/1", "la peste", ["7", "6"], ["Paris 1947"], ["Éditions Gallimard"], 12), ("/e/2", "Autre", ["5"], None, None, 13)]),
        ("/w/2", "L'Étranger", ["A. Camus"], None, None, None, None, None, None),
        ("/w/3", "Nausée", ["Sartre"], ["4"], ["1938"], ["Gallimard"], 31, "", []), ("/w/4", "nausee", ["J. P. Sartre", "Sartre"], ["4"], ["1938"], ["Seuil"], 32, "", []), ("/w/5", "Nausée", ["Sartre"], ["3"], ["1938"], ["Seuil"], 0, "", []),
        (None, None, None, None, None, None, None, None, None),
    ]
    records = [("a", "La peste", "X | Camus, Albert", "6", "", ""), ("b", "LA PESTE", "Albert Camus", "8", "", ""), ("c", "La Peste", "Albert Camus", "", "Gallimard & fils", "mars 1947"), ("d", "La Peste", "Albert Camus", "", "Gallimard", "1950")]
    records += [("e", "La Peste", "Albert Camus", "5", "Seuil", "1947"), ("f", "Nausée", "Sartre", "4", "Seuil", "1938"), ("g", "Nausée", "Jean Sartre", "", "Seuil", "1938"), ("h", "", "", None, None, None)]
    got = match.edition_matches(spark.createDataFrame(records, "id string, title string, author string, isbn string, publisher string, publication_year string"), spark.createDataFrame(docs, schema)).collect()
    assert sorted(map(tuple, got)) == [("a", 120, 12, "/e/1"), ("b", 115, 11, "/books/OL1"), ("c", 95, 12, "/e/1"), ("d", 85, 11, "/books/OL1"), ("g", 85, 32, "/w/4")]


def test_provenance(spark):
    df = spark.createDataFrame([("a", "T", "", {"series": "s"}), ("b", None, "P", None)], "id string, title string, publisher string, data_provenance map<string,string>")
    schema = "id string, confidence string, reason string, sources array<string>, changes map<string,string>"
    rules = lambda *r: spark.createDataFrame([r], schema)
    out = {r["id"]: r for r in curate.applied(df, rules("a", "high", "why", ["x", "y"], {"title": "T", "publisher": "Q"}), ["title", "publisher"]).collect()}
    a, b = out["a"], out["b"]
    assert (a["title"], a["publisher"], a["data_provenance"], a["before"]) == ("T", "Q", {"series": "s", "title": "x,y", "publisher": "x,y"}, {"title": "T", "publisher": ""})
    assert (a["curation"]["changed_fields"], sorted(a["curation"]["verified_fields"]), a["curation"]["reason"]) == (["publisher"], ["publisher", "title"], "why")
    assert (b["title"], b["publisher"], b["curation"], b["data_provenance"]) == (None, "P", None, {})
    for wrong, message in ((("z", "high", "", [], {"title": "x"}), "unknown id"), (("a", "low", "", [], {"title": "x"}), "low confidence"), (("a", "high", "", [], {"colour": "x"}), "unknown field")):
        with pytest.raises(Exception, match=message):
            curate.applied(df, rules(*wrong), ["title", "publisher"]).collect()


def test_cascade_without_keys(spark):
    df = spark.createDataFrame([(1, "x", "1"), (2, "", "2"), (3, None, "3"), (4, "y", "4")], "idx long, isbn string, id string")
    first = spark.createDataFrame([("x", None), ("", "no")], "n string, url string")
    last = spark.createDataFrame([("x", "late"), ("y", "u")], "n string, url string")
    own = spark.createDataFrame([("2", "v"), ("1", "w")], "r string, url string")
    got = curate.cascade(df, [("a", first, "isbn", "n"), ("b", own, "id", "r"), ("c", last, "isbn", "n")]).orderBy("idx").collect()
    assert [r["cover"] and tuple(r["cover"]) for r in got] == [("a", None), ("b", "v"), None, ("c", "u")]


def test_cache_table(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    table = CacheTable(spark, str(tmp_path / "cache"), "k")
    assert table.version() == 0
    assert table.upsert(rows(("a", 1), ("b", 2)), "one")
    assert table.upsert(rows(("b", 3), ("c", 4)), "two")
    assert not table.upsert(rows(("a", 9)), "one")
    read = lambda **x: dict(map(tuple, table.read(**x).collect()))
    assert read() == {"a": 1, "b": 3, "c": 4} and read(version=1) == {"a": 1, "b": 2}
    table.compact()
    assert read() == {"a": 1, "b": 3, "c": 4} and table.version() == 3
    assert not CacheTable(spark, str(tmp_path / "cache"), "k").upsert(rows(("z", 0)), "two")
    assert [r[0] for r in table.missing(spark.createDataFrame([("a",), ("q",), (None,), ("q",)], "k string")).collect()] == ["q"]
    with pytest.raises(Exception, match="exist"):  # another writer has made the next version meanwhile
        table._commit(table._manifest())


def test_least_errors():
    def plain(text, query):
        column, best = list(range(len(query) + 1)), len(query)
        for c in text:
            new = [0]
            for i, x in enumerate(query, 1):
                new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (x != c)))
            column, best = new, min(best, new[-1])
        return best

    rng = random.Random(7)
    for _ in range(500):
        text, query = ("".join(rng.choice("abé ") for _ in range(rng.randint(a, b))) for a, b in ((0, 30), (1, 9)))
        assert search.least_errors(text, query, 99) == plain(text, query)


def test_approximate_search(spark):
    docs = [(1, "/a", "An Introduction to Sparks", "", ""), (2, "/b", "", None, "see the introdction to spark, twice: introduction to spark"), (3, "/c", "introduction", "to spark", "intro"), (4, "/d", None, "", "introductoin tu spark"), (5, "/e", "", "xx introduction to spork", "")]
    df = spark.createDataFrame(docs, "page_id int, href string, title string, section string, text string")
    index = search.postings(df)
    find = lambda q: [(r["page_id"], round(r["score"], 3)) for r in search.approximate(df, index, q).collect()]
    assert find("Introduction to spark") == [(1, 20.0), (5, round(20 * 20 / 21, 3)), (2, 10.0)]
    assert find("t") == []
    assert {r[0] for r in find("to")} == {1, 2, 3, 4, 5}
    assert find("absent from all of it") == []


def test_postings_hold_few_letters_at_once(spark, monkeypatch):
    texts = [(i, "abcabcabd " * (i % 4), "x" * i) for i in range(40)]
    want = {(t, f, r[0], tuple(i for i in range(len(r[n]) - 2) if r[n][i : i + 3] == t)) for r in texts for n, f in ((1, "title"), (2, "section")) for t in (r[n][i : i + 3] for i in range(len(r[n]) - 2))}
    told = lambda rows: sorted((r["term"], r["field"], r["page_id"], tuple(r["places"])) for r in rows)
    monkeypatch.setattr(search, "HELD", 50)
    whole = pa.table(dict(zip(("page_id", "title", "section"), zip(*texts, strict=True), strict=True))).to_batches()
    parts = list(search.posted(iter(whole), "page_id", ("title", "section"), None))
    assert told(r for x in parts for r in x.to_pylist()) == sorted(want)
    assert max(sum(len(y) for y in x.column(3).to_pylist()) for x in parts) <= 50 < len(want)
    df = spark.createDataFrame(texts, "page_id int, title string, section string")
    index = search.postings(df, fields=("title", "section"), terms=["abc", "xxx", "abc"])
    assert told(index.collect()) == sorted(x for x in want if x[0] in ("abc", "xxx"))


def test_flags_of_a_row_by_itself_keep_nothing(spark, tmp_path):
    rows = [(1, "A", "x", "p", "1999", "9780306406157"), (2, "a", "X", "", "", "978-0306406157"), (3, None, "", "p", "1950", "12"), (4, "B", "y", "p", "no", "")]
    df = spark.createDataFrame(rows, "idx int, title string, author string, publisher string, publication_year string, isbn string")
    told = lambda out: {r["idx"]: (r["isbn"], r["isbn_status"], [x for x in r["quality_flags"] if x not in curate.SHARED]) for r in out.collect()}
    shared = spark.conf.get("spark.checkpoint.dir")
    want = told(curate.flagged(df))
    before = set(os.listdir(shared))
    assert told(curate.flagged_alone(df)) == want
    assert set(os.listdir(shared)) == before
    assert {x for r in want.values() for x in r[2]} == set(curate.FLAGS[:1] + curate.FLAGS[1:2] + curate.FLAGS[3:7])


def test_attributes_in_any_order(spark):
    listed = f"""<div id="node-9"><a href='x'></a><div id="node-1"><a class="t" href="/livre/1"><img alt="L&#39;&eacute;t&eacute;" data-x="1>0" src="https://i{web.MEDIUM}9781.jpg"></a><b data-sku="9781">"""
    article = f"""<article id="1" class="product-category"><p>978&#49;</p><a href="/p?x=1&amp;y=2#z" class="big img-link"></a><img src="https://i/1{web.LIST_IMAGE}a.jpg" alt=" T " class="js-qv-product-cover"></article>"""
    df = spark.createDataFrame([(listed, article, "9781"), ("", None, "9781")], "l string, a string, n string")
    got = df.select(web.listed_result(F.col("l"), F.col("n"), F.lit("https://s/q")).alias("l"), web.article_result(F.col("a"), F.col("n"), F.lit("https://s/q")).alias("a")).collect()
    assert (got[0]["l"]["title"], got[0]["l"]["source_url"], got[0]["l"]["small"]) == ("L'été", "https://s/livre/1", f"https://i{web.SMALL}9781.jpg")
    assert (got[0]["a"]["title"], got[0]["a"]["source_url"], got[0]["a"]["large"]) == ("T", "https://s/p?x=1&y=2", f"https://i/1{web.LARGE_IMAGE}a.jpg")
    assert got[1]["l"]["isbn"] is None and got[1]["a"]["isbn"] is None


def folded(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip()


def plain_curation(raw):
    """All steps row by row: records by canonical idx, and counts for the report."""
    first, rows, counts = {}, [], collections.Counter()
    for r in raw:
        if r["isbn"]:
            first[r["isbn"]] = min(r["idx"], first.get(r["isbn"], r["idx"]))
    for r in raw:
        r = dict(r) | {"genre": "", "publication_date": ""}
        provenance, r["curation"] = {}, r["idx"] % 37 == 0
        if r["curation"]:
            counts["overrides"] += 1
            counts["changes"] += 1
            r["publisher"] = "Maison " + r["publisher"]
            provenance |= {"publisher": "a", "publication_year": "a"}
        if r["isbn"] and first[r["isbn"]] % 4 < 2:
            counts["matched"] += 1
            for f, v in (("author", "Ann B."), ("publisher", "Pub-A"), ("publication_date", "1987"), ("publication_year", "1987")):
                if not r[f]:
                    r[f], provenance[f] = v, "openlibrary_exact"
        r["cover"] = ("number", "https://n/" + r["isbn"]) if r["isbn"] and first[r["isbn"]] % 5 == 0 else ("id", "https://i/" + r["id"]) if r["idx"] % 7 == 0 else None
        names = {}
        for x in r["author"].split("|"):
            if x.strip():
                names.setdefault(folded(x), x.strip())
        r |= {"author_normalized": " | ".join(names.values()), "publisher_normalized": "Sept" if folded(r["publisher"]) == "brand 7" else " ".join(r["publisher"].split()), "provenance": provenance, "names": list(names)}
        rows.append(r)
    parts = plain_merge([{"idx": r["idx"], "title": folded(r["title"]), "authors": r["names"], "publisher": folded(r["publisher_normalized"]), "year": folded(r["publication_year"]), "series": folded(r["series"]), "isbn": r["isbn"], "valid": bool(r["isbn"])} for r in rows])
    by, out = {r["idx"]: r for r in rows}, {}
    fields = ("author", "title", "isbn", "publisher", "publication_date", "publication_year", "genre", "series")
    for part in set(parts.values()):
        score = lambda r: (r["curation"], r["cover"] is not None, sum(bool(r[f]) for f in fields), len(r["names"]), len(r["title"]), len(r["author_normalized"] or r["author"]), -int(r["id"][5:]), -r["idx"])
        ranked = sorted((by[i] for i in part), key=score, reverse=True)
        best = {f: next((r[f] for r in ranked if r[f]), ranked[0][f]) for f in (*fields, "author_normalized", "publisher_normalized", "cover", "provenance")}
        isbns = {r["isbn"] for r in ranked}
        reason = None if len(part) == 1 else "same_valid_isbn" if len(isbns) == 1 and "" not in isbns else "compatible_metadata"
        theme = ("odd" if int(best["title"][-1]) % 2 else "even") if re.search("no [0-9]+$", best["title"].lower()) else "other"
        listed = " ".join(f"{k}={v}" for k, v in sorted((best["provenance"] or {}).items()))
        out[ranked[0]["idx"]] = (ranked[0]["id"], best["title"], best["author_normalized"], best["publisher_normalized"], best["publication_year"], best["isbn"], best["cover"] and best["cover"][0], listed, ",".join(by[i]["id"] for i in sorted(part)), len(part), reason), theme
    return out, counts


def test_the_whole_curation(spark):
    raw = sorted((r.asDict() for r in copies(spark, SF).collect()), key=lambda r: r["idx"])
    want, counts = plain_curation(raw)
    got = {r["idx"]: r for r in plans.QUERIES["curation_records"](spark, SF).collect()}
    names = ("id", "title", "author_normalized", "publisher_normalized", "publication_year", "isbn", "provider", "provenance", "sources", "source_record_count", "reason")
    told = {i: tuple(r[c] for c in names) for i, r in got.items()}
    assert [(t, want.get(i, [None])[0]) for i, t in sorted(told.items()) if t != want.get(i, [None])[0]] == [] and len(told) == len(want)
    assert {i: r["theme"] for i, r in got.items()} == {i: t for i, (_, t) in want.items()}
    for r in got.values():
        assert ("missing_publisher" in r["flags"], "invalid_isbn" in r["flags"], "shared_isbn" in r["flags"]) == (r["publisher_normalized"] == "", False, False)
        assert r["isbn_status"] == ("valid" if r["isbn"] else "missing_unknown_year" if not r["publication_year"] else "missing_pre_1970" if int(r["publication_year"]) < 1970 else "missing_1970_or_later")
    told = {r["metric"]: r["value"] for r in plans.QUERIES["curation_report"](spark, SF).collect()}
    whole = [w for w, _ in want.values()]
    assert (told["raw_record_count"], told["record_count"], told["source_record_count"]) == (200, len(whole), 200)
    assert (told["manual_override_count"], told["manual_field_change_count"]) == (counts["overrides"], counts["changes"])
    assert told["cover_record_count"] == sum(w[6] is not None for w in whole)
    assert told["duplicate_group_count"] == sum(w[9] > 1 for w in whole)
    assert told["duplicate_reason_counts.same_valid_isbn"] == sum(w[10] == "same_valid_isbn" for w in whole)
    assert told["missing_fields.publisher"] == sum(w[3] == "" for w in whole)


def test_kept_tables_know_their_size(spark):
    """A guess of a few bytes for a large table would have it broadcast."""
    kept = checkpointed(spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(200_000))).alias("a")))
    assert kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 100_000
    assert kept.count() == 200_000


def test_blocks_by_pairs_and_by_keys(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"t{i % 5}", rng.choice(["", "g", "h"]), rng.choice([["a"], ["a", "b"], ["b"]]), *[rng.choice([None, "x", "y"]) for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "idx long, title_key string, good string, authors array<string>, publication_year string, publisher string, series string")
    found = []
    for few in (1, 100):
        monkeypatch.setattr(dedupe, "FEW", few)
        found.append({r["idx"]: r["block"] for r in dedupe.blocks(df).collect()})
    assert found[0] == found[1]


def test_numbers_are_cleaned_once(spark):
    """A number that is rescued and then judged isn't cleaned again for each of its digits."""
    rows = spark.createDataFrame([("978-0306406157",), ("9780306406157 123",), ("9780306406158 1",), ("0-306-40615-2",), ("",), (None,)], "isbn string")
    number = isbn.rescued(F.col("isbn"))
    got = rows.select(number.alias("n"), isbn.valid(number).alias("v"))
    assert [tuple(r) for r in got.collect()] == [("9780306406157", True), ("9780306406157", True), ("97803064061581", False), ("0306406152", True), ("", False), ("", False)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4


def test_flags_read_their_rows_once(spark):
    """What the rows come from isn't computed again for each of the counts."""
    c = spark.createDataFrame([(1, "T", "A", "P", "1950", ""), (2, "t.", "a", "P", "1950", "")], "idx long, title string, author string, publisher string, publication_year string, isbn string")
    out = curate.flagged(c)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["quality_flags"] for r in out.orderBy("idx").collect()] == [["same_title_author_related_editions"]] * 2
