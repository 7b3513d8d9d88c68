import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.functions import isbn, text, web
from quillspark.operators import curate, dedupe, extract, fetch, match, query, reconcile, search
from quillspark.plans import curation as plans
from quillspark.sources import rules
from quillspark.sources.tables import catalogue, copies

SF = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "supplier", "documents", "pages", "events", "conversations", "orders")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, pq.read_table(f"{SF}/{t}.parquet"))
    return con


def shape(rows):
    return sorted(str(tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_oracle(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({plans.SQL[name]}) q").fetchall()
    assert shape(df.select(*cols).collect()) == shape(want)


@pytest.fixture(scope="module")
def million(tmp_path_factory):
    """A folder of the catalogue's tables with rows beyond the millionth, whose ids the fixture's SQL cuts to those of other rows."""
    con, folder = duckdb.connect(), tmp_path_factory.mktemp("million")
    for t, key in (("part", "p_partkey"), ("lineitem", "l_partkey"), ("supplier", None)):
        moved = f" REPLACE (CAST(CASE WHEN {key} < 100 THEN {key} + 99950 ELSE 10 * {key} + 998990 END AS BIGINT) AS {key})" if key else ""
        con.sql(f"SELECT *{moved} FROM '{SF}/{t}.parquet'").write_parquet(str(folder / f"{t}.parquet"))
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", [
    "approved_matches",
    "audit_correction_log",
    "cover_cascade",
    "cover_cascade_ten",
    "identifier_candidates",
    "identifier_join",
    "override_join",
    "source_id_map",
    "override_provenance",
    "remaining_targets",
    "resumed_responses",
    "candidate_match",
    "best_match",
])
def test_ids_that_repeat(spark, million, name):
    con, folder = million
    df = plans.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({plans.SQL[name]}) q").fetchall()
    assert shape(df.select(*cols).collect()) == shape(want)


def test_reconciled_ids_of_a_million(spark, million):
    rows = plans.QUERIES["reconcile_ids"](spark, million[1]).collect()
    assert len(rows) == len({r["id"] for r in rows}) == million[0].sql("SELECT count(*) FROM part WHERE p_partkey % 19 <> 0").fetchall()[0][0]
    assert all(r["id"] == f"book-{r['old_idx'] + 1:06d}" for r in rows if r["old_idx"] is not None)


def test_exact_pairs_by_five_fields(spark, tmp_path):
    """Rows of one title, publisher and year whose genres differ are one group."""
    con = duckdb.connect()
    for t in ("part", "lineitem", "supplier"):
        alike = " REPLACE ('x' AS p_name, 'Brand#1' AS p_brand, 1::INT AS p_size)" if t == "part" else ""
        con.sql(f"SELECT *{alike} FROM '{SF}/{t}.parquet'").write_parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = plans.QUERIES["reconcile_exact"](spark, str(tmp_path)).select("idx", "old_idx").collect()
    assert shape(got) == shape(con.sql(f"SELECT idx, old_idx FROM ({plans.SQL['reconcile_exact']}) q").fetchall())


def test_hits_that_tie(spark):
    """Equal addresses with equal scores come in the order of their ids, wherever the rows lie."""
    rows = [(i, "p#s", 1) for i in range(40)]
    for order in (rows, rows[::-1]):
        hits = spark.createDataFrame(order, "page_id long, href string, score int").repartition(3)
        assert {r["page_id"]: r["place"] for r in search.collapsed(hits).collect()} == {i: i + 1 for i in range(40)}


def test_normalisers(spark):
    rows = spark.createDataFrame([("Straße",), ("œuvre",), ("ﬁn ²",), ("É, à!",), (None,)], "t string")
    got = rows.select(text.key("t"), text.fold("t")).collect()
    assert [tuple(r) for r in got] == [("strasse", "straße"), ("uvre", "œuvre"), ("fin 2", "ﬁn ²"), ("e a", "e, a!"), ("", "")]


def test_hash_and_numbers(spark):
    def fnv(s):
        h, b = 2166136261, s.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h = (h ^ int.from_bytes(b[i : i + 2], "big")) * 16777619 % 2**32
        return h

    words = ["", "a", "é|book-1", "😀x"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(text.fnv1a32("t")).collect()
    assert [r[0] for r in rows] == [fnv(w) for w in words]
    n = spark.createDataFrame([("9780306406157",), ("0306406152",), ("9780306406158",), ("",), (None,)], "t string")
    assert [r[0] for r in n.select(isbn.valid(text.F.col("t"))).collect()] == [True, True, False, False, False]
    assert n.select(isbn.to10(text.F.col("t"))).first()[0] == "0306406152"


def test_override_errors(spark):
    df = spark.createDataFrame([("a", "x")], "id string, title string")
    bad = spark.createDataFrame([("b", "high", "y")], "id string, confidence string, value string")
    with pytest.raises(Exception, match="unknown id"):
        curate.overridden(df, bad, "title").collect()


def test_merging_counts(spark):
    rows = dedupe.merged(copies(spark, SF)).collect()
    groups = {r["canonical_idx"]: r for r in rows if r["size"] > 1}
    assert len(rows) == 200
    assert len({r["canonical_idx"] for r in rows}) == 84
    assert sum(r["reason"] == "same_valid_isbn" for r in groups.values()) == 15
    assert len(groups) == 48


def test_ties_are_rejected(spark):
    df = spark.createDataFrame([("r", "a", 95), ("r", "b", 95), ("s", "a", 95), ("s", "b", 85)], "id string, target string, score int")
    assert [tuple(r) for r in match.best_unless_tied(df).collect()] == [("s", "a", 95)]


def test_candidates(spark, monkeypatch):
    monkeypatch.setattr(match, "HOT", 1)
    schema = "id string, title string, author string, isbn string, publisher string, publication_year string, edition boolean"
    records = [("r", "L'Étranger", "X | Camus, Albert", "", "Éditions Gallimard", "1942", True), ("s", "La Peste", "A. Camus", "1", "Seuil", "mars 1947", True), ("t", "!", "A. Camus", "1", "", "", True)]
    docs = [("a", "l etranger", "Albert Camus", "2", "gallimard", "1942", True), ("b", "L'etranger", "Albert Camus", "3", "Gallimard & fils", "vers 1942", False), ("c", "L'etranger", "Sartre", "", "Gallimard", "1942", True), ("d", "L'etranger", "Albert Camus", "", "Gallimard", "1943", True)]
    docs += [("e", "La peste", "Albert Camus", "1", None, None, False), ("f", "Autre", "Albert Camus", "1", "Seuil", "1947", True), ("g", "la peste", "Albert Camus", "1", "Seuil", "1947", True), ("h", "la peste", "Albert Camus", "4", "Seuil", "1947", True)]
    got = match.scored(match.candidates(spark.createDataFrame(records, schema), spark.createDataFrame(docs, schema))).select("id", "target", "score").collect()
    assert sorted(map(tuple, got)) == [("r", "a", 95), ("r", "b", 85), ("s", "e", 115), ("s", "g", 120), ("s", "h", 95)]


def test_flags(spark):
    rows = [(1, "", "", "", "", ""), (2, "L'Été", "A | B", "2-07-036002-4", "P", "March 1998"), (3, "l ete", "a b", "2070360024", "P", "1950"), (4, "T", "A", "", "P", "1950"), (5, "T", "", "12", "P", "x"), (6, "U", "A", "n.c.", "P", "vers 1980")]
    df = spark.createDataFrame(rows, "idx long, title string, author string, isbn string, publisher string, publication_year string")
    got = {r["idx"]: r["quality_flags"] for r in curate.flagged(df).collect()}
    pair = ["shared_isbn_possible_multiple_copy", "same_title_author_related_editions"]
    assert got == {1: ["missing_isbn_unknown_year", "missing_title", "missing_author", "missing_publisher", "missing_or_invalid_year"], 2: pair, 3: pair, 4: [], 5: ["invalid_isbn", "missing_author", "missing_or_invalid_year"], 6: ["missing_isbn_1970_or_later"]}


def test_reconciliation_by_eight_fields(spark):
    schema = "idx long, id string, title string, author string, isbn string, publisher string, publication_year string, series string, genre string"
    row = lambda i, id, title, isbn, series, genre: (i, id, title, "Éluard", isbn, "P", "1950", series, genre)
    old = [row(0, "book-0007", "T", "", "Tome 1", "g"), row(1, "book-0009", "T", "", "Tome 2", "g"), row(2, "x", "N", "1", "I", "a"), row(3, "book-0002", "N", "1", "II", "b"), row(4, "book-0003", "Été", "", "", "")]
    new = [row(0, None, "T", "", "Tome 2", "g"), row(1, None, "T", "", "Tome 3", "g"), row(2, None, "N.", "1", "ii", "b"), row(3, None, "ete", "", "", ""), row(4, None, "Neu", "", "", "")]
    got = reconcile.identified(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert {r["idx"]: (r["pass"], r["old_idx"], r["id"]) for r in got} == {0: ("exact", 1, "book-0009"), 1: (None, None, "book-0010"), 2: ("isbn", 3, "book-0002"), 3: ("normalized", 4, "book-0003"), 4: (None, None, "book-0011")}


def test_merging_by_keys(spark):
    schema = "idx long, id string, title string, author string, publisher string, publication_year string, series string, isbn string, genre string, source_pages array<int>, source_record_count int"
    rows = [(0, "b-1", "Poèmes", "Paul Éluard", "BRAND#1", "1950", "", "", "", [3], None), (1, "b-2", "poemes", "paul eluard", "Brand 1", "", "Blanche", "", "verse", [2, 3], 2), (2, "b-3", "Poemes", "Eluard (Paul)", "", "1950", "BLANCHE", "", "", None, None)]
    rows += [(3, "b-4", "Poemes", "Paul Eluard", "Autre", "1950", "", "", "", [9], None)]
    df = dedupe.normalized(spark.createDataFrame(rows, schema), {"Eluard (Paul)": "Paul Éluard"}, {"Brand 1": "Brand"})
    got = {r["id"]: r for r in dedupe.filled(df).collect()}
    assert sorted(got) == ["b-2", "b-4"]
    r = got["b-2"]
    assert (r["source_record_ids"], r["source_pages"], r["source_record_count"]) == (["b-1", "b-2", "b-3"], [2, 3], 4)
    assert (r["idx"], r["title"], r["publisher_normalized"], r["publication_year"], r["series"], r["genre"], r["reason"]) == (1, "poemes", "Brand", "1950", "Blanche", "verse", "compatible_metadata")
    assert (got["b-4"]["source_record_ids"], got["b-4"]["source_record_count"], got["b-4"]["publication_year"]) == (["b-4"], 1, "1950")
    with pytest.raises(ValueError, match="conflicting"):
        dedupe.alias_map({"A.": "B", "a": "C"})


def test_empty_catalogue(spark):
    empty = catalogue(spark, SF).limit(0)
    assert query.metrics(empty).first()["total"] == 0
    assert query.CatalogueQuery("x").run(empty).count() == 0


def test_highlight_and_matches(spark):
    def plain(t, q):
        at = t.lower().find(q.lower())
        if at < 0:
            return t
        m = t[:at] + web.MARK + t[at : at + len(q)] + web.END_MARK + t[at + len(q) :]
        first = 0 if at < 50 else max(m.rfind(c, 0, at) for c in " ,:") + 1
        end = first + len(web.MARK + web.END_MARK) + 200
        if end > len(m):
            return m[first:]
        stop = min((i for i in (m.find(c, end) for c in " ,:") if i >= 0), default=None)
        return m[first : len(m) - 1] if stop is None else m[first:stop] + "…"

    words = "un deux, trois: quatre The cinq " * 30
    texts = [words, words[:100], "x" * 300 + " the " + "y" * 400, "the", "", "rien", "x" * 60 + "the end", words[:260]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for q in ("the", "quatre", "zz"):
        assert [r[0] for r in df.select(web.highlighted(F.col("t"), q)).collect()] == [plain(t, q) for t in texts]
    df = spark.createDataFrame([("a  b ab a\nb aab",), (None,)], "t string")
    assert [r[0] for r in df.select(web.matches(F.col("t"), "a b")).collect()] == [2, 0]
    assert [r[0] for r in df.select(web.matches(F.col("t"), "ab")).collect()] == [4, 0]


def test_page_fragments(spark):
    schema = "document long, page int, row int, author string, title string, isbn string, publisher string, publication_date string, genre string, publication_year string, series string"
    row = lambda p, r, author, title, isbn="", date="mai 2001", year="", publisher="": (1, p, r, author, title, isbn, publisher, date, "", year, "")
    rows = [
        row(1, 0, "Author", "Title"), row(1, 1, "A", "Introduction to the", year="2001"), row(2, 0, "B", "Theory", date="", publisher="P"), row(2, 1, "C |", "T", "1"), row(3, 0, "D", "", date=""), row(4, 0, "| E", "(part", date=""),
        row(5, 0, "F", "one)", date=""), row(5, 1, "G", "Whole", "2"), row(6, 0, "H", "Other", "3"), row(6, 1, "", "", date=""), row(7, 0, "I", "Alone", date="2002"),
    ]
    got = extract.records(spark.createDataFrame(rows, schema)).orderBy("page", "row").collect()
    assert [(r["author"], r["title"], r["source_pages"]) for r in got] == [("A B", "Introduction to the Theory", [1, 2]), ("C | D | E F", "T (part one)", [2, 3, 4, 5]), ("G", "Whole", [5]), ("H", "Other", [6]), ("I", "Alone", [7])]
    assert got[0]["publisher"] == "P"


def test_report_file(tmp_path):
    rules.write_report(str(tmp_path / "a" / "r.json"), {"b": "é", "a": 1}, ordered=True)
    assert (tmp_path / "a" / "r.json").read_text() == '{\n  "a": 1,\n  "b": "é"\n}\n'


def test_errors_of_rules(spark):
    df = spark.createDataFrame([("a", "T", ["x"]), ("b", "U", ["x"])], "id string, title string, source_record_ids array<string>")
    with pytest.raises(Exception, match="two records"):
        fetch.source_ids(df).collect()
    bad = spark.createDataFrame([("a", "u", "V")], "id string, url string, title string")
    with pytest.raises(Exception, match="have changed"):
        fetch.approved(df, bad, ["title"]).collect()
    with pytest.raises(Exception, match="absent"):
        fetch.approved(df, bad.withColumn("id", F.lit("z")), ["title"]).collect()


def test_empty_report(spark):
    c = catalogue(spark, SF).limit(0)
    rows = {r["metric"]: r["value"] for r in plans._report(c).collect()}
    assert (rows["record_count"], rows["cover_record_rate"], rows["preserved_distinct_isbn_group_count"]) == (0, None, 0)


def number13(n):
    body = f"978{n:09d}"
    return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)


def plain_merge(rows):
    """The conservative procedure in plain Python: numbers first, then titles in order of appearance, each pair against its whole combined component."""
    part = {r["idx"]: frozenset([r["idx"]]) for r in rows}
    by = {r["idx"]: r for r in rows}

    def unite(a, b):
        both = part[a] | part[b]
        for i in both:
            part[i] = both

    def fits(ids):
        m = [by[i] for i in ids]
        if len({r["isbn"] for r in m if r["valid"]}) > 1 or any(len({r[c] for r in m} - {""}) > 1 for c in ("year", "publisher", "series")):
            return False
        names = [set(r["authors"]) for r in m]
        if not all(names) or any(not (x <= y or y <= x) for x in names for y in names):
            return False
        fields = ("isbn", "year", "publisher", "series")
        shared = any(len(v) > 1 and len(set(v)) == 1 for v in ([r[c] for r in m if r[c]] for c in fields))
        return shared or any(not any(r[c] for c in fields) for r in m)

    for a in rows:
        for b in rows:
            if a["valid"] and b["valid"] and a["isbn"] == b["isbn"]:
                unite(a["idx"], b["idx"])
    for title in dict.fromkeys(r["title"] for r in rows):
        ids = [r["idx"] for r in rows if r["title"] == title]
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if part[a] is not part[b] and fits(part[a] | part[b]):
                    unite(a, b)
    return part


def test_merging_of_random_catalogues(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(60):
        some = []
        for _ in range(rng.randint(2, 10)):
            valid = rng.random() < 0.4
            some.append({
                "idx": len(rows) + len(some), "title": f"t{k} {rng.randint(0, 1)}", "authors": [[], ["ann"], ["ann", "bob"], ["cy"]][rng.choice([0, 1, 1, 2, 2, 3])], "publisher": rng.choice(["", "", "p", "q"]), "year": rng.choice(["", "", "1950", "1960"]), "series": rng.choice(["", "", "", "s"]),
                "isbn": number13(10 * k + rng.randint(0, 2)) if valid else rng.choice(["", "", "12"]), "valid": valid,
            })
        rows += some
        want |= plain_merge(some)
    data = [(r["idx"], "b-%d" % r["idx"], r["title"].upper(), " | ".join(r["authors"]), r["publisher"], r["year"], r["series"], r["isbn"]) for r in rows]
    df = spark.createDataFrame(data, "idx long, id string, title string, author string, publisher string, publication_year string, series string, isbn string")
    got = {}
    for r in dedupe.merged(df).collect():
        got.setdefault(r["canonical_idx"], set()).add(r["idx"])
    assert {frozenset(x) for x in got.values()} == set(want.values())
    assert 20 < len(got) < len(rows)


def test_numbers_of_random_snapshots(spark):
    rng = random.Random(5)
    make = lambda i: (i, str(rng.randint(0, 12)), rng.choice("TU"), rng.choice(["", "a", "b"]), rng.choice(["", "x", "y"]), rng.choice(["", "1950", "1951"]))
    new, old = [make(i) for i in range(80)], [make(i) for i in range(80)]
    schema = "idx long, isbn string, title string, author string, publisher string, publication_year string"
    free, want = set(range(80)), {}
    for r in new:
        best = max((o for o in old if o[0] in free and o[1] == r[1]), key=lambda o: (sum(bool(x) and x == y for x, y in zip(r[1:], o[1:], strict=True)), sum(map(bool, o[1:])), -o[0]), default=None)
        if best:
            want[r[0]] = best[0]
            free.remove(best[0])
    got = reconcile.by_number(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert {r["idx"]: r["old_idx"] for r in got} == want
