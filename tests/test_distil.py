import io
import random
import zipfile

import duckdb
import pytest

from tallyloom.functions import navigation
from tallyloom.functions.byte_pairs import count_tokens, merge_ranks, tokens_of
from tallyloom.operators import distil, lint
from tallyloom.operators.distil import Key, Located, Reference
from tallyloom.plans import distil_queries
from tallyloom.sources import books

DATA = "/root/testdata/sf0.01"


def got(df):
    return {tuple(r) for r in df.collect()}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as f:
        for name, data in files.items():
            f.writestr(name, data)
    return out.getvalue()


CONTAINER = '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
PACKAGE = '<package><manifest><item id="a" href="a%20b.x" media-type="t"/><item id="n" href="../n.x" properties="x nav"/><item id="g" href="gone"/></manifest><spine>{}</spine></package>'


def test_books_are_read_in_the_order_of_their_spine(spark, tmp_path):
    good = zipped({books.CONTAINER: CONTAINER, "o/p.opf": PACKAGE.format('<itemref idref="g"/><itemref idref="a"/>'), "o/a b.x": "text", "n.x": "<nav/>", "o/more": "m"})
    rows = [("good", good), ("good", good), ("cut", good[:200]), ("none", None), ("empty", b""), ("text", b"no archive"), ("bare", zipped({"x": "y"})), ("lost", zipped({books.CONTAINER: CONTAINER}))]
    rows += [("odd", zipped({books.CONTAINER: CONTAINER, "o/p.opf": "<package>"})), ("wrong", zipped({books.CONTAINER: CONTAINER, "o/p.opf": PACKAGE.format('<itemref idref="z"/>')})), ("root", zipped({books.CONTAINER: "<a/>"}))]
    found = books.ingest(spark.createDataFrame(rows, "book string, content binary")).collect()
    own = sorted((r["position"], r["member"], r["media_type"], r["nav"], bytes(r["content"] or b""), r["problem"] is None) for r in found if r["book"] == "good")
    assert own == sorted([(0, "o/gone", None, False, b"", False), (1, "o/a b.x", "t", False, b"text", True), (2, "n.x", None, True, b"<nav/>", True)] * 2)
    others = [r for r in found if r["book"] != "good"]
    assert len(others) == len(rows) - 2 and all(r["problem"] and r["position"] is None and r["content"] is None for r in others)
    large = books.ingest(spark.createDataFrame(rows[:1], "book string, content binary"), most_bytes=4).collect()
    assert [(r["position"], r["content"] is None, r["problem"]) for r in large if r["position"] == 2] == [(2, True, "6 bytes")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(good)
    (tmp_path / "c.txt").write_bytes(good)
    assert books.read_books(spark, str(tmp_path)).count() == 3
    assert books.ingest(spark.createDataFrame([], "book string, content binary")).count() == 0


def test_nested_lists_are_flattened():
    html = """<body><ul><li>not nav</li></ul><nav epub:type="toc"><h1>Contents</h1><ol>
      <li><a href="c1.x#a">One &amp; <b>only</b></a><ol><li><a href="../d.x">In</a><ul><li><span>deep</span></li></ul></li><li>last</ol>
      <li><a href="#here">Two</a></li><li></li></ol></nav><ol><li>after</li></ol></body>"""
    assert navigation.units(html, "t/n.x") == [
        (0, 1, None, "One & only", "t/c1.x", "One & only"), (1, 2, 0, "In", "d.x", "One & only / In"), (2, 3, 1, "deep", None, "One & only / In / deep"),
        (3, 2, 0, "last", None, "One & only / last"), (4, 1, None, "Two", None, "Two"), (5, 1, None, "", None, ""),
    ]
    assert [x[:4] for x in navigation.units("<ul><li>a<li>b<ul><li>c</ul></ul>")] == [(0, 1, None, "a"), (1, 1, None, "b"), (2, 2, 1, "c")]
    assert navigation.units("") == [] and navigation.units("<li>x</li>") == []
    assert len(navigation.units("<ol><li>" * 20_000)) == 20_000


@pytest.mark.parametrize("most", [1, 7, 40])
def test_pieces_join_to_the_text(most):
    rnd = random.Random(most)
    for _ in range(200):
        text = "".join(rnd.choices(["a", "bc", "é", "😀", " ", ". ", "\n", "\n\n", "\r\n"], k=rnd.randrange(60)))
        found = list(distil.pieces(text, most))
        assert "".join(x for _, x in found) == text and all(0 < len(x) <= most for _, x in found)
        assert [k for k, _ in found] == [sum(len(x) for _, x in found[:k]) for k in range(len(found))]
    assert [x for _, x in distil.pieces("aa bb. cc\ndd ee\n\nff gg", 11)] == ["aa bb. cc\n", "dd ee\n\n", "ff gg"]
    assert [x for _, x in distil.pieces("aa bb. cc dd", 9)] == ["aa bb. ", "cc dd"]


def test_chunk_ids_survive_edits_elsewhere(spark):
    parts = [f"part {k % 3} of the text, with some words in it.\n" for k in range(9)]
    rows = [("a", "".join(parts)), ("b", "new\n" + "".join(parts)), ("c", None), ("d", "")]
    found = distil.chunk(spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, no int"), most=len(parts[0])).collect()
    ids = {d: [r["chunk_id"] for r in sorted(found, key=lambda r: r["no"]) if r["doc_id"] == d] for d in "abcd"}
    assert len(set(ids["a"])) == 9 and ids["b"][1:] == ids["a"] and ids["c"] == ids["d"] == []


def test_store_constraints(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "héllo"), (2, "x"), (2, "y"), (None, "z"), (4, None)], "id long, text string")
    places = spark.createDataFrame([(1, 1, 3, sha("éll")), (1, 0, 9, sha("héllo")), (1, 0, 2, sha("no")), (1, 0, 2, None), (7, 0, 1, "x"), (None, 0, 1, "x"), (4, 0, 1, "x")], "doc long, s long, n long, d string")
    constraints = [Key("key", "texts", ("id",)), Key("pair", "places", ("doc", "s")), Reference("of", "places", ("doc",), "texts", ("id",), both=True), Reference("one way", "texts", ("id",), "places", ("doc",)), Located("at", "places", "doc", "s", "n", "d", "texts", "id", "text")]
    assert got(distil.check_store({"texts": texts, "places": places}, constraints)) == {
        ("key", "repeated key", "2", 2), ("key", "null key", None, 1), ("pair", "repeated key", "1\x1f0", 3), ("pair", "null key", None, 1), ("of", "no target", "7", 1), ("of", "null key", None, 1),
        ("of", "no source", "2", 2), ("one way", "no target", "2", 2), ("one way", "null key", None, 1), ("at", "wrong digest", "1", 2), ("at", "no target", "7", 1), ("at", "no target", None, 1), ("at", "wrong digest", "4", 1),
    }
    assert distil.check_store({"texts": texts.limit(0), "places": places.limit(0)}, constraints).count() == 0


def test_certificates_fold_to_the_worst(spark):
    rows = [
        ("a", 1, "x", "certified", None), ("a", 2, "y", "certified", "fine"), ("b", 3, "z", "qualified", "late"), ("b", 2, "y", "qualified", "early"), ("b", 1, "x", "certified", None), ("c", 1, "x", "qualified", "q"),
        ("c", 2, "y", "incomplete", None), ("d", 1, "x", "incomplete", "i"), ("d", 9, "y", "refused", "r"), ("d", 9, "y", "refused", "r"), ("e", 1, "x", None, "n"), ("e", 2, "y", "refused", "r"), ("f", 1, "x", "odd", "o"),
    ]
    reports = spark.createDataFrame(rows, "unit string, place int, report string, state string, reason string")
    want = {
        ("a", "certified", 0, 2, 0, None), ("b", "qualified", 0, 3, 2, "y: early"), ("c", "incomplete", 1, 2, 2, "y: no reason given"), ("d", "refused", 2, 3, 3, "y: r"), ("e", "refused", 2, 2, 2, "x: n"), ("f", "refused", 2, 1, 1, "x: o"),
    }
    assert got(distil.certify(reports)) == got(distil.certify(reports.repartition(3))) == want
    assert distil.certify(reports.limit(0)).count() == 0


def test_byte_pairs_by_hand():
    ranks = merge_ranks(["# table", "", "l o", "lo w", "e r", "n e", "w er", "a a", "aa a"])
    table = {"lower": ["low", "er"], "newer": ["ne", "wer"], "low": ["low"], "aaaa": ["aa", "aa"], "aaaaa": ["aa", "aaa"], "wer": ["wer"], "": [], "é": 2, " lo": [" ", "lo"], "nener": ["ne", "n", "er"]}
    for text, want in table.items():
        found = tokens_of(text.encode(), ranks)
        assert len(found) == want if isinstance(want, int) else [x.decode() for x in found] == want
    known = {}
    assert count_tokens("lower  newer\n".encode(), ranks, known) == count_tokens("lower  newer\n".encode(), ranks, known) == 2 + 2 + 2 + 1
    assert count_tokens(b"a" * 300_001, ranks, {}) == 150_000


def test_byte_pairs_against_rescanning():
    rnd = random.Random(5)
    lines = ["a b", "b a", "ab a", "a a", "ba b", "aa ab", "c a", "ab ab"]
    ranks = merge_ranks(lines)
    for _ in range(300):
        word = "".join(rnd.choices("abc", k=rnd.randrange(30))).encode()
        own = [word[k : k + 1] for k in range(len(word))]
        while True:
            best = min(((ranks[p], k) for k, p in enumerate(zip(own, own[1:])) if p in ranks), default=None)
            if best is None:
                break
            own[best[1] : best[1] + 2] = [own[best[1]] + own[best[1] + 1]]
        assert tokens_of(word, ranks) == own


def test_long_bodies_by_merges(spark):
    rows = [("a/SKILL.md", "---\nname: a\n---\n" + "ab" * 50), ("b/SKILL.md", "---\nname: a\n---\n" + "ba" * 10), ("c/SKILL.md", "ab" * 90)]
    tree = spark.createDataFrame(rows, "rel string, content string")
    assert got(lint.long_bodies(tree, 10, ranks=merge_ranks(["a b"]))) == {("a/SKILL.md", 50), ("b/SKILL.md", 11)}


@pytest.mark.parametrize("name", list(distil_queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(distil_queries.SQL[name])
    cols = [c[0] for c in cur.description]
    df = distil_queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(str, cur.fetchall()))
