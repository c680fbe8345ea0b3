import time
import tracemalloc

import duckdb
import pyarrow as pa
import pytest

from tallyloom.functions import markdown
from tallyloom.functions.front_matter import read_front
from tallyloom.operators import lint
from tallyloom.plans import lint_queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("kit/SKILL.md", "---\nname: kit\nlist:\n  - a\n# note\n---\n[a](docs/a.md) [up](../other/SKILL.md#x) [self](#y) [web](https://a.b/c) [dir](docs)"),
        ("kit/docs/a.md", "[gone](./b.md) ![pic](/kit/pic.png 'title') [out](../../../x.md)"),
        ("kit/docs/c.md", None),
        ("kit/pic.png", ""),
        ("other/SKILL.md", "﻿---\r\nname: 'wrong'\r\n---\r\n"),
        ("third/Skill.MD", "---\nname: third\n---"),
        ("open/SKILL.md", "---\nname: open\n"),
        ("odd/SKILL.md", "---\nname odd\n---\n"),
        ("SKILL.md", None),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], "rel string, content string, name string")


def got(df):
    return {tuple(r) for r in df.collect()}


def test_front_matter(tree):
    assert got(lint.byte_order_marks(tree)) == {("other/SKILL.md",)}
    assert got(lint.wrong_case(tree)) == {("third/Skill.MD",)}
    assert got(lint.mismatched_names(tree)) == {("other/SKILL.md", "wrong", "other")}
    assert got(lint.unreadable_front_matter(tree)) == {("open/SKILL.md",), ("odd/SKILL.md",)}


def test_front_matter_values(spark):
    lines = {"description: does x: and y": False, "description: 'does x: and y'": True, 'd: "a: b"': True, "d: ends:": False, "url: http://a.b/c": True, "time: 10:30": True, "d: >\n  folded: text": True, "d: [a: b]": True, "d:": True, "d:x": False}
    rows = [(f"{k}/SKILL.md", f"---\n{x}\n---\n") for k, x in enumerate(lines)]
    assert got(lint.unreadable_front_matter(spark.createDataFrame(rows, "rel string, content string"))) == {(f"{k}/SKILL.md",) for k, ok in enumerate(lines.values()) if not ok}


def test_limits(spark):
    rows = [
        ("a/SKILL.md", "---\nname: a\ndescription: >-\n  one two\n  three\nother: 1\n---\n" + "x" * 41),
        ("b/SKILL.md", "---\nname: b\ndescription: 'short'\n---\nbody"),
        ("c/SKILL.md", "---\nname: c\n---\n"),
        ("d/SKILL.md", None),
        ("e/notes.md", "---\nother: 1\n---\n" + "x" * 90),
    ]
    tree = spark.createDataFrame([(*r, 1) for r in rows], "rel string, content string, key int")
    assert got(lint.description_lengths(tree, 12)) == {("a/SKILL.md", 13), ("c/SKILL.md", 0)}
    assert got(lint.unknown_keys(tree, ["name", "description"])) == {("a/SKILL.md", "other")}
    assert got(lint.long_bodies(tree, most=10)) == {("a/SKILL.md", 11)}
    assert got(lint.doctor(tree, 12, ["name", "description"])) == {("a/SKILL.md", "description"), ("c/SKILL.md", "description"), ("a/SKILL.md", "unknown key")}
    assert lint.doctor(tree.limit(0), 12, []).count() == 0


def test_links_of_ordinary_markdown(spark):
    body = "[x](b%20c.md) [y](<b c.md>) [z](e(1).md 'title') [r][ref] `[code](gone.md)` ``a ` [code](gone.md)`` [p](a+b.md)\n\n```\n[code](gone.md)\n```\n\n[ref]: docs/r.md\n"
    rows = [("k/SKILL.md", body), *((f"k/{x}", None) for x in ("b c.md", "e(1).md", "a+b.md", "docs/r.md", "docs/s.md")), ("k/docs/t.md", "[s](s.md)")]
    tree = spark.createDataFrame(rows, "rel string, content string")
    assert lint.broken_links(tree).count() == 0
    assert got(lint.unlinked(tree)) == {("k/docs/s.md",), ("k/docs/t.md",)}
    assert got(lint.unlinked(tree, body_only=False)) == {("k/docs/t.md",)}


def test_links(tree):
    assert got(lint.links(tree)) == {("kit/SKILL.md", x) for x in ("kit/docs/a.md", "other/SKILL.md", "kit/docs")} | {("kit/docs/a.md", x) for x in ("kit/docs/b.md", "kit/pic.png", "../x.md")}
    assert got(lint.broken_links(tree)) == {("kit/docs/a.md", "kit/docs/b.md"), ("kit/docs/a.md", "../x.md")}
    assert got(lint.unlinked(tree)) == {("kit/docs/c.md",)}
    for rule in (lint.byte_order_marks, lint.wrong_case, lint.mismatched_names, lint.unreadable_front_matter, lint.links, lint.broken_links, lint.unlinked):
        assert rule(tree.limit(0)).count() == 0


def test_counts(spark):
    evals = spark.createDataFrame([("a", i < 8) for i in range(17)] + [("b", True), ("b", None)], "name string, triggers boolean")
    assert got(lint.trigger_sets(evals)) == {("a", 8, 9, True), ("b", 1, 0, False)}
    units, some = (spark.createDataFrame([(x,) for x in xs], "u long") for xs in ([1, 2, 2, 3, None], [2, 2, 9, None]))
    assert got(lint.coverage(units, some, "u")) == {(3, 1, 1 / 3)}
    assert got(lint.coverage(units.limit(0), some, "u")) == {(0, 0, None)}
    assert got(lint.untraced(units, some, "u")) == {(1,), (3,), (None,)}


@pytest.mark.parametrize("name", list(lint_queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(lint_queries.SQL[name])
    cols = [c[0] for c in cur.description]
    df = lint_queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize(
    "text, want",
    [
        ("![a](data:image/png;base64," + "A" * 5_000_000 + ") [x](e(1).md)", ["data:image/png;base64," + "A" * 5_000_000, "e(1).md"]),
        ("[](" * 300_000, []),
        ("[a](b" * 300_000, []),
        ("](" * 500_000 + "[x](y)", ["y"]),
        ("`` ` " * 300_000 + "[x](y)", ["y"]),
        ("[a](" + "x/../" * 500_000 + "b.md)", ["x/../" * 500_000 + "b.md"]),
        ("[" * 3_000_000, []),
        ("[![i](a.png)](b.md) \\[n](x) [k](a b) [s]( c.md ) [t](d(1).md 'x') [u](e(f)g)[v](h) [w]((i)) []() [o](a(b", ["a.png", "b.md", "c.md", "d(1).md", "e(f)g", "h", "(i)"]),
        ("[a]: <m n.md>\n  [b]: x 'title'\n    [c]: y\n~~~ x\n[d](e)\n~~\n~~~~\n`a\n[f](g)`\n\n`[h](i)", ["m n.md", "x", "i"]),
    ],
    ids=range(9),
)
def test_targets_in_linear_time(text, want):
    began = time.time()
    assert list(markdown.targets(text)) == want
    assert time.time() - began < 30


def test_huge_links_and_descriptions(spark):
    far = "x/../" * 1_000_000 + "b.md"
    rows = [
        ("k/SKILL.md", "---\nname: k\ndescription: a\n" + "  more\n" * 20_000 + "---\n![a](data:image/png;base64," + "A" * 5_000_000 + f") [e](e(1).md) [f]({far})"),
        ("k/e(1).md", "\ud7ff" * 100_000),
        ("k/b.md", None),
    ]
    tree = spark.createDataFrame(rows, "rel string, content string")
    assert got(lint.links(tree)) == {("k/SKILL.md", "k/e(1).md"), ("k/SKILL.md", "k/b.md")}
    assert got(lint.description_lengths(tree, 1024)) == {("k/SKILL.md", 100_001)}
    assert got(lint.doctor(tree, 1024, ["name", "description"])) == {("k/SKILL.md", "description")}
    odd = spark.createDataFrame([("k/a.md", bytearray(b"\xff[x](y%zz.md) [z](%ff.md)"))], "rel string, content binary")
    assert got(lint.links(odd)) == {("k/a.md", "k/y%zz.md"), ("k/a.md", "k/%ff.md")}


UNREADABLE = [
    'description: "abc', "name: [a, b", "\tname: a", "a: 1\na: 2", 'name: "a" b', "name: @x", "name: %x", "name: a\n  b: c", "- a: b: c", "name:x", 'a: "x\\qy"', "a: {b: [c}", "a:\n    b: 1\n  c: 2",
    "a: |x\n  b", "? a", 'a: ["b" c]', "a: b\n c\nd", "a: *b c", "a: 'b", "a: [`b]", "a:\n\tb: 1", "a: b\n- c", "a: - b", "a: 'b'c", "a: ]", "a: b:", "[a", 'a: "b\nc"', "a:\n  b: 1\n  b: 2",
]
READABLE = [
    "", "d: 'x: y'", "url: http://a.b/c", "t: 10:30", "d: >\n  folded: text\n\n  - more", "d: [a: b]", "d:", "l:\n  - a\n# note\nm: 1", "l:\n- a\n- b: c\n  d: e\n- - x\n  - y\nk: v", "a: {b: c, 'd': [1, 2]} # x",
    "a: [x,\n  y]\nb: 1", "d: one\n  two\n\n  three", 'd: "one\n  two: \\" x"', "a: &x b\nc: *x", "a: !t b", "'q k': v", "d: a#b", "d: 'it''s: so'", "a:\n  b:\n    c: 1\n  d: 2\ne: 3", "x: -1", "d: |2-\n   a\n  b", "a: b # c: d", "a:   \n  b", "- a\n- b",
]


@pytest.mark.parametrize("text", UNREADABLE)
def test_front_matter_that_no_parser_reads(text):
    assert read_front(text)[1]


@pytest.mark.parametrize("text", READABLE)
def test_front_matter_that_parsers_read(text):
    assert read_front(text)[1] is None


def test_front_matter_scalars():
    found, _ = read_front('name: a b # c\nd: >-\n  x\n  y\ne: "one\n  \\"two\\""\nf: \'it\'\'s\'\nl:\n  - z\ng: one\n  two\nh:\n  three\n  four')
    assert [(k, " ".join(v.split())) for k, v in found] == [("name", "a b"), ("d", "x y"), ("e", 'one "two"'), ("f", "it's"), ("l", ""), ("g", "one two"), ("h", "three four")]


def test_doctor_over_roots(spark):
    said = "---\nname: {}\ndescription: d\n---\n"
    rows = [
        ("here", "a/SKILL.md", said.format("a")), ("here", "b/SKILL.md", "\ufeff" + said.format("c")), ("here", "b/docs/SKILL.md", "x"), ("here", "top.md", "x"), ("here", "d/x.md", None),
        ("home", "a/SKILL.md", said.format("a")), ("home", "b/skill.md", None), ("home", "b/SKILL.md", said.format("b")), ("lost", "e/SKILL.md", said.format("e")),
    ]
    trees = spark.createDataFrame(rows, "root string, rel string, content string")
    roots = spark.createDataFrame([("home", 0), ("here", 1), ("none", 2)], "root string, rank int")
    want = {
        ("home", 0, "a", "a/SKILL.md", None, True, "home"), ("here", 1, "a", "a/SKILL.md", None, True, "home"), ("here", 1, "b", "b/SKILL.md", "byte-order mark", False, "home"),
        ("here", 1, "b", "b/SKILL.md", "name is not its folder", False, "home"), ("here", 1, "d", None, "no entry file", False, None), ("home", 0, "b", "b/skill.md", "wrong case", False, "home"),
        ("home", 0, "b", "b/skill.md", "unreadable front matter", False, "home"), ("home", 0, "b", "b/SKILL.md", None, True, "home"), ("none", 2, None, None, None, None, None),
    }
    assert got(lint.doctor_roots(trees, roots, 10, ["name", "description"])) == want
    assert got(lint.doctor_roots(trees.limit(0), roots, 10, [])) == {(r, k, None, None, None, None, None) for k, r in enumerate(["home", "here", "none"])}


class _Given:
    """Stands for a DataFrame whose mapInArrow runs here, on one batch."""

    def __init__(self, schema, batch):
        self.schema, self.columns, self.batch = schema, schema.names, batch

    def mapInArrow(self, run, schema):
        for out in run(iter([self.batch])):
            self.rows = getattr(self, "rows", 0) + out.num_rows
        return self


@pytest.mark.parametrize("script", ["a", "\u044f"])
def test_front_matter_holds_no_whole_batch(spark, script):
    schema = spark.createDataFrame([], "rel string, content binary").schema
    contents = [f"---\nname: p{k}\n---\n{script * 40_000}".encode() for k in range(400)] + [None, b"", b"---\nopen"]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(contents))]), pa.array(contents)], ["rel", "content"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    given = lint._with_front(_Given(schema, batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the texts of the batch are 16 or 32 MB in Python
    assert given.rows == 403 and peak < 5e6 and pa.total_allocated_bytes() - before < 5e6
