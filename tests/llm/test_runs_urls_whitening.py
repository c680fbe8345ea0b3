"""Operators 11 to 13 against brute force, with the edge cases of their docstrings."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries
from tallyloom.llm.oracles import oracle_sql
from tallyloom.llm.periodic_runs import find_runs, periodic_runs
from tallyloom.llm.url_filter import blocked_filter, may_hold, url_verdicts
from tallyloom.llm.whitening import fit_whitening, whiten

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def brute_runs(w):
    out = []
    for p in range(1, len(w) // 3 + 1):
        k = 0
        while k + p < len(w):
            if w[k] != w[k + p]:
                k += 1
                continue
            s = k
            while k + p < len(w) and w[k] == w[k + p]:
                k += 1
            part = w[s : k + p]
            if len(part) >= max(24, 3 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((s, len(part), p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_texts():
    rnd = random.Random(3)
    texts = [None, "", " \n\t ", "a " * 23, "a " * 24, "A a " * 12, "a b " * 12, "é\u00a0ü " * 30]
    for n, letters in ((60, "ab"), (400, "ab"), (300, "abc"), (900, "abcdefgh"), (50, "a"), (2000, [f"w{i}" for i in range(300)])):
        for _ in range(6):
            w = [rnd.choice(letters) for _ in range(n)]
            for _ in range(rnd.randrange(4)):
                a, p, size = rnd.randrange(n), rnd.randrange(1, 40), rnd.randrange(10, 200)
                for i in range(a + p, min(n, a + size)):
                    w[i] = w[i - p]
            texts.append(rnd.choice([" ", "  \n", "\x0b"]).join(w))
    # two runs that overlap, a run of runs, and one over almost a whole long text
    texts.append(" ".join(["a", "b", "c"] * 9 + ["a", "b"] + ["c", "a", "b", "d"] * 8))
    texts.append(" ".join((["x"] * 30 + ["y"]) * 5))
    texts.append(" ".join(["q", *[f"v{i % 977}" for i in range(40_000)], "z"]))
    return texts


def test_op11_against_brute_force(spark):
    texts = periodic_texts()
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[-2], "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        runs = brute_runs(w) if len(w) < 5000 else [(1, 40_000, 977)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i or -1, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert sum(len(x[2]) for x in want) > 40
    assert periodic_runs(spark.createDataFrame([], docs.schema)).count() == 0


def test_op11_probes_stay_few():
    rng = np.random.default_rng(1)
    for words in (rng.integers(0, 2, 30_000), np.tile(rng.integers(0, 9, 7), 5000), np.zeros(30_000)):
        h = words.astype(np.uint64)
        *_, period = find_runs(h, np.array([0, len(h)]))
        assert len(period) < 200
    assert find_runs(np.zeros(0, dtype=np.uint64), np.array([0, 0]))[0].size == 0


def test_op11_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    seen = 0
    for i, text in docs:
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if (h % 10 and i % 10) or len(w) > 600:
            continue
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = brute_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        milli = best[1] * 1000 // best[2] if runs else None
        said = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), *best, milli)
        assert r["runs_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        seen += len(runs)
    assert seen > 30


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "http://example.com/en/x", "https://www.example.com/en/x?q=1", "https://a.www.example.com/en/",
    "http://example.com/de/", "http://notexample.com/en/x", "http://x.net/es/1", "http://x.net/fr/1#a", "http://x.net/de/1", "x://y://z.com/", "http://bad.org/a/", "https://www.bad.org:443/a?utm_x=1#t",
    "http://bad.org/a/index.html?b=2&a=1", "http://bad.org/a?a=1&b=2", "http://bad.org/a/b", "http://user@bad.org./a", "http://com/x", "http://hot.org/", "http://x.org?d#/en/",
]


def brute_verdict(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "block" if named(url) in listed else "allow"


def named(url):
    if not url or "://" not in url:
        return None
    rest = url.split("://", 1)[1]
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", rest).groups()
    host = re.sub(r"^www\.", "", re.sub(r"\.*(:80|:443)?$", "", re.sub(r"^.*@", "", host.lower())))
    kept = "&".join(sorted(x for x in (query or "").split("&") if x and not x.startswith("utm_")))
    return host + re.sub(r"/+(index\.html?)?$", "", path) + (f"?{kept}" if kept else "")


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "most_bytes": 64}, {"most_bytes": 8}])
def test_op12_against_brute_force(spark, limits):
    rnd = random.Random(8)
    urls = URLS + ["http://hot.org/"] * 400 + [f"http://{rnd.choice(['a', 'b', 'www.c'])}.x.{rnd.choice(['org', 'net'])}/{rnd.choice(['en', 'es'])}/{rnd.randrange(40)}" for _ in range(600)]
    bad = ["http://bad.org/a", "http://bad.org/a?b=2&a=1", "https://hot.org", None, "nothing", *rnd.sample(urls[-600:], 100)]
    rules = [*queries.URL_RULES, ("x.org", "/en/1", "block"), ("b.x.org", "/en/1", "allow"), ("b.x.org", "/en/1", "block"), ("org", "/en/1", "allow")]
    odd = [(None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("org", "/", None)]
    pages = spark.createDataFrame([(i if i % 5 else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    listed = spark.createDataFrame([(u,) for u in bad], "url string")
    got = url_verdicts(pages, listed, spark.createDataFrame(rules + odd, "host string, path string, verdict string"), **limits)
    names = {named(u) for u in bad} - {None}
    want = sorted((i if i % 5 else -1, *map(str, brute_verdict(u, rules, names))) for i, u in enumerate(urls))
    assert sorted((-1 if r[0] is None else r[0], *map(str, r[1:])) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    assert {x[-1] for x in want} == {"allow", "block"}
    assert url_verdicts(pages.limit(0), listed, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = url_verdicts(pages, listed.limit(0), spark.createDataFrame([], "host string, path string, verdict string"))
    assert none.filter("verdict = 'allow' and rule is null").count() == len(urls)


def test_op12_filter_holds_all_and_little_else(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    made = blocked_filter(keys, 20_000)
    asked = spark.range(60_000).select("id", F.xxhash64("id").alias("key")).crossJoin(made)
    passed = asked.filter(may_hold(F.col("key"), F.col("filter"), F.col("blocks"))).groupBy(F.col("id") < 20_000).count().collect()
    passed = dict(map(tuple, passed))
    assert passed[True] == 20_000 and passed.get(False, 0) < 400


def test_op12_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.sql(oracle_sql()["op12_url_filter"])
    got = queries.op12_url_filter(spark, DATA).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def brute_whitening(points):
    fit = np.array(sorted({tuple(p) for p in points}), dtype=np.int64)
    n, total = len(fit), [sum(int(v) for v in col) for col in fit.T]
    far = (fit * n - np.array(total)).astype(float) / n
    values, axes = np.linalg.eigh(far.T @ far / n)
    return n, total, values[::-1], axes[:, ::-1]


def test_op13_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(size=(700, 20)) * np.linspace(2, 0.2, 20) @ rng.normal(size=(20, 20))).round(4)
    rows = [(i, x.tolist(), "x", 1.0) for i, x in enumerate(base)] + [(None, base[3].tolist(), "x", 1.0)] + [(5, base[9].tolist(), "x", 1.0)] * 300
    bad = [None, [], [1.0, None], [float("nan")] * 20, [float("inf"), *[0.0] * 19], [1e300] * 20]
    rows += [(9000 + i, x, "x", 1.0) for i, x in enumerate(bad)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, deviation double").repartition(7)
    spaces = fit_whitening(vectors)
    got = whiten(vectors, spaces).collect()
    n, total, values, axes = brute_whitening(np.floor(base * 64).astype(np.int64) + 1_000_000)
    assert len(got) == 1001 and set(spaces) == {20}
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    for i in (0, 3, 17, 699):
        r, x = by_id[i][0], np.floor(base[i] * 64).astype(np.int64) + 1_000_000
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - b) ** 2 for a, b in zip(x, total, strict=True))
        want = ((x * n - np.array(total)) / n) @ axes[:, :16] / np.sqrt(values[:16])
        assert len(r["whitened"]) == 16 and np.allclose(np.abs(r["whitened"]), np.abs(want), atol=1e-8)
        assert np.allclose(r["explained"], values[:16] / values.sum(), rtol=1e-9) and r["identity_error"] < 1e-9
    first = np.array([by_id[i][0]["whitened"] for i in range(700) if i != 5])
    assert np.abs(np.cov(first.T, bias=True) - np.eye(16)).max() < 0.02
    assert fit_whitening(vectors.limit(0)) == {} and whiten(vectors.limit(0), {}).count() == 0


def test_op13_degenerate_spaces(spark):
    rows = [(0, [1.0, 2.0, 2.0]), (1, [3.0, 2.0, 2.0]), (2, [3.0, 2.0, 2.0]), (3, [5.0]), (4, [1e15, -1e15]), (5, [-1e15, 1e15])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in whiten(vectors, fit_whitening(vectors)).collect()}
    assert got[0]["n"] == 2 and got[0]["deviation"] == 128**2 and [x is None for x in got[0]["whitened"]] == [False, True, True]
    assert abs(got[0]["whitened"][0]) == pytest.approx(1) and got[0]["explained"][0] == pytest.approx(1) and got[0]["identity_error"] < 1e-12
    assert got[3]["n"] == 1 and got[3]["deviation"] == 0 and got[3]["whitened"] == [None] and got[3]["identity_error"] is None
    assert got[4]["deviation"] is None and abs(got[4]["whitened"][0]) == pytest.approx(1)


def test_op13_query(spark):
    rows = queries.op13_whitening(spark, DATA).collect()
    data = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    points = {r["vec_id"]: np.floor(np.array(r["embedding"], dtype=float) * 64).astype(np.int64) + 1_000_000 for r in data}
    n, total, values, axes = brute_whitening(points.values())
    assert len(rows) == 16 * len(points) and {r["component"] for r in rows} == set(range(1, 17))
    signs = {}
    for r in rows:
        c, x = r["component"] - 1, points[r["vec_id"]]
        want = ((x * n - np.array(total)) / n) @ axes[:, c] / np.sqrt(values[c])
        sign = signs.setdefault(c, np.sign(want * r["whitened"]))
        assert r["n"] == n and abs(want * sign - r["whitened"]) < 1e-7 and r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["deviation"] == sum((n * int(a) - b) ** 2 for a, b in zip(x, total, strict=True)) and r["identity_error"] < 1e-4
