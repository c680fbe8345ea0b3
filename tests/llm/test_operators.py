"""Each operator on small tables: brute force where SQL can't express it, and the edge cases of its docstring."""

import hashlib
import itertools
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import candidates, common
from tallyloom.llm import components as components_module
from tallyloom.llm.common import mix64, words
from tallyloom.llm.candidates import _marks, _may_link, _pairs, connect, exact_test, group_links, pack, shared_members, shared_packed, spread
from tallyloom.llm.components import components
from tallyloom.llm.decontaminate import contamination, drop_contaminated
from tallyloom.llm.embedding_dedup import near_vectors
from tallyloom.llm.license_scan import license_places
from tallyloom.llm.line_dedup import BANDS, _band_keys, _line_sets, near_lines, remove_lines
from tallyloom.llm.line_dedup import _keys as line_keys
from tallyloom.llm.mixing import mix
from tallyloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from tallyloom.llm.preferences import preference_pairs
from tallyloom.llm.queries import op6_fuzzy_line_dedup, op10_license_scan
from tallyloom.llm.repeats import remove_repeats
from tallyloom.llm.token_counts import PATTERN, VOCABULARY, attribute, token_counts
from tallyloom.llm.toxicity import Model, fit, score

SCHEMA = "doc_id long, text string, source string, score string, size string, keys string, id string, key string"
RNG = np.random.default_rng(5)
WORDS = ["w" + "".join(chr(97 + c) for c in RNG.integers(0, 26, 6)) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(WORDS[i] for i in RNG.integers(0, len(WORDS), n))


LONG = prose(3000)
BASE = [prose(60) for _ in range(6)]
EDITED = [" ".join("other" if i == 20 else w for i, w in enumerate(b.split())) for b in BASE]
TEXTS = [*BASE, *EDITED, BASE[0], BASE[0], None, "", "  \n ", "short one", "short one", LONG, LONG + " " + BASE[1], "é" * 70 + BASE[2] + "\n" + prose(30)]
ROWS = [(i, t, f"s{i % 3}" if i % 7 else None, "x", None, None, None, None) for i, t in enumerate(TEXTS)]
ROWS += [(None, BASE[3], None, None, None, None, None, None), ROWS[2]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], SCHEMA)


def reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_op1_shares_and_bounds(spark, docs, empty):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs).collect()))
    assert mix(empty).count() == 0
    # sources of one very long document, of equal ones and of a null name, with ties and repeated rows
    table = [(i, prose(int(n)), f"s{i % 7}" if i % 7 else None) for i, n in enumerate(RNG.integers(0, 60, 300))]
    table += [(1000, prose(4000), "s1"), *[(i, "five words of equal rank", "s8") for i in range(2000, 2040)], (3000, None, "s9"), table[5], table[5]]
    rows = mix(spark.createDataFrame(table, "doc_id long, text string, source string")).collect()
    source = {i: x for i, _, x in table}
    per = {}
    for r in rows:
        assert r["size"] * (r["target"] // r["source_size"] if r["source_size"] else 0) <= r["taken"] <= 3 * r["size"] and 0 <= r["inclusion"] <= 1
        per.setdefault(source[r["doc_id"]], []).append(r)
    sizes = {x: sum(r["size"] for r in own) for x, own in per.items()}
    order = sorted((x for x in sizes if x is not None)) + [None]
    weight = {x: 1 + k % 3 for k, x in enumerate(order)}
    # targets by sharing again and again what the full sources can't take
    left, free, want = sum(sizes.values()), set(order), {}
    while True:
        over = {x for x in free if left * weight[x] >= 3 * sizes[x] * sum(weight[y] for y in free)}
        if not over:
            break
        want |= {x: 3.0 * sizes[x] for x in over}
        left, free = left - sum(3 * sizes[x] for x in over), free - over
    want |= {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
    for x, own in per.items():
        target = own[0]["target"]
        gap = target - sum(r["taken"] for r in own)
        assert own[0]["source_size"] == sizes[x] and abs(target - want[x]) < 1e-6
        out = [r["size"] for r in own if r["size"] and r["copies"] == target // sizes[x]]
        assert -1e-6 <= gap and (not out or gap < min(out))


def test_op1_sample_follows_inclusions(spark, docs):
    table = spark.createDataFrame([(i, prose(20 + i % 50), f"s{i % 2}") for i in range(400)], "doc_id long, text string, source string")
    took = {}
    for k in range(12):
        for r in mix(table, seed=f"seed {k}").collect():
            took.setdefault(r["doc_id"], [r["inclusion"], 0])[1] += r["copies"] - r["target"] // r["source_size"]
    p, n = np.array(list(took.values()), dtype=float).T
    assert len(p) and abs((n / 12).mean() - p.mean()) < 0.05


def test_op2_against_brute_force(docs, empty):
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()}
    want, first = set(), {}
    data = [(i if i is not None else 1 << 62, (t or "").encode(), i) for i, t, *_ in ROWS]
    for k, b, _ in data:
        for x in range(len(b) - 49):
            w = b[x : x + 50]
            first[w] = min(first.get(w, k), k)
    for k, b, i in data:
        gone = bytearray(len(b))
        for x in range(len(b) - 49):
            if first[b[x : x + 50]] < k:
                gone[x : x + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.add((i, len(b), sum(gone), sum(1 for x in range(len(b)) if gone[x] and not (x and gone[x - 1])), hashlib.sha256(kept).hexdigest()))
    assert got == want
    assert remove_repeats(empty).count() == 0


def test_op3_finds_toxic_words(spark, docs, empty):
    rows = [(i, prose(40) + (" vile " if i % 4 == 0 else " ") + prose(20)) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = fit(texts, labels)
    got = score(texts, model).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    r = next(r for r in got if r["doc_id"] == 0)
    assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == ["vile"]
    edge = score(docs, model).collect()
    assert len(edge) == len(ROWS) and all(r["predicted"] == 0 for r in edge)
    assert score(empty, model).count() == 0
    constant = fit(empty, labels.limit(0))
    assert {r["spans"] == [] for r in score(docs, constant).collect()} == {True}


def test_op3_marginals_against_enumeration():
    model = Model(np.arange(3, dtype=np.uint64), np.array([1.5, -0.3, 0.8, -1.1]), np.array([[0.4, -0.7], [0.2, 1.3]]), np.zeros(3))
    ids, first = np.array([0, 3, 2, 1, 3, 3, 0]), np.array([0, 4, 4, 6, 7])
    got = model.marginals(ids, first)
    for a, b in itertools.pairwise(first):
        own, total, toxic = ids[a:b], 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=b - a):
            x = np.exp(sum(model.weights[w] * y for w, y in zip(own, states)) + sum(model.trans[y, z] for y, z in itertools.pairwise(states)))
            total, toxic = total + x, toxic + x * np.array(states)
        assert np.allclose(got[a:b], toxic / total)


def test_op4_containment(spark, docs, empty):
    item, few = BASE[1], " ".join(BASE[2].split()[7:10])
    texts = [(1, item), (2, "short one"), (3, None), (4, ""), (5, prose(40)), (6, few), (7, few.upper() + " absent"), (None, BASE[0]), (8, item), (8, prose(9))]
    tests = spark.createDataFrame([(*x, "x") for x in texts], "item_id long, text string, doc_id string")

    def found(x: str, t: str | None) -> bool:
        x, t = lower(x).split(), lower(t).split()
        runs = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        k = min(len(x), 5)
        return bool(x) and len(runs(x, k) & runs(t, k)) * 100 >= 75 * len(runs(x, k))

    got = [(r["doc_id"], [x["item_id"] for x in r["items"]]) for r in contamination(docs, tests).collect()]
    want = [(i, sorted({k for k, x in texts if k is not None and found(x or "", t)})) for i, t, *_ in ROWS]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(6 in x for _, x in want)
    assert sorted(map(str, drop_contaminated(docs, tests).select("doc_id").collect())) == sorted(f"Row(doc_id={i})" for i, x in want if not x)
    assert contamination(empty, tests).count() == 0
    assert not any(r["contaminated"] for r in contamination(docs, tests.limit(0)).collect())


@pytest.mark.parametrize("rule", ["majority", "first", "split"])
def test_op5_counts_add_up(docs, empty, rule):
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    parts = docs.select("doc_id", F.split("text", "\n").alias("sections"), "key")
    for r in token_counts(parts, rule=rule).collect():
        assert abs(sum(s["tokens"] for s in r["sections"]) - r["n_tokens"]) < 1e-6
        assert r["n_tokens"] == 0 or r["sections"][0]["start"] == 0
    assert token_counts(empty.select("doc_id", F.split("text", "\n").alias("sections"))).count() == 0


def test_op5_rule():
    tokens, bounds = np.array([0, 3, 7, 8]), np.array([0, 4, 4, 8])
    assert attribute(tokens, bounds, "majority")[0].tolist() == [1, 0, 2]
    assert attribute(tokens, bounds, "first")[0].tolist() == [2, 0, 1]
    assert attribute(tokens, bounds, "split")[0].tolist() == [1.25, 0, 1.75]
    assert attribute(tokens, bounds, "split")[1] == 1


@pytest.mark.parametrize("rule", ["majority", "first", "split"])
def test_op5_against_brute_force(spark, docs, rule):
    if not os.path.exists(VOCABULARY):
        pytest.skip("no vocabulary file")
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(x): int(n) for x, n in map(bytes.split, f)}
    enc = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [["Hello  ", " world", "", "naïve déjà", None], ["\n\n", "  x", "\n"], ["漢字 😀", "😀😀 é"], [prose(50), prose(3)], [], None, ["", ""]]
    got = {r["doc_id"]: r for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, sections array<string>"), rule=rule).collect()}
    for k, parts in enumerate(texts):
        own = [(x or "") + ("\n" if i < len(parts) - 1 else "") for i, x in enumerate(parts or [])]
        byte_of = [i for i, x in enumerate(own) for _ in x.encode()]
        want, crossing, at = [0.0] * len(own), 0, 0
        ids = enc.encode("".join(own), disallowed_special=())
        for token in ids:
            held = byte_of[at : at + len(enc.decode_single_token_bytes(token))]
            at += len(held)
            crossing += held[0] != held[-1]
            share = {i: held.count(i) for i in held}
            if rule == "split":
                for i, n in share.items():
                    want[i] += n / len(held)
            else:
                want[held[0] if rule == "first" else min(share, key=lambda i: (-share[i], i))] += 1
        r = got[k]
        assert (r["n_tokens"], r["n_crossing"]) == (len(ids), crossing) and np.allclose([x["tokens"] for x in r["sections"]], want)
        ends = list(itertools.accumulate(map(len, own)))
        assert [(x["start"], x["end"]) for x in r["sections"]] == list(zip([0, *ends[:-1]], ends))


def similar(x: str, y: str) -> bool:
    x, y = ({t[j : j + 9] for j in range(max(1, len(t) - 8))} for t in (lower(x), lower(y)))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_op6_against_brute_force(docs, empty):
    found = near_lines(docs).collect()
    assert len(found) == len(ROWS)
    lines = [(i if i is not None else 1 << 62, no, k, x) for k, (i, t, *_) in enumerate(ROWS) for no, x in enumerate((t or "").split("\n")) if x.strip()]
    root = reachable(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if similar(lines[a][3], lines[b][3])])
    best = {}
    for a, x in enumerate(lines):
        best[root[a]] = min(best.get(root[a], x[:2]), x[:2])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, x["no"]) for r in found for x in r["removed"]) == sorted(x[:2] for a, x in enumerate(lines) if x[:2] != best[root[a]])
    assert sum(r["n_compared"] for r in found) == len(lines)
    cleaned = remove_lines(docs, near_lines(docs))
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    assert near_lines(empty).count() == 0


def test_op6_takes_every_line_that_is_not_blank(spark, docs, tmp_path):
    short = ["Menu", "menu", "© 2024", "x", "eight ch", "nine char", "nine chars", "nineteen characters", "Nineteen characters", "  ", "\r", "", "\t", " " * 30]
    texts = ["\n".join([*RNG.permutation(short), prose(9)]) for _ in range(5)] + ["Menu\n \nMenu", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = [(i, no, x) for i, t in enumerate(texts) for no, x in enumerate(t.split("\n")) if x.strip()]
    root = reachable(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if similar(lines[a][2], lines[b][2])])
    gone = {i: [no for a, (d, no, _) in enumerate(lines) if d == i and root[a] != a] for i in range(len(texts))}
    got = {r["doc_id"]: (r["n_compared"], r["removed"]) for r in op6_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (sum(d == i for d, *_ in lines), ",".join(map(str, gone[i]))) for i in range(len(texts))}
    cleaned = corpus_pipeline.line_dedup(spark, common.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert dict(map(tuple, cleaned.collect())) == {i: "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i]) for i, t in enumerate(texts)}


def edits(text: str, share: float) -> str:
    """text with about share of its words replaced."""
    return " ".join(prose(1) if RNG.random() < share else w for w in text.split())


def test_op6_recall_near_the_threshold(spark, docs):
    lines = [prose(30) for _ in range(150)]
    lines += [edits(x, share) for x in lines for share in (0.02, 0.04, 0.06)]
    sets = [{t[j : j + 9] for j in range(len(t) - 8)} for t in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = reachable(range(len(lines)), links)
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {r["doc_id"] for r in near_lines(table).collect() if r["removed"]}
    want = {i for i in root if root[i] != i}
    assert len(links) > 250 and gone <= want and len(gone) >= 0.98 * len(want)


@pytest.mark.parametrize("block", [4, 1024])
def test_groups_are_settled_in_blocks(spark, docs, block):
    x = np.concatenate([np.repeat(np.arange(12), 9), [100, 101, 500]])
    rows = [(int(i % 2), i, 1, int(v)) for i, v in enumerate(x)]
    table = common.cut(spark.createDataFrame(rows, "g long, id long, w int, v long").repartition(3))

    def tests(batch):
        v = batch.column(5).to_numpy()
        return lambda i, j: np.abs(v[i] - v[j]) <= 0

    got = {r["id"]: r["component"] for r in group_links(table, tests, block=block).collect()}
    links = [(a, b) for a, b in itertools.combinations(range(len(x)), 2) if x[a] == x[b] and a % 2 == b % 2]
    want = reachable(range(len(x)), links)
    assert {i: got.get(i, i) for i in want} == want


def test_exact_test_of_sets():
    texts = ["a b c d", "", "d c b a x", "a a b c d", *[f"{'long ' * 9}{k}" for k in range(9)]]
    sets = lambda data, rows: (h := words(data, rows))[0:4:3]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    test = exact_test(sets, 75, 0)(batch)
    i, j = np.array(list(itertools.combinations(range(len(texts)), 2))).T
    own = [set(t.split()) for t in texts]
    assert test(i, j).tolist() == [bool(own[a]) and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]) for a, b in zip(i, j)]
    # pairs whose sizes rule all of them out
    assert test(np.array([0, 1]), np.array([4, 2])).tolist() == [False, False]


def test_pairs_of_groups():
    rnd = np.random.default_rng(3)
    size = rnd.integers(1, 9, 40)
    start = np.cumsum(size) - size + 5
    label = rnd.integers(0, 3, size.sum() + 5)
    got = [tuple(sorted(p)) for i, j in _pairs(size, start, label, 17) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    for s, m in zip(start, size):
        own = {p for p in got if s <= p[0] < s + m}
        every = {p for p in itertools.combinations(range(s, s + m), 2) if label[p[0]] != label[p[1]]}
        same = [p for p in own if label[p[0]] == label[p[1]]]
        common = max(np.bincount(label[s : s + m]))
        assert every <= own and all(s <= x < s + m for p in own for x in p) and not any(sum(label[s : s + m] == label[x]) == common for x, _ in same if sum(np.bincount(label[s : s + m]) == common) == 1)
    assert list(_pairs(size[:0], start[:0], label)) == []


def test_template_texts_meet_only_on_rare_elements():
    # 8000 lines of one template, two of which are near-duplicates of others: their pairs are 32 million
    rnd = random.Random(4)
    lines = ["this entry was posted in the general section by user: " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=44)) for _ in range(8000)]
    lines[5], lines[9] = lines[3] + ".", lines[8][:-2] + "zz"
    test = exact_test(_line_sets, 75, 0)(pa.RecordBatch.from_pydict({"text": lines}))
    met = [(a, b) for i, j in test.near(np.array([8000]), np.array([0]), np.arange(8000)) for a, b in zip(i.tolist(), j.tolist())]
    assert {(3, 5), (8, 9)} <= set(met) and len(met) < 8000


@pytest.mark.parametrize("block, meetings", [(6, 0), (6, 40), (1024, 64)])
def test_large_unsettled_groups_lose_no_link(spark, docs, monkeypatch, block, meetings):
    monkeypatch.setattr(candidates, "MEETINGS", meetings)
    rnd = random.Random(7)
    head = prose(12)
    lines = [f"{head} {prose(9)}" for _ in range(120)]
    lines += [edits(x, 0.03) for x in lines[:60]] + [lines[0] + "!" * (k % 3) for k in range(40)] + [prose(20) for _ in range(20)]
    rnd.shuffle(lines)
    table = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    members = common.cut(table.select(F.lit(7).cast("long").alias("g"), "id", F.lit(1).alias("w"), F.length("text").alias("n")))

    def likely(batch):
        n = batch.column(5).to_numpy()
        return lambda i, j: np.abs(n[i] - n[j]) < 60

    got = connect(members, likely, lambda ids: table.join(ids, "id").select("id", "text"), _line_sets, 75, block)
    got = {r["id"]: r["component"] for r in got.collect()}
    want = reachable(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if similar(lines[a], lines[b])])
    assert {i: got.get(i, i) for i in want} == want and 80 < sum(i != c for i, c in want.items()) < 140


def test_common_keys_are_spread(spark, docs):
    keys = np.array([[1, i + 10] for i in range(2000)], dtype=np.uint64)
    batches = [spread(keys[a : a + 500], np.arange(a, a + 500)) for a in range(0, 2000, 500)]
    table = spark.createDataFrame(pa.Table.from_batches(batches)).toDF("place", "id", "key", "far")
    assert table.groupBy("place").count().agg(F.max("count")).first()[0] <= 8
    got = {(r["key"], r["id"]) for r in shared_members(table).collect()}
    assert got == {(1, i) for i in range(2000)}


def test_op6_rows_are_documents_of_their_own(spark, docs):
    a, b, c, d, e = (prose(12) for _ in range(5))
    near = c[:-1] + "#"
    texts = [(None, f"{a}\n{b}"), (None, f"{c}\n{b}"), (None, f"{a}\n{d}"), (None, f"{e}\n{d}"), (None, f"{e}\n{d}"), (None, f"{e}\n{d}"), (None, None)]
    texts += [(7, prose(12)), (7, f"{near}\n{prose(12)}"), (7, f"{prose(12)}\n{a}"), (8, a), (9, "same line of two rows"), (9, "same line of two rows")]
    table = spark.createDataFrame([(*x, k) for k, x in enumerate(texts)], "doc_id long, text string, row long")
    cleaned = {r["row"]: r["text"] for r in remove_lines(table, near_lines(table)).collect()}
    assert set(cleaned) == set(range(len(texts))) and cleaned[6] is None
    left = [x for k in range(len(texts)) for x in (cleaned[k] or "").split("\n") if x]
    # each group of near-equal lines stays once, by the smallest doc_id; only the two equal rows of document 9 both keep theirs
    assert sorted(left) == sorted([*(x for k in (7, 8, 9) for x in texts[k][1].split("\n")), b, d, e, *[texts[11][1]] * 2])
    assert [cleaned[k] for k in (7, 8, 9, 10, 11, 12)] == [texts[7][1], texts[8][1], texts[9][1], "", texts[11][1], texts[11][1]]


def word_sets(text: str | None) -> set:
    w = lower(text).split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_roots(texts: list) -> dict:
    """The first of the component of each text, by position."""
    sets = [word_sets(t) for t in texts]
    return reachable(range(len(sets)), [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


def test_op7_against_brute_force(docs, empty):
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is None, ROWS[k][0] or 0))
    root = near_roots([ROWS[k][1] for k in order])
    first = {ROWS[order[k]][1]: ROWS[order[root[k]]][0] for k in root if word_sets(ROWS[order[k]][1])}
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    texts = {i: t for i, t, *_ in ROWS if i is not None} | {None: BASE[3]}
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["n_shingles"] == len(word_sets(t))
        assert r["component_id"] == first.get(t, r["doc_id"])
        assert r["kept"] == (r["doc_id"] is not None and r["component_id"] == r["doc_id"])
    assert near_duplicates(empty).count() == 0
    left = [r["doc_id"] for r in drop_near_duplicates(docs).collect()]
    assert sorted(left) == sorted({first[t] for t in first} | {i for i, t, *_ in ROWS if not word_sets(t)})
    assert drop_near_duplicates(docs).columns == docs.columns


def test_op7_repeated_ids_and_rows(spark, docs):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(5, a), (5, b), (9, b), (None, c), (None, c), (None, None), (None, ""), (3, a), (12, b), (12, b)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted(map(str, near_duplicates(table).select("doc_id", "component_id", "kept").collect()))
    want = [(5, 3, False), (5, 3, False), (9, 3, False), (None, None, False), (None, None, False), (None, None, False), (None, None, False), (3, 3, True), (12, 3, False), (12, 3, False)]
    assert got == sorted(f"Row(doc_id={x}, component_id={y}, kept={z})" for x, y, z in want)
    assert sorted(map(str, drop_near_duplicates(table).select("doc_id", "text").collect())) == sorted(f"Row(doc_id={x!r}, text={y!r})" for x, y in [(3, a), (None, c), (None, None), (None, "")])


def test_op7_recall_near_the_threshold(spark, docs):
    texts = [prose(120) for _ in range(150)]
    texts += [edits(x, share) for x in texts for share in (0.01, 0.02, 0.03)]
    root = near_roots(texts)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(table).collect()}
    assert sum(root[i] != i for i in root) > 250 and np.mean([got[i] == root[i] for i in root]) >= 0.99


def test_op8_against_brute_force(spark, docs):
    x = RNG.normal(size=(120, 24))
    x[60:100] = x[:40] + 0.03 * RNG.normal(size=(40, 24))
    x[100:120] = x[0] * RNG.uniform(1, 1, (20, 1))
    rows = [(i, [float(v) for v in y], "a") for i, y in enumerate(x)]
    rows += [(200, None, "a"), (201, [0.0] * 24, "a"), (202, [1.0, None], "a"), (203, [float("nan")] * 24, "a"), (204, [], "a"), (205, [1e300] * 24, "a")]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string"), block=16).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if near[a, b]]
    root = reachable(range(120), links)
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == ((int(near[i].sum()) - 1, root[i]) if i < 120 else (0, i))
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op9_prefix_and_masks(spark, docs):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", None), (3, 0, None, "x"), (None, 0, "user", "lost")]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad one"), (2, 0, "user", None)]
    schema = "pair_id long, turn long, role string, text string"
    got = {r["pair_id"]: r for r in preference_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert set(got) == {1, 2, 3}
    r = got[1]
    assert r["n_prefix"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_mask"]] == ["bad one<|end|>\n"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[3]["rejected"] == "" and got[3]["n_prefix"] == 0
    assert preference_pairs(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    # nulls come last, in turn, role and text
    mixed = [(7, None, "assistant", "end"), (7, 0, "user", "a"), (7, 1, None, "c"), (7, 1, "user", None), (7, 1, "user", "b"), (7, 2, "user", "d"), (7, 2, "user", "d")]
    r = preference_pairs(spark.createDataFrame(mixed, schema), spark.createDataFrame(mixed[1:], schema)).first()
    turns = ["<|user|>\na<|end|>\n", "<|user|>\nb<|end|>\n", "<|user|>\n<|end|>\n", "<||>\nc<|end|>\n", *["<|user|>\nd<|end|>\n"] * 2]
    assert (r["n_prefix"], r["prompt"], r["chosen"], r["rejected"]) == (6, "".join(turns), "<|assistant|>\nend<|end|>\n", "")


def test_op10_places(spark, empty):
    rows = [(1, "Under CC-BY. All rights  reserved, cc by"), (2, None), (3, ""), (4, "the GNU General Public License"), (5, "cc, then by"), (None, "cc by")]
    got = {r["doc_id"]: [(x["label"], x["start"]) for x in r["places"]] for r in license_places(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == [("cc-by", 1), ("reserved", 3), ("cc-by", 6)]
    assert got[2] == got[3] == got[5] == [] and ("gpl", 2) in got[4] and got[None] == [("cc-by", 0)]
    assert license_places(empty).count() == 0


def test_op10_base_columns_against_brute_force(spark, docs, tmp_path):
    phrases = ["cc by", "CC-BY-NC", "General Public License", "all rights reserved", "All Rights", "rights reserved", "MIT License", "Apache License"]
    texts = [None, "", "\x00", *(" ".join(RNG.permutation([*RNG.choice(phrases, 6), *prose(8).split(), "é"])) for _ in range(60)), ("x " * 200_000) + "cc by"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    base = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
    for r in op10_license_scan(spark, str(tmp_path)).collect():
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(texts[r["doc_id"]]).encode())
        at = sorted((i, x) for x, p in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split())
        want = (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert {x for _, x in at} <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    texts = [prose(50) + (" vile vile " if i % 5 == 0 else " ") + prose(20) for i in range(100)]
    texts += [texts[1] + "\n" + prose(40), " ".join(texts[2].split()[:-1]) + "\n" + prose(40), prose(70)]
    item = prose(30)
    texts += [prose(20) + " " + item + " " + prose(20), None, "", texts[102]]
    rows = [(i, t, "en", f"s{i % 4}", len(t or ""), float(i), "x", i) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", None, 1, 0.0, "x", 500), (None, prose(10) + " " + item, "en", None, 1, 0.0, "x", 501), (None, prose(30), "en", None, 1, 0.0, "x", 502), (4, texts[4], "en", "s0", 1, 4.0, "x", 503)]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, `a.b` string, __h long"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # each stage by brute force on what the one before left
    left = [r for r in rows if "vile" not in (r[1] or "")]
    lines = [(r[0] if r[0] is not None else 1 << 62, no, r[7], x) for r in left for no, x in enumerate((r[1] or "").split("\n")) if x.strip()]
    root = reachable(range(len(lines)), [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if similar(lines[a][3], lines[b][3])])
    best = {}
    for a, x in enumerate(lines):
        best[root[a]] = min(best.get(root[a], x[:2]), x[:2])
    gone = {(x[2], x[1]) for a, x in enumerate(lines) if x[:2] != best[root[a]]}
    left = [(r[0], "\n".join(x for no, x in enumerate(r[1].split("\n")) if (r[7], no) not in gone) if r[1] else r[1], r[3], r[5], r[7]) for r in left]
    left.sort(key=lambda r: (r[0] is None, r[0] or 0))
    root = near_roots([r[1] for r in left])
    left = [r for k, r in enumerate(left) if root[k] == k or not word_sets(r[1])]
    left = [r for r in left if 100 * len(word_sets(item) & word_sets(r[1])) < 75 * len(word_sets(item))]
    read = common.table(spark, d, "documents")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        read = common.cut(stage(spark, read, d))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert read.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "a.b", "__h"]
        # of the two equal rows of document 4 either may stay
        if i == len(corpus_pipeline.STAGES) - 2:
            assert sorted(map(str, read.select("doc_id", "text", "source", "score", F.when(F.col("__h") == 503, 4).otherwise(F.col("__h")).alias("__h")).collect())) == sorted(f"Row(doc_id={a}, text={b!r}, source={c!r}, score={x}, __h={h})" for a, b, c, x, h in left)
    last = sorted(map(str, read.collect()))
    assert [r["size"] for r in sorted(read.collect(), key=str)] and sorted((r["doc_id"] or -1, r["size"]) for r in read.collect()) == sorted((r[0] or -1, len((r[1] or "").split())) for r in left)
    assert sorted(map(str, corpus_pipeline.run(spark, d).collect())) == last
    empty = f"{d}/none"
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        common.table(spark, d, name).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("lots, most", [(1, 1 << 19), (24, 1 << 19), (1, 30), (24, 30)])
def test_components_against_union_find(spark, monkeypatch, lots, most):
    monkeypatch.setattr(components_module, "LINKS", most)
    random.seed(lots)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, 500 + k) for k in range(60)] + [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(250)]
    links += links[:20] + [(None, 7), (8, None), (9, 9)]
    random.shuffle(links)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(links, "a long, b long").repartition(lots)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_settled_components_leave_the_rounds(spark, monkeypatch):
    # 3000 pairs that one round settles, and a path that takes several
    monkeypatch.setattr(components_module, "LINKS", 64)
    rows = []

    def cut(df):
        out = common.cut(df)
        rows.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(components_module, "cut", cut)
    path = [(10_000 + 7 * x % 2003, 10_000 + 7 * (x + 1) % 2003) for x in range(2002)]
    links = path + [(100_000 + 2 * x, 100_001 + 2 * x) for x in range(3000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()))
    assert all(got[x] == x - x % 2 for x in range(100_000, 106_000))
    assert {got[x] for a in path for x in a} == {10_000} and len(got) == 6000 + 2003
    stars = [n for columns, n in rows if columns == ["u", "v"]]
    assert stars[0] > 3000 and max(stars[1:]) < 3000  # the pairs went through every round before


def test_cut_leaves_no_shuffle_files(spark, docs):
    jvm = spark.sparkContext._jvm
    folders = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {os.path.join(d, x) for top in folders for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key), files()
    out = common.cut(spark.range(200_000).withColumn("k", F.xxhash64("id") % 1000).repartition("k").groupBy("k").count())
    began = time.time()
    while (left := files() - before) and time.time() < began + 5:  # they go in the background; the driver's next collection may be 30 minutes off
        time.sleep(0.1)
    assert not left
    assert out.agg(F.sum("count")).first()[0] == 200_000 and spark.conf.get(key) == was


def _peak(f):
    tracemalloc.start()
    f()
    out = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out


def test_kernels_take_little_memory_besides_their_results(monkeypatch):
    texts = [prose(300) + "\n \nÄ" for _ in range(900)] + ["", None, " ", prose(60_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    slices = list(common.text_slices(batch, 0))
    assert max(len(data) for _, _, data, _ in slices) > 1_500_000
    with monkeypatch.context() as m:
        m.setattr(common, "PIECE", 1 << 40, raising=False)
        whole = [words(data, rows) for _, _, data, rows in slices]
    common._POWERS.clear()
    got = []
    # hashed at once these slices took 71 MB, and the sets 134 MB below
    assert _peak(lambda: got.extend(words(data, rows) for _, _, data, rows in slices)) < 45e6
    assert all(np.array_equal(x, y) for a, b in zip(whole, got, strict=True) for x, y in zip(a, b, strict=True))
    test = {}
    # the sets themselves are 8 bytes for each of 2 million characters
    assert _peak(lambda: test.update(f=exact_test(_line_sets, 75, 0)(batch))) < 70e6
    assert test["f"](np.array([0, 900]), np.array([0, 0])).tolist() == [True, False]


def test_line_keys_travel_packed_by_bucket(spark, docs):
    # 40 lines of which one stands in every document: a key has at most two near rows of a task, and a task sends a row for each bucket, not for each key
    lines = [prose(12) for _ in range(40)]
    near = [lines[0][:-1] + c for c in "12345678"]
    table = spark.createDataFrame([("\n".join([*lines, x, "short"]),) for x in near], "text string").repartition(2)
    rows = line_keys(table, 3)
    assert rows.columns == ["bucket", "rows"] and rows.count() <= 12
    triples = sum(len(r["rows"]) // 24 for r in rows.collect())
    assert 48 * BANDS <= triples <= 2 * 48 * BANDS
    got = shared_packed(rows, "sketch").groupBy("key").agg(F.collect_set("id").alias("ids")).collect()
    assert got and all(len(r["ids"]) > 1 for r in got)
    ids = {i for r in got for i in r["ids"]}
    assert len(ids) == 9  # the line and its near copies; chance keys of others would be more


def test_packed_rows_equal_spread_rows(spark, docs):
    rnd = np.random.default_rng(5)
    parts = []
    for k in range(6):
        keys = mix64(rnd.integers(0, 400, (300, 4)).astype(np.uint64) + np.uint64(1000) * np.arange(4, dtype=np.uint64))
        ids = np.arange(300 * k, 300 * (k + 1)).astype(np.uint64) % np.uint64(1500)
        parts.append((keys, ids, ids * np.uint64(7)))
    table = lambda batches, names: spark.createDataFrame(pa.Table.from_batches(batches)).toDF(*names)
    old = table([spread(k, i.view(np.int64), m.view(np.int64)) for k, i, m in parts], ["place", "id", "key", "far", "more"])
    new = table([pack([p], 7) for p in parts], ["bucket", "rows"])
    want = {tuple(r) for r in shared_members(old, ", more long").collect()}
    assert {tuple(r) for r in shared_packed(new, "more").collect()} == want and len(want) > 1000


@pytest.mark.parametrize("size", [4, 12, 40, 200])
def test_bands_miss_few_lines_at_the_threshold(size):
    # pairs of sets of which three quarters are shared: bands of minima of their own share a key with probability 0.9986
    rnd = np.random.default_rng(size)
    pairs = 8000
    own = rnd.integers(0, 1 << 64, (pairs, size), dtype=np.uint64)
    common, one = size * 3 // 4, size // 8
    sides = [np.concatenate([own[:, :common], x], axis=1) for x in (own[:, common : common + one], own[:, common + one :])]
    keys = []
    for x in sides:
        gap = np.zeros((pairs, 8), dtype=np.uint64)
        lo = np.arange(pairs) * (x.shape[1] + 8)
        keys.append(_band_keys(np.concatenate([x, gap], axis=1).ravel(), lo, lo + x.shape[1])[0])
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.9975


def test_marks_only_rule_out_what_cannot_link():
    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = []
    for k in range(120):
        x = base[: rnd.integers(250, 400)].copy()
        edit = rnd.random(len(x)) < (k % 12) / 30
        x[edit] = rnd.integers(0, 1 << 64, edit.sum(), dtype=np.uint64)
        sets.append(np.unique(x))
    flat, n = np.concatenate(sets), np.array([len(x) for x in sets])
    i, j = np.array(list(itertools.combinations(range(len(sets)), 2))).T
    common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
    linked = common * 100 >= (n[i] + n[j] - common) * 75
    may = _may_link(_marks(flat, n), n, i, j, 75)
    assert linked.sum() > 100 and may[linked].all() and may.sum() < 2 * linked.sum()
