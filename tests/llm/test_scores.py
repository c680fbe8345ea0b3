"""What operators 3 and 10 say beyond their fixed parts, against brute force and on rows held out."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm.license_scan import BASE, COVERAGE, TEMPLATES, TEXTS, license_places
from tallyloom.llm.toxicity import fit, score

DATA = "/root/testdata/sf0.01"
TOKEN = re.compile(r"[^\x00-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def test_op3_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    found = {r["doc_id"]: r for r in score(docs, fit(docs, labels)).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0}
    # words that toxic rows for training have and clean ones don't: what any model of words could learn from
    words = {y: [set(TOKEN.findall(plain(found[i]["text"]))) for i, t in toxic.items() if t == y and i not in held] for y in (0, 1)}
    clean = set().union(*words[0])
    telling = {w for own in words[1] for w in own - clean if sum(w in x for x in words[1]) > 5}
    assert 5 < len(telling) < 50
    right = {y: [found[i]["predicted"] == y for i in held if toxic[i] == y] for y in (0, 1)}
    assert np.mean(right[0]) > 0.98
    told = [found[i]["predicted"] == 1 for i in held if toxic[i] and telling & set(TOKEN.findall(plain(found[i]["text"])))]
    assert len(told) >= 4 and all(told)


def test_op3_spans_and_scores_against_brute_force(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{k}é" for k in range(60)] + ["it's"]
    said = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = [(i, rnd.choice([" ", "\n", " - "]).join([*said(rnd.randrange(12)), *(["Vile", "nasty"][: i % 3] if i % 4 == 0 else []), *said(rnd.randrange(12))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, int(i % 4 == 0 and i % 3 > 0)) for i in range(400)], "doc_id long, toxic int"))
    assert 1 <= len(model.lexicon) <= 4
    spans = 0
    for r in score(docs, model).collect():
        tokens = list(TOKEN.finditer(plain(r["text"])))
        from tallyloom.llm.common import words as hashed
        from tallyloom.llm.toxicity import GAP

        data = np.frombuffer(r["text"].encode(), dtype=np.uint8)
        ids = model.ids(hashed(data, np.array([0, len(data)]), GAP)[0])
        assert len(ids) == len(tokens)
        # forward and backward sums in plain numbers
        emit = [(1.0, math.exp(model.weights[k])) for k in ids]
        move = np.exp(model.trans)
        fore, back = [], [np.ones(2)]
        for k, e in enumerate(emit):
            fore.append(np.array(e) * (1 if k == 0 else fore[-1] @ move))
            fore[-1] = fore[-1] / fore[-1].sum()
        for e in reversed(emit[1:]):
            b = move @ (np.array(e) * back[0])
            back.insert(0, b / b.sum())
        p = [float(f[1] * b[1] / (f @ b)) for f, b in zip(fore, back)]
        top = min(max([0.0, *p]), 1 - 1e-7)
        top = max(top, 1e-7)
        x = np.array([1.0, math.log(top / (1 - top)), math.log1p(sum(v for v in p if v >= 0.5))])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-float(x @ model.document))), abs=1e-9)
        want, k = [], 0
        while k < len(p):
            a = k
            while k < len(p) and p[k] >= 0.5:
                k += 1
            if k > a:
                want.append((tokens[a].start(), tokens[k - 1].end(), max(p[a:k])))
            k = max(k, a + 1)
        assert [(s["start"], s["end"]) for s in r["spans"]] == [x[:2] for x in want]
        assert np.allclose([s["p"] for s in r["spans"]], [x[2] for x in want])
        spans += len(want)
    assert spans > 50


def test_op10_templates_against_brute_force(spark):
    rnd = random.Random(9)
    some = [t.split() for _, t, _ in TEMPLATES]
    texts = []
    for k in range(150):
        w = [rnd.choice(["alpha", "the", "license", "of", "and", "software", "7"]) for _ in range(rnd.randrange(20))]
        for t in rnd.sample(some, 3):
            own = [rnd.choice(["x", "the"]) if rnd.random() < 0.12 else y for y in t]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = own
        texts.append(rnd.choice([" ", ", ", "\n"]).join(w))
    rows = [(i, t, "x", 1) for i, t in enumerate([*texts, None, "", texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string, n_words int")
    got = {r["doc_id"]: r for r in license_places(docs, texts=()).collect()}
    words = {i: re.findall(r"[a-z0-9\x80-\U0010ffff]+", plain(t)) for i, t, *_ in rows}
    names = {w for t in some for w in t}
    count = {w: sum(w in own for own in words.values()) for w in names}
    most = max(1, max(count.values()))
    weight = {w: math.log1p(most / (n + 1)) + 1e-9 for w, n in count.items()}
    total = 0
    for i, own in words.items():
        want = []
        for k, (label, t, key) in enumerate(TEMPLATES):
            t, key = t.split(), key.split()
            a = next(j for j in range(len(t)) if t[j : j + len(key)] == key)
            for x in range(len(own) - len(t) + 1):
                same = [u == v for u, v in zip(own[x : x + len(t)], t)]
                if sum(same) >= (len(t) if label in BASE else math.ceil(COVERAGE * len(t))) and all(same[a : a + len(key)]):
                    want.append((x, k, label, sum(weight[v] for u, v in zip(same, t) if u) / sum(map(weight.get, t))))
        found = [(x["start"], x["label"], x["coverage"]) for x in got[i]["places"]]
        assert [x[:2] for x in found] == [(x, label) for x, _, label, _ in sorted(want)]
        assert np.allclose([x[2] for x in found], [x[3] for x in sorted(want)])
        total += len(want)
    assert total > 200


def test_op10_whole_licence_texts(spark):
    rnd = random.Random(2)
    text = {label: t for label, _, t in TEXTS}
    key = {label: k for label, k, _ in TEXTS}
    filler = " ".join(rnd.choice(["lorem", "the", "software", "and", "notice"]) for _ in range(300))
    rows, want = [], {}

    def add(body, *labels):
        want[len(rows)] = sorted(labels)
        rows.append((len(rows), body))

    for label, t in text.items():
        add(t, label)
        add(f"{filler} {t.upper()} {filler}", label)
        add(f"// {t.replace(chr(10), chr(10) + '// ')}", label)
        # a word in ten is another one, and the key phrase stands
        w = t.split()
        add(" ".join("zzz" if k % 13 == 5 and x.strip('.,;:()"').lower() not in key[label] else x for k, x in enumerate(w)), label)
        # names put in shift what follows
        add(" ".join([*w[: len(w) // 2], *["Jane", "Doe", "and", "others"], *w[len(w) // 2 :]]), label)
        add(" ".join(w[: len(w) // 3]))
        rnd.shuffle(w)
        add(" ".join(w))
        add(re.sub(re.escape(key[label].split()[-1]), "zzz", t, flags=re.I))
        add(f"{t}\n{filler}\n{t}", label, label)
    add("")
    add(None)
    add(filler)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in license_places(docs, templates=()).collect():
        assert sorted(x["label"] for x in r["places"]) == want[r["doc_id"]], rows[r["doc_id"]]
        assert all(COVERAGE <= x["coverage"] <= 1 for x in r["places"])
    whole = {r["doc_id"]: r["places"] for r in license_places(docs).collect()}
    n = len(filler.split())
    assert [(x["start"], x["length"], x["coverage"]) for x in whole[1] if x["length"] > 100 and x["label"] == "mit"] == [(n, len(re.findall("[a-z0-9]+", text["mit"].lower())), pytest.approx(1))]
