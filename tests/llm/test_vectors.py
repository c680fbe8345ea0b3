"""Operator 8 near its threshold, in large buckets and on odd rows."""

import numpy as np
import pytest

from tallyloom.llm.embedding_dedup import near_vectors

SCHEMA = "vec_id long, embedding array<double>, print string, keys int, label int"


@pytest.fixture(scope="module", autouse=True)
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))


def table(spark, rows):
    return spark.createDataFrame([(i, x if x is None else [None if v is None else float(v) for v in x], "x", 1, None) for i, x in rows], SCHEMA).repartition(3)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at_cosine(rng, base, cosines):
    other = rng.normal(size=base.shape)
    other = unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    c = np.asarray(cosines)[:, None]
    return c * base + np.sqrt(1 - c * c) * other


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = unit(rng.normal(size=(600, 64)))
    linked = at_cosine(rng, base[:400], rng.uniform(0.9505, 0.965, 400))
    apart = at_cosine(rng, base[400:], rng.uniform(0.93, 0.9495, 200))
    rows = list(enumerate([*base, *linked, *apart]))
    got = {r["vec_id"]: r for r in near_vectors(table(spark, rows)).collect()}
    found = sum(got[i]["n_links"] == 1 and got[i + 600]["component_id"] == i for i in range(400))
    assert found >= 0.97 * 400
    assert all(got[i]["n_links"] == 0 and got[i + 600]["kept"] for i in range(400, 600))


@pytest.mark.parametrize("block", [40, 8192])
def test_large_buckets_count_every_link(spark, block):
    rng = np.random.default_rng(12)
    x = np.concatenate([unit(rng.normal(size=(1, 32)) + 0.03 * rng.normal(size=(260, 32))), unit(rng.normal(size=(40, 32)))])
    x = np.concatenate([x, x[:30]])
    near = unit(x) @ unit(x).T >= 0.95
    got = {r["vec_id"]: r for r in near_vectors(table(spark, list(enumerate(x))), block=block).collect()}
    want = near.sum(axis=1) - 1
    missed = sum(int(want[i]) - got[i]["n_links"] for i in range(len(x)))
    assert all(got[i]["n_links"] <= want[i] for i in range(len(x))) and missed <= 0.02 * want.sum()
    assert {got[i]["component_id"] for i in range(260)} == {0} and all(got[i]["kept"] for i in range(260, 300))


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (0, one), (1, [2.0, 4.0, 6.0, 8.0]), (2, one[:3]), (3, [*one, 0.0]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 3.0, 4.0]), (8, [1.0, float("nan"), 3.0, 4.0]), (9, [float("inf"), 1, 1, 1]),
        (None, one), (None, None), (10, [1e300, 2e300, 3e300, 4e300]), (11, [1e-300, 2e-300, 3e-300, 4e-300]), (12, [-1.0, -2.0, -3.0, -4.0]), (13, one), (13, one), (14, [-0.0, 0.0, 1.0, 0.0]), (15, [0.0, -0.0, 1.0, 0.0]),
    ]
    got = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(table(spark, rows)).collect())
    same = {0, 1, 10, 11, 13}
    want = [(i, 4, 0, i == 0) for i in (0, 1, 10, 11, 13, 13)] + [(14, 1, 14, True), (15, 1, 14, False)]
    want += [(i, 0, i, True) for i in range(13) if i not in same] + [(-1, 0, None, False)] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_vectors(table(spark, rows).limit(0)).count() == 0
