"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_class, cut, mix64, quoted, text_slices, words

#: Bytes between tokens: all ASCII but letters, digits and the apostrophe.
GAP = byte_class((0x00, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
PER_CLASS, LEXICON, LEAST_DOCS, LEAST_G, REACH, WINDOWS, CLEAN = 4000, 2000, 3, 14.0, 5, 20_000, 3


@dataclasses.dataclass
class Model:
    """Two states, clean 0 and toxic 1. lexicon is sorted; weights has one entry more, for other words."""

    lexicon: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    document: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[i] == hashes, i, len(self.lexicon))

    def marginals(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of each token given its whole document, by forward and backward log odds.

        All rows of a slice step forward together, longest first, so the rows still running
        are a prefix.
        """
        emit, t = self.weights[ids], self.trans
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, size = first[:-1][order], n[order]
        running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        fore, back = np.empty(len(ids)), np.zeros(len(ids))
        odds = np.zeros(0)
        for k, m in enumerate(running):
            at = start[:m] + k
            odds = emit[at] if k == 0 else emit[at] + _step(odds[:m], t[0, 1] - t[0, 0], t[1, 1] - t[0, 0], t[1, 0] - t[0, 0])
            fore[at] = odds
        for k in range(len(running) - 1, 0, -1):
            m = running[k]
            at = start[:m] + k
            back[at - 1] = _step(back[at] + emit[at], t[1, 0] - t[0, 0], t[1, 1] - t[0, 0], t[0, 1] - t[0, 0])
        return 1 / (1 + np.exp(-np.clip(fore + back, -40, 40)))


def _step(odds: np.ndarray, one: float, both: float, other: float) -> np.ndarray:
    """log((e^one + e^(both + odds)) / (1 + e^(other + odds))): the log odds carried over one transition."""
    return np.logaddexp(one, both + odds) - np.logaddexp(0, other + odds)


def _features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, the largest log odds of its tokens, log of the expected number of toxic tokens among likely ones."""
    n = len(first) - 1
    full = np.flatnonzero(np.diff(first) > 0)
    top = np.zeros(n)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    top = np.clip(top, 1e-7, 1 - 1e-7)
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.5, p, 0.0))])
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(total[first[1:]] - total[first[:-1]])], axis=1)


def _fit_chain(ids: np.ndarray, gold: np.ndarray, real: np.ndarray, times: np.ndarray, n: int, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights per word and transition scores that maximise the penalised likelihood of gold.

    ids, gold and real are windows x positions; real marks positions that exist, times says how often each window stands.
    """
    each = np.broadcast_to(times[:, None], ids.shape)[real]
    w, t = np.zeros(n + 1), np.zeros((2, 2))
    g1, g2 = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    rows, width = ids.shape
    link = real[:, 1:] & real[:, :-1]
    want = np.array([[((link & (gold[:, :-1] == a) & (gold[:, 1:] == b)) * times[:, None]).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    want_w = np.bincount(ids[real], each * (gold[real] == 1), minlength=n + 1)
    for k in range(1, steps + 1):
        emit = np.where(real, w[ids], 0.0)
        state = np.stack([np.zeros_like(emit), emit], axis=2)
        fore, back = np.empty((rows, width, 2)), np.zeros((rows, width, 2))
        fore[:, 0] = state[:, 0]
        for j in range(1, width):
            step = np.logaddexp(fore[:, j - 1, :1] + t[0], fore[:, j - 1, 1:] + t[1])
            fore[:, j] = np.where(link[:, j - 1, None], step, 0.0) + state[:, j]
        for j in range(width - 2, -1, -1):
            x = back[:, j + 1] + state[:, j + 1]
            step = np.logaddexp(x[:, :1] + t[:, 0], x[:, 1:] + t[:, 1])
            back[:, j] = np.where(link[:, j, None], step, 0.0)
        joint = fore + back
        p = np.exp(joint[:, :, 1] - np.logaddexp(joint[:, :, 0], joint[:, :, 1]))
        pair = fore[:, :-1, :, None] + t + (back + state)[:, 1:, None, :]
        pair = np.exp(pair - pair.max(axis=(2, 3), keepdims=True))
        pair = pair / pair.sum(axis=(2, 3), keepdims=True) * (link * times[:, None])[:, :, None, None]
        grads = (want_w - np.bincount(ids[real], each * p[real], minlength=n + 1) - 0.1 * w, want - pair.sum(axis=(0, 1)) - 0.1 * t)
        for x, g, a, b in zip((w, t), grads, g1, g2, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.1 * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return w, t


def _fit_document(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method with step halving; features that would lower a score are left out."""
    use = list(range(x.shape[1]))
    while True:
        part, ridge = x[:, use], np.diag([1e-3] + [0.05] * (len(use) - 1))
        value = lambda b, part=part, ridge=ridge: (weight * (y * (part @ b) - np.logaddexp(0, part @ b))).sum() - b @ ridge @ b / 2
        b = np.zeros(len(use))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(part @ b, -30, 30)))
            h = (part * (weight * p * (1 - p))[:, None]).T @ part + ridge
            step = np.linalg.solve(h, part.T @ (weight * (y - p)) - ridge @ b)
            size = 1.0
            while size > 1e-6 and value(b + size * step) < value(b):
                size /= 2
            b = b + size * step
            if size <= 1e-6 or np.abs(size * step).max() < 1e-6:
                break
        if len(use) == 1 or b[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[use] = b
            return out
        use.pop(1 + int(np.argmin(b[1:])))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, lexicon: int = LEXICON, windows: int = WINDOWS, clean: int = CLEAN) -> Model:
    """The model learned from docs (doc_id, text) and labels (doc_id, toxic in 0, 1).

    A row is for training if crc32 of its doc_id as text is not 0 modulo 5. The fit uses at most
    per_class rows of each label, those whose doc_id hashes lowest. Tokens are labelled by them: a
    word is suspect if toxic documents hold it more often (likelihood ratio G of 14 or
    more, at least 3 documents; at most `lexicon` words, the highest G first), and a suspect word in a toxic
    document is tagged toxic. The chain learns from windows of 5 tokens on each side of every suspect word and of `clean`
    other places of each text: at most `windows` different windows, those that hash lowest, each as often as it stands. The
    document score learns from all sampled documents, weighted back to the true class shares. Rows whose doc_id,
    toxic or text is null are not learned from; several labels of one document count as toxic if any is.
    Without both classes the score is a constant, the share of toxic rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # the sample has at most 2 * per_class rows of two numbers: a proven bound
    sample = cut(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 0.5) / (sum(shares.values()) + 1)
    nothing = Model(np.zeros(0, dtype=np.uint64), np.array([-10.0]), np.zeros((2, 2)), np.array([np.log(prior / (1 - prior)), 0.0, 0.0]))
    if not counts.get(0) or not counts.get(1):
        return nothing

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, rows in text_slices(batch, 0):
                h, _, _, first = words(data, rows, GAP)
                sets = [np.unique(h[first[i] : first[i + 1]]) for i in range(hi - lo)]
                flat = np.concatenate(sets)
                y = np.repeat(label[lo:hi], [len(s) for s in sets]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(y)], ["word", "y"])

    a, b = F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")
    stats = sample.mapInArrow(seen, "word long, y long").groupBy("word").agg(a, b)
    n1, n0 = float(counts[1]), float(counts[0])
    share = (F.col("a") + F.col("b")) / F.lit(n1 + n0)
    g = 2 * (F.col("a") * F.log(F.col("a") / (share * n1)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (share * n0))).otherwise(0.0))
    found = stats.filter(f"a >= {LEAST_DOCS}").withColumn("g", g).filter((F.col("g") >= LEAST_G) & (F.col("a") / n1 > 3 * F.col("b") / n0))
    lex = np.sort(np.array([r["word"] for r in found.orderBy(F.desc("g"), "word").limit(lexicon).collect()], dtype=np.int64).view(np.uint64))
    model = dataclasses.replace(nothing, lexicon=lex)
    if not len(lex):
        return nothing
    width = 2 * REACH + 1

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, rows in text_slices(batch, 0):
                h, _, _, first = words(data, rows, GAP)
                ids = model.ids(h)
                # every suspect word of the text, and the `clean` places of it whose words and numbers hash lowest
                rank = mix64(h + np.arange(len(h), dtype=np.uint64))
                for i in range(hi - lo):
                    own = ids[first[i] : first[i + 1]]
                    hit = np.flatnonzero(own < len(lex))
                    near = np.unique(np.concatenate([hit, np.argsort(rank[first[i] : first[i + 1]], kind="stable")[:clean]])).astype(np.int64)
                    if not len(near):
                        continue
                    at = near[:, None] + np.arange(-REACH, REACH + 1)
                    ok = (at >= 0) & (at < len(own))
                    got = np.where(ok, own[np.clip(at, 0, len(own) - 1)], -1)
                    y = np.full(len(near), label[lo + i], dtype=np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * width), pa.array(got.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(y)], ["ids", "y"])

    got = sample.mapInArrow(around, "ids array<int>, y long").groupBy("ids", "y").agg(F.count("*").alias("n")).orderBy(F.xxhash64("ids", "y"), "ids", "y").limit(windows).toArrow()
    ids = np.asarray(got["ids"].combine_chunks().flatten()).reshape(-1, width).astype(np.int64)
    y, times = np.asarray(got["y"]), np.asarray(got["n"]).astype(float)
    real = ids >= 0
    gold = ((ids >= 0) & (ids < len(lex)) & (y[:, None] == 1)).astype(np.int64)
    w, t = _fit_chain(np.where(real, ids, len(lex)), gold, real, times, len(lex))
    model = dataclasses.replace(model, weights=w, trans=t)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, 0):
                h, _, _, first = words(data, rows, GAP)
                x = _features(model.marginals(model.ids(h), first), first)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(x[:, 1]), pa.array(x[:, 2])], ["y", "x1", "x2"])

    rated = sample.mapInArrow(rate, "y int, x1 double, x2 double").groupBy("y", "x1", "x2").agg(F.count("*").alias("n")).orderBy("y", "x1", "x2").toPandas()
    y = rated["y"].to_numpy()
    weight = rated["n"].to_numpy() * np.where(y == 1, shares[1] / counts[1], shares[0] / counts[0])
    x = np.stack([np.ones(len(y)), rated["x1"], rated["x2"]], axis=1)
    return dataclasses.replace(model, document=_fit_document(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("score", "predicted", "spans")) -> DataFrame:
    """All columns of docs (which needs text), then score, predicted and spans (start, end, p), called by names.

    Documents are tokenised and tagged whole. spans are the maximal runs of tokens whose marginal is 0.5 or
    more, in characters from 0, end exclusive, with the largest marginal. score (0 to 1) comes from all marginals of
    the document; predicted is 1 if it is 0.5 or more.

    Edge cases: null and empty texts have no tokens, so no spans and the score of a text without any
    toxic token; repeated rows and ties are scored row by row; columns of docs may have any names, but
    those that are called as one of names are dropped; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in names]]
    # numbered names go in, as mapInArrow can't take columns with a dot in theirs
    given = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(kept)], F.col("text").cast("string").alias("tagged"))
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
        for batch in batches:
            for lo, hi, data, rows in text_slices(batch, at):
                h, starts, ends, first = words(data, rows, GAP)
                p = model.marginals(model.ids(h), first)
                s = 1 / (1 + np.exp(-np.clip(_features(p, first) @ model.document, -30, 30)))
                hit = np.flatnonzero(p >= 0.5)
                row = np.searchsorted(first, hit, side="right") - 1
                new = np.ones(len(hit), dtype=bool)
                new[1:] = (np.diff(hit) > 1) | (np.diff(row) > 0)
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(hit))
                if len(a):
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    base = chars[rows[row[a]]]
                    spans = [chars[starts[hit[a]]] - base, chars[ends[hit[b - 1]]] - base, np.maximum.reduceat(p[hit], a)]
                else:
                    spans = [a, a, a.astype(float)]
                cells = pa.StructArray.from_arrays([pa.array(x, type=f.type) for x, f in zip(spans, kind, strict=True)], fields=list(kind))
                per = np.searchsorted(row[a], np.arange(hi - lo + 1)).astype(np.int32)
                cols = [c.slice(lo, hi - lo) for c in batch.columns[:at]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(pa.array(per), cells)], [*kept, *names])

    schema = T.StructType([docs.schema[c] for c in kept]).add(names[0], "double").add(names[1], "integer")
    schema = schema.add(names[2], T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("p", "double")))
    return given.mapInArrow(run, schema)
