"""Token counts of sections: each document is encoded once, its tokens are attributed by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary above splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[int, tuple] = {}


def _encoder(vocabulary: bytes, pattern: str) -> tuple:
    """The encoding and the bytes in each of its tokens; loaded once a worker."""
    key = hash((vocabulary, pattern))
    if key not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        sizes[list(ranks.values())] = [len(x) for x in ranks]
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _LOADED[key]


def attribute(tokens: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens of each section, tokens that cross a boundary).

    tokens are the boundaries of the token spans, bounds those of the sections, both from 0 to the same end.
    """
    n = len(bounds) - 1
    if len(tokens) < 2:
        return np.zeros(n), 0
    a, b = tokens[:-1], tokens[1:]
    # empty sections hold nothing: the last section that starts at or before a token's start holds it
    lo = np.searchsorted(bounds[1:], a, side="right")
    hi = np.searchsorted(bounds[1:], b - 1, side="right")
    cross = lo != hi
    if rule == "first":
        return np.bincount(lo, minlength=n).astype(float), int(cross.sum())
    out = np.bincount(lo[~cross], minlength=n).astype(float)
    for i in np.flatnonzero(cross):
        s = np.arange(lo[i], hi[i] + 1)
        share = np.minimum(b[i], bounds[s + 1]) - np.maximum(a[i], bounds[s])
        if rule == "split":
            out[s] += share / share.sum()
        else:
            out[s[np.argmax(share)]] += 1
    return out, int(cross.sum())


def token_counts(docs: DataFrame, separator: str = "\n", rule: str = "majority", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, n_crossing, sections (start, end, tokens) for every row of docs (doc_id, sections array<string>).

    A document is its sections joined by separator, encoded whole and once. A section's span, in characters from 0,
    includes the separator after it. A token inside one section is that section's. One that crosses a boundary goes by rule:
    "majority" to the section with most of its UTF-8 bytes (the earlier if equal), "first" to the section with its first
    byte, "split" to each by its share of the bytes. So counts add up to n_tokens. The join is on bytes, as a token
    may be a part of a character; the spans are given in characters.

    Edge cases: null sections are empty; a null or empty list of sections is an empty document of no section; empty texts have no
    tokens; repeated rows and null doc_ids are counted row by row; other columns are ignored; an empty table gives an empty result.
    """
    if rule not in ("majority", "first", "split"):
        raise ValueError(rule)
    with open(vocabulary, "rb") as f:
        ranks = f.read()  # a fixed file of about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = _encoder(ranks, pattern)
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.float64())])
        for batch in batches:
            lens = batch.column(2)
            for lo, hi, data, rows in text_slices(batch, 1):
                totals, crossings, per, cells = [], [], [0], []
                for i in range(hi - lo):
                    own = data[rows[i] : rows[i + 1]]
                    ids = enc.encode_to_numpy(own.tobytes().decode(), disallowed_special=()).astype(np.int64) if len(own) else np.zeros(0, dtype=np.int64)
                    at = np.concatenate([[0], np.cumsum(sizes[ids])])
                    mine = np.asarray(lens[lo + i].values).astype(np.int64) if lens[lo + i].is_valid else np.zeros(0, dtype=np.int64)
                    bounds = np.concatenate([[0], np.cumsum(mine)])
                    starts_of = np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))
                    ends = starts_of[np.minimum(bounds, len(starts_of) - 1)]
                    n, crossing = attribute(at, ends, rule) if len(mine) else (np.zeros(0), 0)
                    totals.append(len(ids))
                    crossings.append(crossing)
                    per.append(per[-1] + len(mine))
                    cells.append((bounds[:-1], bounds[1:], n))
                flat = [np.concatenate(x) if cells else np.zeros(0) for x in zip(*cells, strict=True)]
                cell = pa.StructArray.from_arrays([pa.array(x, type=f.type) for x, f in zip(flat, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(totals, type=pa.int64()), pa.array(crossings, type=pa.int64()), pa.ListArray.from_arrays(pa.array(np.array(per, dtype=np.int32)), cell)], ["doc_id", "n_tokens", "n_crossing", "sections"])

    own = F.transform(F.coalesce("sections", F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")))
    lens = F.transform(own, lambda s, i: F.length(s) + F.when(i < F.size(own) - 1, len(separator)).otherwise(0))
    ready = docs.select(F.col("doc_id").cast("long"), F.array_join(own, separator), lens)
    return ready.mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, sections array<struct<start:long,end:long,tokens:double>>")
