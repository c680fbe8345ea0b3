"""Counts of byte-pair tokens: a merge table applied by a queue of adjacent pairs."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

#: Merges never cross from a word to the space before the next one.
PIECE = re.compile(rb"\s*\S+|\s+")
Ranks = dict[tuple[bytes, bytes], int]


def merge_ranks(lines: Iterable[str]) -> Ranks:
    """Ranks of the pairs of a merge table, one pair a line with a space between; empty lines and those that start with `#` don't count."""
    pairs = [x.split(" ") for x in (y.rstrip("\n") for y in lines) if x and not x.startswith("#")]
    return {(a.encode(), b.encode()): k for k, (a, b) in reversed(list(enumerate(pairs)))}


def tokens_of(piece: bytes, ranks: Ranks) -> list[bytes]:
    """The tokens of a piece: the adjacent pair of least rank, the leftmost of equal ones, is merged until no pair has a rank.

    Tokens form a chain and pairs wait in a priority queue, so n bytes take n log n steps.
    """
    token: list[bytes | None] = [piece[k : k + 1] for k in range(len(piece))]
    after = list(range(1, len(piece) + 1))
    before = list(range(-1, len(piece) - 1))
    queue: list[tuple[int, int, bytes, bytes]] = []

    def push(k: int) -> None:
        if 0 <= k and after[k] < len(piece):
            pair = (token[k], token[after[k]])
            rank = ranks.get(pair)
            if rank is not None:
                heapq.heappush(queue, (rank, k, *pair))

    for k in range(len(piece)):
        push(k)
    while queue:
        _, k, a, b = heapq.heappop(queue)
        nxt = after[k] if token[k] == a else len(piece)
        if nxt >= len(piece) or token[nxt] != b:
            continue  # one of the two has been merged since
        token[k], token[nxt] = a + b, None
        after[k] = after[nxt]
        if after[k] < len(piece):
            before[after[k]] = k
        push(before[k])
        push(k)
    return [x for x in token if x is not None]


def count_tokens(data: bytes, ranks: Ranks, known: dict[bytes, int]) -> int:
    """Tokens of a text, piece by piece; known keeps the counts of short pieces between calls."""
    total = 0
    for m in PIECE.finditer(data):
        piece = m[0]
        n = known.get(piece)
        if n is None:
            n = len(tokens_of(piece, ranks))
            if len(piece) < 32 and len(known) < 1 << 16:
                known[piece] = n
        total += n
    return total
