"""Links inside groups of any size: candidate buckets, clusters of likely links, and their exact comparison.

A group of more than `block` members is dealt to blocks, each of which also gets a few hubs of its group. A
group of near copies is so settled by its hubs, whatever its size. Members still apart from the largest component of their group
meet the other blocks, as long as those are few. Groups with more of them, as of texts made from one
template, go on as they are to the exact comparison, where two sets meet only if they share one of their rarest elements: of n
elements, two sets of the similarity wanted share one of the n - ceil(similarity * n) + 1 that come first in any common order, here by
rarity. Only what then still is one large group of likely links, all with rare elements in common, has
all its blocks compared pair by pair, so no link is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, cut, discard, mix64, text_slices
from .components import components, roots_of

BLOCK, WEIGHT, HUBS, PAIRS, FEW = 1024, 2_000_000, 3, 1 << 18, 64
#: Pairs of blocks of a group that are compared as they are; a group with more is brought together anew.
MEETINGS = 64
#: Counters of the table by which elements are told to be rare; the table has so many longs, whatever the input.
COUNTERS = 1 << 18
EDGES, SPREAD = "a long, b long", "place long, id long, key long, far boolean"
#: Rows of a key that pack takes at a time; buckets of pack at least, and rows of a bucket about, beyond that.
HELD, BUCKETS, IN_BUCKET, PACKED = 1 << 18, 8192, 1 << 17, "bucket long, rows binary"


def spread(keys: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    """Rows (place, id, key, far, *more) of keys (rows x keys per row), with what a slice has of one key kept apart.

    The first two ids of a key in the slice go to the place that the key names. Further ones are known to share
    it, so they are far: they go anywhere (place is a hash of key and id). No place gets more than two rows of a
    slice, however common its key is.
    """
    key, row = keys.ravel(), np.repeat(np.arange(len(ids)), keys.shape[1])
    order = np.lexsort((ids[row], key))
    key, row = key[order], row[order]
    own = ids[row]
    new_key = np.ones(len(key), dtype=bool)
    new_key[1:] = key[1:] != key[:-1]
    new = new_key.copy()
    new[1:] |= own[1:] != own[:-1]
    key, own, row, first = key[new], own[new], row[new], new_key[new]
    near = first.copy()
    near[1:] |= first[:-1]
    place = np.where(near, key, key ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    cols = [place.view(np.int64), own, np.where(near, np.uint64(0), key).view(np.int64), ~near, *(x[row] for x in more)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], [f"c{k}" for k in range(len(cols))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of spread sorted by place to (key, id, *more) of every key with two ids or more."""
    last: pa.RecordBatch | None = None  # the last near row, and whether it went out
    gone = False
    for batch in batches:
        far = batch.column(3)
        out = [batch.filter(far).select([2, 1, *range(4, batch.num_columns)])]
        near = batch.filter(pc.invert(far))
        if near.num_rows:
            if last is not None:
                near = pa.Table.from_batches([last, near]).combine_chunks().to_batches()[0]
            p, o = near.column(0).to_numpy(), near.column(1).to_numpy()
            at = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            several = np.minimum.reduceat(o, at) < np.maximum.reduceat(o, at)
            several[0] |= gone
            take = np.repeat(several, np.diff(np.append(at, len(p))))
            last, was, gone = near.slice(len(p) - 1), gone, bool(take[-1])
            take[0] &= not was
            out.append(near.filter(pa.array(take)).select([0, 1, *range(4, batch.num_columns)]))
        for x in out:
            if x.num_rows:
                yield pa.RecordBatch.from_arrays(x.columns, [f"c{k}" for k in range(x.num_columns)])


def shared_members(rows: DataFrame, more: str = "") -> DataFrame:
    """(key, id, *more) of the keys that two ids or more have, of rows as spread makes them; more are declarations of columns."""
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(_runs, "key long, id long" + more)


def bucket_count(rows: int) -> int:
    """How many buckets pack deals so many rows to: a bucket's rows don't grow with the input."""
    return max(BUCKETS, rows // IN_BUCKET)


def pack(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """What spread makes of (keys, ids, one more column), dealt by place to buckets: one row (bucket, rows) for each that has any.

    rows are triples (key, id, more) of 8 bytes each. Rows that are far have buckets of their own, -1 and less. No id may stand twice in parts.
    """
    key = np.concatenate([k.ravel() for k, _, _ in parts])
    ids, more = (np.concatenate([np.repeat(p[c].view(np.uint64), p[0].shape[1]) for p in parts]) for c in (1, 2))
    order = np.argsort(key)
    key, ids, more = key[order], ids[order], more[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    far = ~new
    far[1:] &= ~new[:-1]
    # by the high half of the key, so rows in order of their keys are in order of their buckets
    place = lambda k: ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    rows, bucket = np.stack([key, ids, more], axis=1), place(key)
    if far.any():
        away = -1 - place(mix64(key[far] ^ ids[far]))
        own = np.argsort(away, kind="stable")
        rows = np.concatenate([rows[~far], rows[far][own]])
        bucket = np.concatenate([bucket[~far], away[own]])
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = pa.array(np.append(at, len(bucket)).astype(np.int32) * np.int32(24))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.Array.from_buffers(pa.binary(), len(at), [None, ends.buffers()[1], pa.py_buffer(rows)])], ["bucket", "rows"])


def _unpacked(batches: list[pa.RecordBatch]) -> np.ndarray:
    """The triples of rows of pack, one a line."""
    found = []
    for batch in batches:
        col = batch.column(1)
        offs = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1, offset=4 * col.offset)
        found.append(np.frombuffer(col.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]].copy().view(np.uint64).reshape(-1, 3))
    return np.concatenate(found)


def _shared(rows: np.ndarray, far: bool) -> pa.RecordBatch:
    """(key, id, more) of the triples of whole buckets: all that are far, else each id once of the keys that two ids or more have."""
    if not far:
        order = np.argsort(rows[:, 0].copy())
        key = rows[order, 0]
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        rows = rows[order[same[1:] | same[:-1]]]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
        key = rows[:, 0]
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        rows = rows[same[1:] | same[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(rows[:, c].copy().view(np.int64)) for c in range(3)], ["key", "id", "more"])


def _bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pack sorted by bucket to (key, id, more); some whole buckets are held at a time."""
    held: list[pa.RecordBatch] = []
    last, size = 0, 0
    for batch in itertools.chain(batches, [None]):
        b = batch.column(0).to_numpy() if batch is not None else np.zeros(0, dtype=np.int64)
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(b)]):
            ends = batch is None or (hi > lo and b[lo] != last and (size >= 24 * IN_BUCKET or (b[lo] < 0) != (last < 0)))
            if held and (ends or (last < 0 and size >= 24 * IN_BUCKET)):
                out = _shared(_unpacked(held), last < 0)
                held, size = [], 0
                if out.num_rows:
                    yield out
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
                last, size = b[lo], size + pc.sum(pc.binary_length(held[-1].column(1))).as_py()


def shared_packed(rows: DataFrame, more: str) -> DataFrame:
    """What shared_members gives, of rows as pack makes them; more names the further column, a long."""
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_runs, f"key long, id long, {more} long")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups of rows sorted by (g, block), the first two columns: about so many rows or bytes, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        full = sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size
        if not held or (batch is not None and not full):
            continue
        both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        g, block = both.column(0).to_numpy(), both.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (block[1:] != block[:-1])]))
        ends = np.append(starts[1:], len(g)) if batch is None else starts[1:]
        step, at = max(1, min(rows, both.num_rows * size // max(1, both.nbytes))), 0
        while len(ends) and at < ends[-1]:
            to = int(ends[max(int(np.searchsorted(ends, at + step, side="right")) - 1, int(np.searchsorted(ends, at, side="right")))])
            yield both.slice(at, to - at)
            at = to
        held = [both.slice(at)] if at < both.num_rows else []


def _relabel(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label once the rows i and j are joined."""
    ids, roots = roots_of(label[i], label[j])
    at = np.minimum(np.searchsorted(ids, label), len(ids) - 1)
    return np.where(ids[at] == label, roots[at], label)


def _pairs(size: np.ndarray, start: np.ndarray, label: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside the groups that start at start, about most at a time: all but those whose labels are both the commonest of the group."""
    total = int(size.sum())
    if not total:
        return
    begin = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    row = np.repeat(start - begin, size) + np.arange(total)
    order = np.lexsort((label[row], group))
    own = label[row][order]
    head = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])]))
    count = np.diff(np.append(head, total))
    first = np.searchsorted(group[head], np.arange(len(size)))
    common = np.lexsort((-count, group[head]))[first]
    minor = label[row] != own[head[common]][group]
    row = row[np.lexsort((~minor, group))]
    minor = np.sort(np.where(minor, 2 * group, 2 * group + 1)) % 2 == 0
    at = np.arange(total)
    left = np.where(minor, np.repeat(begin + size, size) - 1 - at, 0)
    at, left = at[left > 0], left[left > 0]
    ends = np.cumsum(left)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        n = left[a:b]
        i = np.repeat(at[a:b], n)
        yield row[i], row[i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        a = b


def settle(start: np.ndarray, size: np.ndarray, side: np.ndarray, label: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The label of each row once every link that test confirms inside a group is joined.

    Rows with equal labels are known to be connected and are not tested. In a group with two sides
    only pairs across them are. Each group is first compared with up to three of its rows; what then is apart meets in
    all pairs but those of its largest part, or in those of test.near if it has that and the group more than FEW rows.
    """
    row, group = np.arange(len(label)), np.repeat(np.arange(len(start)), size)
    across = (np.maximum.reduceat(side, start) > np.minimum.reduceat(side, start))[group]

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        open_ = (label[i] != label[j]) & (~across[i] | (side[i] != side[j]))
        i, j = i[open_], j[open_]
        if len(i):
            ok = test(i, j)
            if ok.any():
                label = _relabel(label, i[ok], j[ok])

    join(start[group], row)
    for last in (False, True):
        apart = label != label[start][group]
        hub = np.maximum.reduceat(np.where(apart, row, -1), start) if last else np.minimum.reduceat(np.where(apart, row, len(row)), start)
        some = ((hub >= 0) & (hub < len(row)))[group]
        join(hub[group][some], row[some])
    left = np.maximum.reduceat(label, start) != np.minimum.reduceat(label, start)
    near = getattr(test, "near", None)
    few = left & (size <= FEW) if near else left
    for i, j in _pairs(size[few], start[few], label):
        join(i, j)
    if near:
        for i, j in near(size[left & ~few], start[left & ~few], label):
            join(i, j)
    return label


def _solve(tests: Callable[[pa.RecordBatch], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> Callable:
    """A mapInArrow function over rows (g, block, id, c, side, ...) sorted by (g, block): the links (a, b) that it finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            g, block, ids, c, side = (batch.column(k).to_numpy() for k in range(5))
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (block[1:] != block[:-1])])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(g)))
            if size.max() < 2:
                continue
            # rows of one group and component are connected from the start
            order = np.lexsort((c, np.cumsum(new)))
            head = np.concatenate([[True], new[order][1:] | (c[order][1:] != c[order][:-1])])
            begin = np.empty(len(g), dtype=np.int64)
            begin[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            label = settle(start, size, side, begin, tests(batch))
            far = np.flatnonzero(label != begin)
            yield pa.RecordBatch.from_arrays([pa.array(ids[begin[far]]), pa.array(ids[label[far]])], ["a", "b"])

    return run


def group_links(rows: DataFrame, tests: Callable, block: int = BLOCK, weight: int = WEIGHT, rest: Callable | None = None) -> DataFrame:
    """(id, component) over the links inside the groups of rows (g, id, w, ...), w being the weight of a member.

    tests gets a batch of rows (g, block, id, c, side, ...) and gives a function that tells of rows i, j whether they
    are linked. A block has at most about `block` members and `weight` weight, or one member. A column c of rows names components
    that are known already; without it each member is its own. Of groups that their hubs don't settle the blocks meet in pairs; rest, if
    given, answers for those with more than MEETINGS such pairs. Ids without a link are absent. rows is read several times and should be a table.
    """
    extra = [c for c in rows.columns if c not in ("g", "id", "w", "c")]
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("total") / weight)).cast("int")
    large = cut(rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("w").alias("total")).filter((F.col("n") > 1) & ((F.col("n") > block) | (F.col("total") > weight))).select("g", parts.alias("blocks")))
    some = not large.isEmpty()
    known = rows.filter("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct() if "c" in rows.columns else None
    base = rows if known is not None else rows.withColumn("c", F.col("id"))
    rows = rows.drop("c")
    if some:
        base = base.join(large, "g", "left")
        dealt = base.withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
        hub = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id"))).getField("id")
        hubs = rows.join(large, "g").groupBy("g", "blocks").agg(F.array_distinct(F.array(*map(hub, range(HUBS)))).alias("ids")).select("g", "blocks", F.explode("ids").alias("id"))
        hubs = base.drop("blocks").join(hubs, ["g", "id"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        base = dealt.drop("blocks").unionByName(hubs.drop("blocks"))
    else:
        base = base.withColumn("block", F.lit(0))
    order = ["g", "block", "id", "c", "side", *extra]
    base = base.withColumn("side", F.lit(0)).select(order)
    links = base.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_solve(tests), EDGES)
    comp = components(links if known is None else links.unionByName(known))
    if some:
        comp = _leftover(rows, extra, large, comp, tests, block, weight, rest)
    discard(large)
    return comp


def _placed(rows: DataFrame, large: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of the groups of large with c, their component so far."""
    return rows.join(large, "g").join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _known(comp: DataFrame) -> DataFrame:
    return comp.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _as_one(rows: DataFrame, large: DataFrame, comp: DataFrame) -> DataFrame:
    """comp with each group of large as one component."""
    per = cut(_placed(rows, large, comp).select("g", "c").distinct())
    links = per.join(per.groupBy("g").agg(F.min("c").alias("top")), "g").filter("c <> top").select(F.col("c").alias("a"), F.col("top").alias("b"))
    out = comp if links.isEmpty() else components(links.unionByName(_known(comp)))
    discard(per)
    return out


def _leftover(rows: DataFrame, extra: list[str], large: DataFrame, comp: DataFrame, tests: Callable, block: int, weight: int, rest: Callable | None) -> DataFrame:
    """comp with the links between blocks of the groups of large that are not yet one component, by rest where too many blocks meet."""
    placed = _placed(rows, large, comp)
    per = placed.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("w").alias("total"))
    most = F.max(F.struct("n", "total", "c"))
    main = per.groupBy("g").agg(most.alias("m"), (F.sum("n") - F.max("n")).alias("others"), F.sum("total").alias("all")).filter("others > 0")
    share = lambda n, total: F.ceil(F.greatest(n / block, total / weight, F.lit(1))).cast("int")
    main = cut(main.select("g", F.col("m.c").alias("mc"), share(F.col("m.n"), F.col("m.total")).alias("ours"), share(F.col("others"), F.col("all") - F.col("m.total")).alias("theirs")))
    if main.isEmpty():
        discard(main)
        return comp
    meetings = F.col("theirs").cast("long") * (F.col("ours") + F.col("theirs"))
    beyond = main.filter(meetings > MEETINGS).select("g") if rest else None
    side = (F.col("c") != F.col("mc")).cast("int")
    both = placed.join(main.filter(meetings <= MEETINGS) if rest else main, "g").withColumn("minor", side == 1)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("theirs")).otherwise(F.col("ours"))).cast("int")
    both = both.withColumn("own", own)
    # pairs of blocks: a minor one (x) with each main one (y >= 0) and with each minor one from itself on (y < 0)
    mains = F.transform(F.sequence(F.lit(0), F.col("ours") - 1), lambda y: F.struct(F.col("own").alias("x"), y.alias("y")))
    minors = F.transform(F.sequence(F.lit(0), F.col("theirs") - 1), lambda y: F.struct(F.least("own", y).alias("x"), (-1 - F.greatest(F.col("own"), y)).alias("y")))
    meets = F.transform(F.sequence(F.lit(0), F.col("theirs") - 1), lambda x: F.struct(x.alias("x"), F.col("own").alias("y")))
    both = both.withColumn("at", F.explode(F.when(F.col("minor"), F.concat(mains, minors)).otherwise(meets)))
    at, x, y = F.xxhash64("at.x", "at.y"), F.col("at.x"), F.col("at.y")
    # in a pair of blocks, which of the two a row is of
    which = F.when(y >= 0, F.col("minor").cast("int")).otherwise((F.col("own") == x).cast("int"))
    both = both.select("g", at.alias("block"), "id", "c", which.alias("side"), *extra)
    links = both.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_solve(tests), EDGES)
    out = components(links.unionByName(_known(comp)))
    if beyond is not None and not beyond.isEmpty():
        out = rest(rows, beyond, out)
    discard(main)
    return out


def _distinct(sets: Callable, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, size of each row) of the sets of a slice, each sorted and without repeats."""
    flat, first = sets(data, rows)
    for a, b in itertools.pairwise(first.tolist()):
        flat[a:b].sort()
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (flat[1:] != flat[:-1]) | (own[1:] != own[:-1])
    return flat[new], np.bincount(own[new], minlength=len(first) - 1)


def _rarest(flat: np.ndarray, n: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Places in flat of the elements of each set, by rising count, that two sets of the similarity percent / 100 can't both do without.

    n are the sizes of the sets and count the number of sets that have an element, roughly; one that no other set has is left out.
    """
    own = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((flat, count, own))
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    need = n - (n * percent + 99) // 100 + 1
    return order[(rank < need[own]) & (count[order] > 1)]


def _rare_keys(left: DataFrame, sets: Callable, percent: int) -> DataFrame:
    """Rows of spread with c: keys of the rarest elements of the sets of left (g, id, c, text), within each group g.

    Rarity is by a table of COUNTERS counters, of that size at any input; it only orders the elements, so sharing a counter does no harm.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for _, _, data, rows in text_slices(batch, 0, PIECE):
                flat, _ = _distinct(sets, data, rows)
                out += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["k", "n"])

    counts = left.select("text").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(COUNTERS, dtype=np.int64)
    table[counts["k"].to_numpy()] = counts["n"].to_numpy()
    held = left.sparkSession.sparkContext.broadcast(table)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, ids, c = (batch.column(k).to_numpy() for k in range(3))
            for lo, hi, data, rows in text_slices(batch, 3, 1 << 19):
                flat, n = _distinct(sets, data, rows)
                at = _rarest(flat, n, held.value[(flat % np.uint64(COUNTERS)).astype(np.int64)], percent)
                own = np.repeat(np.arange(lo, hi), n)[at]
                keys = mix64(flat[at] ^ mix64(g[own].astype(np.int64).view(np.uint64)))
                yield spread(keys[:, None], ids[own], c[own])

    return left.select("g", "id", "c", "text").mapInArrow(keyed, SPREAD + ", c long")


def _marks(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bit row for each set, a bit set where an element of it falls; of about four times as many bits as sets have elements."""
    bits = 256
    while bits < 4 * len(flat) // max(1, len(n)):
        bits *= 2
    out = np.empty((len(n), bits // 64), dtype=np.uint64)
    first = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        # some sets at a time, as a mark is a byte and an element 24 before they are packed
        b = max(a + 1, min(int(np.searchsorted(first, first[a] + PIECE, side="right")) - 1, a + 4 * PIECE // bits))
        wide = np.zeros((b - a) * bits, dtype=bool)
        wide[np.repeat(np.arange(0, (b - a) * bits, bits), n[a:b]) + (flat[first[a] : first[b]] % np.uint64(bits)).astype(np.int64)] = True
        out[a:b] = np.packbits(wide).view(np.uint64).reshape(b - a, -1)
        a = b
    return out


def _may_link(marks: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """False only where the sets i and j can't have the similarity: each mark of one that the other lacks is an element it lacks."""
    out = np.empty(len(i), dtype=bool)
    step = max(1, (1 << 17) // marks.shape[1])
    for a in range(0, len(i), step):
        x, y = i[a : a + step], j[a : a + step]
        p, q = marks[x], marks[y]
        p, q, both = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (p, q, p & q))
        common = np.minimum(n[x] - (p - both), n[y] - (q - both))
        out[a : a + step] = common * 100 >= (n[x] + n[y] - common) * percent
    return out


def exact_test(sets: Callable, percent: int, text: int) -> Callable:
    """tests for group_links by whole sets: sets(data, rows) gives (flat hashes, first of each row) of the texts in column text."""

    def tests(batch: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        parts = [_distinct(sets, data, rows) for _, _, data, rows in text_slices(batch, text, PIECE)]
        flat, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        first = np.concatenate([[0], np.cumsum(n)])
        marks = _marks(flat, n)

        def near(size: np.ndarray, start: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Those of _pairs that share one of their rarest elements in the group, unless sharing brings more of them than there are."""
            for s, m in zip(start.tolist(), size.tolist(), strict=True):
                values, count = np.unique(label[s : s + m], return_counts=True)
                minor = label[s : s + m] != values[count.argmax()]
                every = int(minor.sum()) * m
                if every > FEW * FEW:
                    _, element, count = np.unique(flat[first[s] : first[s + m]], return_inverse=True, return_counts=True)
                    at = _rarest(element, n[s : s + m], count[element], percent)
                    row = np.repeat(np.arange(m), n[s : s + m])[at]
                    element = element[at]
                    order = np.argsort(element, kind="stable")
                    row, element = row[order], element[order]
                    a, b = np.searchsorted(element, element, side="left"), np.searchsorted(element, element, side="right")
                    k = np.flatnonzero(minor[row])
                    many = (b - a)[k]
                    if many.sum() < every:
                        j = np.arange(many.sum()) + np.repeat(a[k] - np.cumsum(many) + many, many)
                        x, y = np.repeat(row[k], many), row[j]
                        pair = np.unique(np.minimum(x, y)[x != y] * np.int64(m) + np.maximum(x, y)[x != y])
                        for c in range(0, len(pair), PAIRS):
                            yield s + pair[c : c + PAIRS] // m, s + pair[c : c + PAIRS] % m
                        continue
                yield from _pairs(np.array([m]), np.array([s]), label)

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
            ok &= n[i] > 0
            k = np.flatnonzero(ok)
            ok[k] = _may_link(marks, n, i[k], j[k], percent)
            k = np.flatnonzero(ok)
            if not len(k):
                return ok
            k = k[np.argsort(i[k], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(i[k]) != 0]))
            for a, b in zip(cuts, np.append(cuts[1:], len(k)), strict=True):
                one = flat[first[i[k[a]]] : first[i[k[a]] + 1]]
                for c in range(a, b, 512):
                    part = k[c : min(b, c + 512)]
                    js = j[part]
                    m = n[js]
                    starts = np.concatenate([[0], np.cumsum(m)[:-1]])
                    other = flat[np.repeat(first[js] - starts, m) + np.arange(m.sum())]
                    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
                    common = np.add.reduceat((one[at] == other).astype(np.int64), starts)
                    ok[part] = common * 100 >= (len(one) + m - common) * percent
            return ok

        test.near = near
        return test

    return tests


def signature_test(column: int, most: int, size: int, percent: int) -> Callable:
    """tests for group_links by signatures (binary of one width in column): at most `most` bytes differ, and the sizes in column size allow percent."""

    def tests(batch: pa.RecordBatch) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        col = batch.column(column)
        flat = np.frombuffer(col.buffers()[2], dtype=np.uint8)
        offs = np.frombuffer(col.buffers()[1], dtype=np.int32, count=len(col) + 1, offset=4 * col.offset)
        sig = flat[offs[0] : offs[-1]].reshape(len(col), -1)
        n = batch.column(size).to_numpy()

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
            k = np.flatnonzero(ok)
            for a in range(0, len(k), 1 << 16):
                part = k[a : a + (1 << 16)]
                ok[part] = (sig[i[part]] != sig[j[part]]).sum(axis=1) <= most
            return ok

        return test

    return tests


def connect(members: DataFrame, likely: Callable, texts: Callable[[DataFrame], DataFrame], sets: Callable, percent: int, block: int = BLOCK) -> DataFrame:
    """(id, component) over the exact links among members (g, id, w, ...) of the candidate groups g.

    likely are the tests of group_links for members, which depend on a member alone and not on its group. Clusters of likely links are
    then compared by their whole texts, which texts gives as (id, text) for a table of (id). In clusters that hubs don't
    settle, members are brought together anew by rare elements they share, told by likely and compared. An id without a link is absent.
    """
    clusters = group_links(members, likely, block, rest=_as_one)
    whole = cut(clusters.join(texts(clusters.select("id")), "id").select(F.col("component").alias("g"), "id", F.octet_length("text").alias("w"), "text"))

    def by_rare(rows: DataFrame, large: DataFrame, comp: DataFrame) -> DataFrame:
        placed = _placed(rows, large, comp).select("g", "id", "w", "c", "text")
        apart = placed.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("g")
        left = cut(placed.join(apart, "g"))
        if left.isEmpty():
            discard(left)
            return comp
        shared = cut(shared_members(_rare_keys(left, sets, percent), ", c long"))
        mixed = shared.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("key")
        told = members.drop("g", "w").join(left.select("id"), "id", "left_semi").dropDuplicates(["id"])
        again = cut(shared.join(mixed, "key").select(F.col("key").alias("g"), "id", F.lit(1).alias("w")).distinct().join(told, "id").select("g", "id", "w", *told.drop("id").columns))
        close = group_links(again, likely, block, rest=_as_one)
        both = cut(left.drop("g").join(close.select("id", F.col("component").alias("g")), "id").select("g", "id", "w", "c", "text"))
        found = group_links(both, exact_test(sets, percent, 5), block)
        out = components(_known(found).unionByName(_known(comp)))
        discard(left, shared, again, close, both, found)
        return out

    comp = group_links(whole, exact_test(sets, percent, 5), block, rest=by_rare)
    discard(clusters, whole)
    return comp
