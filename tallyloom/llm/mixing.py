"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

WEIGHTS, MOST, SALTS, BROADCAST_ROWS = (1, 2, 3), 3, 64, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, sid, n_docs, source_size, squares, target) of each source of sized (src, size).

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating, and share
    the sum of all sizes by weight. A target stops at `most` times its source's size and what it
    can't take is shared again by weight. That is a water level: sorted by size per weight,
    a prefix of the sources is full and all others stand at one level, so running sums settle it.
    One row a source goes through the one-partition windows here, never a row a document.
    """
    s = sized.groupBy("src").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"), F.sum((F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)"))).cast("double").alias("squares"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("full", F.col("source_size") * most)
    order = Window.orderBy(F.col("full").cast("double") / F.col("weight"), "sid")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(below), F.lit(0))).cast("long")
    share = (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))).cast("long")
    s = s.withColumn("left", left).withColumn("share", share)
    s = s.withColumn("is_full", F.col("full") * F.col("share") <= F.col("left") * F.col("weight"))
    # the first source that isn't full has the largest share left, i.e. the smallest -share
    level = F.min(F.when(~F.col("is_full"), F.struct((-F.col("share")).alias("k"), (F.col("left").cast("double") / F.col("share")).alias("x")))).over(every).getField("x")
    s = s.withColumn("target", F.when(F.col("is_full"), F.col("full").cast("double")).otherwise(level * F.col("weight")))
    return s.select("src", "sid", "n_docs", "source_size", "squares", "target")


def _with(d: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """d with what per_source has for its sid; a source may hold any share of d, so d is never dealt by sid alone."""
    if small:
        return d.join(F.broadcast(per_source), "sid")
    salted = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return d.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).join(salted, ["sid", "salt"]).drop("salt")


def _inclusions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """sid, whole, rest, level, left, squares: what each source still takes after whole copies, and by which inclusions.

    Inclusions are in proportion to size and give `rest` words on average. Documents of more than
    `level` words would have 1 or more: they are certain, and the others share the `left` words, p = left * size / squares. Sizes
    are settled from the largest down on the number of documents of each size, so a window holds no documents.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    t = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).select("src", "sid", "whole", "rest")
    counts = sized.filter("size > 0").groupBy("src", "size").agg(F.count("*").alias("n"))
    h = counts.alias("c").join(t.alias("t"), F.col("c.src").eqNullSafe(F.col("t.src"))).select("sid", "rest", F.col("size").cast("double").alias("x"), F.col("n").cast("double").alias("n"))
    larger = Window.partitionBy("sid").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("sid").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("left", F.col("rest") - F.coalesce(F.sum(F.col("x") * F.col("n")).over(larger), F.lit(0.0)))
    h = h.withColumn("squares", F.sum(F.col("x") * F.col("x") * F.col("n")).over(rest))
    open_ = F.col("x") * F.col("left") < F.col("squares")
    first = F.max(F.when(open_, F.struct("x", "left", "squares")))
    per = h.groupBy("sid").agg(first.alias("f"))
    return t.join(per, "sid", "left").select("sid", "whole", "rest", F.col("f.x").alias("level"), F.coalesce("f.left", F.lit(0.0)).alias("left"), F.coalesce("f.squares", F.lit(0.0)).alias("squares"))


def _fill(d: DataFrame, small: bool) -> DataFrame:
    """Marks as got, in order of xi, further documents of each source while their sum stays within its gap.

    The running sum is in two steps: over the sums of about sqrt(n) ranges of xi in each source,
    then within a range. So no window holds a whole source.
    """
    gap = d.groupBy("sid").agg((F.first("rest") - F.coalesce(F.sum(F.when(F.col("got"), F.col("size"))), F.lit(0))).alias("gap"))
    d = _with(d, gap, small).withColumn("fits", ~F.col("got") & (F.col("size") > 0) & (F.col("size") <= F.col("gap")))
    part = F.floor(F.col("xi") / (F.col("xi") + F.col("mid")) * F.ceil(F.sqrt(F.col("n_docs").cast("double"))))
    some = d.filter("fits").withColumn("part", part)
    sums = some.groupBy("sid", "part").agg(F.sum("size").alias("x"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "part", F.coalesce(F.sum("x").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "part").orderBy("xi", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    some = some.join(sums, ["sid", "part"]).withColumn("got", F.col("base") + F.sum("size").over(within) <= F.col("gap"))
    return some.drop("gap", "fits", "part", "base").unionByName(d.filter(~F.col("fits")).drop("gap", "fits"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, inclusion for every row of docs (doc_id, text, source).

    size is the number of words of the text. Each document first gets floor(target / source size)
    certain whole copies. The remainder of its source's target is drawn by Pareto sampling: a document's
    inclusion p is proportional to its size; where it would reach 1 the document is certain and the others share the
    rest anew. Documents come in by rank of random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)),
    while their words stay within the remainder, so the sample's fixed size is one of words. A document too
    long for what is left is passed over, and passes go on until no document fits: a source falls short by less
    than the shortest document it has left out. u comes from md5 of the seed and doc_id: reruns agree. A source may
    hold any share of all rows; sources are broadcast only up to 100000 of them, and joined by salted keys beyond.

    Edge cases: null and empty texts have size 0 and take nothing; a null source is a source of its
    own, last in order; a null doc_id draws as the empty string; repeated rows are sampled as
    the equal-ranked rows they are; ties of rank go by doc_id and size; other columns are ignored; an empty table gives an empty result.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    targets = cut(source_targets(sized, weights, most))
    small = targets.count() <= BROADCAST_ROWS
    drawn = cut(_inclusions(sized, targets))
    d = _named(sized, targets, small)
    d = _with(d, drawn, small)
    p = F.when(F.col("size") <= F.col("level"), F.col("left") * F.col("size") / F.col("squares")).when(F.col("size") > F.col("level"), F.lit(1.0)).when(F.col("level").isNull() & (F.col("size") > 0) & (F.col("rest") > 0), F.lit(1.0)).otherwise(F.lit(0.0))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    d = d.withColumn("inclusion", p).withColumn("u", u)
    xi = F.when(F.col("inclusion") >= 1, F.lit(0.0)).when(F.col("inclusion") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("inclusion") / (1 - F.col("inclusion")))).otherwise(F.lit(1e300))
    # only for even ranges of xi in _fill: its usual size
    mean = F.greatest(F.least(F.when(F.col("squares") > 0, F.col("left") * F.col("source_size") / (F.col("squares") * F.col("n_docs"))), F.lit(0.5)), F.lit(1e-15))
    d = cut(d.withColumn("xi", xi).withColumn("mid", (1 - F.coalesce(mean, F.lit(0.5))) / F.coalesce(mean, F.lit(0.5))).withColumn("got", F.lit(False)).drop("u", "squares", "level", "left"))
    discard(sized, targets, drawn)
    taken = -1
    while (now := d.filter("got").count()) != taken:
        last, taken = d, now
        d = cut(_fill(d, small))
        discard(last)
    copies = F.col("whole") + F.col("got").cast("long")
    return d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "inclusion")


def _named(sized: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """sized with what targets has for its source, in place of its name."""
    same = F.col("d.src").eqNullSafe(F.col("t.src"))
    if small:
        return sized.alias("d").join(F.broadcast(targets).alias("t"), same).drop("src", "squares")
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("t")
    d = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")).alias("d")
    return d.join(salted, same & (F.col("d.salt") == F.col("t.salt"))).drop("src", "salt", "squares")
