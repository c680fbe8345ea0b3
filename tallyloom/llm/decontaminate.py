"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, quoted, unused

WIDTH, PERCENT, BROADCAST_ROWS = 5, 75, 200_000


def shingles_of(text: Column, width: int = WIDTH, shorter: Sequence[int] = ()) -> Column:
    """Distinct 64-bit hashes of the runs of width words, a shorter text being one run; empty without words.

    shorter are lengths below width whose runs are wanted too.
    """
    ws = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def runs(w: Column) -> Column:
        n, none = F.size(w), F.array().cast("array<bigint>")
        of = lambda k: F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
        whole = F.when(n >= width, of(width)).when(n > 0, F.array(F.xxhash64(w))).otherwise(none)
        parts = [F.when(n >= k, of(k)).otherwise(none) for k in shorter]
        return F.array_distinct(F.concat(whole, *parts) if parts else whole)

    # a one-element transform names the words once, so they aren't split again for each use
    return F.element_at(F.transform(F.array(ws), runs), 1)


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, key): the sketch of each item of items (item_id, sh).

    Items are partitioned by the size of their set, from one power of two to the next. A document that
    holds percent of a set of n misses at most n - ceil(percent n) of it, so one of any that many plus one is
    in it. The upper size of a partition gives its number; the item's least hashes of that number are its sketch.
    """
    n = F.size("sh")
    top = F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int")
    m = top - F.ceil(top * percent / F.lit(100)).cast("int") + 1
    return items.filter(n > 0).select("item_id", F.explode(F.slice(F.array_sort("sh"), F.lit(1), m)).alias("key"))


def contamination(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, items (item_id, containment), contaminated, h for every row of docs (doc_id, text).

    An item of items (item_id, text) is found in a document if the document holds at least percent / 100 of the item's
    distinct width-word shingles; an item of fewer words is one shingle, held where its words stand one after another. An
    item's least MinHash values, as many as its size partition asks for, look up the documents that hold any of them, which
    loses no such document; each candidate is then confirmed on both whole sets. The sketches are broadcast only while
    they have at most 200000 rows.

    Edge cases: null and empty texts hold nothing and are found nowhere; h is a hash of the text, and rows that repeat a text share its
    finds, whatever their doc_id, null included; rows that repeat an item_id are items of their own with one name, of which the larger
    share counts; a null item_id is never found; other columns are ignored; an empty table on either side gives no finds.
    """
    tests = items.filter("item_id is not null").select("item_id", shingles_of(F.col("text"), width).alias("sh"), _words(F.col("text")).alias("n_words")).distinct()
    tests = cut(tests)
    keys = cut(sketches(tests, percent).distinct())
    small = keys.count() <= BROADCAST_ROWS
    shorter = sorted(r["n_words"] for r in tests.filter(F.col("n_words").between(1, width - 1)).select("n_words").distinct().collect())
    own = shingles_of(F.col("text"), width, shorter)
    texts = docs.filter("text is not null").select(F.xxhash64(F.col("text").cast("string")).alias("h"), "text")
    rows = texts.select("h", F.explode(own).alias("key"))
    pairs = cut(rows.join(F.broadcast(keys) if small else keys, "key").select("h", "item_id").distinct())
    near = texts.join(pairs.select("h").distinct(), "h", "left_semi").select("h", own.alias("dsh")).dropDuplicates(["h"])
    both = near.join(pairs, "h").join(F.broadcast(tests) if small else tests, "item_id")
    share = F.size(F.array_intersect("sh", "dsh"))
    both = both.filter(share * 100 >= F.size("sh") * percent)
    finds = both.groupBy("h", "item_id").agg(F.max(share / F.size("sh")).alias("containment"))
    per = cut(finds.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("item_id", "containment"))).alias("items")))
    discard(tests, keys, pairs)
    none = F.array().cast(per.schema["items"].dataType)
    named = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"))
    return named.join(per, "h", "left").select("doc_id", F.coalesce("items", none).alias("items"), F.col("items").isNotNull().alias("contaminated"), "h")


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """docs without the rows that hold an item; columns may have any names."""
    h = unused("h", docs)
    found = contamination(docs, items, percent, width).filter("contaminated").select(F.col("h").alias(h)).distinct()
    keyed = docs.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    return keyed.join(found, h, "left_anti").select(*[quoted(c) for c in docs.columns])


def _words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
