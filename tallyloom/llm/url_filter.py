"""URL filters: a blocked Bloom filter passes possible hits of a list to an exact join."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: 64-bit words of a block, bits of the filter for a key, and the fewest at which it still tells anything.
WORDS, BITS, LEAST_BITS = 8, 16, 4
#: The largest filter, and the most entries that are broadcast for the exact join.
MOST_BYTES, BROADCAST_ROWS = 32 << 20, 100_000
#: A key with more than this share of the hits is joined by broadcast; no more than the inverse many keys can have it.
HOT = 1 / 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One name for the spellings of a URL; null without `://`.

    Scheme, user, `www.`, default port, dots after the host, slashes after the path, an index file, parameters that start with
    `utm_`, empty ones and the fragment go; the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r"\.*(:80|:443)?$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+(index\.html?)?$", "")
    given = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(given, lambda x: (x != "") & ~F.startswith(x, F.lit("utm_")))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _key(whole: Column, a: Column, b: Column) -> Column:
    return F.xxhash64(whole, a, b)


def _places(key: Column) -> list[Column]:
    """Which bit of each word of its block a key sets."""
    other = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(other, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]


def blocked_filter(keys: DataFrame, n: int, most_bytes: int = MOST_BYTES) -> DataFrame | None:
    """One row (filter, blocks) with the 64-bit words of the filter over n keys (key), or None where most_bytes are too few to tell anything.

    A key sets one bit in each of the eight words of one block, so a look-up stays in one place. Blocks are made by
    partial aggregation; the row has at most most_bytes, whatever the number of keys.
    """
    blocks = 1
    while blocks * WORDS * 64 < n * BITS and blocks * 2 * WORDS * 8 <= most_bytes:
        blocks *= 2
    if blocks * WORDS * 64 < n * LEAST_BITS:
        return None
    one = F.lit(1).cast("long")
    words = [F.bit_or(F.call_function("shiftleft", one, x)).alias(f"w{k}") for k, x in enumerate(_places(F.col("key")))]
    made = keys.groupBy(F.col("key").bitwiseAND(F.lit(blocks - 1)).alias("id")).agg(*words)
    zero = [F.coalesce(f"w{k}", F.lit(0)) for k in range(WORDS)]
    every = keys.sparkSession.range(blocks).join(made, "id", "left").select(F.struct("id", F.array(*zero).alias("w")).alias("x"))
    return every.agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"])).alias("filter")).withColumn("blocks", F.lit(blocks).cast("long"))


def may_hold(key: Column, words: Column, blocks: Column) -> Column:
    """Whether the filter (words, blocks) may hold key; false only for keys it doesn't hold."""
    at = (key.bitwiseAND(blocks - 1) * WORDS).cast("int")
    bits = [F.call_function("shiftrightunsigned", F.get(words, at + k), x).bitwiseAND(F.lit(1)) == 1 for k, x in enumerate(_places(key))]
    return functools.reduce(lambda a, b: a & b, bits)


def _joined(hits: DataFrame, entries: DataFrame, few: bool) -> DataFrame:
    """hits with the entry equal to them, if any: (row, whole, a, b, verdict)."""
    on = ["key", "whole", "a", "b"]
    if few:
        return hits.join(F.broadcast(entries), on)
    # keys that many hits share are few, so theirs are broadcast; the rest meets by key
    total = hits.count()
    hot = cut(hits.groupBy("key").count().filter(F.col("count") > max(1.0, total * HOT)).select("key"))
    often = cut(entries.join(F.broadcast(hot), "key", "left_semi"))
    rest = hits.join(F.broadcast(hot), "key", "left_anti").join(entries, on)
    return hits.join(F.broadcast(often), on).unionByName(rest)


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: DataFrame, default: str = "allow", most_bytes: int = MOST_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, host, path, canonical, rule, listed, verdict for every row of pages (page_id, url).

    host is what stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; path reaches from there to `?`, `#` or
    the end. rules (host, path, verdict) fit their host and all its subdomains where the URL's path starts with theirs; the longest
    (host and path, then host) decides, and of equal ones `block`. A URL that no rule fits is blocked if its canonical form is that of a
    URL of listed (url), else it gets `default`.

    Rules and listed URLs are the entries of one blocked Bloom filter. A URL asks for its canonical form and, for each pair of
    number of labels and length of path that rules have, for its own end of host and start of path. What the filter passes
    is joined exactly, text by text, so false positives go. Entries are broadcast up to `broadcast_rows`; beyond, they meet the hits by
    key, but for keys that many hits share. A list too long for a filter of `most_bytes` is joined without one.

    Edge cases: a null url, or one without `://`, has an empty host and path and no canonical form; rows are judged one by
    one, with a null or repeated page_id too; rules with a null column or an empty host are ignored, and so are listed URLs
    without a canonical form; rules' hosts are lower-cased; other columns are ignored; an empty table gives an empty result.
    """
    url = F.col("url").cast("string")
    rows = cut(
        pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical")).withColumn("row", F.monotonically_increasing_id())
    )
    own = rules.filter("host <> '' and path is not null and verdict is not null").select(F.lit(False).alias("whole"), F.translate("host", _UPPER, _LOWER).alias("a"), F.col("path").alias("b"), "verdict")
    names = listed.select(F.lit(True).alias("whole"), canonical(F.col("url").cast("string")).alias("a"), F.lit("").alias("b"), F.lit("block").alias("verdict")).filter("a is not null")
    entries = own.unionByName(names).groupBy("whole", "a", "b").agg(F.max("verdict").alias("verdict"))
    entries = cut(entries.withColumn("key", _key(F.col("whole"), F.col("a"), F.col("b"))))
    n = entries.count()
    labels = F.size(F.split("a", r"\."))
    # as many pairs as the longest rules have labels and characters at most
    shapes = entries.filter("not whole").agg(F.collect_set(F.struct(labels.alias("labels"), F.length("b").alias("chars"))).alias("shapes"))
    shapes = shapes.select(F.concat("shapes", F.array(F.struct(F.lit(0).alias("labels"), F.lit(0).alias("chars")))).alias("shapes"))
    asked = rows.crossJoin(F.broadcast(shapes)).select("row", "host", "path", "canonical", F.explode("shapes").alias("s"))
    whole = F.col("s.labels") == 0
    fits = F.when(whole, F.col("canonical").isNotNull()).otherwise((F.size(F.split("host", r"\.")) >= F.col("s.labels")) & (F.length("path") >= F.col("s.chars")))
    a = F.when(whole, F.col("canonical")).otherwise(F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels")))
    b = F.when(whole, F.lit("")).otherwise(F.call_function("left", F.col("path"), F.col("s.chars")))
    asked = asked.filter(fits).select("row", whole.alias("whole"), a.alias("a"), b.alias("b"))
    asked = asked.withColumn("key", _key(F.col("whole"), F.col("a"), F.col("b")))
    made = blocked_filter(entries.select("key"), n, most_bytes)
    if made is not None:
        made = cut(made)
        asked = asked.crossJoin(F.broadcast(made)).filter(may_hold(F.col("key"), F.col("filter"), F.col("blocks"))).drop("filter", "blocks")
    hits = cut(asked)
    size = F.length("a") + F.length("b")
    said = F.struct(size.alias("size"), F.length("a").alias("host"), F.col("verdict"), F.concat("a", "b").alias("rule"))
    best = _joined(hits, entries, n <= broadcast_rows).groupBy("row").agg(F.max(F.when(~F.col("whole"), said)).alias("best"), F.max("whole").alias("listed"))
    out = rows.join(cut(best), "row", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    discard(made, hits, entries)
    verdict = F.coalesce("best.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(default))
    return out.select("page_id", "host", "path", "canonical", F.col("best.rule").alias("rule"), "listed", verdict.alias("verdict"))
