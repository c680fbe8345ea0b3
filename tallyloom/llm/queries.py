"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .license_scan import BASE, license_places
from .line_dedup import near_lines
from .mixing import mix
from .near_dedup import near_duplicates
from .periodic_runs import periodic_runs
from .preferences import preference_pairs, stale_answers
from .repeats import remove_repeats
from .token_counts import token_counts
from .toxicity import fit, score
from .url_filter import host_of, url_verdicts
from .whitening import fit_whitening, whiten


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    offsets = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), offsets.alias("offsets"))


def op4_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",")
    best = F.coalesce(F.array_max(F.transform("items", lambda x: x["containment"])), F.lit(0.0))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), names.alias("items"), best.alias("containment"), "contaminated")


def op5_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("sections"))
    found = token_counts(docs)
    counts = F.array_join(F.transform("sections", lambda x: x["tokens"].cast("long").cast("string")), ",")
    return found.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), counts.alias("section_tokens"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_compared", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x["no"].cast("string")), ",").alias("removed"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rejected = stale_answers(turns).withColumnRenamed("conv_id", "pair_id")
    found = preference_pairs(turns.withColumnRenamed("conv_id", "pair_id"), rejected)
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias(c)
    return found.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_places(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["label"].isin(*BASE))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by the checksum h of its number, repeats p of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), split.alias("w")).withColumn("n", F.size("w"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_periods(table(spark, sf_dir, "documents")))
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    # runs stand by start and period, so the first of equal exponents stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(y, x), y).otherwise(x))
    said = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The query's rules, and words in labels of hosts whose pages are its list.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED_HOSTS = r"(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.regexp_like(host_of(F.col("url")), F.lit(LISTED_HOSTS))).select("url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(pages, listed, rules).select("page_id", "host", "path", "canonical", "rule", "verdict")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = whiten(vectors, fit_whitening(vectors))
    cells = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")).alias("x")
    return found.select("vec_id", "n", "deviation", "identity_error", cells).select("vec_id", "x.component", "n", "deviation", "x.whitened", "x.explained", "identity_error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
