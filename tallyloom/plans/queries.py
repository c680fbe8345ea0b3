"""Queries over the driver's tables, in which documents stand for files, with the SQL that checks them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, comment_text, executable, in_list, labelled, top_name, utf16_order
from ..operators.integrity import as_maps, capped, digests, digests_of, drift, present, rows_of, shadowed, stale, winners
from ..sources.manifest import read_manifest_shards, write_manifest_shards
from ..sources.shared import shared_folder, shared_location
from ..sources.tree import read_tree, write_tree
from ..streaming.drift import arriving_edits
from .verdicts import check_verdict, install_actions, install_verdict, uninstall_verdict


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _renamed(every: int) -> Column:
    """The number of a document as its path, another path for those that the number divides."""
    return F.when(F.col("doc_id") % every == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("rel")


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every eleventh under another path: what is found."""
    return _docs(spark, sf_dir).select(_renamed(11), F.col("text").alias("content"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every fifth under another path and every seventh with another digest: what was recorded."""
    said = F.when(F.col("doc_id") % 7 == 0, F.col("lang")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select(_renamed(5), F.sha2(said, 256).alias("digest"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(_manifest(spark, sf_dir), digests(_tree(spark, sf_dir)))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("rel", F.col("rel").cast("string"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as copies: the name is the page number modulo 40, every third copy is global."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scope = F.when(F.col("page_id") % 3 == 0, "global").otherwise("project")
    return pages.select((F.col("page_id") % 40).cast("string").alias("name"), scope.alias("scope"), F.col("url").alias("path"))


def q1_digest(spark, sf_dir):
    return digests(_docs(spark, sf_dir).select(F.col("doc_id").alias("rel"), F.col("text").alias("content"))).withColumnRenamed("rel", "doc_id")


def q2_drift(spark, sf_dir):
    return _drift(spark, sf_dir)


def q3_stale(spark, sf_dir):
    return stale(_manifest(spark, sf_dir), _tree(spark, sf_dir))


def q4_capped_report(spark, sf_dir):
    return capped(_named(_drift(spark, sf_dir))).select("rel", "kind", "label", "total", "more")


def q5_check_verdict(spark, sf_dir):
    return check_verdict(_drift(spark, sf_dir))


def q6_precedence(spark, sf_dir):
    return winners(_targets(spark, sf_dir))


def q7_explode_manifest(spark, sf_dir):
    return rows_of(as_maps(_manifest(spark, sf_dir)))


def q8_untracked(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _docs(spark, sf_dir).select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")


def q9_overflow(spark, sf_dir):
    return _drift(spark, sf_dir).agg(F.greatest(F.count("*") - 20, F.lit(0)).alias("more"))


def q10_allow_list(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel"))
    parts = [docs.filter(in_list(F.col("rel"), x)) for x in (["src0"], ["src1", "src2"])]
    return parts[0].unionByName(parts[1]).select("rel", top_name(F.col("rel")).alias("top"), basename(F.col("rel")).alias("base")).orderBy(utf16_order(F.col("rel")))


def q11_digests_of(spark, sf_dir):
    return digests_of(_tree(spark, sf_dir), _manifest(spark, sf_dir))


def q12_presence(spark, sf_dir):
    return present(_manifest(spark, sf_dir).select("rel"), _tree(spark, sf_dir))


def q13_shadowed(spark, sf_dir):
    return shadowed(_targets(spark, sf_dir))


def q14_install_actions(spark, sf_dir):
    return install_actions(_manifest(spark, sf_dir), digests(_tree(spark, sf_dir)), _docs(spark, sf_dir).select(_renamed(3)), force=True)


def q15_install_verdict(spark, sf_dir):
    return install_verdict(_tree(spark, sf_dir).select("rel"), _drift(spark, sf_dir))


def q16_uninstall_verdict(spark, sf_dir):
    return uninstall_verdict(_drift(spark, sf_dir))


def q17_labels(spark, sf_dir):
    return _named(_drift(spark, sf_dir)).select(labelled(F.col("rel"), F.col("kind")).alias("label"))


def q18_executable(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", executable(F.col("p_size")).alias("runs"))


def q28_capped_ten(spark, sf_dir):
    return capped(_named(_drift(spark, sf_dir)), 10).select("rel", "kind", "label", "total", "more")


def q29_blocked_verdict(spark, sf_dir):
    files = _named(_tree(spark, sf_dir)).select("rel").filter(in_list(F.col("rel"), []))
    return install_verdict(files, _drift(spark, sf_dir))


def q30_forced_verdict(spark, sf_dir):
    return install_verdict(_tree(spark, sf_dir).select("rel"), _drift(spark, sf_dir), force=True)


def q31_untracked_verdict(spark, sf_dir):
    return check_verdict(_drift(spark, sf_dir), readable=False)


def q32_clean_verdict(spark, sf_dir):
    now = digests(_tree(spark, sf_dir))
    return check_verdict(drift(now, now))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a new tree with a file for each document, in folders by number and source; every third file can be run."""
    d = F.col("doc_id")
    rel = F.concat_ws("/", F.concat(F.lit("d"), (d % 20).cast("string")), "source", F.concat(F.lit("."), d.cast("string")))
    root = os.path.join(shared_folder(spark), f"tree-{uuid.uuid4().hex}")
    write_tree(_docs(spark, sf_dir).select(rel.alias("rel"), F.col("text").cast("binary").alias("content"), F.when(d % 3 == 0, 0o755).otherwise(0o644).alias("mode")), root)
    return root


def q44_tree_scan(spark, sf_dir):
    found = read_tree(spark, _written(spark, sf_dir))
    return found.select("rel", F.sha2("content", 256).alias("digest"), F.length("content").cast("long").alias("bytes"), executable(F.col("mode")).alias("runs"))


def q45_allow_list_scan(spark, sf_dir):
    return read_tree(spark, _written(spark, sf_dir), content=False, only=["d1", "d7", "none"]).select("rel")


def q46_recorded_manifest(spark, sf_dir):
    """What the manifest of a tree says once it is written and read again, and whether the tree has it."""
    root = _written(spark, sf_dir)
    write_manifest_shards(digests(read_tree(spark, root)), f"file://{root}.manifest", "documents", "1")
    said = read_manifest_shards(spark, f"file://{root}.manifest")
    return present(said, read_tree(spark, root, content=False)).select("rel", "digest", "readable", "present")


def q48_comment_text(spark, sf_dir):
    """The text of each line that starts with a comment mark, of all lines of documents, a third of which have it after a space."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    marked = F.concat(F.when(F.col("no") % 3 == 0, "// ").when(F.col("no") % 3 == 1, "//").otherwise(" // "), "line")
    return lines.select("doc_id", "no", comment_text(marked).alias("said")).filter("said is not null")


def q47_arriving_edits(spark, sf_dir):
    """Documents as they arrive, against the manifest: one run of the stream over all that is there, kept as a table."""
    docs = _docs(spark, sf_dir)
    out = f"{shared_location(spark)}/edits-{uuid.uuid4().hex}"
    # a pattern, as the path of a single file is taken for a folder
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    found = arriving_edits(stream.select(_renamed(11), F.col("text").alias("content")), _manifest(spark, sf_dir))
    query = found.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{out}.state").start(out)
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


_CTE = """WITH tree AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END AS rel, sha256(text) AS digest FROM documents),
manifest AS (
  SELECT CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS rel, sha256(CASE WHEN doc_id % 7 = 0 THEN lang ELSE text END) AS digest FROM documents),
files AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS rel FROM documents),
drift AS (
  SELECT m.rel, CASE WHEN t.rel IS NULL THEN 'deleted' ELSE 'edited' END AS kind
  FROM manifest m LEFT JOIN tree t ON t.rel = m.rel WHERE t.rel IS NULL OR t.digest IS DISTINCT FROM m.digest),
targets AS (
  SELECT CAST(page_id % 40 AS VARCHAR) AS name, CASE WHEN page_id % 3 = 0 THEN 'global' ELSE 'project' END AS scope, url AS path FROM pages)
"""

_FILES = "WITH files AS (SELECT *, 'd' || doc_id % 20 || '/' || source || '/.' || doc_id AS rel FROM documents) "

SQL = {
    "q48_comment_text": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
n AS (SELECT doc_id, parts, unnest(range(len(parts))) AS no FROM l)
SELECT doc_id, CAST(no AS INT) AS no, regexp_replace(CASE no % 3 WHEN 0 THEN '// ' ELSE '//' END || parts[no + 1], '^//\\s?', '') AS said FROM n WHERE no % 3 < 2""",
    "q47_arriving_edits": _CTE + "SELECT rel FROM drift WHERE kind = 'edited'",
    "q44_tree_scan": _FILES + "SELECT rel, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes, doc_id % 3 = 0 AS runs FROM files",
    "q45_allow_list_scan": _FILES + "SELECT rel FROM files WHERE doc_id % 20 IN (1, 7)",
    "q46_recorded_manifest": _FILES + "SELECT rel, sha256(text) AS digest, TRUE AS readable, TRUE AS present FROM files",
    "q1_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "q2_drift": _CTE + "SELECT rel, kind FROM drift",
    "q3_stale": _CTE + "SELECT rel FROM manifest WHERE rel NOT IN (SELECT rel FROM tree)",
    "q4_capped_report": _CTE + """SELECT CAST(rel AS VARCHAR) AS rel, kind, CAST(rel AS VARCHAR) || CASE WHEN kind = 'deleted' THEN ' (deleted)' ELSE '' END AS label,
  (SELECT count(*) FROM drift) AS total, (SELECT greatest(count(*) - 20, 0) FROM drift) AS more FROM drift ORDER BY CAST(rel AS VARCHAR) LIMIT 20""",
    "q5_check_verdict": _CTE + "SELECT CASE WHEN count(*) = 0 THEN 'clean' ELSE 'drift' END AS state, CAST(count(*) > 0 AS INT) AS exit_code, count(*) AS n FROM drift",
    "q6_precedence": _CTE + "SELECT name, scope, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scope, path) AS r FROM targets) WHERE r = 1",
    "q7_explode_manifest": _CTE + "SELECT rel, digest FROM manifest",
    "q8_untracked": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q9_overflow": _CTE + "SELECT greatest(count(*) - 20, 0) AS more FROM drift",
    "q10_allow_list": "SELECT source || '/' || doc_id AS rel, source AS top, CAST(doc_id AS VARCHAR) AS base FROM documents WHERE source IN ('src0', 'src1', 'src2')",
    "q11_digests_of": _CTE + "SELECT rel, digest FROM tree WHERE rel IN (SELECT rel FROM manifest)",
    "q12_presence": _CTE + "SELECT rel, rel IN (SELECT rel FROM tree) AS present FROM manifest",
    "q13_shadowed": _CTE + "SELECT p.name, p.scope, p.path, g.path AS winner FROM targets p JOIN targets g ON g.name = p.name AND g.scope = 'global' AND p.scope = 'project' AND g.path <> p.path",
    "q14_install_actions": _CTE + """SELECT rel, 'copy' AS action FROM files
UNION ALL SELECT rel, 'delete' FROM manifest WHERE rel NOT IN (SELECT rel FROM files) AND rel IN (SELECT rel FROM tree)""",
    "q15_install_verdict": _CTE + "SELECT CASE WHEN count(*) > 0 THEN 'refused' ELSE 'installed' END AS state, CAST(CASE WHEN count(*) > 0 THEN 2 ELSE 0 END AS INT) AS exit_code, count(*) AS n FROM drift",
    "q16_uninstall_verdict": _CTE + "SELECT 'removed' AS state, 0 AS exit_code, count(*) AS n FROM drift",
    "q17_labels": _CTE + "SELECT CAST(rel AS VARCHAR) || CASE WHEN kind = 'deleted' THEN ' (deleted)' ELSE '' END AS label FROM drift",
    "q28_capped_ten": _CTE + """SELECT CAST(rel AS VARCHAR) AS rel, kind, CAST(rel AS VARCHAR) || CASE WHEN kind = 'deleted' THEN ' (deleted)' ELSE '' END AS label,
  (SELECT count(*) FROM drift) AS total, (SELECT greatest(count(*) - 10, 0) FROM drift) AS more FROM drift ORDER BY CAST(rel AS VARCHAR) LIMIT 10""",
    "q29_blocked_verdict": _CTE + "SELECT 'blocked' AS state, 2 AS exit_code, count(*) AS n FROM drift",
    "q30_forced_verdict": _CTE + "SELECT 'installed' AS state, 0 AS exit_code, count(*) AS n FROM drift",
    "q31_untracked_verdict": _CTE + "SELECT 'untracked' AS state, 0 AS exit_code, count(*) AS n FROM drift",
    "q32_clean_verdict": _CTE + "SELECT 'clean' AS state, 0 AS exit_code, count(*) - count(*) AS n FROM tree",
    "q18_executable": "SELECT p_partkey, (p_size & 73) <> 0 AS runs FROM part",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
