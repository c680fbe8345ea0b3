"""Queries of the way from books to a certificate over the driver's tables, with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distil import Key, Located, Reference, certify, check_store, chunk, enumerate_units
from ..sources.books import ingest, write_book

PAGES = 50
LINK = re.compile(r'<li><a href="([^"]*)">([^<]*)</a></li>')


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, content): all pages, 50 to a book, whose navigation has each page with its links below; every seventh archive is cut short."""

    def made(pages: pd.DataFrame) -> pd.DataFrame:
        pages = pages.sort_values("page_id")
        book = int(pages["book"].iloc[0])
        nav = "".join(f'<li><a href="p{i}.xhtml#top">Page {i}</a><ol>{"".join(m[0] for m in LINK.finditer(html))}</ol></li>' for i, html in zip(pages["page_id"], pages["html"], strict=True))
        data = write_book([(f"p{i}.xhtml", html.encode()) for i, html in zip(pages["page_id"], pages["html"], strict=True)], f"<ol>{nav}</ol>")
        return pd.DataFrame({"book": [f"book{book}"], "content": [data[: len(data) // 2] if book % 7 == 3 else data]})

    pages = _table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).alias("book"), "page_id", "html")
    return pages.groupBy("book").applyInPandas(made, "book string, content binary")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of documents, some with another document, number or digest."""
    found = chunk(_table(spark, sf_dir, "documents"))
    d, no = F.col("doc_id"), F.col("no")
    digest = F.when((d + no) % 29 == 0, F.lit("none")).otherwise(F.sha2("piece", 256))
    return found.select(F.when((d % 17 == 0) & (no == 0), -1 - d).otherwise(d).alias("doc_id"), F.when((d % 31 == 0) & (no == 1), F.lit(0)).otherwise(no).alias("no"), "start", "length", digest.alias("digest"))


def q38_ingest(spark, sf_dir):
    found = ingest(_archives(spark, sf_dir)).filter("not nav")
    return found.select("book", "position", "member", F.sha2("content", 256).alias("digest"), F.col("problem").isNotNull().alias("broken"))


def q39_enumerate(spark, sf_dir):
    return enumerate_units(ingest(_archives(spark, sf_dir)))


def q40_chunks(spark, sf_dir):
    found = chunk(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "no", "chunk_id", "start", "length", F.sha2("piece", 256).alias("digest"))


def q41_store_violations(spark, sf_dir):
    tables = {"documents": _table(spark, sf_dir, "documents"), "labels": _table(spark, sf_dir, "labels"), "chunks": _chunks(spark, sf_dir)}
    constraints = [
        Key("one document a number", "documents", ("doc_id",)),
        Key("one chunk a place", "chunks", ("doc_id", "no")),
        Reference("chunks have documents", "chunks", ("doc_id",), "documents", ("doc_id",)),
        Reference("documents have labels", "labels", ("doc_id",), "documents", ("doc_id",), both=True),
        Located("chunks are where they say", "chunks", "doc_id", "start", "length", "digest", "documents", "doc_id", "text"),
    ]
    return check_store(tables, constraints).withColumnRenamed("constraint", "rule")


def q42_certificates(spark, sf_dir):
    """A certificate for each source of documents over three reports: labels that cover it, toxic documents and copies of texts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    per = docs.join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.countDistinct("digest").alias("texts"))
    report = lambda place, name, state, reason: F.struct(F.lit(place).alias("place"), F.lit(name).alias("report"), state.alias("state"), reason.alias("reason"))
    few = F.col("labelled") * 5 < F.col("n") * 2
    reports = F.array(
        report(1, "coverage", F.when(few, "incomplete").otherwise("certified"), F.concat(F.col("labelled").cast("string"), F.lit(" of "), F.col("n").cast("string"))),
        report(2, "toxicity", F.when(F.col("toxic") > 2, "refused").when(F.col("toxic") > 1, "qualified").otherwise("certified"), F.concat(F.col("toxic").cast("string"), F.lit(" toxic"))),
        report(3, "copies", F.when(F.col("n") - F.col("texts") > 3, "qualified").otherwise("certified"), F.concat((F.col("n") - F.col("texts")).cast("string"), F.lit(" copies"))),
    )
    return certify(per.select(F.col("source").alias("unit"), F.explode(reports).alias("x")).select("unit", "x.*"))


_CHUNKS = r"""WITH RECURSIVE c AS (
  SELECT doc_id, CAST(-1 AS BIGINT) AS no, CAST(0 AS BIGINT) AS start, '' AS piece, text AS rest FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, no + 1, start + length(piece), left(rest, n), substr(rest, n + 1) FROM (
    SELECT *, CAST(CASE WHEN length(rest) <= 2000 THEN length(rest) WHEN contains(w, chr(10) || chr(10)) THEN length(regexp_extract(w, '(?s)^.*\n\n'))
      WHEN contains(w, chr(10)) THEN length(regexp_extract(w, '(?s)^.*\n')) WHEN contains(w, '. ') THEN length(regexp_extract(w, '(?s)^.*[.] '))
      WHEN contains(w, ' ') THEN length(regexp_extract(w, '(?s)^.* ')) ELSE 2000 END AS BIGINT) AS n
    FROM (SELECT *, left(rest, 2000) AS w FROM c WHERE rest <> ''))),
pieces AS (SELECT doc_id, no, start, length(piece) AS length, sha256(piece) AS digest FROM c WHERE no >= 0)
"""

SQL = {
    "q38_ingest": f"""SELECT 'book' || page_id // {PAGES} AS book, row_number() OVER (PARTITION BY page_id // {PAGES} ORDER BY page_id) - 1 AS position, 'text/p' || page_id || '.xhtml' AS member,
  sha256(html) AS digest, FALSE AS broken FROM pages WHERE page_id // {PAGES} % 7 <> 3
UNION ALL SELECT DISTINCT 'book' || page_id // {PAGES}, NULL, NULL, NULL, TRUE FROM pages WHERE page_id // {PAGES} % 7 = 3""",
    "q39_enumerate": f"""WITH l AS (
  SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels FROM pages),
k AS (SELECT *, unnest(range(1, len(hrefs) + 1)) AS k FROM l),
n AS (SELECT page_id, 0 AS k, 'text/p' || page_id || '.xhtml' AS target, 'Page ' || page_id AS label FROM pages
  UNION ALL SELECT page_id, k, hrefs[k], trim(regexp_replace(labels[k], '\\s+', ' ', 'g')) FROM k),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id // {PAGES} ORDER BY page_id, k) - 1 AS unit FROM n WHERE page_id // {PAGES} % 7 <> 3)
SELECT 'book' || page_id // {PAGES} AS book, unit, CAST(CASE WHEN k = 0 THEN 1 ELSE 2 END AS BIGINT) AS depth, CASE WHEN k > 0 THEN unit - k END AS parent, label, target,
  CASE WHEN k > 0 THEN 'Page ' || page_id || ' / ' ELSE '' END || label AS path FROM u""",
    "q40_chunks": _CHUNKS + "SELECT doc_id, no, left(digest, 16) || '-' || row_number() OVER (PARTITION BY doc_id, digest ORDER BY no) - 1 AS chunk_id, start, length, digest FROM pieces",
    "q41_store_violations": _CHUNKS
    + """, s AS (
  SELECT doc_id AS d, CASE WHEN doc_id % 17 = 0 AND no = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 31 = 0 AND no = 1 THEN 0 ELSE no END AS no, (doc_id + no) % 29 = 0 AS wrong FROM pieces)
SELECT 'one chunk a place' AS rule, 'repeated key' AS kind, doc_id || chr(31) || no AS key, count(*) AS n FROM s GROUP BY doc_id, no HAVING count(*) > 1
UNION ALL SELECT 'chunks have documents', 'no target', CAST(doc_id AS VARCHAR), count(*) FROM s WHERE doc_id < 0 GROUP BY doc_id
UNION ALL SELECT 'documents have labels', 'no source', CAST(doc_id AS VARCHAR), count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
UNION ALL SELECT 'chunks are where they say', CASE WHEN doc_id < 0 THEN 'no target' ELSE 'wrong digest' END, CAST(doc_id AS VARCHAR), count(*) FROM s WHERE doc_id < 0 OR wrong GROUP BY doc_id""",
    "q42_certificates": """WITH p AS (
  SELECT source, count(*) AS n, count(toxic) AS labelled, count(*) FILTER (toxic = 1) AS toxic, count(DISTINCT text) AS texts FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
r AS (
  SELECT source, 1 AS place, CASE WHEN labelled * 5 < n * 2 THEN 2 ELSE 0 END AS rank, 'coverage: ' || labelled || ' of ' || n AS said FROM p
  UNION ALL SELECT source, 2, CASE WHEN toxic > 2 THEN 3 WHEN toxic > 1 THEN 1 ELSE 0 END, 'toxicity: ' || toxic || ' toxic' FROM p
  UNION ALL SELECT source, 3, CASE WHEN n - texts > 3 THEN 1 ELSE 0 END, 'copies: ' || (n - texts) || ' copies' FROM p)
SELECT source AS unit, ['certified', 'qualified', 'incomplete', 'refused'][max(rank) + 1] AS state, CAST(greatest(max(rank) - 1, 0) AS INT) AS exit_code, count(*) AS reports,
  count(*) FILTER (rank > 0) AS failing, CASE WHEN max(rank) > 0 THEN arg_min(said, place - 10 * rank) END AS reason FROM r GROUP BY source""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
