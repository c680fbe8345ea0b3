"""Queries of the Markdown rules over the driver's tables, in which documents stand for files of packages, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.byte_pairs import merge_ranks
from ..operators import lint


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in a folder of its own with front matter, some with a byte-order mark, another name, a long or no
    description, a further key, an open fence or another file name."""
    d = F.col("doc_id")
    mark = F.when(d % 13 == 0, "\ufeff").otherwise("")
    named = F.when(d % 7 == 0, F.col("lang")).otherwise(F.concat(F.lit("p"), d.cast("string")))
    said = F.repeat(F.concat("source", F.lit(" ")), (d % 200).cast("int"))
    further = F.when(d % 19 == 0, "license: mit\n").otherwise("")
    fence = F.when(d % 17 == 0, "").otherwise("---\n")
    file = F.when(d % 3 == 0, "SKILL.md").when(d % 3 == 1, "skill.md").otherwise("notes.md")
    return _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), d.cast("string"), F.lit("/"), file).alias("rel"),
        F.concat(mark, F.lit("---\nname: "), named, F.lit("\ndescription: "), said, F.lit("\n"), further, fence, F.col("text")).alias("content"),
    )


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every eleventh under another name; every other one links to the document after it, in a folder beside its own."""
    path = lambda x, before="": F.concat(F.lit("d"), (x % 50).cast("string"), F.lit(f"/{before}"), x.cast("string"), F.lit(".md"))
    d = F.col("doc_id")
    text = F.when(d % 2 == 0, F.concat(F.lit("See [next](../"), path(d + 1), F.lit("#top) and [site](https://example.org/).")))
    rel = F.when(d % 11 == 0, path(d, "old")).otherwise(path(d))
    return _table(spark, sf_dir, "documents").select(rel.alias("rel"), F.concat_ws("\n", text, "text").alias("content"))


ROOTS = ["global", "project", "team", "none"]


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a package of one of three discovery roots; three documents share a name. Some have no entry file or one
    of the faults of _entries, or an open quote."""
    d = F.col("doc_id")
    mark = F.when(d % 13 == 0, "\ufeff").otherwise("")
    name = F.concat(F.lit("p"), F.floor(d / 3).cast("string"))
    file = F.when(d % 5 == 0, "skill.md").when(d % 5 == 1, "notes.md").otherwise("SKILL.md")
    said = F.concat(F.when(d % 23 == 0, '"').otherwise(""), F.repeat(F.concat("source", F.lit(" ")), (d % 200).cast("int")))
    further = F.when(d % 19 == 0, "license: mit\n").otherwise("")
    fence = F.when(d % 17 == 0, "").otherwise("---\n")
    return _table(spark, sf_dir, "documents").select(
        F.element_at(F.array(*map(F.lit, ROOTS)), (d % 3 + 1).cast("int")).alias("root"),
        F.concat(name, F.lit("/"), file).alias("rel"),
        F.concat(mark, F.lit("---\nname: "), F.when(d % 7 == 0, F.col("lang")).otherwise(name), F.lit("\ndescription: "), said, F.lit("\n"), further, fence, F.col("text")).alias("content"),
    )


def q37_doctor_roots(spark, sf_dir):
    roots = spark.createDataFrame([(x, k) for k, x in enumerate(ROOTS)], "root string, rank int")
    return lint.doctor_roots(_rooted(spark, sf_dir), roots, 1024, ["name", "description"])


def q19_byte_order_marks(spark, sf_dir):
    return lint.byte_order_marks(_entries(spark, sf_dir))


def q20_wrong_case(spark, sf_dir):
    return lint.wrong_case(_entries(spark, sf_dir))


def q21_mismatched_names(spark, sf_dir):
    return lint.mismatched_names(_entries(spark, sf_dir))


def q22_unreadable_front_matter(spark, sf_dir):
    return lint.unreadable_front_matter(_entries(spark, sf_dir))


def q23_broken_links(spark, sf_dir):
    return lint.broken_links(_linked(spark, sf_dir))


def q24_unlinked(spark, sf_dir):
    return lint.unlinked(_linked(spark, sf_dir), body_only=False)


def q25_trigger_sets(spark, sf_dir):
    names = (F.col("doc_id") % 20).cast("string")
    return lint.trigger_sets(_table(spark, sf_dir, "labels").select(names.alias("name"), (F.col("quality") == 1).alias("triggers")))


def q26_untraced(spark, sf_dir):
    return lint.untraced(_table(spark, sf_dir, "documents").select("doc_id", "source"), _table(spark, sf_dir, "labels"), "doc_id")


def q27_coverage(spark, sf_dir):
    return lint.coverage(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


def q33_long_bodies(spark, sf_dir):
    return lint.long_bodies(_entries(spark, sf_dir), most=500)


#: A merge table of a few frequent pairs.
MERGES = ["t h", "e r", "o n", "a n", "th e", "e n", "i n", "an d", "r e"]


def q43_byte_pair_bodies(spark, sf_dir):
    return lint.long_bodies(_entries(spark, sf_dir), most=500, ranks=merge_ranks(MERGES))


def q34_descriptions(spark, sf_dir):
    return lint.description_lengths(_entries(spark, sf_dir), most=1024)


def q35_unknown_keys(spark, sf_dir):
    return lint.unknown_keys(_entries(spark, sf_dir), ["name", "description"])


def q36_doctor(spark, sf_dir):
    return lint.doctor(_entries(spark, sf_dir), most=1024, allowed=["name", "description"])


# the SQL makes the same files and then reads them line by line
_ENTRIES = """WITH made AS (
  SELECT 'p' || doc_id || '/' || CASE doc_id % 3 WHEN 0 THEN 'SKILL.md' WHEN 1 THEN 'skill.md' ELSE 'notes.md' END AS rel,
    CASE WHEN doc_id % 13 = 0 THEN chr(65279) ELSE '' END || '---' || chr(10) || 'name: ' || CASE WHEN doc_id % 7 = 0 THEN lang ELSE 'p' || doc_id END || chr(10)
    || 'description: ' || repeat(source || ' ', doc_id % 200) || chr(10) || CASE WHEN doc_id % 19 = 0 THEN 'license: mit' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '---' || chr(10) END || text AS content
  FROM documents),
lined AS (
  SELECT rel, split_part(rel, '/', 1) AS folder, split_part(rel, '/', 2) AS base, starts_with(content, chr(65279)) AS marked, string_split(ltrim(content, chr(65279)), chr(10)) AS lines FROM made),
closed AS (SELECT *, coalesce(list_position([rtrim(x, ' ' || chr(9) || chr(13)) for x in lines[2:]], '---'), 0) AS fence FROM lined),
skills AS (
  SELECT rel, folder, fence > 0 AND lines[1] = '---' AS fenced, lines[2:fence] AS front, array_to_string(lines[fence + 2:], chr(10)) AS body FROM closed WHERE base = 'SKILL.md'),
keys AS (SELECT rel, folder, split_part(x, ':', 1) AS key, trim(substr(x, strpos(x, ':') + 1)) AS said FROM (SELECT rel, folder, unnest(front) AS x FROM skills WHERE fenced) WHERE contains(x, ':')),
described AS (SELECT rel, coalesce(max(length(said)) FILTER (key = 'description'), 0) AS length FROM keys GROUP BY rel)
"""

_LINKED = r"""WITH made AS (
  SELECT 'd' || doc_id % 50 || CASE WHEN doc_id % 11 = 0 THEN '/old' ELSE '/' END || doc_id || '.md' AS rel,
    CASE WHEN doc_id % 2 = 0 THEN 'See [next](../d' || (doc_id + 1) % 50 || '/' || (doc_id + 1) || '.md#top) and [site](https://example.org/).' || chr(10) ELSE '' END || text AS content
  FROM documents),
links AS (SELECT rel, unnest(regexp_extract_all(content, '\]\(\.\./([^()\s#]+)', 1)) AS target FROM made)
"""

_MARKED = "SELECT rel FROM closed WHERE marked"
_CASED = "SELECT rel FROM closed WHERE lower(base) = 'skill.md' AND base <> 'SKILL.md'"
_NAMED = "SELECT rel, said AS name, folder FROM keys WHERE key = 'name' AND said <> '' AND said <> folder"
_UNREAD = "SELECT rel FROM skills WHERE NOT fenced"
_SHORT = "SELECT rel, length FROM described WHERE length = 0 OR length > 1024"
_OTHER = "SELECT rel, key FROM keys WHERE key NOT IN ('name', 'description')"

_ROOTED = """WITH made AS (
  SELECT ['global', 'project', 'team'][doc_id % 3 + 1] AS root, CAST(doc_id % 3 AS INT) AS rank, 'p' || doc_id // 3 AS name,
    CASE doc_id % 5 WHEN 0 THEN 'skill.md' WHEN 1 THEN 'notes.md' ELSE 'SKILL.md' END AS base, doc_id AS d, lang,
    CASE WHEN doc_id % 23 = 0 THEN 0 ELSE length(rtrim(repeat(source || ' ', doc_id % 200))) END AS said
  FROM documents),
judged AS (
  SELECT *, CASE WHEN base = 'notes.md' THEN ['no entry file'] ELSE list_filter([
      CASE WHEN base <> 'SKILL.md' THEN 'wrong case' END, CASE WHEN d % 13 = 0 THEN 'byte-order mark' END,
      CASE WHEN d % 17 = 0 OR d % 23 = 0 THEN 'unreadable front matter' END,
      CASE WHEN d % 17 <> 0 AND d % 7 = 0 THEN 'name is not its folder' END,
      CASE WHEN d % 17 <> 0 AND (said = 0 OR said > 1024) THEN 'description' END,
      CASE WHEN d % 17 <> 0 AND d % 23 <> 0 AND d % 19 = 0 THEN 'unknown key' END], lambda x: x IS NOT NULL) END AS causes
  FROM made),
best AS (SELECT name, arg_min(root, rank) AS winner FROM judged WHERE len(causes) = 0 GROUP BY name)
SELECT root, rank, name, CASE WHEN base <> 'notes.md' THEN name || '/' || base END AS rel, unnest(CASE WHEN len(causes) = 0 THEN [NULL] ELSE causes END) AS cause,
  len(causes) = 0 AS loads, winner FROM judged LEFT JOIN best USING (name)
UNION ALL SELECT 'none', 3, NULL, NULL, NULL, NULL, NULL
"""

# in a table that makes no earlier pair anew, merging by rank is replacing pair by pair
_MERGED = "body"
for _k, (_a, _b) in enumerate([("t", "h"), ("e", "r"), ("o", "n"), ("a", "n"), ("\x01", "e"), ("e", "n"), ("i", "n"), ("\x04", "d"), ("r", "e")], 1):
    _ab = [f"chr({ord(x)})" for x in (_a, _b)]
    _MERGED = f"replace({_MERGED}, {_ab[0]} || {_ab[1]}, chr({_k}))"

SQL = {
    "q43_byte_pair_bodies": _ENTRIES + f"SELECT rel, tokens FROM (SELECT rel, CAST(strlen({_MERGED}) AS BIGINT) AS tokens FROM skills WHERE fenced) WHERE tokens > 500",
    "q37_doctor_roots": _ROOTED,
    "q33_long_bodies": _ENTRIES + "SELECT rel, CAST(ceil(length(body) / 4.0) AS BIGINT) AS tokens FROM skills WHERE fenced AND ceil(length(body) / 4.0) > 500",
    "q34_descriptions": _ENTRIES + _SHORT,
    "q35_unknown_keys": _ENTRIES + _OTHER,
    "q36_doctor": _ENTRIES
    + f"""SELECT rel, 'byte-order mark' AS cause FROM ({_MARKED}) UNION ALL SELECT rel, 'wrong case' FROM ({_CASED})
UNION ALL SELECT rel, 'name is not its folder' FROM ({_NAMED}) UNION ALL SELECT rel, 'unreadable front matter' FROM ({_UNREAD})
UNION ALL SELECT rel, 'description' FROM ({_SHORT}) UNION ALL SELECT DISTINCT rel, 'unknown key' FROM ({_OTHER})""",
    "q19_byte_order_marks": _ENTRIES + _MARKED,
    "q20_wrong_case": _ENTRIES + _CASED,
    "q21_mismatched_names": _ENTRIES + _NAMED,
    "q22_unreadable_front_matter": _ENTRIES + _UNREAD,
    "q23_broken_links": _LINKED + "SELECT rel, target FROM links WHERE target NOT IN (SELECT rel FROM made)",
    "q24_unlinked": _LINKED + "SELECT rel FROM made WHERE rel NOT IN (SELECT target FROM links WHERE rel <> target)",
    "q25_trigger_sets": """SELECT *, positive BETWEEN 8 AND 10 AND near_miss BETWEEN 8 AND 10 AS enough FROM (
  SELECT CAST(doc_id % 20 AS VARCHAR) AS name, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality <> 1) AS near_miss FROM labels GROUP BY 1)""",
    "q26_untraced": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "q27_coverage": """SELECT enumerated, covered, covered / enumerated AS ratio FROM (
  SELECT count(DISTINCT doc_id) AS enumerated, count(DISTINCT doc_id) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS covered FROM documents)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in SQL}
