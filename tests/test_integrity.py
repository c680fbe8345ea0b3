import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import paths
from tallyloom.operators import integrity
from tallyloom.plans import commands, queries, verdicts
from tallyloom.sources.manifest import manifest_rows, parse_manifest, read_manifest_shards, write_manifest_shards
from tallyloom.sources import tree as tree_source
from tallyloom.sources.tree import read_tree
from tallyloom.streaming.drift import arriving_edits


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for rel, text in {"a.txt": "a", ".hidden": "h", "_under/x": "u", "k=v/y": "", "docs/run.sh": "#!", "docs/.m": "skip", "other": "o"}.items():
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(text)
    os.chmod(root / "docs/run.sh", 0o755)
    os.symlink("nowhere", root / "broken")
    return root


def test_tree_lists_what_file_sources_drop(spark, tree):
    rows = {r["rel"]: r for r in read_tree(spark, str(tree), skip=".m").collect()}
    assert set(rows) == {"a.txt", ".hidden", "_under/x", "k=v/y", "docs/run.sh", "other"}
    assert rows["k=v/y"]["content"] == b"" and rows["docs/run.sh"]["mode"] & 0o111
    only = read_tree(spark, str(tree), content=False, only=["docs", "a.txt", "none"]).collect()
    assert {r["rel"] for r in only} == {"docs/run.sh", "docs/.m", "a.txt"} and only[0]["content"] is None
    assert read_tree(spark, str(tree / "missing")).count() == 0


def test_tree_is_listed_by_level(spark, tmp_path, monkeypatch):
    want = {}
    for k in range(60):
        rel = "/".join(f"d{k % m}" for m in range(1, 1 + k % 7)) + f"/f{k}"
        (tmp_path / rel.lstrip("/")).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel.lstrip("/")).write_bytes(b"x" * (k * 50))
        want[rel.lstrip("/")] = k * 50
    os.symlink(tmp_path / "d0", tmp_path / "link")
    monkeypatch.setattr(tree_source, "PACK_BYTES", 5000)
    monkeypatch.setattr(tree_source, "BATCH_BYTES", 500)
    rows = {r["rel"]: r["content"] for r in read_tree(spark, str(tmp_path)).collect()}
    assert rows.pop("link") is None and {k: len(v) for k, v in rows.items()} == want
    listed = {r["rel"]: r["bytes"] for r in tree_source.list_tree(spark, str(tmp_path), only=["d0"]).collect()}
    assert listed == {k: n for k, n in want.items() if k.startswith("d0/")}
    both = tree_source.scan_roots(spark, {"x": str(tmp_path / "d0"), "y": str(tmp_path / "gone")})
    assert both.count() == len(listed) and {r["root"] for r in both.collect()} == {"x"}


@pytest.mark.parametrize("text", ["", "null", "[]", '"s"', "{'a': 1}", "{} x", "﻿{}", '{"a": NaN}'])
def test_unreadable_manifests(text):
    assert parse_manifest(text) is None


def test_manifest_details():
    m = parse_manifest('{"name": "n", "files": {"a": "1", "a": "2", "b": null, "c": 3}}')
    assert m.files == {"a": "2", "b": None, "c": None} and m.version is None
    assert parse_manifest("{}").files is None


def test_drift_is_null_safe_and_left_only(spark):
    manifest = spark.createDataFrame([("same", "1"), ("changed", "1"), ("gone", "1"), ("nodigest", None), ("now_null", "1")], "rel string, digest string")
    found = spark.createDataFrame([("same", "1"), ("changed", "2"), ("added", "9"), ("nodigest", "5"), ("now_null", None)], "rel string, digest string")
    got = {tuple(r) for r in integrity.drift(manifest, found).collect()}
    assert got == {("changed", "edited"), ("gone", "deleted"), ("nodigest", "edited"), ("now_null", "edited")}
    assert integrity.drift(manifest.limit(0), found).count() == 0
    assert {r["rel"] for r in integrity.stale(manifest, found).collect()} == {"gone"}


def test_capped_report_and_order(spark):
    found = spark.createDataFrame([(x, "deleted") for x in ("\U00010000", "", "b")] + [(f"z{i:02}", "edited") for i in range(22)], "rel string, kind string")
    rows = integrity.capped(found).collect()
    assert len(rows) == 20 and rows[0]["total"] == 25 and rows[0]["more"] == 5
    ordered = [r["rel"] for r in found.orderBy(paths.utf16_order(F.col("rel"))).collect()]
    assert ordered[-2:] == ["\U00010000", ""]


def test_verdict_table(spark):
    none = spark.createDataFrame([], "rel string, kind string")
    some = spark.createDataFrame([("a", "edited")], "rel string, kind string")
    state = lambda df: tuple(df.first())[:2]
    assert state(verdicts.check_verdict(none, target_exists=False)) == ("missing", 0)
    assert state(verdicts.check_verdict(none, readable=False)) == ("untracked", 0)
    assert state(verdicts.check_verdict(none)) == ("clean", 0)
    assert state(verdicts.check_verdict(some)) == ("drift", 1)
    files = some.select("rel")
    assert state(verdicts.install_verdict(none.select("rel"), none)) == ("blocked", 2)
    assert state(verdicts.install_verdict(files, some)) == ("refused", 2)
    assert state(verdicts.install_verdict(files, some, force=True)) == ("installed", 0)
    assert state(verdicts.uninstall_verdict(some)) == ("removed", 0)


def test_install_check_uninstall(spark, tree, tmp_path):
    target = commands.resolve_target("kit", path=str(tmp_path / "there"))
    assert target.endswith("there/kit")
    ship = ["a.txt", "docs", "_under"]
    run = lambda **k: tuple(commands.install(spark, str(tree), target, "kit", "1", ship, **k).first())[:2]
    assert run() == ("installed", 0)
    assert os.stat(os.path.join(target, "docs/run.sh")).st_mode & 0o777 == 0o755
    assert commands.check(spark, target)[0].first()["state"] == "clean"
    with open(os.path.join(target, "a.txt"), "w") as f:
        f.write("mine")
    verdict, report = commands.check(spark, target)
    assert verdict.first()["exit_code"] == 1 and [r["label"] for r in report.collect()] == ["a.txt"]
    assert run() == ("refused", 2)
    os.remove(tree / "_under/x")
    assert run(force=True) == ("installed", 0) and not os.path.exists(os.path.join(target, "_under/x"))
    assert commands.uninstall(spark, target)[0].first()["state"] == "removed" and not os.path.exists(target)
    assert tuple(commands.install(spark, str(tree / "none"), target, "kit", "1", ship).first())[:2] == ("blocked", 2)


def test_paths(spark):
    assert [paths.safe(x) for x in ("a/b", "../a", "/a", "a/../b", "")] == [True, False, False, False, False]
    row = spark.range(1).select(paths.slashes(F.lit("a\\b")), paths.basename(F.lit("a/b")), paths.comment_text(F.lit("// hi")), paths.comment_text(F.lit(" // no"))).first()
    assert tuple(row) == ("a/b", "b", "hi", None)
    assert commands.parse_arguments(["--check", "--path=x"]).path == "x"


def test_targets_and_maps(spark):
    t = spark.createDataFrame([("n", "global", "/g"), ("n", "project", "/p"), ("m", "project", "/m")], "name string, scope string, path string")
    assert {r["path"] for r in integrity.winners(t).collect()} == {"/g", "/m"}
    assert [r["path"] for r in integrity.shadowed(t).collect()] == ["/p"]
    m = manifest_rows(spark, parse_manifest('{"files": {"a": "1", "b": "2"}}'))
    assert {tuple(r) for r in integrity.rows_of(integrity.as_maps(m)).collect()} == {("a", "1"), ("b", "2")}
    assert {tuple(r) for r in integrity.rows_of(integrity.as_maps(m, 1)).collect()} == {("a", "1"), ("b", "2")}


def test_stream_of_edits(spark, tmp_path):
    rows = spark.createDataFrame([("a", "new"), ("b", "same"), ("c", "x")], "rel string, content string")
    rows.write.json(str(tmp_path / "in"))
    manifest = spark.createDataFrame([("a", "old"), ("b", "same")], "rel string, digest string").withColumn("digest", F.sha2("digest", 256))
    stream = spark.readStream.schema("rel string, content string").json(str(tmp_path / "in"))
    query = arriving_edits(stream, manifest).writeStream.format("memory").queryName("edits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(120)
    assert [r["rel"] for r in spark.table("edits").collect()] == ["a"]


def test_dispatch(spark, tmp_path, capsys):
    source = tmp_path / "from"
    (source / "kit").mkdir(parents=True)
    (source / "kit" / "a.md").write_text("one")
    (source / "kit" / "run").write_text("two")
    (source / "kit" / "run").chmod(0o700)
    (source / "kit" / "a.md").chmod(0o600)
    common = ["--name", "tree", "--path", str(tmp_path / "to")]
    install = [*common, "--source", str(source), "--ship", "kit"]
    assert commands.run(spark, install) == 0
    target = tmp_path / "to" / "tree"
    assert (target / "kit" / "a.md").read_text() == "one"
    assert [(target / "kit" / x).stat().st_mode & 0o777 for x in ("a.md", "run")] == [0o600, 0o755]
    assert commands.run(spark, [*common, "--check"]) == 0
    (target / "kit" / "a.md").write_text("edited")
    # check comes before uninstall and changes nothing
    assert commands.run(spark, [*common, "--check", "--uninstall"]) == 1 and target.exists()
    assert commands.run(spark, install) == 2 and commands.run(spark, [*install, "--force"]) == 0
    assert commands.run(spark, [*common, "--uninstall"]) == 0 and not target.exists()
    assert commands.run(spark, [*common, "--source", str(source), "--ship", "none"]) == 2 and not target.exists()
    with pytest.raises(SystemExit) as e:
        commands.run(spark, ["--help", "--uninstall"])
    assert e.value.code == 0 and "uninstall" in capsys.readouterr().out


def test_reports(spark, tmp_path, capsys):
    source, home, root = tmp_path / "from", tmp_path / "home", tmp_path / "project"
    for k in range(25):
        (source / "kit").mkdir(parents=True, exist_ok=True)
        (source / "kit" / f"f{k:02}").write_text("one")
    (source / "kit" / "SKILL.md").write_text("---\nname: kit\ndescription: d\n---\n")
    install = ["--name", "kit", "--source", str(source / "kit"), "--ship", *sorted(os.listdir(source / "kit")), "--version", "7"]
    said = lambda *argv: (commands.run(spark, list(argv), home=str(home)), capsys.readouterr().out)
    assert said(*install) == (0, f"installed: {home / 'kit'}, 0 differing\n  26 files copied, 0 deleted\n")
    code, out = said(*install, "--project", "--root", str(root))
    assert code == 0 and f"warning: {home / 'kit'} comes first" in out
    for k in range(22):
        (home / "kit" / f"f{k:02}").write_text("mine")
    code, out = said(*install)
    assert code == 2 and out.startswith("refused:") and "  f00\n" in out and "  f19\n" in out and "  f20\n" not in out and "... 2 more" in out and "--force" in out
    code, out = said("--name", "kit", "--check", "--version", "8")
    assert code == 1 and "version 7, 2" in out and "at hand: version 8" in out and "... 2 more" in out
    (root / "other").mkdir()
    (root / "other" / "Skill.md").write_text("---\nname: other\ndescription: d\n---\n")
    assert said("--doctor", "--check", "--root", str(root)) == (0, "global: kit: loads\nproject: kit: hidden by global\nproject: other: wrong case\n")
    code, out = said("--name", "kit", "--uninstall")
    assert code == 0 and "  f09\n" in out and "  f10\n" not in out and "... 12 more" in out
    assert said("--doctor", "--root", str(tmp_path / "none"))[1] == "global: -: nothing\nproject: -: nothing\n"


def test_files_and_manifests_are_written_in_tasks(spark, tmp_path):
    rows = [(f"a{k % 3}/b/.f{k}", bytes([k]) * k, 0o755 if k % 2 else None) for k in range(40)]
    files = spark.createDataFrame(rows, "rel string, content binary, mode int").repartition(5)
    tree_source.write_tree(files, str(tmp_path / "t"))
    tree_source.write_tree(files, str(tmp_path / "t"))
    got = {r["rel"]: (bytes(r["content"]), r["mode"]) for r in read_tree(spark, str(tmp_path / "t")).collect()}
    assert got == {rel: (data, 0o755 if mode else 0o644) for rel, data, mode in rows}
    for wrong in ("../x", "/x", None):
        with pytest.raises(Exception, match="unsafe path"):
            tree_source.write_tree(spark.createDataFrame([(wrong, None, None)], files.schema), str(tmp_path / "t"))
    entries = integrity.digests(files)
    write_manifest_shards(entries, str(tmp_path / "m"), "n", "1", most=7)
    back = read_manifest_shards(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in back.collect()} == {(*r, True) for r in entries.collect()}
    (tmp_path / "m" / "part-x.txt").write_text("{'a': 1}\n")
    assert [tuple(r) for r in read_manifest_shards(spark, str(tmp_path / "m")).filter("not readable").collect()] == [(None, None, False)]


@pytest.mark.parametrize("name", ["q48_comment_text", "q47_arriving_edits", "q44_tree_scan", "q45_allow_list_scan", "q46_recorded_manifest", "q28_capped_ten", "q29_blocked_verdict", "q30_forced_verdict", "q31_untracked_verdict", "q32_clean_verdict"])
def test_verdict_queries_equal_their_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet/*.parquet')" if os.path.isdir(f"{data}/documents.parquet") else f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{data}/pages.parquet')")
    cur = con.execute(queries.SQL[name])
    cols = [c[0] for c in cur.description]
    got = queries.queries()[name](spark, data).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall()))


def test_shadowed_copies_are_dealt_to_cells(spark):
    rows = [(f"n{k % 2}", "global" if k % 3 == 0 else "project", f"u{k % 7}") for k in range(600)] + [("one", "project", "x"), (None, "global", "y"), (None, "project", "z"), ("n0", "project", None)]
    targets = spark.createDataFrame(rows, "name string, scope string, path string").repartition(3)
    want = sorted(tuple(r) for r in integrity.shadowed(targets).collect())
    found = integrity.shadowed(targets, cell=16, task=1000)
    assert found.columns == ["name", "scope", "path", "winner"] and sorted(tuple(r) for r in found.collect()) == want
    per = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    # 40,000 pairs of two names: two tasks had half of them each
    assert len(want) > 30_000 and len(per) > 30 and max(per) < 4000
    assert integrity.shadowed(targets.limit(0), task=0).count() == 0
