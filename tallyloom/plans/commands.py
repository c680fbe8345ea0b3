"""Check, install and uninstall a tree: pure plans, then an explicit step that changes files."""

from __future__ import annotations

import argparse
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..functions.paths import safe
from ..operators.integrity import capped, digests, drift, shadowed
from ..operators.lint import doctor_roots
from ..sources.manifest import manifest_rows, read_manifest, write_manifest
from ..sources.tree import read_tree, scan_roots
from .verdicts import check_verdict, install_actions, install_verdict, uninstall_verdict

MANIFEST = ".manifest.json"


def resolve_target(name: str, path: str | None = None, project: bool = False, root: str | None = None, home: str | None = None) -> str:
    """The folder of an installed tree: path, else below the project's root, else below home."""
    if path:
        path = os.path.abspath(path)
        return path if os.path.basename(path) == name else os.path.join(path, name)
    return os.path.join(os.path.abspath(root or ".") if project else (home or os.path.expanduser("~")), name)


def _state(spark: SparkSession, target: str) -> tuple[bool, bool, DataFrame, DataFrame]:
    manifest = read_manifest(os.path.join(target, MANIFEST))
    rows = manifest_rows(spark, manifest)
    now = digests(read_tree(spark, target, skip=MANIFEST)) if os.path.isdir(target) else manifest_rows(spark, None)
    return os.path.exists(target), manifest is not None, rows, now


def check(spark: SparkSession, target: str, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(verdict, capped drift) of target; nothing is changed."""
    exists, readable, rows, now = _state(spark, target)
    found = drift(rows, now)
    return check_verdict(found, exists, readable), capped(found, most)


def install(spark: SparkSession, source: str, target: str, name: str, version: str, ship: list[str], force: bool = False) -> DataFrame:
    """Copies what is on the ship list from source to target, deletes stale files, writes the manifest last; returns the verdict, with
    the numbers of files copied and deleted.

    Paths come from one tree's listing and go file by file through the driver's file system, as this changes one local folder.
    """
    _, _, rows, now = _state(spark, target)
    files = read_tree(spark, source, content=False, skip=MANIFEST, only=ship).select("rel")
    verdict = install_verdict(files, drift(rows, now), force)
    actions = install_actions(rows, now, files, force).orderBy("action", "rel").collect()
    verdict = spark.createDataFrame(verdict.collect(), verdict.schema)
    number = lambda x: F.lit(sum(a == x for _, a in actions))
    verdict = verdict.withColumns({"copied": number("copy"), "deleted": number("delete")})
    if not actions:
        return verdict
    os.makedirs(target, exist_ok=True)
    for rel, action in actions:
        if not safe(rel):
            raise ValueError(f"unsafe path {rel!r}")
        to = os.path.join(target, rel)
        if action == "copy":
            os.makedirs(os.path.dirname(to), exist_ok=True)
            shutil.copyfile(os.path.join(source, rel), f"{to}.new")
            shutil.copymode(os.path.join(source, rel), f"{to}.new")
            if os.stat(os.path.join(source, rel)).st_mode & 0o111:
                os.chmod(f"{to}.new", 0o755)
            os.replace(f"{to}.new", to)
        elif os.path.exists(to):
            os.remove(to)
    landed = digests(read_tree(spark, target, skip=MANIFEST).join(files, "rel", "left_semi"))
    write_manifest(os.path.join(target, MANIFEST), name, version, dict(map(tuple, landed.collect())))
    return verdict


def uninstall(spark: SparkSession, target: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(verdict, capped drift); the whole target is removed."""
    exists, _, rows, now = _state(spark, target)
    found = drift(rows, now)
    verdict, report = uninstall_verdict(found, exists), capped(found, most)
    out = tuple(spark.createDataFrame(x.collect(), x.schema) for x in (verdict, report))
    if exists:
        shutil.rmtree(target)
    return out


def shadow_warning(spark: SparkSession, name: str, target: str, home: str | None = None) -> DataFrame:
    """(name, scope, path, winner): the project copy at target if a global copy of the name exists at another path, which then counts."""
    top = resolve_target(name, home=home)
    found = [(name, "project", os.path.abspath(target))] + [(name, "global", top)] * os.path.exists(top)
    return shadowed(spark.createDataFrame(found, "name string, scope string, path string"))


def doctor(spark: SparkSession, roots: dict[str, str], most: int, allowed: list[str]) -> DataFrame:
    """The report of lint.doctor_roots over folders (name to path), the first of which comes first; missing ones are reported too."""
    ranked = spark.createDataFrame([(x, k) for k, x in enumerate(roots)], "root string, rank int")
    return doctor_roots(scan_roots(spark, roots), ranked, most, allowed)


def parse_arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tallyloom", description="Check, install or uninstall a tree of files.")
    p.add_argument("--check", action="store_true", help="compare the installed tree with its manifest")
    p.add_argument("--uninstall", action="store_true", help="remove the installed tree")
    p.add_argument("--doctor", action="store_true", help="report the packages of home and project, which copy counts and what keeps one from loading")
    p.add_argument("--force", action="store_true", help="install over edited files")
    p.add_argument("--project", action="store_true", help="install below the project's root")
    p.add_argument("--root", help="the project's root")
    p.add_argument("--path", help="the folder to install into")
    p.add_argument("--name", default="tree", help="name of the tree")
    p.add_argument("--version", default="0", help="version to record")
    p.add_argument("--source", default=".", help="the folder to install from")
    p.add_argument("--ship", nargs="*", default=[], help="top names of source that are installed")
    p.add_argument("--most", type=int, default=1024, help="characters that a description may have")
    p.add_argument("--keys", nargs="*", default=["name", "description"], help="keys that front matter may have")
    return p.parse_args(argv)


def _list(report: DataFrame) -> list[str]:
    """The lines of a capped report, with the number of entries not shown."""
    rows = report.collect()
    return [f"  {r['label']}" for r in rows] + [f"  ... {r['more']} more" for r in rows[:1] if r["more"]]


def run(spark: SparkSession, argv: list[str], home: str | None = None) -> int:
    """Does what argv asks for, help before doctor before check before uninstall before install; prints a report and returns its exit code.

    A check names the recorded version and date, an edited file stops an install and is named, a project copy that a global one hides is warned
    of; lists show 20 files (10 when a tree is removed) and how many more there are.
    """
    args = parse_arguments(argv)
    if args.doctor:
        roots = {"global": home or os.path.expanduser("~"), "project": os.path.abspath(args.root or ".")}
        for r in doctor(spark, roots, args.most, args.keys).orderBy("rank", "name", "rel", "cause").toLocalIterator():
            state = "nothing" if r["name"] is None else r["cause"] or ("loads" if r["winner"] == r["root"] else f"hidden by {r['winner']}")
            print(f"{r['root']}: {r['name'] or '-'}: {state}")
        return 0
    target = resolve_target(args.name, args.path, args.project, args.root, home)
    lines: list[str] = []
    if args.check:
        verdict, report = check(spark, target)
        found = read_manifest(os.path.join(target, MANIFEST))
        if found:
            lines.append(f"  recorded: version {found.version or 'unknown'}, {found.installed_at or 'at an unknown time'}; at hand: version {args.version}")
        lines += _list(report)
    elif args.uninstall:
        verdict, report = uninstall(spark, target)
        lines += _list(report)
    else:
        verdict = install(spark, args.source, target, args.name, args.version, args.ship, args.force)
        state = verdict.first()
        if state["state"] == "refused":
            lines += [*_list(check(spark, target)[1]), "  nothing was changed; --force installs over these"]
        elif state["state"] == "installed":
            lines.append(f"  {state['copied']} files copied, {state['deleted']} deleted")
            if args.project and not args.path:
                lines += [f"  warning: {r['winner']} comes first, so this copy is not used" for r in shadow_warning(spark, args.name, target, home).collect()]
    said = verdict.first()
    print(f"{said['state']}: {target}, {said['n']} differing")
    for line in lines:
        print(line)
    return said["exit_code"]
