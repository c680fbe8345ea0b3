"""What a command would answer and do: verdicts as one-row tables, changes as an action table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.integrity import drift, stale


def check_verdict(found: DataFrame, target_exists: bool = True, readable: bool = True) -> DataFrame:
    """(state, exit_code, n) of a check whose drift is found."""
    n = found.agg(F.count("*").alias("n"))
    state = F.when(F.lit(not target_exists), "missing").when(F.lit(not readable), "untracked").when(F.col("n") == 0, "clean").otherwise("drift")
    return n.select(state.alias("state"), F.when(state == "drift", 1).otherwise(0).alias("exit_code"), "n")


def install_verdict(files: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """(state, exit_code, n) of an install: blocked with nothing to ship, refused over edits, else installed."""
    both = files.agg(F.count("*").alias("files")).crossJoin(F.broadcast(found.agg(F.count("*").alias("n"))))
    state = F.when(F.col("files") == 0, "blocked").when((F.col("n") > 0) & F.lit(not force), "refused").otherwise("installed")
    return both.select(state.alias("state"), F.when(state == "installed", 0).otherwise(2).alias("exit_code"), "n")


def uninstall_verdict(found: DataFrame, target_exists: bool = True) -> DataFrame:
    """(state, exit_code, n): drift is noted, never a reason to stop."""
    state = F.lit("removed" if target_exists else "missing")
    return found.agg(F.count("*").alias("n")).select(state.alias("state"), F.lit(0).alias("exit_code"), "n")


def install_actions(manifest: DataFrame, current: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """(rel, action): copy every file of files, delete stale entries that still exist; nothing where refused.

    manifest and current are (rel, digest), files is (rel). Planning changes nothing.
    """
    ok = install_verdict(files, drift(manifest, current), force).filter("exit_code = 0").select(F.lit(True).alias("go"))
    old = stale(manifest, files).join(current.select("rel"), "rel", "left_semi")
    todo = files.select("rel", F.lit("copy").alias("action")).unionByName(old.select("rel", F.lit("delete").alias("action")))
    return todo.crossJoin(F.broadcast(ok)).drop("go")
