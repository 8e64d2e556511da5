"""Repositories: URL parsing and the choice of a source directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.files import is_python_file


def parse_repo_url(repos: DataFrame, url: str = "url") -> DataFrame:
    """Add owner, name and valid: the first two non-empty path segments.

    ``.git`` is removed anywhere in the name, as specified.
    """
    path = F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    valid = F.size(parts) >= 2
    return repos.select(
        "*",
        F.when(valid, F.get(parts, F.lit(0))).alias("owner"),
        F.when(valid, F.replace(F.get(parts, F.lit(1)), F.lit(".git"), F.lit(""))).alias("name"),
        valid.alias("valid"),
    )


def python_directories(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct directories with a Python file anywhere below them.

    Ignored directories count here: a tree with Python only in ``venv`` is a
    source.  Directories are made distinct before the ancestors are listed, so the
    expansion is over directories and not over files.
    """
    parent = F.regexp_replace(F.col(path), "/[^/]*$", "")
    leaf = paths.where(is_python_file(F.col(path))).select(parent.alias("leaf")).distinct()
    steps = F.split(F.col("leaf"), "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    )
    return leaf.select(F.explode(ancestors).alias("dir")).where(F.col("dir") != "").distinct()


def resolve_source(repos: DataFrame, paths: DataFrame, roots: list[str]) -> DataFrame:
    """Add source_root and mode: the first candidate directory with Python below it.

    Candidates: the given local path, then root/name and root/owner/name for each
    root in order.  No candidate holds Python: mode ``fallback``.
    """
    candidates = [F.struct(F.lit(0).alias("rank"), F.col("local_path").alias("dir"))]
    for i, root in enumerate(roots):
        base = F.lit(root.rstrip("/") + "/")
        candidates.append(
            F.struct(F.lit(2 * i + 1).alias("rank"), F.concat(base, F.col("name")).alias("dir"))
        )
        candidates.append(
            F.struct(
                F.lit(2 * i + 2).alias("rank"),
                F.concat(base, F.col("owner"), F.lit("/"), F.col("name")).alias("dir"),
            )
        )
    wanted = repos.select("repo_id", F.explode(F.array(*candidates)).alias("c")).select(
        "repo_id", "c.rank", F.regexp_replace("c.dir", "/+$", "").alias("dir")
    )
    found = (
        wanted.where(F.col("dir") != "")
        .join(python_directories(paths), "dir", "left_semi")
        .groupBy("repo_id")
        .agg(F.min_by("dir", "rank").alias("source_root"))
    )
    return repos.join(found, "repo_id", "left").withColumn("mode", _mode(F.col("source_root")))


def _mode(root: Column) -> Column:
    return F.when(root.isNotNull(), F.lit("ast-local")).otherwise(F.lit("fallback"))


def ingestion_mode(
    repos: DataFrame, paths: DataFrame, checkouts: DataFrame, checkout_enabled: bool = True
) -> DataFrame:
    """Where each repository's source came from: mode, message and branch.

    ``checkouts(owner, name, dir, branch, error)`` lists prepared working copies;
    a row with ``error`` is a copy which could not be made.
    """
    dirs = python_directories(paths)
    local = (
        repos.select("repo_id", F.regexp_replace("local_path", "/+$", "").alias("dir"))
        .join(dirs, "dir", "left_semi")
        .select("repo_id", F.lit(True).alias("has_local"))
    )
    copies = checkouts.join(
        dirs.select("dir", F.lit(True).alias("has_copy")), "dir", "left"
    ).select("owner", "name", "branch", "error", "has_copy")
    merged = repos.join(local, "repo_id", "left").join(copies, ["owner", "name"], "left")

    is_local = F.col("has_local").isNotNull()
    requested = F.nullif(F.col("default_branch"), F.lit(""))
    branch = F.coalesce(F.col("branch"), requested, F.lit("main"))
    has_copy = F.col("has_copy").isNotNull() & F.col("error").isNull()
    if not checkout_enabled:
        mode = F.when(is_local, F.lit("local")).otherwise(F.lit("fallback"))
        other = F.lit("Git ingestion disabled by environment")
        resolved = requested
    else:
        mode = (
            F.when(is_local, F.lit("local"))
            .when(has_copy, F.lit("git-clone"))
            .otherwise(F.lit("fallback"))
        )
        other = (
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(
                has_copy,
                F.concat(F.lit("Repository prepared in local cache (branch="), branch, F.lit(")")),
            )
            .otherwise(F.lit("No Python files found after ingestion"))
        )
        resolved = F.when(is_local, requested).otherwise(branch)
    return merged.select(
        "repo_id",
        mode.alias("mode"),
        F.when(is_local, F.lit("Using user-provided local path")).otherwise(other).alias("message"),
        resolved.alias("branch"),
    )


def effective_branch(repos: DataFrame, listed: DataFrame) -> DataFrame:
    """Branch to check out for repos(repo_id, requested), given the remote's branches
    listed(repo_id, branch, is_default).

    The requested one if the remote has it (also as the last part of a longer name, which a
    remote listing finds too), else the remote's default, else null.
    """
    asked = repos.select("repo_id", "requested")
    met = asked.join(listed, "repo_id", "left")
    same = (F.col("branch") == F.col("requested")) | F.endswith("branch", F.concat(F.lit("/"), F.col("requested")))
    found = met.groupBy("repo_id", "requested").agg(
        F.coalesce(F.bool_or(same), F.lit(False)).alias("exists"), F.min(F.when(F.col("is_default"), F.col("branch"))).alias("default")
    )
    return found.select("repo_id", "requested", F.when(F.col("exists"), F.col("requested")).otherwise(F.col("default")).alias("branch"))


def is_missing_branch(message: Column) -> Column:
    """Does an error text of a checkout say that the branch is not there?"""
    text = F.lower(message)
    return F.contains(text, F.lit("remote branch")) & F.contains(text, F.lit("not found"))
