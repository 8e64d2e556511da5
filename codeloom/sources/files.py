"""Source files as a table: scan, select, decode."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.lexicons import IGNORED_DIRECTORIES
from codeloom.functions.text import decode_source, module_name
from codeloom.session import checkpointed

_LISTING_DDL = "run_id string, root string, path string, is_dir boolean, size bigint, modified bigint"
_LISTING = pa.schema(
    [
        ("run_id", pa.string()),
        ("root", pa.string()),
        ("path", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("modified", pa.int64()),
    ]
)
_CONTENT_DDL = "run_id string, path string, content binary"
_CONTENT = pa.schema([("run_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])

# Groups into which the paths of one run are split for ranking.
_SALTS = 64

# Bytes of text in one result batch of the reader.
_BATCH_BYTES = 16 * 1024 * 1024


def in_ignored_directory(path: Column) -> Column:
    """True when any directory of the relative path is on the ignore list."""
    return F.arrays_overlap(F.split(path, "/"), lx.string_array(IGNORED_DIRECTORIES))


def is_python_file(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))


def select_sources(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Python files outside ignored directories, at most ``max_files`` per run.

    The cap keeps the first paths in sorted order.  File text never enters a sort: only
    (run_id, path) is ranked, which yields one cut-off path per run, and the files are
    then filtered by that cut-off.  A run may hold most of the files, so paths are first
    ranked in salted groups; only what survives there is ranked per run.
    """
    kept = files.where(is_python_file(F.col("path")) & ~in_ignored_directory(F.col("path")))
    if max_files is None:
        return kept
    salted = Window.partitionBy("run_id", "salt").orderBy("path")
    per_run = Window.partitionBy("run_id").orderBy("path")
    cut = (
        kept.select("run_id", "path", F.pmod(F.xxhash64("path"), F.lit(_SALTS)).alias("salt"))
        .withColumn("rank", F.row_number().over(salted))
        .where(F.col("rank") <= max_files)
        .withColumn("rank", F.row_number().over(per_run))
        .where(F.col("rank") <= max_files)
        .groupBy("run_id")
        .agg(F.max("path").alias("last_path"))
    )
    return kept.join(cut, "run_id").where(F.col("path") <= F.col("last_path")).drop("last_path")


def _list_directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each (run_id, root, dir) row: Python files, and directories to visit."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            system, base = _file_system(row["root"])
            here = f"{base}/{row['dir']}".rstrip("/")
            for entry in system.get_file_info(FileSelector(here, allow_not_found=True)):
                path = f"{row['dir']}/{entry.base_name}".lstrip("/")
                is_dir = entry.type == FileType.Directory
                if is_dir and entry.base_name in IGNORED_DIRECTORIES:
                    continue
                if is_dir and isinstance(system, LocalFileSystem) and os.path.islink(entry.path):
                    continue  # a link to a directory may lead back to its own parent
                if is_dir or entry.base_name.endswith(".py"):
                    rows.append(
                        {
                            "run_id": row["run_id"],
                            "root": row["root"],
                            "path": path,
                            "is_dir": is_dir,
                            "size": 0 if is_dir else entry.size,
                            "modified": None if is_dir else entry.mtime_ns,
                        }
                    )
        yield pa.RecordBatch.from_pylist(rows, schema=_LISTING)


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each listed file, in result batches of bounded size."""
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            system, base = _file_system(row["root"])
            with system.open_input_stream(f"{base}/{row['path']}") as stream:
                content = stream.read()
            rows.append({"run_id": row["run_id"], "path": row["path"], "content": content})
            held += len(content)
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=_CONTENT)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_CONTENT)


@lru_cache(maxsize=1024)
def _file_system(root: str) -> tuple[FileSystem, str]:
    """File system and base path of a root: a URI or an absolute local path."""
    system, path = FileSystem.from_uri(root)
    return system, path.rstrip("/")


def list_sources(spark: SparkSession, roots: DataFrame) -> DataFrame:
    """Python files below roots(run_id, root): (run_id, root, path, size, modified).

    Spark's own file listing skips every name which starts with ``_`` or ``.`` and every
    empty file, and so would lose ``__init__.py``.  Directories are therefore listed
    by tasks, one tree level per round and all roots together: a huge repository is
    spread over the tasks by its directories.  Ignored directories are never entered.
    """
    parallelism = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = roots.select("run_id", "root", F.lit("").alias("dir"))
    levels = []
    while True:
        found = checkpointed(
            frontier.repartition(parallelism).mapInArrow(_list_directories, _LISTING_DDL)
        )
        levels.append(found.where(~F.col("is_dir")).drop("is_dir"))
        frontier = found.where("is_dir").select("run_id", "root", F.col("path").alias("dir"))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)


def read_sources(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """Listed files with their content; tasks get about ``maxPartitionBytes`` each."""
    per_task = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_task))
    return listing.select("run_id", "root", "path").repartition(tasks).mapInArrow(_read_contents, _CONTENT_DDL)


def scan_sources(
    spark: SparkSession, roots: dict[str, str] | DataFrame, max_files: int | None = None
) -> DataFrame:
    """files(run_id, path, content) of ``{run_id: root directory}`` or such a table.

    ``path`` is relative to its root, so a root which itself lies below a directory
    named ``build`` still counts.
    """
    if isinstance(roots, dict):
        roots = spark.createDataFrame(list(roots.items()), "run_id string, root string")
    return read_sources(spark, select_sources(list_sources(spark, roots), max_files))


def new_sources(listing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Listed files which an earlier scan has not seen in this state."""
    return listing.join(scanned, ["run_id", "path", "size", "modified"], "left_anti")


def decoded(files: DataFrame) -> DataFrame:
    """Add ``text`` and ``module`` and drop the bytes."""
    return files.select(
        "run_id",
        "path",
        module_name(F.col("path")).alias("module"),
        decode_source(F.col("content")).alias("text"),
    )
