"""Append-only tables whose writes become visible one by one, all or nothing.

A write puts its rows into a folder of its own and then adds a small commit file, which
names the folder.  Readers open only the folders that commits name, so a failed or running
write is never seen, and writers need no lock: commits are ordered by their number (one
more than the largest which the writer saw) and, of writers at the same time, by their id.
No clock is involved.  Compaction replaces folders by one in which only the newest row of
every key is left; what others append meanwhile stays.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Columns which order the rows of a table: number and id of the commit, place in the write.
ORDER = ["_commit", "_write", "_row"]
_LOG, _DATA = "_log", "data"


@dataclass(frozen=True)
class Commit:
    number: int
    write: str
    adds: tuple[str, ...]
    removes: tuple[str, ...] = ()


def _folder(path: str, name: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(f"{path.rstrip('/')}/{name}")


def commits(path: str) -> list[Commit]:
    """All commits of a table in order.  One small file each; the rows stay where they are."""
    system, folder = _folder(path, _LOG)
    found = []
    for info in system.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.type == FileType.File and info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as text:
                c = json.loads(text.read())
            found.append(Commit(c["number"], c["write"], tuple(c["adds"]), tuple(c["removes"])))
    return sorted(found, key=lambda c: (c.number, c.write))


def _commit(path: str, write: str, adds: list[str], removes: list[str]) -> None:
    """Publish a write: the file gets its name, which no other writer uses, when it is whole."""
    number = max((c.number for c in commits(path)), default=0) + 1
    system, folder = _folder(path, _LOG)
    system.create_dir(folder, recursive=True)
    text = json.dumps({"number": number, "write": write, "adds": adds, "removes": removes}, indent=1)
    with system.open_output_stream(f"{folder}/.{write}") as out:
        out.write(text.encode())
    system.move(f"{folder}/.{write}", f"{folder}/{number:012d}-{write}.json")


def _place(path: str, write: str) -> str:
    return f"{path.rstrip('/')}/{_DATA}/_folder={write}"


def _save(rows: DataFrame, path: str, write: str, partition_by: list[str] | None) -> None:
    out = rows.write.mode("overwrite")
    out = out.partitionBy(*partition_by) if partition_by else out
    out.parquet(_place(path, write))


def live_folders(path: str) -> dict[str, Commit]:
    """Folders which make up the table now, with the commit that added each."""
    log = commits(path)
    gone = {name for c in log for name in c.removes}
    return {name: c for c in log for name in c.adds if name not in gone}


def append(rows: DataFrame, path: str, *, write: str | None = None, partition_by: list[str] | None = None) -> None:
    """Add ``rows`` as one commit.

    ``write`` names the write (else it gets a name of its own): a repeated write of that name
    replaces what an interrupted one left, and does nothing if it was committed.
    """
    if write is not None and any(c.write == write for c in commits(path)):
        return
    write = write or uuid.uuid4().hex
    marked = rows.withColumn("_commit", F.lit(None).cast("bigint")).withColumn("_write", F.lit(write))
    marked = marked.withColumn("_row", F.monotonically_increasing_id())
    _save(marked, path, write, partition_by)
    _commit(path, write, [write], [])


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows of the committed writes, with the columns of ``ORDER``."""
    live = live_folders(path)
    whole = spark.createDataFrame([], schema).schema
    for name, kind in zip(ORDER, (LongType(), StringType(), LongType())):
        whole = whole.add(name, kind)
    if not live:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", f"{path.rstrip('/')}/{_DATA}")
    rows = reader.parquet(*[_place(path, name) for name in live])
    numbers = spark.createDataFrame([(c.write, c.number) for c in set(live.values())], "_write string, number bigint")
    # rows of a compacted folder carry the number of their own commit
    met = rows.join(numbers, "_write", "left").withColumn("_commit", F.coalesce("_commit", "number"))
    return met.select(*whole.fieldNames())


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last written row of every key; only the newest one per key and map task is
    shuffled (group limit below the exchange)."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in ORDER])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def compact(spark: SparkSession, path: str, schema: str | StructType, keys: list[str], *, partition_by: list[str] | None = None) -> None:
    """Replace the present folders by one with the newest row of every key.

    Rows keep the number, write and place they had, so a write which is committed while the
    compaction runs is newer than all of them.  Of two compactions at once both stay, and
    hold the same rows: reading takes one of each.
    """
    live = live_folders(path)
    if len(live) < 2:
        return
    write = uuid.uuid4().hex
    rows = latest(read(spark, path, schema), keys)
    _save(rows, path, write, partition_by)
    _commit(path, write, [write], sorted(live))


def vacuum(path: str) -> list[str]:
    """Delete the folders that compactions replaced; gives their names.  Not for a table which
    somebody still reads in an older state."""
    log = commits(path)
    system, folder = _folder(path, _DATA)
    gone = sorted({name for c in log for name in c.removes})
    found = {i.base_name.partition("=")[2] for i in system.get_file_info(FileSelector(folder, allow_not_found=True))}
    for name in gone:
        if name in found:
            system.delete_dir(f"{folder}/_folder={name}")
    return [name for name in gone if name in found]
