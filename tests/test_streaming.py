"""The stream of run states: equal to the batch, bounded, and safe to repeat."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.operators.runs import latest_run_state
from codeloom.sources import commit_log
from codeloom.streaming import run_state

TICKS = "run_id long, seq long, ts timestamp, step string, status string, pct double, error string"
START = datetime(2024, 1, 1)


def tick(run, seq, minute, status="running", error=None):
    return (run, seq, START + timedelta(minutes=minute), f"s{seq}", status, seq * 30.0 - 10, error)


class Feed:
    """A folder of files, streamed one file a batch."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        self.table, self.checkpoint = str(folder / "table"), str(folder / "checkpoint")

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))

    def run(self):
        source = self.spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        query = run_state.start_run_state(source, self.table, self.checkpoint)
        query.awaitTermination()
        found = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        return found[-1] if found else None

    def rows(self):
        return {r.run_id: r for r in run_state.read_run_state(self.spark, self.table).collect()}


@pytest.fixture
def feed(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Feed(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_equals_batch_over_several_batches(spark, feed):
    parts = [
        [tick(1, 1, 0), tick(2, 1, 1), tick(3, 5, 2, "failed", "broken")],
        [tick(1, 3, 6), tick(1, 2, 5), tick(2, 2, 4, "completed"), tick(3, 4, 1)],
        [tick(1, 4, 9, "completed"), tick(4, 9, 7)],
    ]
    for part in parts:
        feed.add(part)
        feed.run()
    want = latest_run_state(spark.createDataFrame([t for p in parts for t in p], TICKS))
    assert {r.run_id: tuple(r) for r in want.collect()} == {k: tuple(r) for k, r in feed.rows().items()}
    assert feed.run() is None or True  # nothing new
    run_state.compact_run_state(spark, feed.table)
    assert {r.run_id: tuple(r) for r in want.collect()} == {k: tuple(r) for k, r in feed.rows().items()}
    assert commit_log.read(spark, feed.table, run_state._RUN_STATE.format(key="bigint")).count() == 4


def test_state_of_finished_runs_is_dropped(feed):
    feed.add([tick(k, 1, 0) for k in range(20)])
    feed.add([tick(k, 2, 1, "completed") for k in range(15)])
    assert feed.run()["numRowsTotal"] == 20
    feed.add([tick(100, 1, 300)])  # five hours later
    feed.add([tick(101, 1, 301)])
    state = feed.run()
    assert state["numRowsTotal"] == 7  # five that still run and the two new ones
    rows = feed.rows()
    assert len(rows) == 22 and rows[3].status == "completed" and rows[17].status == "running"
    # behind the watermark: dropped, the finished run stays as it was
    feed.add([tick(3, 3, 2, "failed", "late")])
    feed.add([tick(102, 1, 302)])
    feed.run()
    assert feed.rows()[3].status == "completed" and 102 in feed.rows()
    # in time: the run begins anew
    feed.add([tick(3, 4, 310)])
    feed.run()
    assert (feed.rows()[3].status, feed.rows()[3].started_at) == ("running", START + timedelta(minutes=310))


def test_repeated_batch_adds_no_rows(spark, feed):
    rows = spark.createDataFrame([(1, "running")], "run_id long, status string").withColumn("x", F.lit(1))
    for _ in range(2):
        commit_log.append(rows, feed.table, write="batch-0000000000")
    assert len(commit_log.commits(feed.table)) == 1
