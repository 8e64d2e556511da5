"""Scanning, storing and the streaming forms."""

import pytest
from pyspark.sql import functions as F

from codeloom.sources import artifacts, commit_log
from codeloom.sources.files import (
    decoded,
    list_sources,
    new_sources,
    read_sources,
    scan_sources,
    select_sources,
)


@pytest.fixture()
def tree(tmp_path):
    base = tmp_path / "build" / "repo"  # an ignored name above the root does not matter
    for name, data in {
        "a.py": b"x = 1\n",
        "pkg/__init__.py": b"",
        "pkg/latin.py": "# caf\u00e9\n".encode("latin-1"),
        "pkg/utf.py": "# caf\u00e9\n".encode(),
        "venv/lib.py": b"",
        "pkg/node_modules/x.py": b"",
        "notes.txt": b"",
        "build.py": b"",
    }.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return base


def test_scan(spark, tree):
    rows = scan_sources(spark, {"r": str(tree), "sub": str(tree / "pkg")}).select("run_id", "path").collect()
    assert {(r.run_id, r.path) for r in rows} == {
        ("r", "a.py"), ("r", "build.py"), ("r", "pkg/__init__.py"), ("r", "pkg/latin.py"), ("r", "pkg/utf.py"),
        ("sub", "__init__.py"), ("sub", "latin.py"), ("sub", "utf.py"),
    }
    text = {r.path: r.text for r in decoded(scan_sources(spark, {"r": str(tree)})).collect()}
    assert text["pkg/latin.py"] == text["pkg/utf.py"] == "# caf\u00e9\n"
    modules = {r.path: r.module for r in decoded(scan_sources(spark, {"r": str(tree / "pkg")})).collect()}
    assert modules["__init__.py"] == ""


def test_cap_keeps_the_first_paths(spark, tree):
    kept = [r.path for r in scan_sources(spark, {"r": str(tree)}, max_files=2).collect()]
    assert sorted(kept) == ["a.py", "build.py"]


def test_cap_ranks_a_hot_run_in_salted_groups(spark):
    files = spark.range(3000).selectExpr(
        "if(id % 3 = 0, concat('r', id % 2), 'hot') AS run_id", "concat(lpad(id, 5, '0'), '.py') AS path"
    )
    kept = select_sources(files, 1000)
    counts = {r.run_id: (r["n"], r["last"]) for r in kept.groupBy("run_id").agg(
        F.count("*").alias("n"), F.max("path").alias("last")).collect()}
    assert counts == {"hot": (1000, "01499.py"), "r0": (500, "02994.py"), "r1": (500, "02997.py")}
    assert "salt" in kept._jdf.queryExecution().optimizedPlan().toString()


def test_latest_wins_on_read(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    first = spark.createDataFrame([("r", "n1", "old"), ("r", "n2", "keep")], "run_id string, node_id string, payload string")
    artifacts.write_artifacts(first, "evidence", path)
    artifacts.write_artifacts(first.where("node_id = 'n1'").withColumn("payload", F.lit("new")), "evidence", path)
    artifacts.write_artifacts(spark.createDataFrame([("r", "{}")], "run_id string, payload string"), "risk", path)
    found = {(r.kind, r.node_id): r.payload for r in artifacts.read_artifacts(spark, path).collect()}
    assert found == {("evidence", "n1"): "new", ("evidence", "n2"): "keep", ("risk", ""): "{}"}
    keys = spark.createDataFrame([("r", "evidence", "n1"), ("r", "evidence", "zz")], "run_id string, kind string, node_id string")
    rows = artifacts.lookup_artifacts(keys, artifacts.stored_artifacts(spark, path), commit_log.ORDER).collect()
    assert [r.payload for r in rows] == ["new"]
    with pytest.raises(ValueError):
        artifacts.as_artifacts(first, "other")


def test_second_scan_reads_only_what_changed(spark, tmp_path):
    root = tmp_path / "src"
    (root / "_vendor").mkdir(parents=True)
    (root / "a.py").write_text("def first(order):\n    pass\n")
    (root / "_vendor" / "__main__.py").write_text("x = 1\n")
    roots = spark.createDataFrame([("r", str(root))], "run_id string, root string")
    before = list_sources(spark, roots).persist()
    assert {r.path for r in before.collect()} == {"a.py", "_vendor/__main__.py"}
    (root / "b.py").write_text("")
    (root / "a.py").write_text("def first(order, more):\n    pass\n")
    changed = new_sources(list_sources(spark, roots), before)
    rows = {r.path: bytes(r.content) for r in read_sources(spark, changed).collect()}
    assert set(rows) == {"a.py", "b.py"} and rows["b.py"] == b""


def test_linked_directory_is_not_entered(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("def f(): pass\n")
    (tmp_path / "pkg" / "loop").symlink_to(tmp_path / "pkg")
    roots = spark.createDataFrame([("r", tmp_path.as_uri())], "run_id string, root string")
    assert [r["path"] for r in list_sources(spark, roots).collect()] == ["pkg/a.py"]


def test_last_row_of_one_write_wins(spark, tmp_path):
    rows = spark.createDataFrame([("r", f"p{n}") for n in range(8)], "run_id string, payload string").repartitionByRange(4, "payload")
    artifacts.write_artifacts(rows, "risk", str(tmp_path / "a"))
    assert artifacts.read_artifacts(spark, str(tmp_path / "a")).first()["payload"] == "p7"


def _payloads(spark, text, n=3):
    return spark.createDataFrame([(f"r{k}", text) for k in range(n)], "run_id string, payload string")


def test_failed_and_running_writes_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "a")
    assert artifacts.read_artifacts(spark, path).collect() == []
    artifacts.write_artifacts(_payloads(spark, "first"), "risk", path)
    broken = _payloads(spark, "broken").withColumn("payload", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        artifacts.write_artifacts(broken, "risk", path)
    running = artifacts.as_artifacts(_payloads(spark, "running"), "risk")
    running.write.partitionBy("kind").parquet(f"{path}/data/other")  # no commit yet
    assert {r.payload for r in artifacts.read_artifacts(spark, path).collect()} == {"first"}


def test_two_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "a")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: artifacts.write_artifacts(_payloads(spark, f"w{k}", 50), "risk", path), range(4)))
    rows = artifacts.read_artifacts(spark, path).collect()
    assert len(rows) == 50 and len({r.payload for r in rows}) == 1  # one of the writes is the last, for all rows
    assert len(commit_log.commits(path)) == 4
    artifacts.write_artifacts(_payloads(spark, "after", 1), "risk", path)
    assert {r.run_id: r.payload for r in artifacts.read_artifacts(spark, path).collect()}["r0"] == "after"


def test_compaction_keeps_what_is_written_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    for text in ("old", "new"):
        artifacts.write_artifacts(_payloads(spark, text), "risk", path)
    artifacts.write_artifacts(_payloads(spark, "other", 1), "evidence", path)
    publish = commit_log._commit

    def late(*args):  # a write is committed while the compaction runs
        monkeypatch.setattr(commit_log, "_commit", publish)
        artifacts.write_artifacts(_payloads(spark, "newest", 1), "risk", path)
        publish(*args)

    monkeypatch.setattr(commit_log, "_commit", late)
    artifacts.compact_artifacts(spark, path)
    want = {("r0", "risk"): "newest", ("r1", "risk"): "new", ("r2", "risk"): "new", ("r0", "evidence"): "other"}
    assert {(r.run_id, r.kind): r.payload for r in artifacts.read_artifacts(spark, path).collect()} == want
    assert len(commit_log.vacuum(path)) == 3
    assert {(r.run_id, r.kind): r.payload for r in artifacts.read_artifacts(spark, path).collect()} == want
    assert "old" not in {r.payload for r in artifacts.stored_artifacts(spark, path).collect()}
    artifacts.compact_artifacts(spark, path)
    assert artifacts.stored_artifacts(spark, path).count() == 4


def test_named_write_counts_once(spark, tmp_path):
    path = str(tmp_path / "a")
    for _ in range(2):
        commit_log.append(_payloads(spark, "x"), path, write="batch-1")
    assert commit_log.read(spark, path, "run_id string, payload string").count() == 3
