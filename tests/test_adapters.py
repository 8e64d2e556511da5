"""The generated files parse to exactly the facts of the generated table."""

import os
from collections import Counter

import pytest

from codeloom.catalog import adapters
from codeloom.operators.tagging import tag_functions
from codeloom.sources.extract import extract_facts, extract_functions
from codeloom.sources.files import decoded, select_sources

SF = "/root/testdata/sf0.001"


@pytest.fixture
def heavy_order(spark, tmp_path):
    """The tables of ``SF`` with 1,000 more lines in one order."""
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    more = lines.limit(1000).withColumn("l_orderkey", lines.l_orderkey * 0 + 1).cache()
    lines.union(more).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_parser_agrees_with_table(spark, heavy_order):
    files = select_sources(adapters.source_files(spark, heavy_order), None)
    parsed = tag_functions(extract_functions(extract_facts(decoded(files)))).persist()
    table = adapters.function_table(spark, heavy_order).select(*parsed.columns).persist()
    assert parsed.count() == table.count() > 1500
    assert parsed.exceptAll(table).count() == 0
    assert table.exceptAll(parsed).count() == 0
    assert parsed.where("file_path rlike 'order_1[.]py' AND size(calls) > 200").count() == 1


def test_part_files_are_spread_over_tasks(spark, tmp_path):
    """A small table is one split, but the files made from it are work for many tasks."""
    rows = [(k, k % 50 + 1, f"name {k}") for k in range(1, 401)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = adapters.part_files(spark, str(tmp_path)).selectExpr("p", "spark_partition_id() AS at").collect()
    assert sorted(r.p for r in found) == [k for k, _, _ in rows]
    most = max(Counter(r.at for r in found).values())
    assert len({r.at for r in found}) > 1 and most < len(rows)
