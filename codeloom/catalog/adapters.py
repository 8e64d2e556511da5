"""The driver's tables as inputs of the library.

The tables hold no source code, so Python files are generated from them: one file per
order (a branch and a call per line) and one per part (two functions).  ``source_files``
gives the text, ``function_table`` the facts which parsing that text yields, built
without the parser.  Both rest on the same per-order rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.callgraph import call_edges, with_degrees
from codeloom.operators.tagging import as_set, tag_crud, tag_entities
from codeloom.plans.analyze import Analysis
from codeloom.session import stored

RUNS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(key: str) -> str:
    return f"concat('run-', {key} % {RUNS})"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, lines): the sorted lines of every order, which become one file whatever its size."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k", "l_linenumber AS n", "l_partkey AS p", "l_returnflag AS rf", "l_linestatus AS ls"
    )
    return lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "p", "rf", "ls"))).alias("lines"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generated order file.

    The explicit partitioning keeps the session's number of shuffle partitions: rows are
    small here, but the work on their text is not.  The join by ``k`` uses it as well, so
    it costs no extra shuffle.
    """
    parallelism = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").selectExpr(
        f"{_run('o_custkey')} AS run_id",
        "o_orderkey AS k",
        "CASE o_orderstatus WHEN 'F' THEN 'process' WHEN 'O' THEN 'create' ELSE 'review' END AS verb",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'payment' WHEN '2-HIGH' THEN 'shipment' "
        "WHEN '3-MEDIUM' THEN 'invoice' WHEN '4-NOT SPECIFIED' THEN 'ledger' ELSE 'account' END AS noun",
    )
    spread = orders.repartition(parallelism, "k")
    return spread.join(order_lines(spark, sf_dir), "k", "left").selectExpr(
        "run_id", "k", "verb", "noun", "cast(k AS string) AS tag",
        "coalesce(lines, array()) AS lines",
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per generated part file, also those a scan must reject.

    Spread like the orders: the table is a few MB, so a single task would read, and then
    parse or tag, most of its files.
    """
    parallelism = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "part").repartition(parallelism, "p_partkey").selectExpr(
        f"{_run('p_partkey')} AS run_id",
        "p_partkey AS p",
        "p_size AS size",
        "replace(p_name, ' ', '_') AS alias",
        f"if(p_partkey % {RUNS} = 0, 'tests', 'parts') AS dir",
    )


_CALL = "if(l.ls = 'O', concat('parts.part_', l.p, '.part_', l.p), concat('part_', l.p))"


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(run_id, path, content BINARY), with rejected and broken ones among them."""
    line = f"""concat(
        CASE l.rf WHEN 'N' THEN concat('    if order.f', l.n)
                  WHEN 'A' THEN concat('    for item in order.f', l.n)
                  ELSE concat('    while order.f', l.n) END, ':\\n        ',
        {_CALL}, '(order)\\n',
        if(l.rf = 'R', concat('        ', noun, ' = order\\n'), ''))"""
    orders = order_files(spark, sf_dir).selectExpr(
        "run_id",
        "concat('svc/order_', tag, '.py') AS path",
        f"""encode(concat('import pkg_', k % 7, '\\n\\n\\ndef ', verb, '_order_', tag, '(order):\\n',
            array_join(transform(lines, l -> {line}), ''), '    return order\\n'), 'UTF-8') AS content""",
    )
    parts = part_files(spark, sf_dir).selectExpr(
        "run_id",
        """CASE size WHEN 47 THEN concat(dir, '/part_', p, '.txt')
                     WHEN 48 THEN concat(dir, '/part_', p, '/__init__.py')
                     WHEN 49 THEN concat('venv/', dir, '/part_', p, '.py')
                     ELSE concat(dir, '/part_', p, '.py') END AS path""",
        """encode(CASE WHEN size = 50 THEN 'def broken(:\\n' ELSE concat(
            if(size BETWEEN 41 AND 45, '# pièce\\n', ''),
            'def part_', p, '(x):\\n',
            CASE WHEN size <= 10 THEN '    stock = x\\n'
                 WHEN size <= 20 THEN '    x.update_lead(x)\\n'
                 ELSE concat('    ', alias, '(x)\\n') END,
            '    return x\\n\\n\\ndef ', alias, '(x):\\n    return x\\n') END,
            if(size BETWEEN 41 AND 45, 'ISO-8859-1', 'UTF-8')) AS content""",
    )
    return orders.unionByName(parts)


def function_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``functions`` table of the generated files, built without parsing."""
    orders = order_files(spark, sf_dir).selectExpr(
        "run_id",
        "concat('svc/order_', tag, '.py') AS file_path",
        "1 AS fn_ord",
        "concat('svc.order_', tag, '.', verb, '_order_', tag) AS qname",
        "concat(verb, '_order_', tag) AS short_name",
        "4 AS line_start",
        "5 + 2 * size(lines) + size(filter(lines, l -> l.rf = 'R')) AS line_end",
        "1 + size(lines) AS complexity",
        f"transform(lines, l -> {_CALL}) AS calls",
        """concat(flatten(transform(lines, l -> if(l.rf = 'R',
            array('Order', 'Order', initcap(noun), 'Order'), array('Order', 'Order')))),
            array('Order', 'Order')) AS entity_sequence""",
        "if(verb = 'create', array('create'), cast(array() AS array<string>)) AS crud_ops",
    )
    kept = part_files(spark, sf_dir).where("size NOT IN (47, 49, 50)").selectExpr(
        "*",
        "concat(dir, '/part_', p, if(size = 48, '/__init__.py', '.py')) AS file_path",
        "concat(dir, '.part_', p) AS module",
        "if(size BETWEEN 41 AND 45, 2, 1) AS first",
    )
    own = kept.selectExpr(
        "run_id", "file_path", "1 AS fn_ord", "concat(module, '.part_', p) AS qname",
        "concat('part_', p) AS short_name", "first AS line_start", "first + 2 AS line_end",
        "1 AS complexity",
        """CASE WHEN size <= 10 THEN cast(array() AS array<string>)
                WHEN size <= 20 THEN array('x.update_lead') ELSE array(alias) END AS calls""",
        """CASE WHEN size <= 10 THEN array('stock')
                WHEN size <= 20 THEN array('x.update_lead', 'update_lead')
                ELSE array(alias, alias) END AS idents""",
    )
    other = kept.selectExpr(
        "run_id", "file_path", "2 AS fn_ord", "concat(module, '.', alias) AS qname",
        "alias AS short_name", "first + 5 AS line_start", "first + 6 AS line_end",
        "1 AS complexity", "cast(array() AS array<string>) AS calls", "array(alias) AS idents",
    )
    parts = (
        own.unionByName(other)
        .withColumn("entity_sequence", tag_entities(F.col("idents")))
        .withColumn("crud_ops", tag_crud(F.col("idents")))
        .drop("idents")
    )
    return orders.unionByName(parts).withColumn("entities", as_set(F.col("entity_sequence")))


def record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, record_type) of every fact that parsing the generated files yields."""
    parts = part_files(spark, sf_dir)
    of = lambda rows, kind: rows.select("run_id", F.lit(kind).alias("record_type"))
    orders = table(spark, sf_dir, "orders").selectExpr(f"{_run('o_custkey')} AS run_id")
    records = of(function_table(spark, sf_dir), "function").unionByName(of(parts.where("size = 50"), "error"))
    records = records.unionByName(of(parts.where("size NOT IN (47, 49)"), "file"))
    return records.unionByName(of(orders, "file")).unionByName(of(orders, "import"))


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs(run_id, root_name, name): the runs of the orders, plus one per supplier
    without any file."""
    used = (
        table(spark, sf_dir, "orders").selectExpr(f"{_run('o_custkey')} AS run_id").distinct()
        .selectExpr("run_id", "concat('erp-', run_id) AS root_name")
    )
    empty = table(spark, sf_dir, "supplier").selectExpr(
        "concat('empty-', s_suppkey) AS run_id",
        "concat(CASE s_nationkey % 3 WHEN 0 THEN 'erp' WHEN 1 THEN 'crm' ELSE 'doc' END, '-', s_suppkey) AS root_name",
    )
    return used.unionByName(empty)


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``function_table`` computed once and stored."""
    return stored(function_table(spark, sf_dir))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their degrees, stored."""
    table_ = functions(spark, sf_dir)
    return stored(with_degrees(table_, call_edges(table_)))


def products(spark: SparkSession, sf_dir: str) -> Analysis:
    """Products of the generated corpus on demand; shared tables are stored once."""
    return Analysis(run_table(spark, sf_dir), functions(spark, sf_dir), keep=stored)
