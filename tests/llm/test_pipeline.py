"""The corpus pipeline on the smallest tables, stage by stage against plain Python."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from codeloom.llm import contamination, simhash
from codeloom.llm.registry import QUERIES, table
from codeloom.session import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = [docs.count()]
    frame = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept.append(frame.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert frame.groupBy("text").count().where("count > 1 and length(text) > 0").isEmpty()
    assert contamination.overlaps(frame, table(spark, SF, "benchmark")).isEmpty()
    packed = pipeline.STAGES[-1][1](spark, frame, SF)
    assert packed.select("doc_id").distinct().count() == frame.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").isEmpty()


def test_empty_documents(spark, tmp_path):
    frame = table(spark, SF, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.isEmpty()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_dedup_of_null_and_repeated_ids(spark):
    """Different texts stay whatever their ids; a copy goes even where its id is null."""
    def own(tag):
        return " ".join(f"{tag}{n}" for n in range(30))
    rows = [(None, own("a")), (None, own("b")), (None, own("c")), (None, own("c")), (7, own("d")), (7, own("e")), (7, own("e")),
            (3, own("f")), (None, own("f")), (9, own("g")), (8, own("g")), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    kept = sorted(str((r["doc_id"], r["text"])) for r in got.collect())
    want = [(None, own("a")), (None, own("b")), (None, own("c")), (7, own("d")), (7, own("e")), (3, own("f")), (8, own("g"))]
    assert [k for k in kept if k not in ("(None, None)", "(None, '')")] == sorted(map(str, want)) and len(kept) == len(want) + 1


def test_near_dedup_against_brute_force(spark):
    """The smallest id of every component of fingerprints that differ in two bits at most."""
    docs = table(spark, SF, "documents")
    prints = [(r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash.fingerprints(docs).collect()]
    root = {k: k for k, _ in prints}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for n, (a, x) in enumerate(prints):
        for b, y in prints[:n]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = pipeline.near_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(k for k in root if find(k) == k)


def test_contaminated_rows_share_ids_with_clean_ones(spark):
    item = table(spark, SF, "benchmark").where("length(text) > 100").first()["text"]
    own = " ".join(f"w{n}" for n in range(60))
    rows = [(None, item), (None, own), (7, "x " + item), (7, own + " y"), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, found string")
    got = pipeline.decontamination(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"], r["found"])) for r in got.collect()) == sorted(str((i, t, "kept")) for i, t in (rows[1], rows[3], rows[4], rows[5]))


def test_stages_return_columns_with_clashing_names(spark):
    names = ["lang_pred", "score", "first", "repeated", "text_key", "found", "found_id", "_text", "_found", "_values", "_marked", "_again", "pii_kinds", "name", "fp", "id", "sha"]
    docs = table(spark, SF, "documents").where("doc_id < 40").select("*", *[F.lit(n).alias(n) for n in names])
    for name, stage in pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns[-len(names):] == names, name
        assert docs.select(*names).distinct().collect() == [tuple(names)], name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
