"""Every operator and pipeline stage on nulls, repeats, clashing names, very long texts and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickgrain.llm.catalog import QUERIES

EXTRA = ("score", "key", "kept_row", "h1", "name", "shard", "size", "spans", "root", "times")


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    """Tables with odd rows: 'odd' and 'none'."""
    at = tmp_path_factory.mktemp("edges")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = "lorem ipsum dolor sit amet " * 30_000
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (90001, None, "en", "src1", 0), (90002, "", None, None, 0), (90003, long, "en", None, len(long)), (None, "one two", "de", "src2", 7), (90004, " \n\t", "xx", "src0", 3)],
        docs.select("doc_id", "text", "lang", "source", "n_chars").schema,
    )
    few = docs.limit(60)
    both = few.unionByName(odd).unionByName(odd).unionByName(few.limit(5))
    both = both.select("*", *[F.lit(1).alias(c) for c in EXTRA])
    for name, keep in (("odd", True), ("none", False)):
        for table in ("labels", "benchmark", "pages", "embeddings"):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if keep:
                key = rows.columns[0]
                rows = rows.unionByName(rows.limit(1).select(*[F.lit(None).cast(t).alias(c) if c != key else F.col(c) for c, t in rows.dtypes]))
                rows = rows.unionByName(rows.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))
            (rows if keep else rows.limit(0)).write.parquet(f"{at}/{name}/{table}.parquet")
        (both if keep else both.limit(0)).write.parquet(f"{at}/{name}/documents.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folder, name):
    rows = QUERIES[name](spark, f"{folder}/odd").collect()
    if name == "op3_url_filter":
        assert len(rows) == spark.read.parquet(f"{folder}/odd/pages.parquet").count()
    elif name == "op12_vector_codes":
        assert len(rows) == spark.read.parquet(f"{folder}/odd/embeddings.parquet").filter("embedding IS NOT NULL").count()
    elif name == "op13_phrases":
        assert {r.lang for r in rows} >= {"en"}
    elif name != "op4_kd_search":
        assert len(rows) == spark.read.parquet(f"{folder}/odd/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, folder, name):
    assert QUERIES[name](spark, f"{folder}/none").collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, folder, stage):
    _, run = corpus_pipeline.STAGES[stage]
    for name in ("odd", "none"):
        docs = spark.read.parquet(f"{folder}/{name}/documents.parquet")
        made = run(spark, docs, f"{folder}/{name}")
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns
        rows = made.collect()
        assert bool(rows) == (name == "odd")


def test_pipeline_decides(spark, sf_dir):
    """On the small tables: toxic, near duplicate and leaked documents go, nothing else does before the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, run in corpus_pipeline.STAGES[:3]:
        docs = spark.createDataFrame(run(spark, docs, sf_dir).collect(), docs.schema)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] > kept[1] > kept[2] > kept[3]
    assert len(kept[3]) > 0.6 * len(kept[0])
    leaked = {r.doc_id for r in QUERIES["op7_decontamination"](spark, sf_dir).filter("leaked").collect()}
    assert not leaked & kept[3] and kept[2] - kept[3] <= leaked
