"""The operators as queries over the test tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgrain.llm import decontaminate, kdsearch, language, linededup, mixing, ngramjoin, phrases, secrets, sharding, substrings, toxicity, urlrules, vectorcodes
from clickgrain.llm.samples import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The query over pages and its SQL. Apart, as the ones above give a row a document.
PAGE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PAGE_ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, sql: str | None = None):
    def add(run):
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


@query("op1_mixing", mixing.SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five, two and one parts of the sources in turn, 150 % of all words in total."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules; where none fits, the URLs of hosts with a bad label anywhere, listed from that label on."""
    pages = table(spark, sf_dir, "pages")
    listed = urlrules.hosts_below_label(pages, urlrules.BAD_LABELS)
    judged = urlrules.filter_pages(pages, urlrules.rule_table(spark, urlrules.RULES), listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


PAGE_QUERIES["op3_url_filter"] = op3_url_filter
PAGE_ORACLES["op3_url_filter"] = urlrules.SQL


@query("op5_kd_sharding")
def op5_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    shards = sharding.shard_table(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels of the folds 1 to 4 of 5, scores every document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    folded = docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return toxicity.score(folded, model, ("doc_id", "held_out"))


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain patterns and values that are dear to guess."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(secrets.of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = secrets.spelled(secrets.of_kind(F.col("spans"), "assign", "access", "hex"))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the folds 0 and 2 of 3, predicts every document."""
    docs = table(spark, sf_dir, "documents")
    net = language.train(docs, fold(F.col("doc_id"), 3) != 1)
    folded = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return language.predict(folded, net, ("doc_id", "held_out"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they overlap with."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.col("n_overlaps") > 0).alias("leaked"), "n_overlaps", "n_matched", "items")


@query("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under repeated windows of 35 words."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of 85 % or more of the four-word shingles."""
    return ngramjoin.link_documents(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


@query("op4_kd_search", kdsearch.SQL)
def op4_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of all vectors for every hundredth."""
    vectors = kdsearch.integer_vectors(table(spark, sf_dir, "embeddings"))
    return kdsearch.top_k(vectors, F.col("vec_id") % 100 == 0, 10)


@query("op11_line_dedup", linededup.SQL)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more, kept in their first document."""
    rows = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op12_vector_codes", vectorcodes.SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight parts, 16 entries each, six rounds."""
    coded = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    rows = vectorcodes.with_label_errors(coded.rows)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


@query("op13_phrases", phrases.SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three words, ten occurrences, the first 2,000 of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))
