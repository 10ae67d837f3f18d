"""Removal of lines that other documents hold too, all but the first occurrence.

A line's key is the line without white space at its ends and with A-Z in lower case; keys of fewer
than ``least`` characters are left alone. Two Bloom filters find the keys worth a look. The tasks of
the first scan emit 64-bit hashes, each once per million lines of a task, and deal them by hash; the
task that gets a hash holds a *once-seen* filter of its share, and a hash that this filter holds
already goes into the *twice-seen* filter, which is broadcast (8 MB at most, see ``urlrules``). In a
second scan only lines that the twice-seen filter holds leave their task: they are counted by their
whole key, which removes false positives and finds the smallest document of each, and only documents
that lose a line have their text shuffled.

A once-seen filter grows by 8 MB for every four million hashes of a task. Beyond four million repeated
keys the twice-seen filter lets more lines through; the exact step settles them all the same, combined
before its shuffle. Keys held by very many documents are dealt over several tasks where they meet
their first document.

Rows with one doc_id are one document: a line that only they hold stays. A null doc_id is a document
that comes last. A null or empty text is one empty line. Repeated rows have the same result; without
rows it is empty. Texts are split whole, and the lines of one text are the most that a list here holds.
Other columns, whatever their names, are not read. Within one text lines are told by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.hotkeys import attach
from clickgrain.llm.urlrules import BLOCK_WORDS, KEYS_PER_BLOCK, MOST_BLOCKS, _bits, build_filter, lower_ascii, may_hold
from clickgrain.llm.words import U, signed
from clickgrain.session import park

LEAST = 10
CHUNK = 1 << 20
#: White space that is stripped. Fixed values.
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def long_keys(text: Column, least: int) -> Column:
    """The keys of a text that have ``least`` characters."""
    return F.filter(F.transform(lines_of(text), key_of), lambda k: F.length(k) >= least)


class OnceSeen:
    """Blocked Bloom filter of the hashes seen so far: another one is begun where one is full."""

    def __init__(self):
        self.filters: list[np.ndarray] = []
        self.room = 0

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the distinct ``hashes`` may have come before; all of them are held afterwards."""
        place, masks = _bits(hashes, MOST_BLOCKS)
        found = np.zeros(hashes.size, bool)
        for held in self.filters:
            found |= ((held[place] & masks) == masks).all(axis=1)
        fresh = np.flatnonzero(~found)
        if fresh.size > self.room:
            self.filters.append(np.zeros((MOST_BLOCKS, BLOCK_WORDS), U))
            self.room = MOST_BLOCKS * KEYS_PER_BLOCK
        np.bitwise_or.at(self.filters[-1] if self.filters else np.zeros((MOST_BLOCKS, BLOCK_WORDS), U), place[fresh], masks[fresh])
        self.room -= fresh.size
        return found


def _each_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of about CHUNK lines with whether they came more than once."""
    waiting, size = [], 0

    def out() -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts > 1)], ["hash", "again"])

    for batch in batches:
        waiting.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        size += waiting[-1].size
        if size >= CHUNK:
            yield out()
            waiting, size = [], 0
    if size:
        yield out()


def _twice_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = OnceSeen()
    for batch in batches:
        if not batch.num_rows:
            continue
        hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        again = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        each, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        marked = np.bincount(back, weights=again, minlength=each.size) > 0
        twice = once.seen(each.view(U)) | marked | (counts > 1)
        yield pa.RecordBatch.from_arrays([pa.array(signed(each[twice].view(U)))], ["hash"])


def twice_seen(docs: DataFrame, least: int = LEAST) -> np.ndarray:
    """The filter of the hashes of all keys that stand in two rows of ``docs`` (text) or more."""
    hashes = docs.select(F.array_distinct(F.transform(long_keys(F.col("text"), least), lambda k: F.xxhash64(k))).alias("hashes"))
    dealt = hashes.mapInArrow(_each_once, "hash long, again boolean").repartition("hash")
    return build_filter(park(dealt.mapInArrow(_twice_seen, "hash long"), "twice"), "hash")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, hash): the lines that go, by document, hash of its text and hash of the key."""
    spark = docs.sparkSession
    # Taken from the text before the explode, which would take it along and hash it for every line.
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), long_keys(F.col("text"), least).alias("keys"))
    # Outer, as Spark would test the others for empty lists first and make all keys twice for it.
    each = texts.select("doc_id", "text_hash", F.explode_outer("keys").alias("key")).filter("key IS NOT NULL").withColumn("hash", F.xxhash64("key"))
    suspects = park(each.filter(may_hold(spark, twice_seen(docs, least), F.col("hash"))), "suspects")
    held = suspects.groupBy("hash", "key").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named")
    )
    # In two documents: two ids, or an id and the document without one.
    shared = park(held.filter("first < last OR named < n AND named > 0").select("hash", "key", "first", "n"), "shared")
    met = attach(suspects, shared, ["hash", "key"], "n")
    return met.filter("first IS NOT NULL AND (doc_id IS NULL OR doc_id > first)").select("doc_id", "text_hash", "hash")


def _stays(hashes: Column, gone: Column) -> Column:
    """Array of booleans: which hashes are not among the gone ones, in linear time."""

    @F.pandas_udf("array<boolean>")
    def test(own: pd.Series, out: pd.Series) -> pd.Series:
        return pd.Series([~np.isin(np.asarray(h, np.int64), np.asarray(g, np.int64)) for h, g in zip(own, out)], dtype=object)

    return test(hashes, gone)


def drop_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped and text, the lines that stay."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    gone = repeated_lines(docs, least).groupBy("doc_id", "text_hash").agg(F.collect_set("hash").alias("gone"))
    gone = park(gone.withColumn("row_hash", F.xxhash64("doc_id", "text_hash")), "gone")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    touched = may_hold(spark, build_filter(gone, "row_hash"), F.xxhash64("doc_id", "text_hash"))
    marked = rows.withColumn("touched", touched)
    whole = marked.filter("NOT touched").select("doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"))
    side = gone.select(F.col("doc_id").alias("g_doc"), F.col("text_hash").alias("g_hash"), "gone")
    cut = marked.filter("touched").join(side, (F.col("text_hash") == F.col("g_hash")) & F.col("doc_id").eqNullSafe(F.col("g_doc")), "left")
    cut = cut.select("doc_id", lines_of(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<long>")).alias("gone"))
    keys = F.transform("lines", key_of)
    cut = cut.withColumn("stays", _stays(F.transform(keys, lambda k: F.xxhash64(k)), F.col("gone")))
    # A short key never goes, whatever its hash.
    zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("stays").alias("stay"))
    kept = F.transform(F.filter(zipped, lambda x: x["stay"] | (F.length(key_of(x["line"])) < least)), lambda x: x["line"])
    cut = cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    cut = cut.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
    return whole.unionByName(cut)


SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, rid, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id > s.first AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
