"""Phrases of words that stand together more often than their parts suggest, per language.

A text is cut at punctuation and line ends into pieces, a piece into words. Every word starts one
window: itself and the ``order - 1`` words that lead it, padded with nulls at the end of the piece.
Only these longest windows are counted. A window's first words are a shorter phrase, so ROLLUP over
the counted windows sums all shorter phrases, down to the number of words of the language: no
occurrence is emitted more than once, whatever the order.

Most longest windows occur once, and they alone would be a multiple of the texts. So phrases are
counted by 64-bit hashes first, size by size, a phrase only where its beginning and its end reach
``at_least``; the hashes that do make a Bloom filter (8 MB at most). A window ends where its words are no
phrase that the filter holds: no candidate begins with them, and the words before are counted all the
same. Hits that are false only leave a window longer, so the counts of all phrases with ``at_least``
occurrences are exact, as are those of words. Beyond four million frequent phrases the filter cuts
fewer windows and more is shuffled.

A phrase's score is that of its weakest cut in two: ``floor(10**6 * a * a / (l * r))`` for the counts
of the phrase and the two parts, in decimals of 38 digits (exact below 10**16 occurrences).

What is shuffled is counted before, so a phrase that makes up a third of all words is one row a task.
All counts are over all rows.

Nulls: a null text has no words, a null language is ``und``. Empty texts and tables give no rows.
Repeated rows count as often as they are there. Ties in score go by count, then by the bytes of the
phrase, so no two phrases share a rank. Texts are read in blocks of a megabyte or the longest text.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickgrain.llm.urlrules import _bits, build_filter
from clickgrain.llm.words import Words, signed, window_hashes, word_hashes, words
from clickgrain.session import park

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False
CHUNK = 1 << 20
PARTS = 32


class Phrases:
    """Hashes of the phrases that begin at each word, and which sizes stay within the word's piece."""

    def __init__(self, w: Words):
        ends = np.flatnonzero(ENDS[w.data])
        self.codes, self.near = word_hashes(w), np.zeros(w.starts.size, bool)
        self.near[:-1] = np.searchsorted(ends, w.ends[:-1]) == np.searchsorted(ends, w.starts[1:])
        self.near[w.first[1:][w.first[1:] > w.first[:-1]] - 1] = False

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        fits, hashes = self.near.copy(), np.zeros(self.near.size, np.uint64)
        for i in range(1, size - 1):
            fits &= _ahead(self.near, i)
        found = window_hashes(self.codes, size)
        hashes[: found.size] = found
        return fits, hashes

    def held(self, size: int, filled: np.ndarray) -> np.ndarray:
        """Whether the phrase of ``size`` words at each word may be in the filter."""
        fits, hashes = self.of(size)
        place, masks = _bits(hashes, filled.shape[0])
        return fits & ((filled[place] & masks) == masks).all(axis=1)


def _ahead(flags: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([flags[by:], np.zeros(min(by, flags.size), bool)])


def frequent_phrases(docs: DataFrame, order: int, at_least: int) -> np.ndarray:
    """The filter of the hashes of phrases of 2 to ``order`` words that occur ``at_least`` times in ``docs`` (text)."""
    rows, held, filled = docs.select("text"), None, None
    for size in range(2, order + 1):
        counted = rows.mapInArrow(_counter(docs, size, filled), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        found = park(counted.filter(F.col("n") >= at_least).select("hash"), "frequent")
        held = found if held is None else held.unionByName(found)
        filled = build_filter(held, "hash")
    return filled


def _counter(docs: DataFrame, size: int, filled: np.ndarray | None):
    """Counts the hashes of phrases of one size; with a filter, of those whose two shorter ones it may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, waits = [], 0

        def out() -> pa.RecordBatch:
            each, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(each)), pa.array(counts)], ["hash", "n"])

        for batch in batches:
            for w in words(batch.column(0), lower=True, inside=INSIDE):
                if w.starts.size:
                    phrases = Phrases(w)
                    fits, hashes = phrases.of(size)
                    if sent.value is not None:
                        shorter = phrases.held(size - 1, sent.value)
                        fits &= shorter & _ahead(shorter, 1)
                    waiting.append(hashes[fits])
                    waits += waiting[-1].size
                if waits >= CHUNK:
                    yield out()
                    waiting, waits = [], 0
        if waits:
            yield out()

    return count


def windows(docs: DataFrame, order: int, frequent: np.ndarray) -> DataFrame:
    """(lang, w1 ... w<order>, n): the windows at every word, equal ones of a block together."""
    names = _columns(order)
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(langs: pa.Array, w: Words) -> pa.Table:
        phrases = Phrases(w)
        lengths = np.concatenate([[0], np.cumsum(w.ends - w.starts)]).astype(np.int32)
        # All bytes inside words, one after the other, are the words one after the other.
        spelled = pa.StringArray.from_buffers(w.starts.size, pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(w.data[INSIDE[w.data]])))
        at, within = np.arange(w.starts.size), np.ones(w.starts.size, bool)
        owner = np.repeat(np.arange(len(w)), np.diff(w.first))
        columns = [langs.take(pa.array(owner)), spelled]
        for i in range(1, order):
            within = within & phrases.held(i + 1, sent.value)
            columns.append(spelled.take(pa.array(np.where(within, at + i, 0), mask=~within)))
        return pa.table(columns, names=["lang", *names])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), lower=True, inside=INSIDE):
                if w.starts.size:
                    counted = cut(batch.column(0).slice(w.rows.start, len(w)), w).group_by(["lang", *names], use_threads=False).aggregate([([], "count_all")])
                    yield from counted.select(["lang", *names, "count_all"]).combine_chunks().to_batches()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(part, "lang string, " + ", ".join(f"{c} string" for c in names) + ", n long")


def _columns(order: int) -> list[str]:
    return [f"w{i}" for i in range(1, order + 1)]


def phrase_counts(docs: DataFrame, order: int = 3, at_least: int = 10) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of up to ``order`` words that occur ``at_least`` times.

    ``size`` 0 is the number of words of the language, whatever ``at_least`` says.
    """
    names = _columns(order)
    counted = windows(docs, order, frequent_phrases(docs, order, at_least)).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    # The condition is on the sum, so it stays behind the aggregate, whose shuffle serves both branches.
    often = F.when(F.col(names[-1]).isNotNull(), F.col("n")) >= at_least
    whole = counted.filter(often).select("lang", F.lit(order).alias("size"), F.array(*names).alias("words"), "n")
    # Grouping sets from (lang, w1 ...) down to (): the bits of the id tell how many columns were summed over.
    shorter = counted.rollup("lang", *names[:-1]).agg(F.sum("n").alias("n"), F.grouping_id().alias("summed"))
    size = F.lit(order - 1) - F.bit_count(F.col("summed"))
    shorter = shorter.select("lang", size.cast("int").alias("size"), F.array(*names[:-1]).alias("words"), "n").filter("size >= 0")
    # A prefix that reaches beyond its window is no phrase of its size.
    within = shorter.filter("size = 0 OR words[size - 1] IS NOT NULL")
    both = whole.unionByName(within.withColumn("words", F.slice("words", 1, F.col("size"))))
    return both.filter((F.col("size") == 0) | (F.col("n") >= at_least)).select("lang", "size", F.array_join("words", " ").alias("phrase"), "n")


def _score(a: Column, left: Column, right: Column) -> Column:
    million, a, left, right = F.lit(1_000_000).cast("decimal(38,0)"), a.cast("decimal(16,0)"), left.cast("decimal(16,0)"), right.cast("decimal(16,0)")
    return F.call_function("div", million * a * a, left * right)


def collocations(docs: DataFrame, order: int = 3, at_least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``order`` words per language: lang, rank, phrase, a, l, r, n, score.

    ``at_least`` occurrences make a candidate. One is left out where a longer candidate contains it and
    occurs in ``covered`` per cent of its occurrences or more.
    """
    counts = park(phrase_counts(docs, order, at_least), "phrases")
    phrases = counts.filter("size > 0").select("lang", "phrase", "n")
    candidates = counts.filter("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words"))

    def part(begin: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", begin, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    first, rest = (phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(n)) for side, n in (("first", "l"), ("rest", "r")))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    inner = [
        candidates.filter(F.col("size") > size).select("lang", "a", "words", F.lit(size).alias("part"), F.explode(F.sequence(F.lit(1), F.col("size") - size + 1)).alias("begin"))
        for size in range(2, order)
    ]
    if inner:
        held = reduce(DataFrame.unionByName, inner).groupBy("lang", part(F.col("begin"), F.col("part")).alias("phrase")).agg(F.max("a").alias("longer"))
        weakest = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    totals = counts.filter("size = 0").select("lang", F.col("n").alias("n"))

    def ranked_by(*keys: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))

    # First the best of each of PARTS parts of a language, so that the last sort has PARTS * top rows of it.
    best = weakest.withColumn("place", ranked_by(F.col("lang"), F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", ranked_by(F.col("lang")).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Three words, ten occurrences, the first 2,000 of each language.
SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents WHERE text IS NOT NULL)),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS MATERIALIZED (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS n
  FROM spots, (VALUES (1), (2), (3)) sizes(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws FROM grams WHERE m > 1 AND n >= 10),
split AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
cuts AS (
  SELECT s.lang, s.phrase, s.a, k, f.n AS l, r.n AS r, CAST((CAST(1000000 AS HUGEINT) * s.a * s.a) // (CAST(f.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM split s JOIN grams f ON f.lang = s.lang AND f.phrase = s.first JOIN grams r ON r.lang = s.lang AND r.phrase = s.rest),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT lang, array_to_string(ws[b:b + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS b FROM cand WHERE m = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN held h ON w.lang = h.lang AND w.phrase = h.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * w.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, t.n AS n, score
FROM kept k JOIN totals t ON k.lang = t.lang QUALIFY rank <= 2000
"""
