"""Benchmark leaks by spaced seeds.

A seed is a hash of those words of a stretch that a fixed mask marks with 1; the words under 0 may
differ. Seeds of all masks are taken at every position of every benchmark item and every document.
A Bloom filter of fixed size keeps nearly all document seeds that no item has from leaving the scan; the
rest meet the items' seeds in a hash join. Every hit names an alignment of a document with an item.
Each alignment is verified word by word over all its overlap: the best stretch, a match counting 1
and a substitution -2, must hold at least ``least`` matching words.

Words are runs of letters and digits in lower case, so case and punctuation don't hide a leak. Equal
texts are treated once. The filter has ``2 ** BITS`` bits whatever the size of the benchmark: a larger
benchmark lets more seeds through to the join, and no hit is lost.

Nulls: a null text has no words. Items of fewer than ``least`` words have no seeds: so short a
sequence is found by chance. Without items or documents nothing leaks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.samples import aside
from clickgrain.llm.words import LETTERS, U, lists, mix, signed, splitmix, word_hashes, words
from clickgrain.session import park

#: Eight words each. The first finds exact stretches of items too short for the others.
MASKS = ("11111111", "110110100111", "111010011011", "101111001101")
BITS = 23
SHIFTS = (64 - BITS, 20, 0)
LEAST_WORDS = 8
PLACE_CODES = splitmix(23, 64)


def seed_hashes(codes: np.ndarray, number: int) -> np.ndarray:
    """Hashes of mask ``number`` at every position of ``codes``; numbers keep the masks apart."""
    mask = MASKS[number]
    n = codes.size - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, number + 1, U)
    with np.errstate(over="ignore"):
        for place, kept in enumerate(mask):
            if kept == "1":
                total += codes[place : place + n] * PLACE_CODES[place]
    return mix(total)


def inside_one(first: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of ``n`` positions begin a stretch of ``span`` words that one text holds."""
    text = np.repeat(np.arange(first.size - 1), np.diff(first))
    return text[:n] == text[span - 1 : span - 1 + n]


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, codes) of the benchmark: hashes of the words of each item."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), lower=True, inside=LETTERS):
                codes = lists(signed(word_hashes(w)), w.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.rows.start, len(w)), codes], ["item_id", "codes"])

    return items.select("item_id", "text").mapInArrow(part, "item_id long, codes array<long>")


def item_seeds(coded: DataFrame) -> DataFrame:
    """(seed, item_id, place) of all masks at all positions."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, codes in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.asarray(codes.values, np.int64).view(U)
                for number in range(len(MASKS)):
                    seeds = seed_hashes(own, number)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(seeds)), pa.array([item] * seeds.size, pa.int64()), pa.array(np.arange(seeds.size), pa.int32())], ["seed", "item_id", "place"])

    long_enough = coded.filter(F.size("codes") >= LEAST_WORDS)
    return long_enough.mapInArrow(part, "seed long, item_id long, place int")


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Three bits for every seed, by different bits of it, gathered as bytes: at most 2**BITS / 8 rows."""
    places = seeds.select(F.explode(F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND((1 << BITS) - 1) for s in SHIFTS])).alias("place"))
    place = F.col("place")
    rows = places.groupBy(F.shiftright(place, 3).alias("byte")).agg(F.bit_or(F.pow(F.lit(2.0), place % 8).cast("int")).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for byte, bits in rows.collect():
        out[byte] = bits
    return out


def document_hits(texts: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Of (h1, h2, text) the rows with seeds the bitmap may hold: h1, h2, seeds, places, codes."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for w in words(batch.column(2), lower=True, inside=LETTERS):
                codes = word_hashes(w)
                found = []
                for number, mask in enumerate(MASKS):
                    seeds = seed_hashes(codes, number)
                    at = np.arange(seeds.size)
                    for shift in SHIFTS:
                        place = ((seeds[at] >> U(shift)) & U((1 << BITS) - 1)).astype(np.int64)
                        at = at[((table[place >> 3] >> (place & 7).astype(np.uint8)) & 1) > 0]
                    if at.size:
                        at = at[inside_one(w.first, seeds.size, len(mask))[at]]
                        found.append((at, seeds[at]))
                if not found:
                    continue
                at, seeds = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.argsort(at, kind="stable")
                at, seeds = at[order], seeds[order]
                bounds = np.searchsorted(at, w.first)
                rows = np.flatnonzero(np.diff(bounds) > 0)
                first = np.concatenate([[0], np.cumsum(np.diff(bounds)[rows])])
                owner = np.searchsorted(w.first, at, "right") - 1
                own = [codes[w.first[r] : w.first[r + 1]] for r in rows]
                code_first = np.concatenate([[0], np.cumsum([c.size for c in own], dtype=np.int64)])
                taken = pa.array(rows + w.rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        lists(signed(seeds), first),
                        lists((at - w.first[owner]).astype(np.int32), first),
                        lists(signed(np.concatenate([np.zeros(0, U), *own])), code_first),
                    ],
                    ["h1", "h2", "seeds", "places", "codes"],
                )

    return texts.mapInArrow(part, "h1 long, h2 long, seeds array<long>, places array<int>, codes array<long>")


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Begin, end and matches of the stretch with the highest sum of +1 and -2."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    gain = sums - np.minimum.accumulate(sums)
    end = int(gain.argmax())
    begin = int(sums[: end + 1].argmin()) if end else 0
    return begin, end, int(np.count_nonzero(equal[begin:end]))


def overlaps(texts: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Verified overlaps of distinct texts (h1, h2, text) with items: h1, h2, item_id, start, end, matched.

    ``start`` and ``end`` count words of the text. One row per text, item and alignment.
    """
    coded = park(item_words(items.filter(F.col("item_id").isNotNull())), "items")
    seeds = park(item_seeds(coded), "seeds")
    found = park(document_hits(texts, seed_bitmap(seeds)), "hits").dropDuplicates(["h1", "h2"])
    hits = found.select("h1", "h2", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("h1", "h2", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("at"))
    pairs = hits.join(seeds, "seed").select("h1", "h2", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    placed = pairs.join(coded.withColumnRenamed("codes", "item_codes"), "item_id").join(found.select("h1", "h2", "codes"), ["h1", "h2"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            shifts = batch.column(3).to_pylist()
            for row, (item, text) in enumerate(zip(batch.column(4), batch.column(5))):
                a, b, shift = np.asarray(item.values), np.asarray(text.values), shifts[row]
                low, high = max(0, -shift), min(a.size, b.size - shift)
                begin, end, matched = best_stretch(a[low:high] == b[low + shift : high + shift])
                out.append((low + shift + begin, low + shift + end, matched))
            numbers = np.array(out, np.int32).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(numbers[:, i]) for i in range(3)]], ["h1", "h2", "item_id", "start", "end", "matched"])

    checked = placed.select("h1", "h2", "item_id", "shift", "item_codes", "codes")
    return checked.mapInArrow(part, "h1 long, h2 long, item_id long, start int, end int, matched int").filter(F.col("matched") >= least)


def with_text_key(docs: DataFrame) -> DataFrame:
    """``docs`` with h1 and h2, together 128 bits of a hash of the text."""
    return docs.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("second"), "text")})


def find_leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, h1, h2, n_overlaps, n_matched (most words of one overlap), items."""
    keyed = with_text_key(docs.select("doc_id", "text"))
    found = overlaps(keyed.select("h1", "h2", "text"), items, least)
    found = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_overlaps"), F.max("matched").alias("n_matched"), F.sort_array(F.collect_set("item_id")).alias("items"))
    joined = keyed.select("doc_id", "h1", "h2").join(park(found, "leaks"), ["h1", "h2"], "left")
    return joined.withColumns({"n_overlaps": F.coalesce("n_overlaps", F.lit(0)), "n_matched": F.coalesce("n_matched", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<bigint>"))})


def clean_documents(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` that share no overlap with an item."""
    keyed = with_text_key(docs.select("text"))
    leaked = park(overlaps(keyed.select("h1", "h2", "text"), items, least).select("h1", "h2").distinct(), "leaks")
    rows = aside(docs, h1=F.xxhash64("text"), h2=F.xxhash64(F.lit("second"), "text"))
    return rows.join(leaked, ["h1", "h2"], "left_anti").select("kept_row.*")
