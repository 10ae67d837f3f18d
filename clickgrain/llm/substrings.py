"""Removal of long repeated word sequences by compaction of a de Bruijn graph.

A window of ``window`` words is repeated when the same words also start elsewhere, in another text
or in the same one. Every word under a repeated window goes.

Nodes of the graph are anchors: of the k-mers (``K`` words) in a window the one with the smallest
hash. Equal windows have equal anchors, and only one k-mer in about fourteen is an anchor, so this
is a fraction of all windows. Edges join consecutive anchors of a text and are named by the words
from the first to the second. Spark counts nodes and edges. Where a node, its edge and the next node
have the same count, every occurrence goes on along that edge: the path does not branch. Such edges
in a row are one path, and all windows inside it are repeated as a whole, without being looked at.
Only the other windows over a repeated anchor (at branches and ends of paths) are edges of their own:
they are counted by 128 bits of their words, with their text and place, and joined back to it.

Equal texts are one text with a number of copies; with two or more all their windows are repeated.
Texts without a repeated anchor are settled in the first scan and never shuffled.

Nulls: a null text has no words. Rows repeated exactly are copies of one text. Without rows the
result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.decontaminate import inside_one, with_text_key
from clickgrain.llm.urlrules import build_filter, may_hold
from clickgrain.llm.words import Words, lists, sequence_hash, sequence_sums, signed, window_hashes, word_hashes, words
from clickgrain.session import park

K = 8
NOTHING = hashlib.sha256(b"").hexdigest()


class Anchored:
    """Words of a block with their codes, valid windows and anchors."""

    def __init__(self, w: Words, window: int):
        self.words, self.codes = w, word_hashes(w)
        n = self.codes.size - window + 1
        none = np.zeros(0, np.int64)
        self.begin = self.number = self.places = none
        if n > 0:
            grams = window_hashes(self.codes, K)
            least = sliding_window_view(grams, window - K + 1)[:n].argmin(axis=1)
            self.begin = np.flatnonzero(inside_one(w.first, n, window))
        if self.begin.size:
            place = self.begin + least[self.begin]
            owner = np.searchsorted(w.first, self.begin, "right") - 1
            fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
            self.number = np.cumsum(fresh) - 1  # of each window, its anchor
            self.places = place[fresh]
            self.nodes = grams[self.places]
        #: Anchors first[i]:first[i + 1] belong to text i.
        self.first = np.searchsorted(self.places, w.first)

    def edges(self) -> np.ndarray:
        """Of each anchor, the hash of the words up to the end of the next one; 0 for the last of a text."""
        out = np.zeros(self.places.size, np.uint64)
        text = np.repeat(np.arange(self.first.size - 1), np.diff(self.first))
        inner = np.flatnonzero(text[1:] == text[:-1]) if text.size else text
        if inner.size:
            out[inner] = sequence_hash(sequence_sums(self.codes, 1), self.places[inner], self.places[inner + 1] + K, 1)
        return out


def anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, h1, h2, text): n_words, sha (of all words), nodes, edges."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(3)):
                found = Anchored(w, window)
                nodes = found.nodes if found.places.size else np.zeros(0, np.uint64)
                shas = [hashlib.sha256(b" ".join(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split())).hexdigest() for i in range(len(w))]
                kept = [batch.column(i).slice(w.rows.start, len(w)) for i in range(3)]
                made = [pa.array(np.diff(w.first)), pa.array(shas), lists(signed(nodes), found.first), lists(signed(found.edges()), found.first)]
                yield pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "h1", "h2", "n_words", "sha", "nodes", "edges"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(part, f"doc_id {id_type}, h1 long, h2 long, n_words long, sha string, nodes array<long>, edges array<long>")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(uid, anchors) of rows with repeated anchors: place in order, count of the node, count of its edge."""
    counts = rows.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    counts = park(counts.withColumnRenamed("node", "known"), "nodes")
    each = rows.select("uid", F.posexplode(F.arrays_zip("nodes", "edges")).alias("at", "anchor"))
    each = each.select("uid", "at", F.col("anchor.nodes").alias("node"), F.col("anchor.edges").alias("edge"))
    repeated = park(each.join(counts, F.col("node") == F.col("known")).drop("known"), "repeated")
    edges = repeated.groupBy("node", "edge").agg(F.count(F.lit(1)).alias("m"))
    joined = repeated.join(edges, ["node", "edge"])
    return joined.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "n", F.when(F.col("edge") == 0, 0).otherwise(F.col("m")).alias("m")))).alias("anchors"))


def _settled(found: Anchored, row: int, at: np.ndarray, n: np.ndarray, m: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a text's windows over repeated anchors: those inside an unbranched path, and the others."""
    low, high = found.first[row], found.first[row + 1]
    count, solid = np.zeros(high - low + 1, np.int64), np.zeros(high - low + 1, bool)
    count[at] = n
    solid[at] = (m == n) & (count[at + 1] == m)
    # The end of the path that begins at or runs through an anchor.
    stops = np.flatnonzero(~solid)
    last = stops[np.searchsorted(stops, np.arange(high - low))]
    left, right = np.searchsorted(found.number, [low, high])
    begin, number = found.begin[left:right], found.number[left:right] - low
    over = count[number] > 1
    begin, number = begin[over], number[over]
    # The first anchor at or behind the window's begin is the one a covering path must hold.
    places = found.places[low:high]
    entry = np.minimum(np.searchsorted(places, begin), high - low - 1)
    # A path through the anchor before also covers it: its first word may lie before the entry.
    before = np.maximum(entry - 1, 0)
    reach_entry = (places[entry] <= begin) & (begin + window <= places[last[entry]] + K)
    reach_before = (places[before] <= begin) & (begin + window <= places[last[before]] + K)
    inside = reach_entry | reach_before
    return begin[inside], begin[~inside]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds and fields of the column ``anchors``."""
    column = batch.column(batch.schema.get_field_index("anchors"))
    bounds = np.asarray(column.offsets) - column.offsets[0].as_py()
    flat = column.flatten()
    return bounds, [np.asarray(flat.field(i)).astype(np.int64) for i in range(3)]


def open_windows(texts: DataFrame, window: int) -> DataFrame:
    """(uid, begin, w1, w2) of the windows that no unbranched path settles."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (at, n, m) = _texts(batch)
            for w in words(batch.column(1)):
                found = Anchored(w, window)
                begins, owners = [], []
                for i in range(len(w)):
                    some = slice(bounds[w.rows.start + i], bounds[w.rows.start + i + 1])
                    _, left = _settled(found, i, at[some], n[some], m[some], window)
                    begins.append(left)
                    owners.append(np.full(left.size, i))
                begin, owner = np.concatenate(begins), np.concatenate(owners)
                hashes = [signed(sequence_hash(sequence_sums(found.codes, f), begin, begin + window, f)) for f in (0, 1)]
                uid = batch.column(0).take(pa.array(owner + w.rows.start))
                yield pa.RecordBatch.from_arrays([uid, pa.array((begin - w.first[owner]).astype(np.int32)), *map(pa.array, hashes)], ["uid", "begin", "w1", "w2"])

    return texts.select("uid", "text", "anchors").mapInArrow(part, "uid long, begin int, w1 long, w2 long")


def cut_texts(texts: DataFrame, window: int) -> DataFrame:
    """Per row of ``texts`` (h1, h2, text, anchors, begins): h1, h2, n_removed, kept_sha256, spans."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, (at, n, m) = _texts(batch)
            repeated = batch.column(4)
            for w in words(batch.column(2)):
                found = Anchored(w, window)
                removed, shas, spans = [], [], []
                for i in range(len(w)):
                    some = slice(bounds[w.rows.start + i], bounds[w.rows.start + i + 1])
                    inside, _ = _settled(found, i, at[some], n[some], m[some], window)
                    low, high = w.first[i], w.first[i + 1]
                    begin = np.concatenate([inside - low, np.asarray(repeated[w.rows.start + i].values if repeated[w.rows.start + i].is_valid else [], np.int64)])
                    change = np.zeros(high - low + 1, np.int64)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + window, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = np.flatnonzero(~gone) + low
                    data = w.data.tobytes() if i == 0 else data
                    shas.append(hashlib.sha256(b" ".join([data[s:e] for s, e in zip(w.starts[kept].tolist(), w.ends[kept].tolist())])).hexdigest())
                    removed.append(int(gone.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist())])
                keys = [batch.column(k).slice(w.rows.start, len(w)) for k in range(2)]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(removed, pa.int64()), pa.array(shas), pa.array(spans, kind)], ["h1", "h2", "n_removed", "kept_sha256", "spans"])

    return texts.select("h1", "h2", "text", "anchors", "begins").mapInArrow(part, "h1 long, h2 long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>")


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and spans.

    ``spans`` are the removed stretches, counted in words.
    """
    keyed = with_text_key(docs.select("doc_id", "text"))
    rows = park(anchor_rows(keyed, window).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    classes = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("uid").alias("rep"))
    found = repeated_anchors(rows)
    flagged = park(found.join(classes, F.col("uid") == F.col("rep")).select("h1", "h2", "uid", "copies", "anchors"), "flagged")
    # One text per flagged class: the filter keeps most others from being shuffled.
    filled = build_filter(flagged, "h1")
    texts = keyed.filter(may_hold(docs.sparkSession, filled, F.col("h1"))).groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = park(texts.join(flagged, ["h1", "h2"]), "texts")
    windows = park(open_windows(texts, window), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("w1", "w2")
    begins = windows.join(twice, ["w1", "w2"]).groupBy("uid").agg(F.collect_list("begin").alias("begins"))
    cut = cut_texts(texts.filter(F.col("copies") == 1).join(begins, "uid", "left"), window)
    copied = classes.filter(F.col("copies") > 1).select("h1", "h2", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("string").alias("kept_sha256"), F.lit(None).cast("array<struct<start: int, end: int>>").alias("spans"), F.lit(True).alias("copied"))
    changed = park(cut.withColumn("copied", F.lit(False)).unionByName(copied), "changed")
    joined = rows.select("doc_id", "h1", "h2", "n_words", "sha").join(changed, ["h1", "h2"], "left")
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= window)
    all_words = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return joined.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>"))).alias("spans"),
    )
