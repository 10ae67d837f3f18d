"""Toxic spans by a linear-chain conditional random field.

Documents are read in chains of ``CHAIN`` words. A word is toxic (1) or not (0); its features are the
word and its first four and five bytes, hashed into a table of weights, and neighbouring words are
tied by transition weights. Forward-backward gives every word's marginal probability of being toxic.
A document's score comes from its highest marginal and the sum of its marginals, by a logistic curve
fitted on the same sample. Words with a marginal of a half or more are the offending offsets.

Labels are given per document. Words of the sample are labelled through them: a word (or word
beginning) that occurs in toxic documents and practically never in clean ones is toxic where it
stands in a toxic document.

Fitting takes about ``per_class`` labelled documents of either class, none above ``max_chars``
characters; both are parameters. Scoring reads every whole text, in map tasks, without a shuffle.

Nulls: a null text is empty; an empty text is scored by the curve alone. Without labels of both
classes every score is the share of toxic ones (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.samples import share_of_values
from clickgrain.llm.words import LETTERS, U, Words, mix, window_hashes, word_hashes, words

CHAIN = 64
TABLE_BITS = 20
PREFIXES = (4, 5)
SATURATION = 15.0


@dataclass
class Model:
    """Weights of features by their hash, log potentials of the four transitions, start, curve.

    A feature's slot in the table is given by the upper bits of its hash, and its weight counts where
    the lower bits agree too; of two features in one slot the heavier stays.
    """

    weights: np.ndarray
    tags: np.ndarray
    transitions: np.ndarray
    start: float
    curve: np.ndarray


def features(w: Words) -> np.ndarray:
    """Hashes of the features of all words: the word itself and its first bytes."""
    hashes = [word_hashes(w)]
    lengths = w.ends - w.starts
    code = np.zeros(w.starts.size, U)
    last = max(w.data.size - 1, 0)
    for i in range(max(PREFIXES)):
        here = np.where(lengths > i, w.data[np.minimum(w.starts + i, last)], 0).astype(U) if w.data.size else code
        code = (code << U(8)) | here
        if i + 1 in PREFIXES:
            hashes.append(mix(code + (U(i + 1) << U(56))))
    return np.stack(hashes)


@dataclass
class Chains:
    """Places of words in a (step, lane) matrix; lanes are chains of up to ``CHAIN`` words."""

    step: np.ndarray
    lane: np.ndarray
    valid: np.ndarray

    @classmethod
    def of(cls, first: np.ndarray) -> Chains:
        counts = np.diff(first)
        chains = -(-counts // CHAIN)
        begin = np.concatenate([[0], np.cumsum(chains)])
        place = np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], counts)
        lane = np.repeat(begin[:-1], counts) + place // CHAIN
        valid = np.zeros((CHAIN, begin[-1]), bool)
        valid[place % CHAIN, lane] = True
        return cls(place % CHAIN, lane, valid)

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.valid.shape, np.float64)
        out[self.step, self.lane] = values
        return out


def forward_backward(odds: np.ndarray, valid: np.ndarray, transitions: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios of state 1 to state 0. Their product is the odds of the marginal."""
    (t00, t01), (t10, t11) = np.exp(transitions)
    forward, backward = np.empty_like(odds), np.ones_like(odds)
    if not odds.shape[1]:
        return forward, backward
    forward[0] = odds[0] * np.exp(start)
    for t in range(1, odds.shape[0]):
        before = forward[t - 1]
        forward[t] = odds[t] * (t01 + before * t11) / (t00 + before * t10)
    for t in range(odds.shape[0] - 2, -1, -1):
        after = odds[t + 1] * backward[t + 1]
        backward[t] = np.where(valid[t + 1], (t10 + t11 * after) / (t00 + t01 * after), 1.0)
    return forward, backward


def emissions(model: Model, hashes: np.ndarray) -> np.ndarray:
    slots = (hashes >> U(64 - TABLE_BITS)).astype(np.int64)
    known = np.where(model.tags[slots] == hashes.astype(np.uint32), model.weights[slots], 0)
    return np.clip(known.sum(axis=0, dtype=np.float64), -SATURATION, SATURATION)


def log_odds(model: Model, w: Words) -> np.ndarray:
    """Log odds of every word's marginal."""
    chains = Chains.of(w.first)
    odds = chains.spread(np.exp(emissions(model, features(w))))
    forward, backward = forward_backward(odds, chains.valid, model.transitions, model.start)
    return np.log(np.maximum((forward * backward)[chains.step, chains.lane], 1e-300))


def summaries(word_odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: highest log odds and the logarithm of the summed marginals."""
    out = np.full((first.size - 1, 2), [-SATURATION, 0.0])
    full = np.flatnonzero(np.diff(first) > 0)
    if full.size:
        clipped = np.clip(word_odds, -SATURATION, SATURATION)
        out[full, 0] = np.maximum.reduceat(clipped, first[full])
        out[full, 1] = np.log1p(np.add.reduceat(np.where(clipped > 0, 1 / (1 + np.exp(-clipped)), 0.0), first[full]))
    return out


def curve_score(curve: np.ndarray, summary: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + summary @ curve[1:], -30, 30)))


def toxic_features(ids: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that mark toxic documents: many of those, or what no other feature explains."""
    # Row by row, as the kinds of features share no number.
    pairs = np.concatenate([np.unique(row.astype(np.int64) * toxic.size + doc) for row in ids])
    pairs = np.stack([pairs // toxic.size, pairs % toxic.size])
    size = int(ids.max()) + 1
    bad = np.bincount(pairs[0][toxic[pairs[1]]], minlength=size)
    good = np.bincount(pairs[0][~toxic[pairs[1]]], minlength=size) * (toxic.sum() / max(1, (~toxic).sum()))
    pure = good <= 0.02 * bad
    least = max(3, 0.01 * toxic.sum())
    chosen = pure & (bad >= 2 * least)
    explained = np.zeros(toxic.size, bool)
    explained[pairs[1][chosen[pairs[0]]]] = True
    candidates = pairs[:, pure[pairs[0]] & (bad[pairs[0]] >= least) & toxic[pairs[1]]]
    while True:
        left = candidates[:, ~explained[candidates[1]]]
        gain = np.bincount(left[0], minlength=size)
        best = int(gain.argmax())
        if gain[best] < least:
            return chosen
        chosen[best] = True
        explained[left[1][left[0] == best]] = True


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes and, in place of each, its number; row by row, which takes less memory."""
    names, ids, known = [], np.empty(hashes.shape, np.int32), 0
    for row, out in zip(hashes, ids):
        own, inverse = np.unique(row, return_inverse=True)
        out[:] = inverse + known
        names.append(own)
        known += own.size
    return np.concatenate(names), ids


def distinct_texts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts without near copies of earlier ones, by six smallest hashes of three words in turn."""
    seen: set[int] = set()
    keep = np.zeros(first.size - 1, bool)
    for i in range(first.size - 1):
        own = codes[first[i] : first[i + 1]]
        own = window_hashes(own, min(3, own.size)) if own.size else own
        least = {int(mix(own ^ U(k)).min()) for k in range(6)} if own.size else set()
        keep[i] = bool(least) and not least & seen
        seen |= least
    return keep


def fit(texts: list[str | None], labels: list[int], rounds: int = 60, rate: float = 0.25, decay: float = 1e-3, weights_of_rows: list[float] | None = None) -> Model:
    """Trains on labelled texts by gradient ascent (Adam) on the chains' log likelihood.

    ``weights_of_rows`` say how many labelled documents each text stands for. The curve that turns
    marginals into scores is fitted with them, so scores do not move with the share of the sample.
    """
    toxic = np.array(labels, bool)
    stands_for = np.ones(toxic.size) if weights_of_rows is None else np.array(weights_of_rows, float)
    share = float(np.average(toxic, weights=stands_for)) if toxic.size else 0.0
    size = 1 << TABLE_BITS
    model = Model(np.zeros(size, np.float32), np.zeros(size, np.uint32), np.zeros((2, 2)), 0.0, np.zeros(3))
    if share in (0.0, 1.0):
        model.curve[0] = np.log(max(share, 1e-13)) - np.log(max(1 - share, 1e-13))
        return model
    pieces, counts, codes = [], [], []
    for w in words(pa.array(texts, pa.string()), lower=True, inside=LETTERS):
        pieces.append(features(w))
        counts.append(np.diff(w.first))
        codes.append(word_hashes(w))
    hashes, first = np.concatenate(pieces, axis=1), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    if not first[-1]:
        return model
    names, ids = _numbered(hashes)
    doc = np.repeat(np.arange(toxic.size), np.diff(first))
    once = distinct_texts(np.concatenate(codes), first)[doc]
    del pieces, codes
    marks = np.zeros(names.size, bool)
    own = toxic_features(ids[:, once], doc[once], toxic)
    marks[: own.size] = own
    truth = marks[ids].any(axis=0) & toxic[doc]

    chains = Chains.of(first)
    y = chains.spread(truth.astype(float))
    both = chains.valid[1:]
    now, before = y[1:][both].astype(int), y[:-1][both].astype(int)
    seen_pairs = np.bincount(2 * before + now, minlength=4).reshape(2, 2)
    weights = np.zeros(names.size)
    parameters = [weights, np.zeros((2, 2)), np.zeros(1)]
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for round_ in range(1, rounds + 1):
        weights, transitions, start = parameters
        odds = chains.spread(np.exp(np.clip(weights[ids].sum(axis=0), -SATURATION, SATURATION)))
        forward, backward = forward_backward(odds, chains.valid, transitions, start[0])
        gap = forward * backward
        gap /= 1 + gap
        np.subtract(y, gap, out=gap)
        gap *= chains.valid
        words_gap = gap[chains.step, chains.lane]
        slope = sum(np.bincount(row, words_gap, names.size) for row in ids)
        (t00, t01), (t10, t11) = np.exp(transitions)
        grown, before_ = odds[1:] * backward[1:], forward[:-1]
        share = both / (t00 + t01 * grown + before_ * (t10 + t11 * grown))
        cells = np.array([[t00 * share.sum(), t01 * (grown * share).sum()], [t10 * (before_ * share).sum(), t11 * (before_ * grown * share).sum()]])
        slopes = [slope - decay * weights, seen_pairs - cells, np.array([gap[0].sum()])]
        for p, g, (m, v) in zip(parameters, slopes, memory):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9**round_)) / (np.sqrt(v / (1 - 0.99**round_)) + 1e-8)
    order = np.argsort(np.abs(parameters[0]), kind="stable")
    slots = (names[order] >> U(64 - TABLE_BITS)).astype(np.int64)
    model.weights[slots] = parameters[0][order]
    model.tags[slots] = names[order].astype(np.uint32)
    model.transitions, model.start = parameters[1], float(parameters[2][0])
    final = chains.spread(np.exp(emissions(model, hashes)))
    forward, backward = forward_backward(final, chains.valid, model.transitions, model.start)
    word_odds = np.log(np.maximum((forward * backward)[chains.step, chains.lane], 1e-300))
    model.curve = _logistic(summaries(word_odds, first), toxic.astype(float), stands_for / stands_for.mean())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, decay: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with intercept by Newton steps; only the slopes are held small."""
    x = np.column_stack([np.ones(len(x)), x])
    held = decay * np.diag(np.r_[1e-3, np.ones(x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (y - p)) - held @ beta
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + held
        step = np.linalg.solve(bend, slope)
        beta = beta + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return beta


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, per_class: int = 800, max_chars: int = 6_000) -> Model:
    """Fits on a sample of the labelled documents (doc_id, text; doc_id, toxic) that are ``allowed``.

    A sampled document stands for as many labelled ones as its class has for each of its sample. Where
    ids repeat, labels and texts are taken once per id: the larger label, the first text by order.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(allowed) if allowed is not None else known
    chosen = share_of_values(known, "toxic", ("doc_id",), per_class).select(F.col("doc_id").alias("labelled"), "toxic", "n_value")
    short = docs.filter(F.length("text") <= max_chars).select("doc_id", "text")
    # About 2 * per_class ids, so no text but the sample's leaves the scan.
    drawn = short.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id", "toxic", "n_value").agg(F.min("text").alias("text"))
    rows = drawn.toPandas().sort_values("doc_id", kind="stable")
    stands_for = rows["n_value"] / rows.groupby("toxic")["toxic"].transform("size")
    return fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist(), weights_of_rows=stands_for.tolist())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` with score, predicted and spans (code points)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**TABLE_BITS weights and tags, 8 MB

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            names = batch.schema.names
            for w in words(batch.column(names.index("tox_text")), lower=True, inside=LETTERS):
                word_odds = log_odds(fitted, w)
                scores = curve_score(fitted.curve, summaries(word_odds, w.first))
                hit = np.flatnonzero(word_odds >= 0)
                points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                owner = np.searchsorted(w.first, hit, "right") - 1
                base = points[w.offsets[owner]]
                spans = pa.StructArray.from_arrays([pa.array(points[w.starts[hit]] - base, pa.int32()), pa.array(points[w.ends[hit]] - base, pa.int32())], ["start", "end"])
                bounds = pa.array(np.searchsorted(hit, w.first), pa.int32())
                kept = [batch.column(i).slice(w.rows.start, len(w)) for i, n in enumerate(names) if n != "tox_text"]
                made = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.ListArray.from_arrays(bounds, spans)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*[n for n in names if n != "tox_text"], "score", "predicted", "spans"])

    rows = docs.select(*keep, F.col("text").alias("tox_text"))
    types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "tox_text")
    return rows.mapInArrow(part, f"{types}, score double, predicted int, spans array<struct<start: int, end: int>>")


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    names = [f"kept_{i}" for i in range(len(docs.columns))]
    aside = docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)])
    clean = score(aside, model, tuple(names)).filter(F.col("predicted") == 0)
    return clean.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])
