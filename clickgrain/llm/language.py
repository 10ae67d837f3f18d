"""Language of texts by a bidirectional gated recurrent network over bytes.

Texts are put in lower case and read in segments of ``SEGMENT`` bytes, all segments of a block side
by side. Two gated recurrent layers, one from either end, and a softmax over both states label every
byte position; a document's probabilities are the mean over all its positions. Gates are hard
sigmoids and states hard tangents, so a step is a few additions, products and clips.

The network is trained here by backpropagation through time, in numpy, on about ``per_language``
documents of every language (``per_text`` segments of each, spread over its whole length); both are
parameters. Every byte of every text is read when predicting, in map tasks without a shuffle.

Nulls: a null text, or one without letters, is ``und`` with score 0. Documents without a language
are not learned from. Without any training document every text is ``und``. The distinct languages
come to the driver, so the column must hold languages, not free text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.samples import share_of_values
from clickgrain.llm.words import blocks, text_buffers

SEGMENT = 64
STATES = 8
LANES = 4096
ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Network:
    """For either direction the input table (3 x states, 256) and recurrent weights; then the output."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def segments(own: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (SEGMENT, lanes), how many count in each lane, and the first lane of each text."""
    sizes = np.diff(offsets)
    lanes = -(-sizes // SEGMENT)
    first = np.concatenate([[0], np.cumsum(lanes)])
    text = np.repeat(np.arange(sizes.size), lanes)
    begin = offsets[text] + (np.arange(first[-1]) - first[text]) * SEGMENT
    filled = np.minimum(SEGMENT, offsets[text + 1] - begin)
    padded = np.concatenate([own, np.full(SEGMENT, 0x20, np.uint8)])
    grid = padded[begin + np.arange(SEGMENT)[:, None]]
    grid[np.arange(SEGMENT)[:, None] >= filled] = 0x20
    return grid, filled, first


def run_layer(table: np.ndarray, weights: np.ndarray, grid: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """States (steps, STATES, lanes). ``trace`` gets what backpropagation needs."""
    steps, lanes = grid.shape
    h = np.zeros((STATES, lanes), np.float32)
    out = np.empty((steps, STATES, lanes), np.float32)
    gates = 2 * STATES
    for t in range(steps - 1, -1, -1) if back else range(steps):
        a = np.take(table, grid[t], axis=1)
        g = weights @ h
        gate = a[:gates]
        gate += g[:gates]
        np.clip(gate, 0.0, 1.0, out=gate)
        z, r = gate[:STATES], gate[STATES:]
        n = g[gates:] * r
        n += a[gates:]
        if trace is not None:
            trace.append((t, h, gate.copy(), g[gates:].copy(), n.copy()))
        np.clip(n, -1.0, 1.0, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return out


def position_probabilities(net: Network, grid: np.ndarray) -> np.ndarray:
    """(steps, languages, lanes)."""
    forward = run_layer(net.inputs[0], net.recurrent[0], grid, False)
    backward = run_layer(net.inputs[1], net.recurrent[1], grid, True)
    return _softmax(np.matmul(net.out[:, :STATES], forward) + np.matmul(net.out[:, STATES:], backward) + net.bias[:, None])


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def text_probabilities(net: Network, own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, languages): mean over all positions; zeros for empty texts."""
    grid, filled, first = segments(own, offsets)
    sums = np.zeros((len(net.languages), first[-1]))
    for at in range(0, first[-1], LANES):
        some = slice(at, min(first[-1], at + LANES))
        p = position_probabilities(net, grid[:, some])
        p *= (np.arange(SEGMENT)[:, None] < filled[some])[:, None, :]
        sums[:, some] = p.sum(axis=0)
    totals = np.concatenate([np.zeros((sums.shape[0], 1)), np.cumsum(sums, axis=1)], axis=1)
    pooled = (totals[:, first[1:]] - totals[:, first[:-1]]).T
    return pooled / np.maximum(np.diff(offsets), 1)[:, None]


def _layer_slopes(weights: np.ndarray, grid: np.ndarray, trace: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights from those of the states."""
    d_table, d_weights = np.zeros((3 * STATES, 256), np.float32), np.zeros_like(weights)
    carried = np.zeros(slope.shape[1:], np.float32)
    gates = 2 * STATES
    for t, h, gate, inner, raw in reversed(trace):
        d = slope[t] + carried
        z, r, n = gate[:STATES], gate[STATES:], np.clip(raw, -1, 1)
        dn = d * (1 - z) * (np.abs(raw) < 1)
        dz = d * (h - n) * ((z > 0) & (z < 1))
        dr = dn * inner * ((r > 0) & (r < 1))
        inputs = np.concatenate([dz, dr, dn])
        outer = np.concatenate([dz, dr, dn * r])
        d_weights += outer @ h.T
        carried = d * z + weights.T @ outer
        counts = grid[t].astype(np.int64)
        for k in range(3 * STATES):
            d_table[k] += np.bincount(counts, inputs[k], 256)
    assert inputs.shape[0] == gates + STATES
    return d_table, d_weights


def fit(texts: list[str], languages: list[str], per_text: int = 8, epochs: int = 6, batch: int = 512, rate: float = 0.02, seed: int = 7) -> Network:
    """Backpropagation through time with Adam over shuffled segments."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    net = Network(
        names,
        [np.concatenate([rng.normal(0.5, 0.1, (2 * STATES, 256)), rng.normal(0, 0.3, (STATES, 256))]).astype(np.float32) for _ in range(2)],
        [rng.normal(0, 0.2, (3 * STATES, STATES)).astype(np.float32) for _ in range(2)],
        rng.normal(0, 0.3, (len(names), 2 * STATES)).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    grids, lengths, labels = [], [], []
    for text, language in zip(texts, languages):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        if raw.size:
            grid, filled, _ = segments(raw, np.array([0, raw.size]))
            chosen = np.unique(np.linspace(0, filled.size - 1, per_text).astype(int))
            grids.append(grid[:, chosen])
            lengths.append(filled[chosen])
            labels.append(np.full(chosen.size, names.index(language)))
    if not grids:
        return Network([], net.inputs, net.recurrent, net.out[:0], net.bias[:0])
    grid, filled, label = np.concatenate(grids, axis=1), np.concatenate(lengths), np.concatenate(labels)
    # A language with few documents weighs as much as one with many.
    weight = (1 / np.bincount(label, minlength=len(names)))[label]
    weight *= label.size / weight.sum()
    parameters = [*net.inputs, *net.recurrent, net.out, net.bias]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(label.size)
        for at in range(0, label.size, batch):
            some, step = order[at : at + batch], step + 1
            part, y = np.ascontiguousarray(grid[:, some]), label[some]
            traces: list[list] = [[], []]
            states = [run_layer(net.inputs[k], net.recurrent[k], part, bool(k), traces[k]) for k in range(2)]
            both = np.concatenate(states, axis=1)
            p = _softmax(np.matmul(net.out, both) + net.bias[:, None])
            p[:, y, np.arange(y.size)] -= 1
            p *= ((np.arange(SEGMENT)[:, None] < filled[some]) * (weight[some] / (SEGMENT * y.size)))[:, None, :]
            p = p.astype(np.float32)
            d_states = np.matmul(net.out.T, p)
            slopes = [_layer_slopes(net.recurrent[k], part, traces[k], d_states[:, k * STATES : (k + 1) * STATES]) for k in range(2)]
            d_out = np.einsum("tln,tsn->ls", p, both, optimize=True)
            all_slopes = [slopes[0][0], slopes[1][0], slopes[0][1], slopes[1][1], d_out, p.sum(axis=(0, 2))]
            pace = rate * (1 - epoch / epochs) ** 0.5
            for q, g, (m, v) in zip(parameters, all_slopes, memory):
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                q -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, allowed: Column | None = None, per_language: int = 300, max_chars: int = 20_000, **options) -> Network:
    """Fits on a sample of the documents (doc_id, text, lang) that are ``allowed``.

    Rows are drawn by id and text, and equal ones count once, so null or repeated ids neither come
    together nor fill the driver. Without rows to learn from, all predictions are ``und``. Of
    languages with equal probabilities the first by name is taken.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    known = (known.filter(allowed) if allowed is not None else known).select("doc_id", "text", "lang")
    drawn = share_of_values(known, "lang", ("doc_id", "text"), per_language).select("doc_id", "text", "lang").distinct()
    rows = drawn.toPandas().sort_values(["doc_id", "text", "lang"], kind="stable")
    return fit(rows["text"].tolist(), rows["lang"].tolist(), **options)


def predict(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text) with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers
    rows = docs.select(*keep, F.col("text").alias("read_text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("read_text"))
            data, at = text_buffers(pc.utf8_lower(pc.fill_null(texts, "")))
            predicted, scores = [], []
            for some in blocks(data, at):
                own, offsets = data[at[some.start] : at[some.stop]], at[some.start : some.stop + 1] - at[some.start]
                if not fitted.languages:
                    predicted += ["und"] * (offsets.size - 1)
                    scores += [0.0] * (offsets.size - 1)
                    continue
                p = text_probabilities(fitted, own, offsets)
                letters = np.concatenate([[0], np.cumsum(ASCII_LETTERS[own])])[offsets]
                named = np.diff(letters) > 0
                for i in np.flatnonzero(~named & (np.diff(offsets) > 0)):
                    named[i] = any(map(str.isalpha, own[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                best = p.argmax(axis=1)
                predicted += [fitted.languages[b] if ok else "und" for b, ok in zip(best, named)]
                scores += np.where(named, np.clip(p.max(axis=1), 0, 1), 0.0).tolist()
            kept = [batch.column(i) for i, n in enumerate(names) if n != "read_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], [*[n for n in names if n != "read_text"], "lang_pred", "score"])

    types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "read_text")
    return rows.mapInArrow(part, f"{types}, lang_pred string, score double")
