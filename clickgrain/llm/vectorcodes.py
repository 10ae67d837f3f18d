"""Vectors as short codes: every part of a vector becomes the index of a codebook entry.

The codebooks come from rounds of exact integer k-means over all vectors. Points (parts of vectors)
are written once as flat blocks: sorted along a Hilbert curve, range-partitioned, and packed to BLOCK
points each with the box around them (smallest and largest component) and their sum. In a round every
box is compared with the codebook: an entry whose least distance to the box is larger than the
largest distance of some other entry is nearest to no point of the block. The entries left are the
block's shortlist. With one entry on it the block counts as a whole by its stored sum; otherwise an
integer kernel takes the distances of its points to the shortlist alone. The results are those of the
plain method, ties included; a tied entry is never struck off.

A round is one scan of the blocks; tasks send one row per part and entry. Only codebooks
(parts * entries rows) reach the driver.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do those whose
length is not that of the smallest kept vec_id or no multiple of ``parts``. Rows are taken one by one:
of repeated vec_ids the smaller vector comes first, a null vec_id comes last. Fewer vectors than
entries make fewer entries; without vectors the result is empty. A null label is a label of its own.
Other columns, whatever their names, are not read. Components have to stay below 2**17.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.hotkeys import attach
from clickgrain.session import park

BLOCK = 256
CURVE_BITS = 60


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of points (n, d) with coordinates of ``bits`` bits on the Hilbert curve; d * bits <= 62.

    The coordinates are turned from the curve's own axes level by level (reflections and swaps), then
    made a Gray code and read off bit by bit across the axes.
    """
    x = points.astype(np.int64).T.copy()
    axes = x.shape[0]
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for axis in range(axes):
            upper = (x[axis] & bit) != 0
            x[0] = np.where(upper, x[0] ^ low, x[0])
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= swap
            x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            place = (place << 1) | ((x[axis] >> level) & 1)
    return place


def integer_vectors(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, written; v holds floor(scale * x)."""
    ints = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & F.coalesce(finite, F.lit(False)))
    rows = park(sound.select("vec_id", "label", ints.alias("v")), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    length = first[0] if first else 0
    return park(rows.filter(F.size("v") == length).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v"), "vectors")


def start_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the first vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    return np.array([r[0] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()


def write_blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, n, low, high, total, members, owners): blocks of points that are near each other."""
    axes = min(width, CURVE_BITS)
    bits = max(1, CURVE_BITS // axes)
    numbers = range(parts * width)
    each = rows.select(F.posexplode("v").alias("i", "x"))
    ends = {r.i: (r.low, r.high) for r in each.groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    low = np.array([ends[i][0] for i in numbers], np.float64).reshape(parts, width)
    span = np.array([max(1, ends[i][1] - ends[i][0]) for i in numbers], np.float64).reshape(parts, width)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, parts, width)
            for p in range(parts):
                cells = np.minimum((v[:, p, :axes] - low[p, :axes]) / span[p, :axes] * (1 << bits), (1 << bits) - 1)
                columns = [pa.array(np.full(len(own), p, np.int32)), pa.array(hilbert_index(cells, bits)), own, _vectors(v[:, p])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "place", "row", "x"])

    points = rows.select("row", "v").mapInArrow(spread, "part int, place long, row long, x array<long>")
    sorted_points = points.repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            part, row, x = (np.concatenate(c) for c in zip(*waiting))
            waiting.clear()
            begins = np.concatenate([np.arange(s, e, BLOCK) for s, e in _stretches(part)])
            ends = np.minimum(begins + BLOCK, np.concatenate([np.full(-(-(e - s) // BLOCK), e) for s, e in _stretches(part)]))
            if not last and part.size:  # The last block may go on in the next batch.
                waiting.append((part[begins[-1] :], row[begins[-1] :], x[begins[-1] :]))
                begins, ends = begins[:-1], ends[:-1]
            if begins.size:
                yield _block_rows(part, row, x, begins, ends)

        for batch in batches:
            if batch.num_rows:
                part = batch.column(0).to_numpy(zero_copy_only=False)
                waiting.append((part, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)))
                yield from blocks(False)
        if waiting:
            yield from blocks(True)

    packed = sorted_points.select("part", "row", "x").mapInArrow(pack, "part int, n long, low array<long>, high array<long>, total array<long>, members binary, owners binary")
    return park(packed, "blocks")


def _stretches(part: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(part[1:] != part[:-1]) + 1
    return list(zip([0, *cut], [*cut, part.size]))


def _vectors(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _block_rows(part, row, x, begins, ends) -> pa.RecordBatch:
    low, high, total = (op.reduceat(x[: ends[-1]], begins, axis=0) for op in (np.minimum, np.maximum, np.add))
    # reduceat runs to the next beginning, which is the block's end as blocks follow each other.
    members = pa.array([x[b:e].tobytes() for b, e in zip(begins, ends)], pa.binary())
    owners = pa.array([row[b:e].tobytes() for b, e in zip(begins, ends)], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begins].astype(np.int32)), pa.array(ends - begins), _vectors(low), _vectors(high), _vectors(total), members, owners],
        ["part", "n", "low", "high", "total", "members", "owners"],
    )


def shortlists(low: np.ndarray, high: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """(blocks, entries): whether the entry may be nearest to a point within the block's box."""
    below, above = codebook[None] - high[:, None], low[:, None] - codebook[None]
    nearest = np.maximum(np.maximum(below, above), 0)
    farthest = np.maximum(np.abs(codebook[None] - low[:, None]), np.abs(codebook[None] - high[:, None]))
    least, most = (nearest * nearest).sum(axis=2), (farthest * farthest).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lowest of equal ones) and squared distance of the nearest of a few entries."""
    apart = points[:, None] - entries[None]
    squares = (apart * apart).sum(axis=2)
    best = squares.argmin(axis=1)
    return best, squares[np.arange(best.size), best]


def _boxes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    part, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    low, high, total = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.size, -1) for i in (2, 3, 4))
    return part, n, low, high, total


def round_sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, total, taken, met): points and sums of every entry, and how many blocks went as a whole."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        parts, entries, width = own.shape
        counts, totals, taken = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), np.zeros(parts, np.int64)
        met = np.zeros(parts, np.int64)
        for batch in batches:
            part, n, low, high, total = _boxes(batch)
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                listed = shortlists(low[here], high[here], own[p])
                single = listed.sum(axis=1) == 1
                whole, entry = here[single], listed[single].argmax(axis=1)
                np.add.at(counts[p], entry, n[whole])
                np.add.at(totals[p], entry, total[whole])
                taken[p] += whole.size
                met[p] += here.size
                for i, some in zip(here[~single], listed[~single]):
                    x = np.frombuffer(batch.column(5)[int(i)].as_buffer(), np.int64).reshape(-1, width)
                    short = np.flatnonzero(some)
                    best = short[nearest_entries(x, own[p][short])[0]]
                    np.add.at(counts[p], best, 1)
                    np.add.at(totals[p], best, x)
        p, e = np.divmod(np.arange(parts * entries), max(entries, 1))
        columns = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts.reshape(-1)), _vectors(totals.reshape(-1, width)), pa.array(taken[p]), pa.array(met[p])]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total", "taken", "met"])

    width = books.shape[2]
    found = blocks.mapInArrow(sums, "part int, entry int, n long, total array<long>, taken long, met long")
    added = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.sum("met").alias("met"), *added)


def fit_codebooks(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after ``rounds`` rounds; an entry without points stays as it is."""
    width = books.shape[2]
    for _ in range(rounds):
        after = books.copy()
        for r in round_sums(blocks, books).collect():  # parts * entries rows
            if r.n:
                after[r.part, r.entry] = [r[f"t{i}"] // r.n for i in range(width)]
        books = after
    return books


def assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, part, code, error): the entry of every point and its squared distance."""
    sent = blocks.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            part, _, low, high, _ = _boxes(batch)
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                for i, some in zip(here, shortlists(low[here], high[here], own[p])):
                    x = np.frombuffer(batch.column(5)[int(i)].as_buffer(), np.int64).reshape(-1, own.shape[2])
                    short = np.flatnonzero(some)
                    best, error = nearest_entries(x, own[p][short])
                    owners = np.frombuffer(batch.column(6)[int(i)].as_buffer(), np.int64)
                    columns = [pa.array(owners), pa.array(np.full(owners.size, p, np.int32)), pa.array(short[best].astype(np.int32)), pa.array(error)]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "part", "code", "error"])

    return blocks.mapInArrow(assign, "row long, part int, code int, error long")


@dataclass
class Coded:
    """Codebooks (parts, entries, width) and ``rows``: vec_id, label, codes (an array by part), error."""

    books: np.ndarray
    rows: DataFrame

    def digest(self) -> str:
        """Of all components of all entries, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Coded:
    """Codes of the rows of ``vectors`` (vec_id, embedding, label) that take part."""
    rows = integer_vectors(vectors, scale, parts)
    books = start_codebooks(rows, parts, entries)
    if not books.size:
        return Coded(books, rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")))
    blocks = write_blocks(rows, parts, books.shape[2])
    books = fit_codebooks(blocks, books, rounds)
    by_row = assigned(blocks, books).groupBy(F.col("row").alias("coded")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("part", "code"))), lambda x: x["code"]).alias("codes"), F.sum("error").alias("error")
    )
    return Coded(books, rows.join(by_row, F.col("row") == F.col("coded")).select("vec_id", "label", "codes", "error"))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` rows with label_error: the errors of all rows of one label together."""
    coded = park(coded, "coded")
    by_label = park(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows_of_label")), "labels")
    return attach(coded, by_label, ["label"], "rows_of_label", null_safe=True)


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The plain method, one pair of tables for each round."""

    def assign(name: str, books: str) -> str:
        near = f"""SELECT p.row, p.part, c.entry, sum((p.x - c.x) * (p.x - c.x)) AS d
  FROM points p JOIN {books} c ON p.part = c.part AND p.i = c.i GROUP BY ALL"""
        return f"{name} AS MATERIALIZED (SELECT row, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM ({near}) GROUP BY row, part)"

    ctes = [
        "sound AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))))",
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM sound)""",
        f"""points AS MATERIALIZED (SELECT row, (j - 1) // (len(v) // {parts}) AS part, (j - 1) % (len(v) // {parts}) AS i, v[j] AS x
  FROM (SELECT row, v, unnest(range(1, len(v) + 1)) AS j FROM kept))""",
        f"books0 AS MATERIALIZED (SELECT part, row AS entry, i, x FROM points WHERE row < {entries})",
    ]
    for t in range(rounds):
        ctes.append(assign(f"near{t}", f"books{t}"))
        ctes.append(
            f"""means{t} AS (SELECT a.part, a.entry, p.i, CAST(sum(p.x) AS BIGINT) AS s, count(*) AS n
  FROM near{t} a JOIN points p ON a.row = p.row AND a.part = p.part GROUP BY ALL)"""
        )
        floored = "(m.s - ((m.s % m.n) + m.n) % m.n) // m.n"
        ctes.append(
            f"""books{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.i, coalesce({floored}, b.x) AS x
  FROM books{t} b LEFT JOIN means{t} m ON b.part = m.part AND b.entry = m.entry AND b.i = m.i)"""
        )
    ctes.append(assign("last", f"books{rounds}"))
    ctes.append(
        """coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', l.entry), '' ORDER BY l.part) AS code, CAST(sum(l.d) AS BIGINT) AS error
  FROM kept k JOIN last l ON k.row = l.row GROUP BY k.row, k.vec_id, k.label)"""
    )
    ctes.append(f"digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM books{rounds})")
    body = "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"
    return "WITH " + ",\n".join(ctes) + "\n" + body


SQL = _sql()
