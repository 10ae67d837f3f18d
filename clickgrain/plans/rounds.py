"""Implicit ALS whose rounds several settings share, and recall of the factors on the way.

A fit of 20 rounds passes through what fits of 5, 10 and 15 rounds end in, where all else is equal. Spark's
``ALS`` neither shows those factors nor starts from given ones, so the rounds are made here: the first factors
are those of its own fit of no rounds, and equations, order of the sides and solver (Cholesky) are its own too.

Ratings lie in blocks by user and once more in blocks by item, as in Spark's ``ALS``. In half a round a block
of one side gets the factors it needs from the blocks of the other, each of them once, and solves for its own
rows in chunks of bounded size. The driver holds one matrix of rank by rank and one number a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in the arrays of a chunk of rows, ratings of one row taken at a time, and rows sent as one array.
CHUNK, SPAN, PIECE = 1_000_000, 20_000, 500_000
#: Item factors (numbers) that meet a block of users at a time in the evaluation.
ITEM_NUMBERS = 16_000_000
#: Factors (numbers) of the other side that a task may hold for all settings of a chain.
BUNDLE_NUMBERS = 20_000_000
#: Stands for an item without a number; ids have 32 bits.
NO_ITEM = 1 << 40
KEPT = StorageLevel.MEMORY_AND_DISK


class Block(NamedTuple):
    """Ratings of one block: ``own`` ids in order, and per rating the place of the other id in ``need``."""

    index: int
    own: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    scores: np.ndarray
    need: np.ndarray


def _same(number: int) -> int:
    return number


def _pieces(rows: DataFrame, key: str, blocks: int) -> RDD:
    """(block, arrays of the columns): the rows of a table dealt by a column of whole numbers."""
    names = [key, *[c for c in rows.columns if c != key]]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append([batch.column(i).flatten() if pa.types.is_list(batch.column(i).type) else batch.column(i) for i in range(len(names))])
            count += batch.num_rows
            if count >= PIECE:
                yield from dealt(held)
                held, count = [], 0
        if count:
            yield from dealt(held)

    def dealt(held: Sequence) -> Iterator[pa.RecordBatch]:
        arrays = [np.concatenate([h[i].to_numpy(zero_copy_only=False) for h in held]) for i in range(len(names))]
        arrays = [a.reshape(len(arrays[0]), -1) if len(a) != len(arrays[0]) else a for a in arrays]
        at = np.mod(arrays[0], blocks)
        for b in np.unique(at):
            some = [np.ascontiguousarray(a[at == b]) for a in arrays]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([b], pa.int32()), "rows": pa.array([len(some[0])], pa.int32()),
                **{f"a{i}": pa.array([a.tobytes()], pa.binary()) for i, a in enumerate(some)},
                "kinds": pa.array([",".join(a.dtype.str for a in some)], pa.string()),
            })

    binaries = ", ".join(f"a{i} binary" for i in range(len(names)))
    packs = rows.select(*names).mapInArrow(packed, f"block int, rows int, {binaries}, kinds string")

    def arrays_of(pack) -> tuple:
        kinds = pack["kinds"].split(",")
        found = [np.frombuffer(pack[f"a{i}"], kind) for i, kind in enumerate(kinds)]
        return pack["block"], [a.reshape(pack["rows"], -1) if len(a) != pack["rows"] else a for a in found]

    return packs.rdd.map(arrays_of).partitionBy(blocks, _same)


def _joined(pieces: Sequence, kinds: Sequence) -> list[np.ndarray]:
    """The arrays of all pieces of a block one after the other; empty ones where there is none."""
    if not pieces:
        return [np.empty(0, kind) for kind in kinds]
    return [np.concatenate([arrays[i] for _, arrays in pieces]) for i in range(len(kinds))]


def rating_blocks(ratings: DataFrame, own: str, other: str, score: str, blocks: int) -> RDD:
    def build(index: int, pieces: Iterator) -> Iterator[Block]:
        ids, others, scores = _joined(list(pieces), (np.int32, np.int32, np.float32))
        mine, at = np.unique(ids, return_inverse=True)
        need, place = np.unique(others, return_inverse=True)
        by_source = np.lexsort((need, np.mod(need, blocks)))
        moved = np.empty(len(need), np.int32)
        moved[by_source] = np.arange(len(need), dtype=np.int32)
        in_rows = np.argsort(at, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(mine)))]).astype(np.int64)
        yield Block(index, mine, starts, moved[place][in_rows], scores[in_rows], need[by_source])

    whole = [F.col(c).cast("int").alias(c) for c in (own, other)]
    pieces = _pieces(ratings.select(*whole, F.col(score).cast("float").alias(score)), own, blocks)
    return pieces.mapPartitionsWithIndex(build, preservesPartitioning=True).persist(KEPT)


def routes(source: RDD, target: RDD, blocks: int) -> RDD:
    """Per block of ``source``: its index and, for each block of ``target``, the places of the rows to send."""

    def asked(block: Block) -> list:
        of = np.mod(block.need, blocks)
        return [(int(s), (block.index, block.need[of == s])) for s in np.unique(of)]

    def answered(pair: tuple) -> tuple:
        block, requests = pair
        return block.index, [(d, np.searchsorted(block.own, ids)) for _, (d, ids) in requests]

    requests = target.flatMap(asked).partitionBy(blocks, _same).glom()
    return source.zip(requests).map(answered).persist(KEPT)


def _solutions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of left x = right for many small matrices, by Cholesky; one that isn't positive definite is an error."""
    lower, x = np.linalg.cholesky(left), np.empty_like(right)
    for j in range(right.shape[1]):
        x[:, j] = (right[:, j] - np.einsum("mi,mi->m", lower[:, j, :j], x[:, :j])) / lower[:, j, j]
    for j in reversed(range(right.shape[1])):
        x[:, j] = (x[:, j] - np.einsum("mi,mi->m", lower[:, j + 1 :, j], x[:, j + 1 :])) / lower[:, j, j]
    return x


def solved(block: Block, near: np.ndarray, gram: np.ndarray, reg: float, alpha: float) -> np.ndarray:
    """The factors of a block's own ids, given those of ``need``. ``gram`` is of all factors of the other side."""
    rank, counts = len(gram), np.diff(block.starts)
    found, diagonal = np.zeros((len(block.own), rank), np.float32), np.arange(rank)
    order = np.argsort(counts, kind="stable")
    degrees, firsts = np.unique(counts[order], return_index=True)
    for n, first, last in zip(degrees, firsts, [*firsts[1:], len(order)]):
        step = max(1, CHUNK // (max(min(n, SPAN), rank) * rank))
        for begin in range(first, last, step):
            rows = order[begin : min(begin + step, last)]
            left, right = np.repeat(gram[None], len(rows), 0), np.zeros((len(rows), rank))
            for span in range(0, n, SPAN):
                at = block.starts[rows][:, None] + np.arange(span, min(span + SPAN, n))
                scores = block.scores[at].astype(np.float64)
                weight, liked = alpha * np.abs(scores), scores > 0
                others = near[block.place[at]].astype(np.float64)
                left += np.matmul((others * weight[:, :, None]).swapaxes(1, 2), others)
                right += np.matmul(np.where(liked, 1 + weight, 0.0)[:, None, :], others)[:, 0]
                left[:, diagonal, diagonal] += reg * liked.sum(1)[:, None]
            found[rows] = _solutions(left, right)
    return found


class Rounds:
    """The ratings and true items in blocks, for chains of rounds of any setting."""

    def __init__(self, ratings: DataFrame, truth: DataFrame, user: str, item: str, score: str, blocks: int):
        self.blocks, self.spark = blocks, ratings.sparkSession
        self.users = rating_blocks(ratings, user, item, score, blocks)
        self.items = rating_blocks(ratings, item, user, score, blocks)
        self.from_users = routes(self.users, self.items, blocks)
        self.from_items = routes(self.items, self.users, blocks)
        self.truth = self._true_items(truth, user, item)
        self.item_counts = dict(self.items.map(lambda b: (b.index, len(b.own))).collect())
        self.most_needed = max(side.map(lambda b: len(b.need)).max() for side in (self.users, self.items))
        self.begun: list[RDD] = []

    def _true_items(self, truth: DataFrame, user: str, item: str) -> RDD:
        """Per block of users: the places of those with a true item, and per true item its user and id."""
        whole = [F.when(F.col(c).try_cast("int") == F.col(c), F.col(c).try_cast("int")).alias(c) for c in (user, item)]
        rows = truth.select(*whole).filter(F.col(user).isNotNull())
        rows = rows.select(user, F.coalesce(F.col(item).cast("long"), F.lit(NO_ITEM)).alias(item))

        def aligned(pair: tuple) -> tuple:
            block, pieces = pair
            ids, items = _joined(pieces, (np.int32, np.int64))
            known = np.isin(ids, block.own)
            places, of = np.unique(np.searchsorted(block.own, ids[known]), return_inverse=True)
            return places, of, items[known]

        return self.users.zip(_pieces(rows, user, self.blocks).glom()).map(aligned).persist(KEPT)

    def start(self, model: ALSModel) -> tuple[RDD, RDD]:
        """The factors of a model of Spark's as blocks."""
        rank, sides = model.rank, []

        def aligned(pair: tuple) -> np.ndarray:
            block, pieces = pair
            ids, factors = _joined(pieces, (np.int32, np.float32))
            return factors.reshape(len(ids), rank)[np.argsort(ids)]

        for blocks, frame in ((self.users, model.userFactors), (self.items, model.itemFactors)):
            pieces = _pieces(frame.select("id", "features"), "id", self.blocks).glom()
            sides.append(blocks.zip(pieces).map(aligned).persist(KEPT))
        self.begun += sides
        return sides[0], sides[1]

    def bundle(self, rank: int) -> int:
        """So many settings may go through their rounds in one chain: a task holds what it needs for all of them."""
        return max(1, BUNDLE_NUMBERS // max(1, self.most_needed * rank))

    def half(self, factors: RDD, gram: np.ndarray, route: RDD, target: RDD, weights: Sequence) -> tuple[RDD, np.ndarray]:
        """The factors of ``target`` from those of the other side, with the products of their columns.

        ``weights`` has (regParam, alpha) of each setting of the chain; factors are (settings, ids, rank).
        """

        def sent(pair: tuple) -> list:
            (index, ways), own = pair
            return [(d, (index, own[:, places])) for d, places in ways]

        def made(pair: tuple) -> np.ndarray:
            block, messages = pair
            near = [rows for _, (_, rows) in sorted(messages, key=lambda m: m[1][0])]
            near = np.concatenate(near, 1) if near else np.empty((len(gram), 0, gram.shape[1]))
            messages.clear()  # else they are held twice while the rows are solved
            return np.stack([solved(block, near[i], gram[i], *weights[i]) for i in range(len(weights))])

        messages = route.zip(factors).flatMap(sent).partitionBy(self.blocks, _same)
        found = target.zip(messages.glom()).map(made).persist(KEPT)
        return found, found.map(_gram).reduce(add)

    def chain(self, start: tuple[RDD, RDD], stops: Iterable[int], weights: Sequence, look: Callable) -> dict:
        """What ``look`` finds in the factors (users, items) after each number of rounds in ``stops``."""
        users, items = (side.map(lambda f: np.repeat(f[None], len(weights), 0)) for side in start)
        found, stops, gram = {}, set(stops), users.map(_gram).reduce(add)
        for done in range(max(stops) + 1):
            if done:
                old = users, items
                items, gram = self.half(users, gram, self.from_users, self.items, weights)
                users, gram = self.half(items, gram, self.from_items, self.users, weights)
                for side in old:
                    side.unpersist()
            if done in stops:
                found[done] = look(users, items)
        users.unpersist()
        items.unpersist()
        return found

    def recall(self, users: RDD, items: RDD, k: int, rank: int) -> list[float]:
        """Per setting the mean recall of the ``k`` best items of each user with factors and a true item, or 0."""
        state, blocks = self.truth.zip(users).map(_no_lists), self.blocks
        for some in self._groups(max(1, ITEM_NUMBERS // rank)):
            parts = self.items.zip(items).filter(lambda p, some=some: p[0].index in some)
            sent = parts.flatMap(lambda p: [(d, (p[0].own, p[1])) for d in range(blocks)])
            state = state.zip(sent.partitionBy(blocks, _same).glom()).map(lambda p: _better(*p, k))
        totals, count = state.map(_recalls).reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
        return [float(total / count) if count else 0.0 for total in totals]

    def _groups(self, most: int) -> list[set[int]]:
        """The blocks of items in groups of ``most`` items, a larger block alone."""
        groups, held = [], 0
        for index, count in sorted(self.item_counts.items()):
            if not groups or held + count > most:
                groups.append(set())
                held = 0
            groups[-1].add(index)
            held += count
        return groups

    def release(self) -> None:
        for rdd in (self.users, self.items, self.from_users, self.from_items, self.truth, *self.begun):
            rdd.unpersist()


def _gram(factors: np.ndarray) -> np.ndarray:
    exact = factors.astype(np.float64)
    return np.matmul(exact.swapaxes(1, 2), exact)


def _no_lists(pair: tuple) -> tuple:
    (places, of, items), factors = pair
    empty = [(np.empty((len(places), 0), np.int32), np.empty((len(places), 0), np.float32))] * len(factors)
    return factors[:, places], of, items, empty


def _better(state: tuple, messages: Sequence, k: int) -> tuple:
    """Each user's best list so far, per setting, with the items of the messages."""
    factors, of, items, lists = state
    for _, (more, others) in messages:
        lists = [_longer(*lists[i], factors[i], more, others[i], k) for i in range(len(lists))]
    return factors, of, items, lists


def _longer(ids: np.ndarray, scores: np.ndarray, factors: np.ndarray, more: np.ndarray, others: np.ndarray, k: int) -> tuple:
    lists = []
    for begin in range(0, max(len(factors), 1), step := max(1, CHUNK // max(len(more), 1))):
        rows = slice(begin, begin + step)
        new = np.hstack([scores[rows], factors[rows] @ others.T])
        names = np.hstack([ids[rows], np.broadcast_to(more, (len(new), len(more)))])
        if new.shape[1] > k:
            best = np.argpartition(-new, k - 1, axis=1)[:, :k]
            new, names = (np.take_along_axis(a, best, 1) for a in (new, names))
        lists.append((names, new))
    return tuple(np.concatenate(a) for a in zip(*lists))


def _recalls(state: tuple) -> tuple[np.ndarray, int]:
    factors, of, items, lists = state
    users, sums = factors.shape[1], np.zeros(len(lists))
    for i, (ids, _) in enumerate(lists):
        step = max(1, CHUNK // max(ids.shape[1], 1))
        hits = [(ids[of[b : b + step]] == items[b : b + step, None]).any(1) for b in range(0, len(of), step)]
        if hits:
            sums[i] = (np.bincount(of, np.concatenate(hits), users) / np.bincount(of, minlength=users)).sum()
    return sums, users
