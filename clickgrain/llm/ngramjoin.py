"""Near duplicates by word shingles: an exact Jaccard join over parity sketches.

The shingles of a document are hashed to 64 bits. Sets with similarity ``percent`` or more differ in
at most ``D`` shingles, which follows from the size of the smaller one. The hashes are dealt over
``m > D`` parts by their upper bits, and the hashes of a part are XOR-ed: the parity sketch of the
set. Two linked sets have at least ``m - D`` parts without a difference, so they agree in those
sketches, and a join on (size band, part, sketch) finds every link. ``m`` is large enough that a set
practically never has ``m - D`` empty parts; a set that has joins on its empty parts as well (its
partner then has as many), so nothing is lost.

A set needs no more than ``D + 1`` of its keys in a band: two linked sets have all but ``D`` of them in
common, so the rarest key they share is among the ``D + 1`` rarest of each, and the others, which are
those of common passages, are left out.

A group of sets with one key is never expanded into pairs: each member is first tested with the
smallest member. Of members that are in different components afterwards, up to ``CENTRES`` of a key
are tested with the rest of it; the sets of keys with more are joined by their rarest shingles. Before
the sets of a pair are compared, a parity sketch of 512 bits is: its Hamming distance is at most the
number of differing shingles. Sets of more than 512 shingles have a second sketch, of at least one bit
a shingle, as 512 bits tell nothing about sets that may differ in as many.

Equal sets are one class and tested once. Links are exact up to equal 64-bit hashes.

Nulls: a document without text or words has an empty set and links with nothing. A null doc_id is
never a component's id while another is there. Rows repeated exactly are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickgrain.llm.components import components
from clickgrain.llm.samples import aside
from clickgrain.llm.urlrules import _bits, build_filter, may_hold
from clickgrain.llm.words import U, lists, mix, sequence_hash, sequence_sums, signed, window_hashes, word_hashes, words
from clickgrain.session import discard, park

GROWTH = 1.5
RARE = 1e-6
SKETCH = 512
PER_TASK = 256
CENTRES = 16
#: Pairs are verified in rounds, so that the sets under way fill no more than a part of the disk.
PAIRS_PER_ROUND = 25_000
MOST_ROUNDS = 8


def _log_choose(m: int, d: int) -> float:
    return math.lgamma(m + 1) - math.lgamma(d + 1) - math.lgamma(m - d + 1)


@dataclass
class Bands:
    """Size bands: ``low[j]`` is the smallest size of band j, ``most[j]`` its D and ``parts[j]`` its m."""

    percent: int

    def __post_init__(self):
        rest = 100 - self.percent
        first = math.ceil(self.percent / rest) if rest else 1 << 31
        low, most, parts = [], [], []
        while first < 1 << 31:
            after = math.ceil(first * GROWTH)
            d = rest * (after - 1) // self.percent
            # Few enough sets of the band's smallest size fill only d parts (union bound), and parts of two shingles or more.
            m = d + 1
            while m < max(d + 1, first // 2) and _log_choose(m, d) + first * math.log(max(d, 0.5) / m) > math.log(RARE):
                m += max(1, m // 200)
            low.append(first)
            most.append(d)
            parts.append(m)
            first = after
        self.low, self.most, self.parts = (np.array(x, np.int64) for x in (low, most, parts))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size; -1 where only equal sets can link."""
        return np.searchsorted(self.low, sizes, "right") - 1

    def below(self, sizes: np.ndarray) -> np.ndarray:
        """The band of the smallest partner of each size."""
        return self.of(-(-sizes * self.percent // 100))


@dataclass
class Sets:
    """Sorted distinct shingle hashes of a block: those of text i are first[i]:first[i + 1]."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, w, n: int) -> Sets:
        codes, counts = word_hashes(w), np.diff(w.first)
        texts = counts.size
        grams = window_hashes(codes, n)
        owner = np.repeat(np.arange(texts), counts)
        whole = np.flatnonzero(owner[: grams.size] == owner[n - 1 : n - 1 + grams.size])
        short = np.flatnonzero((counts > 0) & (counts < n))
        hashes, owner = grams[whole], owner[whole]
        if short.size:
            hashes = np.concatenate([hashes, sequence_hash(sequence_sums(codes), w.first[short], w.first[short + 1])])
            owner = np.concatenate([owner, short])
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(hashes.size, bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        return cls(hashes, owner, np.searchsorted(owner, np.arange(texts + 1)))

    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            totals = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
            return totals[self.first[1:]] - totals[self.first[:-1]]

    def names(self) -> np.ndarray:
        """A hash of each whole set."""
        return mix(self._sums(mix(self.hashes ^ U(0x94D049BB)))) ^ mix(self._sums(self.hashes))

    def parity(self) -> np.ndarray:
        """(texts, SKETCH / 64): one bit toggled for each shingle."""
        texts = self.first.size - 1
        counts = np.bincount(self.owner * SKETCH + (self.hashes & U(SKETCH - 1)).astype(np.int64), minlength=texts * SKETCH)
        return np.packbits((counts & 1).astype(np.uint8).reshape(texts, SKETCH), axis=1, bitorder="little").view(U)

    def long_parity(self, texts: np.ndarray) -> list[bytes | None]:
        """Of each of ``texts`` with more than SKETCH shingles: a power of two of bits, one toggled for each shingle."""
        out = []
        for i in texts:
            own = self.hashes[self.first[i] : self.first[i + 1]]
            if own.size <= SKETCH:
                out.append(None)
                continue
            bits = 1 << int(own.size - 1).bit_length()
            counts = np.bincount((own & U(bits - 1)).astype(np.int64), minlength=bits)
            out.append(np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes())
        return out

    def keys(self, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, key, band, spare) for the parts of each set in its own band and in all of smaller partners.

        ``spare`` of a text's keys in the band may be left out, by an order that is the same for all texts.
        """
        sizes = self.sizes()
        own, least = bands.of(sizes), np.maximum(bands.below(sizes), 0)
        texts, keys, of, spare = [], [], [], []
        for down in range(int((own - least).max(initial=-1)) + 1):
            band = own - down
            some = band >= least
            mine = np.flatnonzero(some[self.owner])
            if not mine.size:
                continue
            owner, hashes = self.owner[mine], self.hashes[mine]
            part = (((hashes >> U(32)) * bands.parts[band[owner]].astype(U)) >> U(32)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])]))
            text, place = owner[start], part[start]
            texts.append(text)
            keys.append(_key(band[text], place, np.bitwise_xor.reduceat(hashes, start)))
            filled = np.bincount(text, minlength=sizes.size)
            of.append(band[text])
            spare.append(np.maximum(filled - bands.most[np.maximum(band, 0)] - 1, 0)[text])
            for i in np.flatnonzero(some & (filled <= bands.most[np.maximum(band, 0)])):
                empty = np.setdiff1d(np.arange(bands.parts[band[i]]), place[text == i])
                texts.append(np.full(empty.size, i))
                keys.append(_key(np.full(empty.size, band[i]), empty, np.zeros(empty.size, U)))
                of.append(np.full(empty.size, band[i]))
                spare.append(np.zeros(empty.size, np.int64))  # its partner may have no key for an empty part
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(texts), np.concatenate(keys), np.concatenate(of), np.concatenate(spare)


def _key(band: np.ndarray, part: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return mix(sketch ^ mix((band.astype(U) << U(40)) + part.astype(U)))


def _scan(docs: DataFrame, n: int, columns: list[str], make, types: str) -> DataFrame:
    """Runs ``make(batch, words, sets)`` over the texts, which are the last of ``columns``."""
    rows = docs.select(*columns)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(len(columns) - 1), lower=True):
                yield make(batch, w, Sets.of(w, n))

    return rows.mapInArrow(part, types)


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, a hash of the text, n_shingles, name of the set and its sketch s0 ..."""
    sketch = [f"s{i}" for i in range(SKETCH // 64)]

    def make(batch, w, sets):
        bits = sets.parity()
        made = [pa.array(sets.sizes()), pa.array(signed(sets.names())), *[pa.array(signed(np.ascontiguousarray(bits[:, i]))) for i in range(len(sketch))]]
        kept = [batch.column(i).slice(w.rows.start, len(w)) for i in range(2)]
        return pa.RecordBatch.from_arrays([*kept, *made], ["doc_id", "text_hash", "n_shingles", "name", *sketch])

    id_type = dict(docs.dtypes)["doc_id"]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return _scan(hashed, n, ["doc_id", "text_hash", "text"], make, f"doc_id {id_type}, text_hash long, n_shingles long, name long, " + ", ".join(f"{s} long" for s in sketch))


def key_rows(docs: DataFrame, n: int, bands: Bands, filled: np.ndarray | None = None) -> DataFrame:
    """(key, name) of all sets; with a filter, (key, name, band, spare) of the keys it may hold."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)  # None or at most 8 MB

    def make(batch, w, sets):
        text, key, band, spare = sets.keys(bands)
        table = sent.value
        if table is None:
            return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(sets.names()[text]))], ["key", "name"])
        if key.size:
            place, masks = _bits(key, table.shape[0])
            some = ((table[place] & masks) == masks).all(axis=1)
            text, key, band, spare = text[some], key[some], band[some], spare[some]
        made = [signed(key), signed(sets.names()[text]), band.astype(np.int16), spare.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["key", "name", "band", "spare"])

    return _scan(docs, n, ["text"], make, "key long, name long" + (", band short, spare int" if filled is not None else ""))


def shared_keys(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(key, centre, name) of the keys of two sets or more, each set with all but its most frequent ones.

    The rows a key has in the table order the keys, the same way for all sets; ``centre`` is its smallest name.
    """
    held = key_rows(docs, n, bands).groupBy("key").agg(F.min("name").alias("least"), F.max("name").alias("last"), F.count(F.lit(1)).alias("holders"))
    held = park(held.filter("least <> last").select("key", "holders"), "keys")
    rows = key_rows(docs, n, bands, build_filter(held, "key")).join(held, "key")
    rows = rows.groupBy("key", "name", "band").agg(F.first("spare").alias("spare"), F.first("holders").alias("holders"))
    frequent = F.row_number().over(Window.partitionBy("name", "band").orderBy(F.col("holders").desc(), "key"))
    rare = park(rows.withColumn("frequent", frequent).filter("frequent > spare").select("key", "name"), "rare-keys")
    discard(held)
    centres = rare.groupBy("key").agg(F.min("name").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return park(rare.join(centres.select("key", "centre"), "key").select("key", "centre", "name"), "shared")


def set_members(docs: DataFrame, n: int, filled: np.ndarray) -> DataFrame:
    """(name, n, long_sketch, members) of the sets whose name the filter may hold, once per name."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)

    def make(batch, w, sets):
        names = sets.names()
        place, masks = _bits(names, sent.value.shape[0])
        some = np.flatnonzero(((sent.value[place] & masks) == masks).all(axis=1) & (sets.sizes() > 0))
        members = [sets.hashes[sets.first[i] : sets.first[i + 1]].tobytes() for i in some]
        made = [pa.array(signed(names[some])), pa.array(sets.sizes()[some]), pa.array(sets.long_parity(some), pa.binary()), pa.array(members, pa.binary())]
        return pa.RecordBatch.from_arrays(made, ["name", "n", "long_sketch", "members"])

    rows = _scan(docs, n, ["text"], make, "name long, n long, long_sketch binary, members binary")
    return rows.groupBy("name").agg(*[F.first(c).alias(c) for c in ("n", "long_sketch", "members")])


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b). The set of ``a`` goes once to each group of about PER_TASK partners."""
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).alias("groups"))
    members = members.select("name", "members")
    dealt = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("grp"))
    partners = dealt.join(members, F.col("b") == F.col("name")).select("a", "grp", "b", "members")
    heads = dealt.select("a", "grp").distinct().join(members, F.col("a") == F.col("name")).select("a", "grp", F.lit(None).cast("long").alias("b"), "members")
    rows = partners.unionByName(heads).repartition("a", "grp").sortWithinPartitions("a", "grp", F.col("b").asc_nulls_first())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, U)
        for batch in batches:
            linked = []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = np.frombuffer(raw.as_buffer(), U)
                if b is None:
                    head = own
                    continue
                common = _common(head, own)
                if 100 * common >= percent * (head.size + own.size - common):
                    linked.append((a, b))
            out = np.array(linked, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return rows.select("a", "b", "members").mapInArrow(part, "a long, b long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _sketch_of(classes: DataFrame) -> list[str]:
    return [c for c in classes.columns if c[0] == "s" and c[1:].isdigit()]


def _alike(one: str, other: str, size: str, sketch: list[str], percent: int) -> Column:
    """Whether sizes and sketches of two sides, named by their prefixes, allow a link."""
    n, m = F.col(f"{one}_{size}"), F.col(f"{other}_{size}")
    distance = sum((F.bit_count(F.col(f"{one}_{c}").bitwiseXOR(F.col(f"{other}_{c}"))) for c in sketch), F.lit(0))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (distance * (100 + percent) <= (n + m) * (100 - percent))


def _promising(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Without the pairs whose sizes or sketches differ too much to link."""
    sketch = _sketch_of(classes)
    sides = [classes.select(F.col("name").alias(s), F.col("n_shingles").alias(f"{s}_n"), *[F.col(c).alias(f"{s}_{c}") for c in sketch]) for s in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.filter(_alike("a", "b", "n", sketch, percent)).select(*pairs.columns)


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Without the pairs (a, b) of large sets whose long sketches differ too much to link."""
    columns = pairs.columns
    sides = [members.select(F.col("name").alias(s), F.col("n").alias(f"{s}_n"), F.col("long_sketch").alias(f"{s}_long")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select(*columns, "a_n", "a_long", "b_n", "b_long")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, long_n, m, long_m = (batch.column(len(columns) + i) for i in range(4))
            kept = [
                x is None or y is None or _distance(x, y) * (100 + percent) <= (i + j) * (100 - percent)
                for i, x, j, y in zip(n.to_pylist(), long_n.to_pylist(), m.to_pylist(), long_m.to_pylist())
            ]
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(part, pairs.schema)


def _distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two long sketches; the longer one is folded to the bits of the other."""
    one, other = sorted((np.frombuffer(x, U), np.frombuffer(y, U)), key=len)
    return int(np.bitwise_count(one ^ np.bitwise_xor.reduce(other.reshape(-1, one.size), axis=0)).sum())


class Links:
    """Labels of the classes found linked so far."""

    def __init__(self, members: DataFrame, percent: int):
        self.members, self.percent = members, percent
        self.labels: DataFrame | None = None

    def labelled(self, rows: DataFrame, column: str, label: str) -> DataFrame:
        """``rows`` with the label of a column of names; a name without links is its own label."""
        if self.labels is None:
            return rows.withColumn(label, F.col(column))
        known = self.labels.select(F.col("node").alias("l_node"), F.col("label").alias("l_label"))
        return rows.join(known, F.col(column) == F.col("l_node"), "left").withColumn(label, F.coalesce("l_label", column)).drop("l_node", "l_label")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are not in one component yet."""
        both = self.labelled(self.labelled(pairs, "a", "label_a"), "b", "label_b")
        return both.filter("label_a <> label_b")

    def test_promising(self, pairs: DataFrame, classes: DataFrame) -> None:
        """Tests those of ``pairs`` that are apart and whose sketches allow a link."""
        open_pairs = park(_promising(self.apart(pairs).select("a", "b"), classes, self.percent), "promising")
        open_pairs = park(_near(open_pairs, self.members, self.percent), "pairs")
        if not open_pairs.isEmpty():
            self.test(open_pairs)

    def test(self, pairs: DataFrame) -> None:
        """Compares the sets of ``pairs`` (a, b) and joins the components of linked ones."""
        pairs, spark = pairs.select("a", "b"), pairs.sparkSession
        rounds = min(MOST_ROUNDS, max(1, math.ceil(pairs.count() / PAIRS_PER_ROUND)))
        parts = []
        for i in range(rounds):  # Shuffled sets of one round are deleted before the next.
            some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i)
            names = some.select(F.col("a").alias("name")).unionByName(some.select(F.col("b").alias("name"))).distinct()
            # Only the sets of these pairs are shuffled, besides a few that the filter lets through.
            needed = self.members.filter(may_hold(spark, build_filter(names, "name"), F.col("name")))
            parts.append(park(verified(some, needed, self.percent), "linked"))
        linked = reduce(DataFrame.unionByName, parts)
        if linked.isEmpty():
            return
        raised = components(self.apart(linked).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
        merged = raised.withColumnRenamed("node", "was").withColumnRenamed("label", "now")
        names = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node")))
        if self.labels is not None:
            names = names.unionByName(self.labels.select("node"))
        old = self.labelled(names.distinct(), "node", "old")
        self.labels = park(old.join(merged, F.col("old") == F.col("was"), "left").select("node", F.coalesce("now", "old").alias("label")), "labels")


def _mixed(links: Links, shared: DataFrame) -> DataFrame:
    """(key, name, label, minor, minors) of the keys of three sets or more in several components.

    ``minor`` members are outside the largest component of their key.
    """
    marked = links.labelled(shared, "name", "label")
    counted = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = counted.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"))
    groups = groups.filter((F.col("total") > F.col("top.n")) & (F.col("total") > 2))
    groups = groups.select("key", F.col("top.label").alias("major"), (F.col("total") - F.col("top.n")).alias("minors"))
    return park(marked.join(groups, "key").select("key", "name", "label", (F.col("label") != F.col("major")).alias("minor"), "minors"), "mixed")


def _others(links: Links, shared: DataFrame, classes: DataFrame) -> None:
    """Tests the members of one key that are in different components, beyond the pairs with the smallest.

    Keys with more than ``CENTRES`` minor members first get another star, around the member that meets
    most others over all its keys: in a group of changed copies that is the text they were made from.
    Then, where a key has up to ``CENTRES`` minor members, each is tested with the members in other
    components, which is linear in the members. The sets of the other keys are joined by rare shingles.
    """
    large = _mixed(links, shared).filter(F.col("minors") > CENTRES)
    if not large.isEmpty():
        met = large.join(large.groupBy("key").agg(F.count(F.lit(1)).alias("met")), "key")
        score = met.groupBy(F.col("name").alias("of")).agg(F.sum("met").alias("score"))
        hubs = met.join(score, F.col("name") == F.col("of")).groupBy("key").agg(F.max(F.struct("score", "name")).alias("hub"))
        around = large.join(hubs, "key").filter(F.col("name") != F.col("hub.name"))
        links.test_promising(around.select(F.col("hub.name").alias("a"), F.col("name").alias("b")).distinct(), classes)
    mixed = _mixed(links, shared)
    # The sketches are compared as part of the join, so only promising pairs leave it.
    sketch = _sketch_of(classes)
    few = mixed.filter(F.col("minors") <= CENTRES).join(classes.select(F.col("name").alias("of"), "n_shingles", *sketch), F.col("name") == F.col("of"))
    carried = ("name", "label", "n_shingles", *sketch)
    centres = few.filter("minor").select("key", *[F.col(c).alias(f"a_{c}") for c in carried])
    others = few.select(F.col("key").alias("same"), *[F.col(c).alias(f"b_{c}") for c in carried])
    alike = (F.col("key") == F.col("same")) & (F.col("a_label") != F.col("b_label")) & _alike("a", "b", "n_shingles", sketch, links.percent)
    met = centres.join(others, alike)
    pairs = met.select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")).distinct()
    links.test_promising(pairs, classes)
    many = park(mixed.filter(F.col("minors") > CENTRES).select("name").distinct(), "many")
    if not many.isEmpty():
        links.test_promising(_by_prefix(links, many, classes), classes)


def _by_prefix(links: Links, names: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components that may link, by their rarest shingles.

    Shingles are ordered by the number of these sets that hold them. Of a linked pair the smaller set
    has one of its first ``n - 2 p n / (100 + p) + 1`` shingles in common with the first
    ``n - p n / 100 + 1`` of the larger one, and what stands before the first common shingle in either
    counts as a difference. Copies that were each changed elsewhere begin with shingles of their own,
    so they do not meet.
    """
    percent, rest = links.percent, 100 - links.percent
    sets = names.join(links.members, "name").select("name", "members")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(raw.as_buffer()) // 8 for raw in batch.column(1)], np.int64)
            for some in np.array_split(np.arange(sizes.size), max(1, int(sizes.sum()) // 200_000)):
                if some.size:
                    taken = pa.array(np.repeat(some, sizes[some]))
                    hashes = np.concatenate([np.frombuffer(batch.column(1)[int(i)].as_buffer(), np.int64) for i in some])
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(0).take(taken), pa.array(np.repeat(sizes[some], sizes[some]))], ["shingle", "name", "n"])

    each = sets.mapInArrow(part, "shingle long, name long, n long")
    held = park(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "holders")
    common = each.join(held, "shingle")
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("name"))
    place = alone + F.row_number().over(Window.partitionBy("name").orderBy("holders", "shingle"))
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shortest = F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    first = common.withColumn("place", place).filter(F.col("place") <= longest).withColumn("brief", F.col("place") <= shortest)
    sketch = _sketch_of(classes)
    first = first.join(classes.select(F.col("name").alias("of"), *sketch), F.col("name") == F.col("of"))
    first = park(links.labelled(first, "name", "label").select("shingle", "name", "label", "n", "place", "brief", *sketch), "prefixes")
    low, high = ([F.col(c).alias(f"{s}_{c}") for c in ("name", "label", "n", "place", *sketch)] for s in ("low", "high"))
    low, high = first.filter("brief").select(F.col("shingle"), *low), first.select(F.col("shingle").alias("same"), *high)
    ordered = (F.col("low_n") < F.col("high_n")) | ((F.col("low_n") == F.col("high_n")) & (F.col("low_name") < F.col("high_name")))
    near = (F.col("low_place") + F.col("high_place") - 2) * (100 + percent) <= (F.col("low_n") + F.col("high_n")) * rest
    alike = near & _alike("low", "high", "n", sketch, percent)
    joined = low.join(high, (F.col("shingle") == F.col("same")) & (F.col("low_label") != F.col("high_label")) & ordered & alike)
    return joined.select(F.least("low_name", "high_name").alias("a"), F.greatest("low_name", "high_name").alias("b")).distinct()


def link_documents(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, name of its set.

    Besides, ``text_hash`` and ``label``: a number of its component, null for an empty set. Where one
    doc_id has several texts, components that share their smallest doc_id differ in the label.
    """
    bands = Bands(percent)
    docs = docs.select("doc_id", "text")
    sets = park(set_rows(docs, n), "sets")
    sketch = _sketch_of(sets)
    classes = sets.filter("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.min("n_shingles").alias("n_shingles"), *[F.min(c).alias(c) for c in sketch])
    classes = park(classes, "classes")
    shared = shared_keys(docs, n, bands)
    wanted = shared.select("name").distinct()
    links = Links(park(set_members(docs, n, build_filter(wanted, "name")), "members"), percent)
    stars = shared.filter("centre <> name").groupBy(F.col("centre").alias("a"), F.col("name").alias("b")).agg(F.count(F.lit(1)).alias("agreed"))
    stars = park(_promising(stars, classes, percent), "promising")
    stars = park(_near(stars, links.members, percent), "stars")
    # First every set with the centre it agrees with most; then what is still apart.
    best = stars.groupBy("b").agg(F.max(F.struct("agreed", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    links.test(best)
    links.test(park(links.apart(stars).select("a", "b"), "pairs"))
    _others(links, shared.select("key", "name"), classes)
    labelled = links.labelled(classes.select("name", "least"), "name", "label")
    roots = labelled.groupBy("label").agg(F.min("least").alias("root"))
    named = park(labelled.join(roots, "label").select(F.col("name").alias("c_name"), "root", "label"), "roots")
    for superseded in (shared, links.members):
        discard(superseded)
    joined = sets.select("doc_id", "text_hash", "n_shingles", "name").join(named, F.col("name") == F.col("c_name"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), "name", "text_hash", "label")


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, then of the smallest hash of the text.

    Of rows equal in both, the one whose other columns have the smallest hash. Texts that share a doc_id
    but are not linked are in different components, so each has a row. Rows without doc_id or without
    words are in no component and stay.
    """
    linked = link_documents(docs, n, percent).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    counted = linked.groupBy("label", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("top"))
    roots = park(first.select(F.col("top.doc_id").alias("root"), F.col("top.text_hash").alias("root_hash"), F.col("top.n").alias("n")), "kept")
    in_one = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = aside(docs, id=F.col("doc_id"), text_hash=F.xxhash64("text"), in_one=in_one)
    same = (F.col("id") == F.col("root")) & (F.col("text_hash") == F.col("root_hash"))
    single = rows.filter("in_one").join(roots.filter("n = 1"), same, "left_semi").select("kept_row")
    several = rows.filter("in_one").join(roots.filter("n > 1"), same, "left_semi")
    repeated = several.groupBy("id", "text_hash").agg(F.min_by("kept_row", F.xxhash64(F.to_json("kept_row"))).alias("kept_row"))
    return rows.filter("NOT in_one").select("kept_row").unionByName(single).unionByName(repeated.select("kept_row")).select("kept_row.*")
