"""Line removal, vector codes and phrases against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickgrain.llm import hotkeys, linededup, phrases, vectorcodes

LOWER = {c: c + 32 for c in range(65, 91)}
BLANKS = " \t\n\x0b\f\r"


@pytest.fixture()
def rows_of(spark, tmp_path):
    """Writes (doc_id, text, lang) rows as a table with further columns whose names clash."""

    def make(rows):
        made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        made = made.select("*", *[F.lit(1).alias(c) for c in ("key", "hash", "n", "first", "gone", "phrase", "size", "words")])
        made.write.parquet(f"{tmp_path}/rows")
        return spark.read.parquet(f"{tmp_path}/rows")

    return make


# Lines -------------------------------------------------------------------------------------------


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANKS).translate(LOWER)
            if len(key) >= least:
                holders[key].add(math.inf if doc_id is None else doc_id)
    out = []
    for doc_id, text, _ in rows:
        own, lines = math.inf if doc_id is None else doc_id, (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(BLANKS).translate(LOWER)) < least or len(holders[k]) < 2 or min(holders[k]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


ODD_LINES = [
    (None, None, None),
    (5, "", "en"),
    (7, "\n\n", None),
    (9, "the same line of text\n\tThe SAME line of text \r\nshort\nshort", "en"),
    (3, "unlike\n  the same line of text\x0b", "de"),
    (3, "unlike\n  the same line of text\x0b", "de"),
    (4, "the same line of text\x1c\nonly in the rows of one id", "en"),
    (4, "only in the rows of one id\nonly without an id, twice", "en"),
    (None, "only without an id\nthe same line of text\nonly without an id, twice", "en"),
    (None, "only without an id", "en"),
    (11, "ÄÖÜ äöü ÄÖ\nnine char\n123456789\U0001f600", "fr"),
    (12, "äÖÜ äöü ÄÖ\nnine char\n123456789\U0001f600", "fr"),
    (13, "\n".join(f"a long text's line {i % 700}" for i in range(30_000)), "en"),
    (14, "\n".join(f"a long text's line {i}" for i in range(650, 30_000)), "en"),
]


def test_lines_against_brute_force(rows_of):
    rows = ODD_LINES + [(100 + i, f"line number {i % 40} here\nand here {i}\nthe line that all have", "en") for i in range(1500)]
    made = linededup.drop_repeated_lines(rows_of(rows)).collect()
    assert Counter(tuple(r) for r in made) == brute_lines(rows)


def test_lines_without_rows(rows_of):
    assert linededup.drop_repeated_lines(rows_of([])).collect() == []


def test_once_seen_has_no_false_negatives(monkeypatch):
    monkeypatch.setattr(linededup, "MOST_BLOCKS", 64)
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64))
    once = linededup.OnceSeen()
    assert once.seen(hashes[:4000]).mean() < 0.02  # the share of false hits
    assert once.seen(hashes[2000:]).sum() >= 2000 and once.seen(hashes).all()
    assert len(once.filters) > 1


def test_filter_passes_few_single_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    each = docs.select("doc_id", F.explode(linededup.long_keys(F.col("text"), 10)).alias("key")).distinct()
    holders = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    passed = holders.withColumn("passed", linededup.may_hold(spark, linededup.twice_seen(docs), F.xxhash64("key")))
    assert passed.filter("n > 1 AND NOT passed").count() == 0
    assert passed.filter("n = 1 AND passed").count() <= 0.02 * passed.count()


def test_attach_deals_a_hot_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    made = hotkeys.attach(rows, side, ["k"], "n", null_safe=True)
    expected = {r.k: r.most for r in side.collect()}
    assert all(r.most == expected[r.k] for r in made.collect()) and made.count() == 6000


# Vectors -----------------------------------------------------------------------------------------


def brute_codes(vectors, parts, entries, rounds, scale):
    points = [[math.floor(scale * x) for x in v] for v in vectors]
    width = len(points[0]) // parts
    cut = [[tuple(p[i * width : (i + 1) * width]) for p in points] for i in range(parts)]
    books = [list(own[:entries]) for own in cut]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for own, book in zip(cut, books):
            sums = defaultdict(list)
            for x in own:
                sums[near(x, book)[0]].append(x)
            for e, some in sums.items():
                book[e] = tuple(sum(c) // len(some) for c in zip(*some))
    final = [[near(x, book) for x in own] for own, book in zip(cut, books)]
    return books, [([own[i][0] for own in final], sum(own[i][1] for own in final)) for i in range(len(points))]


@pytest.mark.parametrize(("width", "parts", "count"), [(2, 4, 700), (8, 2, 300), (1, 3, 400), (3, 8, 5)])
def test_codes_against_brute_force(spark, width, parts, count, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK", 16)
    rng = np.random.default_rng(width)
    # Coarse values make ties between entries and equal vectors.
    vectors = (rng.integers(-6, 7, (count, width * parts)) / 8).astype(np.float32)
    vectors[count // 2 :] = vectors[0]
    rows = [(i, [float(x) for x in v], i % 3 or None) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    made = vectorcodes.compress(frame, parts, 16, 4, 16)
    books, expected = brute_codes(vectors.tolist(), parts, 16, 4, 16)
    assert made.books.tolist() == [[list(e) for e in book] for book in books]
    coded = vectorcodes.with_label_errors(made.rows).collect()
    assert {r.vec_id: (list(r.codes), r.error) for r in coded} == dict(enumerate(expected))
    for label in (None, 1, 2):
        assert {r.label_error for r in coded if r.label == label} == {sum(r.error for r in coded if r.label == label)}


def test_codes_of_odd_rows(spark):
    good = [0.25, -0.5, 1.0, 0.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.1, None, 0.2, 0.3], 1), (4, [float("nan")] * 4, 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (0, [1.0, 2.0, 3.0], 1)]
    rows += [(7, good, None), (7, [0.5, 0.5, 0.5, 0.5], 2), (7, good, None), (None, good, 2), (8, [*good, *good], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("row"), F.lit(1).alias("v"), F.lit(1).alias("error"))
    made = vectorcodes.compress(frame, 2, 16, 2, 16)
    coded = Counter((r.vec_id, r.label, r.error) for r in made.rows.collect())
    assert coded == {(7, 2, 0): 1, (7, None, 0): 2, (None, 2, 0): 1}
    assert made.books.shape == (2, 4, 2)
    for nothing in (frame.limit(0), frame.filter("vec_id < 6")):
        empty = vectorcodes.compress(nothing, 2, 16, 2, 16)
        assert vectorcodes.with_label_errors(empty.rows).collect() == []


def test_hilbert_curve_visits_neighbours():
    for axes, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
        place = vectorcodes.hilbert_index(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(5)
    for _ in range(200):
        points, book = rng.integers(-9, 10, (6, 3)) + rng.integers(-20, 20, 3), rng.integers(-25, 26, (8, 3))
        listed = vectorcodes.shortlists(points.min(axis=0)[None], points.max(axis=0)[None], book)[0]
        squares = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        assert listed[(squares == squares.min(axis=1, keepdims=True)).any(axis=0)].all()


def test_blocks_settle_as_a_whole_and_lists_are_short(spark):
    rng = np.random.default_rng(9)
    centres = rng.uniform(-1, 1, (16, 2))
    # The first 16 ids are the centres themselves, so they start the codebook.
    vectors = np.concatenate([centres, centres[rng.integers(0, 16, 8000)] + rng.normal(0, 0.01, (8000, 2))])
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    rows = vectorcodes.integer_vectors(frame, 4096, 1)
    books = vectorcodes.start_codebooks(rows, 1, 16)
    found = vectorcodes.round_sums(vectorcodes.write_blocks(rows, 1, 2), books).collect()
    assert sum(r.n for r in found) == 8016
    assert found[0].taken > 0.2 * found[0].met


# Phrases -----------------------------------------------------------------------------------------


def brute_phrases(rows, order, at_least, covered, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            if words:
                totals[lang or "und"] += len(words)
            for m in range(1, order + 1):
                for i in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[i : i + m])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= at_least}
        longer = Counter()
        for g, a in candidates.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longer[g[i : i + m]] = max(longer[g[i : i + m]], a)
        kept = []
        for g, a in candidates.items():
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if 100 * longer[g] < covered * a:
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


ODD_PHRASES = [(None, None, None), (1, "", "en"), (2, " \t..!?\n", None), (3, "one", "und"), (4, "One two. ONE TWO\tthree;one two", None), (4, "One two. ONE TWO\tthree;one two", None)]


@pytest.mark.parametrize(("order", "at_least", "top"), [(3, 2, 2000), (4, 2, 2000), (2, 3, 5), (3, 10, 7)])
def test_phrases_against_brute_force(rows_of, order, at_least, top):
    rng = np.random.default_rng(order)
    vocabulary = ["a", "b", "cé", "D", "e'", "\U0001f600x", "\x85y"]
    rows = ODD_PHRASES + [(i, "".join(vocabulary[j] + " \t. ,"[k] for j, k in zip(rng.integers(0, 7, 60), rng.integers(0, 6, 60) % 5)), ["en", "de", None][i % 3]) for i in range(60)]
    rows.append((99, "a very long text of words " * 20_000, "en"))
    made = {tuple(r) for r in phrases.collocations(rows_of(rows), order, at_least, 50, top).collect()}
    assert made == brute_phrases(rows, order, at_least, 50, top)


def test_phrases_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = {tuple(r) for r in phrases.collocations(docs).collect()}
    assert made == brute_phrases([tuple(r) for r in docs.collect()], 3, 10, 50, 2000)


def test_phrase_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_007
    frame = spark.createDataFrame([(big, big + 2, big + 9)], "a long, l long, r long")
    assert frame.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * big * big // ((big + 2) * (big + 9))


def test_phrases_without_rows(rows_of):
    assert phrases.collocations(rows_of([])).collect() == []


def test_digest_is_of_all_entries():
    coded = vectorcodes.Coded(np.array([[[1, -2]], [[3, 4]]]), None)
    assert coded.digest() == hashlib.sha256(b"1,-2,3,4").hexdigest()
