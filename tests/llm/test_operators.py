"""The operators against SQL, brute force or held-out labels on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from clickgrain.llm import decontaminate, kdsearch, language, mixing, ngramjoin, secrets, sharding, substrings, thresholds, toxicity, urlrules
from clickgrain.llm.catalog import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_cut_points_are_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(k), int(w)) for g, k, w in zip(rng.integers(0, 3, 400), rng.integers(0, 1 << 60, 400), rng.integers(0, 50, 400))]
    rows += [(3, 5, 10)] * 4 + [(4, 7, 1)]
    budgets = [(0, 900.0), (1, 0.0), (2, 1e9), (3, 25.0), (4, 0.4)]
    made = thresholds.cut_points(spark.createDataFrame(rows, "grp long, key long, weight long"), spark.createDataFrame(budgets, "grp long, budget double"))
    found = {r.grp: r for r in made.collect()}
    for group, budget in budgets:
        sums = Counter()
        for g, key, weight in rows:
            if g == group:
                sums[key] += weight
        reached, best = 0, 0
        for key in sorted(sums):
            reached += sums[key]
            best = min(best, reached, key=lambda s: (abs(s - budget), s))
        assert found[group].below == best == sum(w for g, k, w in rows if g == group and k < found[group].cut)


@pytest.mark.parametrize("known", [False, True])
def test_cut_points_divide_between_the_keys_there_are(spark, monkeypatch, known):
    """Close keys with nothing around them take few rounds, each of which is a query with plans and threads on the driver."""
    written, park = [], thresholds.park
    monkeypatch.setattr(thresholds, "park", lambda df, label: written.append(label) or park(df, label))
    start = 123 << 45
    rows = spark.range(1500).selectExpr("id % 2 AS grp", f"CAST({start} AS BIGINT) + 3 * id AS key", "1L AS weight")
    rows = rows.unionByName(rows.filter("grp = 1")).unionByName(spark.createDataFrame([(2, 9, 5)], "grp long, key long, weight long"))
    budgets = spark.createDataFrame([(0, 300.0), (1, 601.2), (2, 1.0)], "grp long, budget double")
    if known:
        budgets = budgets.join(rows.groupBy("grp").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("n")), "grp")
    found = {r.grp: (r.cut, r.below) for r in thresholds.cut_points(rows, budgets).collect()}
    assert found == {0: (start + 3 * 600, 300), 1: (start + 3 * 601 + 1, 602), 2: (9, 0)}
    assert len(written) <= (2 if known else 3)


def test_mix_takes_near_its_targets(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert r.taken <= 2 * r.size
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size
    total = sum(r.size for r in rows)
    assert sum(own[0].target for own in by_source.values()) == pytest.approx(1.5 * total)
    assert mixing.mixed_documents(docs).count() == sum(r.times for r in rows)


def test_shards_are_even_and_gapless(docs, texts):
    rows = sharding.shard_table(docs, shards=8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, slots, of_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of_text[raw].add(r.shard)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.2 * sum(sizes.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_shards_take_few_queries(spark, monkeypatch):
    written = []
    for module in (sharding, thresholds):
        monkeypatch.setattr(module, "park", lambda df, label, park=module.park: written.append(label) or park(df, label))
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 90 AS INT)) || id AS text", "IF(id % 3 = 0, 'de', 'en') AS lang", "IF(id % 7 < 5, 'a', 'b') AS source")
    sizes = Counter()
    for r in sharding.shard_table(docs, shards=8).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values())
    assert Counter(written) == {"sizes": 1, "points": 1, "nodes": 3, "boundary": 3, "level": 3}


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_shards_keep_equal_texts_together(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    made = sharding.shard_table(docs, shards=8)
    torn = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(made, "doc_id").groupBy("t").agg(F.countDistinct("shard").alias("n"))
    assert torn.filter("n > 1").isEmpty()
    sizes = [r.s for r in made.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.3 * sum(sizes) / 8


def test_shards_split_a_hot_text(spark):
    rows = [(i, "the same text again and again", "en", "a") for i in range(600)] + [(600 + i, f"text number {i} of its own", "de", f"s{i % 5}") for i in range(600)]
    made = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=5).collect()
    sizes = Counter()
    for r in made:
        sizes[r.shard] += r.size
    assert len(sizes) == 5 and max(sizes.values()) < 1.1 * min(sizes.values())


def brute_components(texts, n, percent):
    sets = {}
    for i, text in texts.items():
        words = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_equals_brute_force(docs, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.link_documents(docs).collect()}
    assert found == brute_components(texts, 4, 85)


def test_ngram_join_finds_every_link_in_groups(spark, monkeypatch):
    """Chains, short texts and sets that agree with the smallest of their key but do not link with it."""
    monkeypatch.setattr(ngramjoin, "CENTRES", 1)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    base = list(rng.choice(vocabulary, 90))
    rows, chain = [], base
    for _ in range(14):  # every text links with its neighbours, the ends do not link
        chain = chain[:]
        chain[int(rng.integers(0, len(chain)))] = "x" + str(rng.integers(0, 99))
        rows.append(" ".join(chain))
    rows += [" ".join(base[:k]) for k in (0, 1, 3, 4, 5, 8, 9, 10, 11, 12, 30, 31, 33, 60, 62, 88, 89)]
    rows += ["A b C", "a B c", "a b c d", None, "", "  \n", rows[3], rows[3]]
    rows += [" ".join(base[:40] + list(rng.choice(vocabulary, 5))) for _ in range(6)]
    texts = dict(enumerate(rows))
    made = ngramjoin.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()} == brute_components(texts, 4, 85)


@pytest.mark.parametrize("percent", [40, 50, 60, 66])
def test_ngram_join_at_low_similarity(spark, percent):
    """Pairs alone whose sizes lie up to three bands apart."""
    rng = np.random.default_rng(percent)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    texts = {}
    for size in (3, 7, 12, 20, 31, 47, 60, 95, 140):
        for share in (percent / 100, percent / 100 + 0.01, percent / 100 + 0.1, 0.97):
            base = fresh(size + 3)
            texts[len(texts)] = " ".join(base)
            texts[len(texts)] = " ".join(base + fresh(max(1, int(size / share) - size)))
    made = ngramjoin.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()} == brute_components(texts, 4, percent)


def test_one_of_each_where_ids_repeat(spark):
    one, two, three = ("a b c d e f g h", "q r s t u v w x", "k l m n o p q r")
    rows = [(1, one, "x"), (1, two, "x"), (1, one, "y"), (2, one, "x"), (2, three, "x"), (3, two, "x"), (None, one, "x"), (4, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    kept = [tuple(r) for r in ngramjoin.one_of_each(docs).collect()]
    assert sorted((i, t) for i, t, _ in kept if i and t) == [(1, one), (1, two), (2, three)]
    assert sum(i is None for i, *_ in kept) == 1 and sum(i == 4 for i, *_ in kept) == 2
    assert sorted(kept, key=str) == sorted(map(tuple, ngramjoin.one_of_each(docs.repartition(5)).collect()), key=str)


def test_parity_bounds_the_difference():
    from clickgrain.llm.words import words
    import pyarrow as pa

    sets = ngramjoin.Sets.of(next(words(pa.array(["a b c d e f g h i j", "a b c d e f g h x y z"]), lower=True)), 2)
    bits = [np.unpackbits(row.view(np.uint8)) for row in sets.parity()]
    own = [set(sets.hashes[sets.first[i] : sets.first[i + 1]].tolist()) for i in range(2)]
    assert (bits[0] != bits[1]).sum() <= len(own[0] ^ own[1])
    bands = ngramjoin.Bands(85)
    for size in range(6, 3000, 7):
        band = bands.of(np.array([size]))[0]
        assert bands.most[band] >= 15 * size // 85 and bands.parts[band] > bands.most[band]


def test_long_sketches_bound_the_difference():
    """Also of sets whose sketches have different lengths; unrelated sets of any size are told apart."""
    import pyarrow as pa

    from clickgrain.llm.words import words

    base, other = [f"w{i}" for i in range(1100)], [f"x{i}" for i in range(1100)]
    texts = [base, base[:1000], base[:980] + other[:60], base[:550] + other[:550], other, base[:300]]
    sets = ngramjoin.Sets.of(next(words(pa.array([" ".join(t) for t in texts]), lower=True)), 4)
    long, own = sets.long_parity(np.arange(6)), [set(sets.hashes[sets.first[i] : sets.first[i + 1]].tolist()) for i in range(6)]
    assert [x and 8 * len(x) for x in long] == [2048, 1024, 2048, 2048, 2048, None]
    for i in range(5):
        for j in range(5):
            assert ngramjoin._distance(long[i], long[j]) <= len(own[i] ^ own[j])
    allowed = 15 * (len(own[0]) + len(own[4])) // 185
    assert ngramjoin._distance(long[0], long[4]) > 2 * allowed and ngramjoin._distance(long[0], long[3]) > allowed


def test_ngram_join_leaves_out_keys_of_common_passages(spark, monkeypatch):
    """Texts that share a passage only never meet; linked ones among them do."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(120)]
    rows = [passage + [f"f{x}" for x in rng.integers(0, 10**9, 100 + i % 15)] for i in range(160)]
    rows += [rows[i][:150] + ["changed"] * (i % 7) + rows[i][150 + i % 7 :] for i in range(0, 40, 3)] + [rows[5][:200], rows[6][:180]]
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    joined, by_prefix = [], ngramjoin._by_prefix
    monkeypatch.setattr(ngramjoin, "_by_prefix", lambda *a: joined.append(a) or by_prefix(*a))
    made = ngramjoin.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()} == brute_components(texts, 4, 85)
    assert not joined


def brute_repeats(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    counts = Counter(tuple(w[j : j + window]) for w in words.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if counts[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substrings_equal_brute_force(docs, texts):
    made = substrings.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == brute_repeats(texts, 35)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in made)


def test_substrings_at_branches_and_ends(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"f{x}" for x in rng.integers(0, 10**9, n)]
    passage, other = fresh(70), fresh(50)
    rows = [fresh(20) + passage + fresh(30) for _ in range(3)]
    rows += [fresh(9) + passage[:40] + fresh(5), passage[30:], passage[10:45], passage[:34], fresh(50), other + fresh(3) + other]
    rows += [["same"] * 90, passage + other, fresh(40)]
    rows.append(rows[-1])
    texts = {i: " ".join(r) for i, r in enumerate(rows)} | {90: None, 91: "", 92: "\t\n"}
    made = substrings.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == brute_repeats(texts, 35)


def test_secrets_equal_plain_patterns(spark, sf_dir, texts):
    plain = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), "access": ("AKIA[A-Z0-9]+", 20, 0), "hex": ("[0-9a-f]+", 24, 0)}
    for r in QUERIES["op8_secrets"](spark, sf_dir).collect():
        found = [(m.start(), k, m.end()) for k, (p, least, g) in enumerate(plain.values()) for m in re.finditer(p, texts[r.doc_id] or "") if len(m[g]) >= least]
        text = ",".join(f"{list(plain)[k]}:{s}:{e}" for s, k, e in sorted(found))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in found) for k in range(3)]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_guess_costs():
    cheap = ["password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "12345678", "2019-04-01", "abcabcabcabc", "p4ssw0rd"]
    dear = ["x9Kq2vLm8Zt4", "b7db7aa4a5fcc78305", "hT5$kk!0pQz7"]
    assert max(map(secrets.guess_cost, cheap)) < secrets.LEAST_COST < min(map(secrets.guess_cost, dear))
    spans = secrets.text_spans("é pwd: x9Kq2vLm8Zt4, pwd: qwerty123456 token='ab'", [])
    assert [s[:3] for s in spans] == [("guess", 7, 19)]


@pytest.mark.parametrize("times", [2, 10, 20, 60, 20_000])
def test_long_repeats_and_walks_stay_cheap(times):
    assert secrets.guess_cost("ab1" * times) < secrets.LEAST_COST
    assert secrets.guess_cost("7" * times) < secrets.LEAST_COST
    assert not secrets.text_spans("password: " + "ab1" * times, [])[1:]
    assert secrets.guess_cost("qwertyuiop" + "x9Kq2vLm8Zt4" + "ab1" * times) > secrets.LEAST_COST


def brute_cost(value):
    """Every segmentation of ``value``; repeats and walks are followed character by character."""
    from functools import cache
    from math import log10

    low, plain, n = value.lower(), value.lower().translate(secrets.LEET), len(value)

    def segments(i):
        yield i + 1, secrets._brute(value[i])
        for j in range(i + 3, n + 1):
            if plain[i:j] in secrets.RANK:
                yield j, 0.3 + log10(secrets.RANK[plain[i:j]] + 1) + 0.3 * (plain[i:j] != low[i:j]) + 0.3 * (value[i:j] != low[i:j])
        if found := secrets.DATE.match(low, i):
            yield found.end(), 0.3 + (secrets.LOG_YEAR if found.end() - i == 4 else secrets.LOG_DAY)
        j = i + 1
        while j < n and secrets._near(low[j - 1], low[j]):
            j += 1
            rows = [secrets.PLACES[c][0] for c in low[i:j]]
            if j - i >= 3:
                yield j, 0.3 + log10(47 * (j - i)) + 0.6 * sum(a != b for a, b in zip(rows[1:], rows[2:]))
        for block in (1, 2, 3, 4):
            times = 1
            while low[i + times * block : i + (times + 1) * block] == low[i : i + block] and i + (times + 1) * block <= n:
                times += 1
            if times > 1 and times * block >= 3:
                yield i + times * block, 0.3 + sum(map(secrets._brute, low[i : i + block])) + log10(times)

    @cache
    def cheapest(i):
        return 0.0 if i == n else min(cost + cheapest(j) for j, cost in segments(i))

    return cheapest(0)


def test_guess_cost_equals_all_segmentations():
    rng = np.random.default_rng(9)
    parts = ["password", "P4ssw0rd", "qwer", "asdfgh", "zaqxsw", "2019-04-01", "1999", "aaa", "abab", "xyzxyz", "7", "K", "!", "m", "1q2w"]
    for _ in range(300):
        value = "".join(rng.choice(parts, int(rng.integers(1, 6))))[:28]
        assert secrets.guess_cost(value) == pytest.approx(brute_cost(value))


def test_languages_held_out(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op10_language"](spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_sample_is_bounded_where_ids_are_null_or_repeat(spark, monkeypatch):
    """A third of the rows is one row, the others have no id."""
    rows = [(7, "the same text", "en")] * 400 + [(None, f"text number {i} without an id", "en") for i in range(800)]
    taken = []
    monkeypatch.setattr(language, "fit", lambda texts, langs: taken.extend(texts))
    language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=60)
    assert 15 <= len(taken) <= 120 and len(set(taken)) == len(taken)


def test_network_slopes():
    """Backpropagation against finite differences, at points where no gate is at its end."""
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    table, weights = rng.normal(0.4, 0.05, (24, 256)), rng.normal(0, 0.05, (24, 8))
    out = rng.normal(size=(5, 8, 3))
    trace = []
    language.run_layer(table, weights, grid, False, trace)
    d_table, d_weights = language._layer_slopes(weights, grid, trace, out)
    for array, slope, at in ((weights, d_weights, (3, 2)), (weights, d_weights, (20, 5)), (table, d_table, (18, int(grid[1, 1])))):
        moved = []
        for step in (1e-2, -1e-2):
            array[at] += step
            moved.append((language.run_layer(table, weights, grid, False) * out).sum())
            array[at] -= step
        assert (moved[0] - moved[1]) / 2e-2 == pytest.approx(slope[at], abs=2e-3)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in QUERIES["op2_toxicity"](spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = ([r for r in held if truth[r.doc_id] == k] for k in (1, 0))
    assert toxic and np.mean([r.predicted for r in toxic]) >= 0.85
    assert np.mean([r.predicted for r in clean]) <= 0.03


def test_toxic_curve_does_not_move_with_the_sample():
    """The curve of half the clean rows, each standing for two, is near that of all; unweighted it isn't."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 1, (2000, 2)), rng.normal(1, 1, (200, 2))])
    y = np.repeat([0.0, 1.0], [2000, 200])
    some = np.concatenate([np.arange(0, 2000, 10), np.arange(2000, 2200)])
    weights = np.where(y[some] == 0, 10.0, 1.0)
    whole, part, plain = (toxicity._logistic(x[i], y[i], w) for i, w in ((slice(None), np.ones(2200)), (some, weights), (some, np.ones(some.size))))
    assert abs(part[0] - whole[0]) < 0.5 < abs(plain[0] - whole[0])


def test_marginals_equal_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    emission, transitions, start = rng.normal(size=5), rng.normal(size=(2, 2)), 0.3
    odds, valid = np.exp(emission)[:, None], np.ones((5, 1), bool)
    forward, backward = toxicity.forward_backward(odds, valid, transitions, start)
    paths = list(product((0, 1), repeat=5))
    weights = np.array([np.exp(start * p[0] + sum(e * y for e, y in zip(emission, p)) + sum(transitions[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    for t in range(5):
        one = weights[[p[t] == 1 for p in paths]].sum()
        assert (forward * backward)[t, 0] == pytest.approx(one / (weights.sum() - one))


def test_toxic_spans_are_code_points(spark):
    model = toxicity.fit(["du bist ein idiot heute", "was für ein Idiot!", "idiot", "IDIOT du"] * 3 + ["ein schöner tag heute", "du bist nett", "was für ein tag"] * 4, [1] * 12 + [0] * 12)
    rows = toxicity.score(spark.createDataFrame([(1, "é ö idiot!"), (2, ""), (3, None)], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end) for s in rows[0].spans] == [(4, 9)] and rows[0].predicted == 1
    assert all(0 <= r.score < 0.5 and not r.spans for r in rows[1:])


def test_leaks_with_substitutions(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    item, short = fresh(40), fresh(9)
    changed = item[:]
    for k in (5, 14, 23, 31):
        changed[k] = "other"
    rows = [fresh(30) + item + fresh(10), fresh(3) + changed, [w.upper() + "," for w in item], short + fresh(4), fresh(60), item[:7] + fresh(20), item[12:32], []]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)] + [(90, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "too short"), (4, None)], "item_id long, text string")
    found = {r.doc_id: (r.items, r.n_matched) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {i for i, (x, _) in found.items() if x} == {0, 1, 2, 3, 6}
    assert found[0] == ([1], 40) and found[1] == ([1], 36) and found[3] == ([2], 9) and found[6] == ([1], 20)
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, items).collect()) == [4, 5, 7, 90]


def test_leaks_of_the_benchmark(spark, sf_dir, texts):
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {r.doc_id for r in QUERIES["op7_decontamination"](spark, sf_dir).collect() if r.leaked}
    grams = {tuple(w[j : j + 8]) for w in items for j in range(len(w) - 7)}
    brute = {i for i, t in texts.items() if (w := WORD.findall((t or "").lower())) and any(tuple(w[j : j + 8]) in grams for j in range(len(w) - 7))}
    assert found >= brute and len(found) <= len(brute) + 2


def test_kd_search_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)] + [(300 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(200)]
    rows += [(600, None), (601, [1.0, None, 0.0, 0.0]), (602, [float("nan")] * 4), (603, [float("inf"), 0.0, 0.0, 0.0]), (604, []), (700, [1.0, 2.0]), (800, [2.0, 1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    found = [tuple(r) for r in kdsearch.top_k(kdsearch.integer_vectors(table), F.col("vec_id") % 100 == 0, 10).collect()]
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    brute = []
    for q in (i for i in ints if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        brute += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    assert sorted(found) == sorted(brute)


def test_url_filter_removes_false_positives(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST_BLOCKS", 1)
    monkeypatch.setattr(urlrules, "KEYS_PER_BLOCK", 1)
    rules = [(f"h{i}.example", f"/{i}", "block") for i in range(300)] + [("example.net", "/en/", "allow"), ("net", "/", "block"), (None, "/", "block")]
    urls = ["http://A.example.net/en/x?y", "https://example.net/de/", "http://net", "http://xexample.net/en/", "h7.example/7", "ftp://h7.example/77#z", "http://sub.h8.example/8", "http://h8.example/9", "", None, "a://b://c"]
    made = urlrules.judge(spark.createDataFrame([(u,) for u in urls + urls], "url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    found = {r.url: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert found["http://A.example.net/en/x?y"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert found["https://example.net/de/"][2:] == ("net/", "block") and found["http://net"] == ("net", "", None, None)
    assert found["http://xexample.net/en/"][2] == "net/" and found["h7.example/7"] == ("", "", None, None)
    assert found["ftp://h7.example/77#z"][2] == "h7.example/7" and found["http://sub.h8.example/8"][2] == "h8.example/8"
    assert found["http://h8.example/9"][2] is None and found["a://b://c"][:2] == ("b:", "//c") and len(found) == 10
