"""The evaluator and the grid search: real fits on the small tables, and the jobs they run together."""

import itertools
import random
import threading
import time

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import functions as F

from clickgrain.catalog.learning import ratings
from clickgrain.operators import ranking
from clickgrain.plans import recommend, rounds, tuning
from clickgrain.plans.together import run_together


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return ratings(spark, sf_dir)


def test_grid_search_equals_one_fit_after_the_other(data):
    grid = {"rank": (2, 5), "maxIter": (1, 3), "regParam": (0.1,), "alpha": (1.0, 40.0)}
    tried = recommend.grid_search(data["train"], data["test"], grid, k=5, threads=3, batch=3).orderBy("setting").collect()
    assert [(r.rank, r.maxIter, r.regParam, r.alpha) for r in tried] == list(itertools.product(*grid.values()))
    for r in tried:
        model = recommend.fit(data["train"], rank=int(r.rank), maxIter=int(r.maxIter), regParam=r.regParam, alpha=r.alpha, numUserBlocks=1, numItemBlocks=1)
        assert r.recall == pytest.approx(recommend.evaluate(data["test"], model, 5).first()["avg_recall_at_k"])


def test_best_setting_is_the_first_of_equal_ones(spark):
    tried = spark.createDataFrame([(0, 5.0, 0.1), (1, 6.0, 0.7), (2, 7.0, 0.7), (3, 8.0, 0.2)], "setting int, rank double, recall double")
    assert tuple(recommend.best_setting(tried).first()) == (1, 6.0, 0.7)


def test_full_grid_has_144_settings():
    assert len(list(itertools.product(*recommend.FULL_GRID.values()))) == 144


def test_evaluator_equals_the_joins(data):
    for k in (3, 100):
        ranked = tuning.RankingALS(k=k, rank=4, maxIter=2).fit(data["train"])
        recall = tuning.RecallAtK(k=k).evaluate(ranked.transform(data["test"]))
        assert recall == pytest.approx(recommend.evaluate(data["test"], ranked.fitted, k).first()["avg_recall_at_k"])


def test_evaluator_against_hand_made_places(spark):
    rows = [(1.0, 1.0, 1), (1.0, 1.0, 1), (1.0, 2.0, None), (1.0, None, None), (2.0, 5.0, 3), (2.0, 6.0, 2), (3.0, 9.0, None)]
    frame = spark.createDataFrame(rows, f"{recommend.USER} double, {recommend.ITEM} double, place int")
    assert tuning.RecallAtK(k=3).evaluate(frame) == pytest.approx((0.5 + 1 + 0) / 3)
    assert tuning.RecallAtK(k=2).evaluate(frame) == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert tuning.RecallAtK(k=2).evaluate(frame.limit(0)) == 0 and tuning.RecallAtK().isLargerBetter()


def test_tuning_with_spark_and_saving(data, tmp_path):
    ranking = tuning.RankingALS(k=5, maxIter=2)
    grid = ParamGridBuilder().addGrid(ranking.rank, [2, 4]).build()
    split = TrainValidationSplit(estimator=ranking, estimatorParamMaps=grid, evaluator=tuning.RecallAtK(k=5), trainRatio=0.7, seed=3, parallelism=2)
    model = split.fit(data["train"])
    assert len(model.validationMetrics) == 2 and model.bestModel.getOrDefault("rank") in (2, 4)
    model.write().overwrite().save(str(tmp_path / "split"))
    again = TrainValidationSplitModel.load(str(tmp_path / "split"))
    assert again.validationMetrics == model.validationMetrics and again.getEvaluator().getOrDefault("k") == 5
    rows = [sorted(map(str, m.transform(data["test"]).collect())) for m in (model, again)]
    assert rows[0] == rows[1]
    assert again.bestModel.transform(data["test"]).filter(F.col("place") > 5).count() == 0


def test_jobs_run_together_and_keep_their_order(spark):
    most, now, lock = [0], [0], threading.Lock()

    def job(i):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        found = spark.range(1000 * (i + 1)).agg(F.sum("id")).first()[0]
        with lock:
            now[0] -= 1
        return found

    made = run_together(spark, [lambda i=i: job(i) for i in range(12)], threads=3)
    assert made == [sum(range(1000 * (i + 1))) for i in range(12)] and 1 <= most[0] <= 3
    assert run_together(spark, []) == []


def test_a_failure_cancels_the_other_jobs(spark):
    def slow():
        rows = spark.range(0, 8, 1, 8).select(F.udf(lambda x: time.sleep(15) or x, "long")("id").alias("x"))
        return rows.agg(F.sum("x")).first()

    def fails():
        time.sleep(3)
        raise KeyError("this one")

    begun = time.time()
    with pytest.raises(KeyError, match="this one"):
        run_together(spark, [slow, fails, slow, slow], threads=2)
    assert time.time() - begun < 40
    assert spark.range(5).count() == 5


def test_recall_of_lists_equals_the_join_of_places(spark):
    truth = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 1), (2, 10, 1), (3, 10, 1), (4, None, 1), (4, 5, 1)], "u int, i int, times long")
    lists = spark.createDataFrame([(1, [12, 9, 10]), (2, [7]), (4, [5]), (9, [10])], "u int, pred_items array<int>")
    places = lists.select("u", F.posexplode("pred_items").alias("at", "i")).select("u", "i", (F.col("at") + 1).alias("place"))
    got = {r.u: r.recall for r in ranking.user_recall(truth, lists, "u", "i").collect()}
    want = {r.u: r.recall for r in ranking.user_metrics(truth, places, "u", "i", 3, repeats=False).collect()}
    assert got == want and got == {1: pytest.approx(2 / 3), 2: 0.0, 4: 0.5}


def test_evaluation_makes_each_list_once_and_never_as_rows(data, spark, monkeypatch):
    """Lists of 100 places for 90,000 users are 9 million rows a model; they were made twice and shuffled."""
    truth = ranking.truth(data["test"], recommend.USER, recommend.ITEM)
    odd = truth.limit(1).select(F.lit(0.5).alias(recommend.USER), recommend.ITEM, "times")
    models = {i: recommend.fit(data["train"], rank=4, maxIter=1, alpha=a) for i, a in ((3, 1.0), (8, 40.0))}
    plans, collect = [], type(truth).collect
    monkeypatch.setattr(type(truth), "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    got = recommend.evaluate_all(truth.unionByName(odd), models, 5)
    monkeypatch.undo()
    assert len(plans) == 1 and "Generate" not in plans[0] and plans[0].count("MapPartitions") <= 3 * len(models)
    for i, model in models.items():
        assert got[i] == pytest.approx(recommend.evaluate(data["test"], model, 5).first()["avg_recall_at_k"])
    assert recommend.evaluate_all(truth.limit(0), models, 5) == {3: 0.0, 8: 0.0}


@pytest.fixture(scope="module")
def odd(spark):
    """Ratings with repeats, zeros and values below zero, and true items nobody has rated, or without a number."""
    rng = random.Random(5)
    rated = [(float(rng.randrange(200)), float(int(rng.random() ** 2 * 150)), float(rng.choice([1, 2, 3, 5, -1, 0]))) for _ in range(4000)]
    true = {(float(rng.randrange(230)), rng.choice([float(rng.randrange(170)), None, 2.5])) for _ in range(900)}
    user, item = f"{recommend.USER} double", f"{recommend.ITEM} double"
    ratings = spark.createDataFrame(rated, f"{user}, {item}, {recommend.SCORE} double").repartition(3)
    return ratings, spark.createDataFrame([(u, i, 1) for u, i in sorted(true, key=str)], f"{user}, {item}, times long")


@pytest.mark.parametrize("blocks", [1, 3])
def test_a_chain_passes_through_the_fits_of_spark(odd, blocks, monkeypatch):
    ratings, truth = odd
    shared = rounds.Rounds(ratings, truth, recommend.USER, recommend.ITEM, recommend.SCORE, blocks)
    many = {"numUserBlocks": blocks, "numItemBlocks": blocks}
    start = shared.start(recommend.fit(ratings, rank=8, maxIter=0, **many))
    monkeypatch.setattr(rounds, "ITEM_NUMBERS", 1)  # the blocks of items come to the users one after the other

    def look(users, items):
        return [np.concatenate(side.collect(), 1) for side in (users, items)], shared.recall(users, items, 10, 8)

    weights = [(0.1, 1.0), (0.001, 200.0)]
    found = shared.chain(start, (1, 4), weights, look)
    for stop, (i, (reg, alpha)) in itertools.product((1, 4), enumerate(weights)):
        model = recommend.fit(ratings, rank=8, maxIter=stop, regParam=reg, alpha=alpha, **many)
        for side, frame in zip(found[stop][0], (model.userFactors, model.itemFactors)):
            rows = sorted(frame.collect(), key=lambda r: (r.id % blocks, r.id))
            assert np.allclose(side[i], [r.features for r in rows], rtol=1e-3, atol=1e-5)
        assert found[stop][1][i] == pytest.approx(recommend.evaluate_all(truth, {0: model}, 10)[0])
    shared.release()


def test_settings_that_differ_in_rounds_alone_share_them(odd, monkeypatch):
    """Rounds are most of the time: with 5, 10, 15 and 20 of them a setting had 50 made, not 20."""
    fits, halves = [], []
    fit, half = recommend.fit, rounds.Rounds.half
    monkeypatch.setattr(recommend, "fit", lambda *a, **b: fits.append(b["maxIter"]) or fit(*a, **b))
    monkeypatch.setattr(rounds.Rounds, "half", lambda *a: halves.append(1) or half(*a))
    grid = {"rank": (2, 3), "maxIter": (1, 2, 3), "regParam": (0.1, 0.01)}
    ratings, truth = odd
    tried = recommend.grid_search(ratings, truth.drop("times"), grid, k=5, threads=2).collect()
    assert len(tried) == 12 and fits == [0, 0] and len(halves) == 2 * 2 * 3
    other = recommend.grid_search(ratings, truth.drop("times"), {"maxIter": (1, 3), "rank": (2,), "seed": (1,)}, k=5).collect()
    assert fits == [0, 0, 1, 3] and [r.recall for r in other] == pytest.approx([tried[0].recall, tried[4].recall])


def test_rows_in_chunks_and_long_rows_in_spans_give_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 3, 3, 50, 700])
    block = rounds.Block(0, np.arange(6), np.concatenate([[0], np.cumsum(counts)]), rng.integers(0, 20, 757), rng.integers(-1, 5, 757).astype(np.float32), np.arange(20))
    near, gram = rng.standard_normal((20, 4)).astype(np.float32), np.eye(4)
    whole = rounds.solved(block, near, gram, 0.1, 3.0)
    monkeypatch.setattr(rounds, "CHUNK", 16)
    monkeypatch.setattr(rounds, "SPAN", 7)
    assert np.allclose(rounds.solved(block, near, gram, 0.1, 3.0), whole, rtol=1e-5, atol=1e-7)
    users, items, ids = rng.standard_normal((9, 4)), rng.standard_normal((30, 4)), np.arange(30, dtype=np.int32)
    lists = np.empty((9, 0), np.int32), np.empty((9, 0))
    for some in (slice(0, 2), slice(2, 19), slice(19, 30)):
        lists = rounds._longer(*lists, users, ids[some], items[some], 6)
    assert np.array_equal(np.sort(lists[0], 1), np.sort(np.argsort(-users @ items.T, axis=1)[:, :6], 1))
