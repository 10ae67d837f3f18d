"""Training, evaluating and tuning implicit-feedback recommendations."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.operators import ranking
from clickgrain.plans import rounds, together
from clickgrain.session import park

USER, ITEM, SCORE = "user_id_index", "product_id_index", "interaction_score"

# The grid of the full search, 144 fits.
FULL_GRID = {
    "rank": (20, 30, 50),
    "maxIter": (5, 10, 15, 20),
    "regParam": (0.01, 0.001, 0.1),
    "alpha": (40.0, 60.0, 100.0, 200.0),
}


def als(seed: int = 1, userCol: str = USER, itemCol: str = ITEM, ratingCol: str = SCORE, **params: float) -> ALS:
    return ALS(
        userCol=userCol, itemCol=itemCol, ratingCol=ratingCol, implicitPrefs=True, coldStartStrategy="drop", seed=seed, **params
    )


def rated(rows: DataFrame) -> DataFrame:
    """The interactions that carry a score, as ALS stops at a null."""
    return rows.select(USER, ITEM, SCORE).filter(F.col(SCORE).isNotNull())


def fit(train: DataFrame, **params: float) -> ALSModel:
    """Every interaction row counts, repeats of a pair included; rows without a score are none."""
    return als(**params).fit(rated(train))


def recommend(model: ALSModel, count: int = 100) -> DataFrame:
    return model.recommendForAllUsers(count)


def recommended_places(model: ALSModel, count: int) -> DataFrame:
    return _places(recommend(model, count), model)


def places_of(model: ALSModel, users: DataFrame, count: int) -> DataFrame:
    """(user, item, place) for the users of one column alone; users without factors have none."""
    return _places(model.recommendForUserSubset(users.distinct(), count), model)


def _places(recommendations: DataFrame, model: ALSModel) -> DataFrame:
    user, item = (model.getOrDefault(c) for c in ("userCol", "itemCol"))
    places = ranking.as_places(recommendations, user, item)
    return places.withColumns({user: F.col(user).cast("double"), item: F.col(item).cast("double")})


def evaluate(test: DataFrame, model: ALSModel, k: int = 100, repeats: bool = False) -> DataFrame:
    """One row: recall@k, precision@k and NDCG@k averaged over the test users with factors."""
    truth = ranking.truth(test, USER, ITEM)
    places = places_of(model, truth.select(USER), k)
    return ranking.mean_metrics(ranking.user_metrics(truth, places, USER, ITEM, k, repeats))


def evaluate_all(truth: DataFrame, models: Mapping[int, ALSModel], k: int) -> dict[int, float]:
    """Recall@k of several models in one job. ``truth`` (user, item, times) is a written table.

    Each model's lists are made once and stay one row per user, dealt as the model has left them: the
    true rows come to them, so no (user, item, place) row is shuffled.
    """
    # Spark's lists have whole numbers; another number has no factors.
    user, item = (F.when(F.col(c).try_cast("int") == F.col(c), F.col(c).try_cast("int")).alias(c) for c in (USER, ITEM))
    numbered = truth.select(user, item).filter(F.col(USER).isNotNull())
    users = numbered.select(USER).distinct()
    means = []
    for number, model in models.items():
        lists = ranking.recommended_ids(model.recommendForUserSubset(users, k), USER, ITEM)
        recalls = ranking.user_recall(numbered, lists, USER, ITEM)
        means.append(recalls.agg(F.avg("recall").alias("recall")).select(F.lit(number).alias("setting"), "recall"))
    found = reduce(DataFrame.unionByName, means).collect()  # one row per model
    return {**dict.fromkeys(models, 0.0), **{r["setting"]: r["recall"] for r in found if r["recall"] is not None}}


#: Ratings of a block of users or items. A fit shuffles blocks * blocks messages in each round, and a user's
#: factors to every block that has one of the user's items; the cores a fit leaves idle have other fits.
RATINGS_PER_BLOCK = 1_000_000


#: Parameters whose settings can share rounds; with any other in the grid every setting is a fit of Spark's own.
SHARED = {"rank", "maxIter", "regParam", "alpha"}


def grid_search(
    train: DataFrame,
    test: DataFrame,
    grid: Mapping[str, Sequence[float]] | None = None,
    k: int = 100,
    threads: int = together.THREADS,
    batch: int = 12,
) -> DataFrame:
    """One row per setting with its recall@k, numbered in the order of the grid.

    Every fit is distributed, and ``threads`` of them run at a time; the inputs are written once. Settings
    that differ in ``maxIter`` alone are one chain of rounds, evaluated at each of their numbers of rounds.
    """
    grid = grid or FULL_GRID
    ratings = park(rated(train), "ratings")
    truth = park(ranking.truth(test, USER, ITEM), "held-out")
    blocks = max(1, math.ceil(ratings.count() / RATINGS_PER_BLOCK))
    settings = list(itertools.product(*grid.values()))
    named = [dict(zip(grid, values)) for values in settings]
    fit_one = partial(fit, ratings, numUserBlocks=blocks, numItemBlocks=blocks)
    if set(grid) <= SHARED:
        recalls = _search_by_rounds(ratings, truth, fit_one, named, blocks, k, threads)
    else:
        recalls = _search_by_fits(truth, fit_one, named, k, threads, batch)
    tried = [(i, *[float(v) for v in values], float(recalls[i] or 0.0)) for i, values in enumerate(settings)]
    columns = ", ".join(f"{name} double" for name in grid)
    return train.sparkSession.createDataFrame(tried, f"setting int, {columns}, recall double")


def _search_by_rounds(
    ratings: DataFrame, truth: DataFrame, fit_one: Callable, named: Sequence[Mapping], blocks: int, k: int, threads: int
) -> dict[int, float]:
    """Recall by setting. A chain's factors are let go round by round, so memory follows the threads."""
    spark, usual = ratings.sparkSession, als()

    def chosen(setting: Mapping) -> tuple:
        rank, stop, reg, alpha = (setting.get(n, usual.getOrDefault(n)) for n in ("rank", "maxIter", "regParam", "alpha"))
        return (int(rank), reg, alpha), int(stop)

    stops: dict[tuple, set[int]] = {}
    for chain, stop in map(chosen, named):
        stops.setdefault(chain, set()).add(stop)
    ranks = sorted({rank for rank, _, _ in stops}, reverse=True)
    models = together.run_together(spark, [partial(fit_one, rank=rank, maxIter=0) for rank in ranks], threads)
    shared = rounds.Rounds(ratings, truth, USER, ITEM, SCORE, blocks)
    begun = {rank: shared.start(model) for rank, model in zip(ranks, models)}
    # Settings of one rank and the same stops go together, as far as that leaves a chain for each thread.
    alike: dict[tuple, list[tuple]] = {}
    for (rank, reg, alpha), some in stops.items():
        alike.setdefault((rank, tuple(sorted(some))), []).append((reg, alpha))
    most = math.ceil(len(stops) / threads)
    bundles = []
    # The longest chains first, so that none of them is left for the end.
    for (rank, some), weights in sorted(alike.items(), key=lambda a: (a[0][0], a[0][1][-1]), reverse=True):
        size = math.ceil(len(weights) / math.ceil(len(weights) / min(most, shared.bundle(rank))))
        bundles += [(rank, some, weights[at : at + size]) for at in range(0, len(weights), size)]
    calls = [
        partial(shared.chain, begun[rank], some, weights, partial(shared.recall, k=k, rank=rank))
        for rank, some, weights in bundles
    ]
    found = {}
    for (rank, _, weights), recalls in zip(bundles, together.run_together(spark, calls, threads)):
        found |= {((rank, *w), stop): values[i] for stop, values in recalls.items() for i, w in enumerate(weights)}
    shared.release()
    return {i: found[setting] for i, setting in enumerate(map(chosen, named))}


def _search_by_fits(
    truth: DataFrame, fit_one: Callable, named: Sequence[Mapping], k: int, threads: int, batch: int
) -> dict[int, float]:
    """Recall by setting. One job evaluates the models of a ``batch`` for the users of the test table, while
    the next batch is fitted; then the models are let go, so memory follows the batch and not the grid.
    """
    recalls: dict[int, float] = {}
    fitted: dict[int, ALSModel] = {}
    for begin in range(0, len(named) + batch, batch):
        calls = [partial(fit_one, **setting) for setting in named[begin : begin + batch]]
        if fitted:
            calls.insert(0, partial(evaluate_all, truth, fitted, k))
        done = together.run_together(truth.sparkSession, calls, threads)
        if fitted:
            recalls |= done.pop(0)
        fitted = dict(enumerate(done, begin))
    return recalls


def best_setting(tried: DataFrame) -> DataFrame:
    """The setting with the highest recall, of equal ones the first in the order of the grid."""
    names = [c for c in tried.columns if c not in ("recall", "setting")]
    best = F.max_by(F.struct("setting", *names), F.struct("recall", -F.col("setting"))).alias("best")
    return tried.agg(best, F.max("recall").alias("recall")).select("best.*", "recall")
