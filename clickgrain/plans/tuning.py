"""Recommendations as parts of Spark's own tuning: an estimator that ranks and an evaluator of the ranks.

An evaluator of ``pyspark.ml.tuning`` sees the transformed rows only, never the model. So the model's
``transform`` gives every row of the test table the place its item has in the user's list
(``recommendForUserSubset``: lists are made for the users of the table, not for all), and ``RecallAtK``
needs those places alone. Both can be saved, and with them a ``TrainValidationSplit`` or
``CrossValidator`` and its model.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.recommendation import ALSModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickgrain.plans import recommend


class _Columns(Params):
    userCol = Param(Params._dummy(), "userCol", "column of user numbers", TypeConverters.toString)
    itemCol = Param(Params._dummy(), "itemCol", "column of item numbers", TypeConverters.toString)
    placeCol = Param(Params._dummy(), "placeCol", "column of the item's place in the user's list, null outside it", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "length of a list", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(userCol=recommend.USER, itemCol=recommend.ITEM, placeCol="place", k=100)

    def names(self) -> tuple[str, str, str]:
        return tuple(self.getOrDefault(p) for p in (self.userCol, self.itemCol, self.placeCol))


class RecallAtK(_Columns, Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Mean over users of the share of their distinct items that stand among the first ``k`` places.

    Rows are (user, item, place). Repeated rows count once; rows without an item don't count. Without
    rows the mean is 0.
    """

    @keyword_only
    def __init__(self, *, userCol=None, itemCol=None, placeCol=None, k=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _evaluate(self, dataset: DataFrame) -> float:
        user, item, place = self.names()
        best = dataset.filter(F.col(item).isNotNull()).groupBy(user, item).agg(F.min(place).alias("best"))
        hit = F.when(F.col("best") <= self.getOrDefault(self.k), 1.0).otherwise(0.0)
        return best.groupBy(user).agg(F.avg(hit).alias("recall")).agg(F.coalesce(F.avg("recall"), F.lit(0.0))).first()[0]

    def isLargerBetter(self) -> bool:
        return True


class _Ranking(_Columns):
    ratingCol = Param(Params._dummy(), "ratingCol", "column of scores", TypeConverters.toString)
    rank = Param(Params._dummy(), "rank", "number of factors", TypeConverters.toInt)
    maxIter = Param(Params._dummy(), "maxIter", "number of rounds", TypeConverters.toInt)
    regParam = Param(Params._dummy(), "regParam", "weight of the factors' size", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "weight of a score", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the first factors", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(ratingCol=recommend.SCORE, rank=10, maxIter=10, regParam=0.1, alpha=1.0, seed=1)


class RankingALS(_Ranking, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Implicit-feedback ALS whose model ranks items. Parameters as those of ``ALS``."""

    @keyword_only
    def __init__(self, *, userCol=None, itemCol=None, ratingCol=None, placeCol=None, k=None, rank=None, maxIter=None, regParam=None, alpha=None, seed=None):
        super().__init__()
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RankingModel:
        shared = {p: self.getOrDefault(p) for p in ("userCol", "itemCol", "ratingCol", "rank", "maxIter", "regParam", "alpha", "seed")}
        scored = dataset.filter(F.col(self.getOrDefault(self.ratingCol)).isNotNull())
        fitted = recommend.als(**shared).fit(scored)
        return self._copyValues(RankingModel(fitted))


class RankingModel(_Ranking, Model, MLReadable, MLWritable):
    """Adds ``placeCol``; rows of users the fit has not seen are dropped, as ALS drops them."""

    def __init__(self, fitted: ALSModel | None = None):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        user, item, place = self.names()
        places = recommend.places_of(self.fitted, dataset.select(user), self.getOrDefault(self.k)).withColumnRenamed("place", "listed_place")
        known = places.select(F.col(user).alias("known_user")).distinct()
        listed = places.select(F.col(user).alias("listed_user"), F.col(item).alias("listed_item"), "listed_place")
        rows = dataset.drop(place).join(known, F.col(user) == F.col("known_user"), "left_semi")
        joined = rows.join(listed, (F.col(user) == F.col("listed_user")) & (F.col(item) == F.col("listed_item")), "left")
        return joined.withColumn(place, F.col("listed_place")).drop("listed_user", "listed_item", "listed_place")

    def write(self) -> MLWriter:
        return _RankingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _RankingReader()


class _RankingWriter(MLWriter):
    def __init__(self, model: RankingModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.write().save(f"{path}/als")


class _RankingReader(MLReader):
    def load(self, path: str) -> RankingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RankingModel(ALSModel.load(f"{path}/als"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
