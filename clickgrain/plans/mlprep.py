"""Model inputs: indexes, hashed categories, scaled recency/frequency/monetary values, clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import FeatureHasher, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgrain.operators.ordered import global_number
from clickgrain.operators.skew import Hot, find_hot, left_join
from clickgrain.session import park

# Hashed columns, vector size, clustered columns, number of clusters and seed.
HASHED_COLUMNS = (
    "user_id", "product_id", "category_id", "brand", "user_session",
    "1_most_purchased_category", "2_most_purchased_category", "3_most_purchased_category",
)
HASH_SIZE = 8000
RFM_COLUMNS = ("Recency", "Frequency", "Monetary")
CLUSTERS = 4
SEED = 1
INDEXED_COLUMNS = ("user_id", "product_id")


def frequency_index(df: DataFrame, column: str) -> DataFrame:
    """(label, index): most frequent label first from 0, equal counts in order of the label.

    Labels are numbered in slices on the cluster; the label list never meets in one place.
    """
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    numbered = global_number(counted, [F.desc("n"), F.col("label")], "number")
    return numbered.select("label", (F.col("number") - 1).cast("double").alias("index"))


def with_index(
    df: DataFrame, labels: DataFrame, column: str, out: str | None = None, hot: Hot | None = None
) -> DataFrame:
    """Adds the index; a label not in the list (null included) gets the number of labels."""
    out = out or f"{column}_index"
    side = labels.select(F.col("label").alias(column), F.col("index").alias(out))
    unseen = labels.agg(F.count(F.lit(1)).cast("double")).scalar()
    return left_join(df, side, [column], hot).withColumn(out, F.coalesce(out, unseen))


def hasher(columns: Sequence[str] = HASHED_COLUMNS, out: str = "categorical_hash_values") -> FeatureHasher:
    return FeatureHasher(inputCols=list(columns), outputCol=out, numFeatures=HASH_SIZE)


def hash_per_column(df: DataFrame, columns: Sequence[str] = HASHED_COLUMNS) -> DataFrame:
    """One hash vector per column, then all of them in one vector."""
    outputs = []
    for column in columns:
        outputs.append(f"{column}_hash")
        df = hasher([column], outputs[-1]).transform(df)
    return VectorAssembler(inputCols=outputs, outputCol="Assembled_hashed_features").transform(df)


def assemble_rfm(df: DataFrame) -> DataFrame:
    rfm = VectorAssembler(inputCols=list(RFM_COLUMNS), outputCol="unscaled_features")
    return rfm.transform(df)


def scale_rfm(df: DataFrame) -> DataFrame:
    """Standard scores of the three values, by all rows of ``df``."""
    scores = []
    for name in RFM_COLUMNS:
        mean, deviation = df.agg(F.avg(name)).scalar(), df.agg(F.stddev_samp(name)).scalar()
        scores.append((F.when(deviation == 0, 0.0).otherwise((F.col(name) - mean) / deviation)).alias(f"{name}_scaled"))
    return df.select("*", *scores)


def rfm_points(df: DataFrame) -> DataFrame:
    """Distinct value triples with the number of rows that have them.

    All rows of a user share one triple, so clustering works on users with a weight and not on
    events; the weights make it the same problem.
    """
    return df.groupBy(*RFM_COLUMNS).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fit_scaler(df: DataFrame):
    scaler = StandardScaler(
        inputCol="unscaled_features", outputCol="RFM_scaled_features", withMean=True, withStd=True
    )
    return scaler.fit(assemble_rfm(df.select(*RFM_COLUMNS)))


def fit_clusters(scaled_points: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> KMeansModel:
    return KMeans(
        k=k, seed=seed, featuresCol="RFM_scaled_features", predictionCol="RFM_user_cluster", weightCol="weight"
    ).fit(scaled_points)


def elbow(df: DataFrame, ks: Sequence[int] = tuple(range(2, 10))) -> DataFrame:
    """Training cost per number of clusters. The weighted points are written once for all fits."""
    scaler = fit_scaler(df)
    points = park(rfm_points(df), "rfm")
    scaled = scaler.transform(assemble_rfm(points))
    costs = [(k, float(fit_clusters(scaled, k).summary.trainingCost)) for k in ks]
    return df.sparkSession.createDataFrame(costs, "k int, cost double")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("RFM_user_cluster").agg(*[F.avg(c).alias(f"Avg_{c}") for c in RFM_COLUMNS])


class FeatureTransform:
    """Fitted indexes and the fitted hash, scale and cluster stages."""

    def __init__(self, labels: dict[str, DataFrame], stages: PipelineModel):
        self.labels = labels
        self.stages = stages

    @classmethod
    def fit(cls, train: DataFrame) -> FeatureTransform:
        labels = {c: park(frequency_index(train, c), f"labels-{c}") for c in INDEXED_COLUMNS}
        scaler = fit_scaler(train)
        points = park(rfm_points(train), "rfm")
        clusters = fit_clusters(scaler.transform(assemble_rfm(points)))
        assembler = VectorAssembler(inputCols=list(RFM_COLUMNS), outputCol="unscaled_features")
        return cls(labels, PipelineModel([hasher(), assembler, scaler, clusters]))

    def transform(self, df: DataFrame, hot_rows: int | None = None) -> DataFrame:
        hot = find_hot(df, {column: [column] for column in self.labels}, min_rows=hot_rows)
        for column, labels in self.labels.items():
            df = with_index(df, labels, column, hot=hot[column])
        return self.stages.transform(df)

    def training_rows(self, df: DataFrame) -> DataFrame:
        """Transformed rows without the hashed and clustered inputs."""
        return self.transform(df).drop(*HASHED_COLUMNS, "unscaled_features", *RFM_COLUMNS)

    def inference_rows(self, df: DataFrame) -> DataFrame:
        """As for training, but the raw values stay and the scaled vector goes."""
        return self.transform(df).drop(*HASHED_COLUMNS, "unscaled_features", "RFM_scaled_features")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        for column, labels in self.labels.items():
            labels.write.mode("overwrite").parquet(f"{path}/labels/{column}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureTransform:
        labels = {c: spark.read.parquet(f"{path}/labels/{c}") for c in INDEXED_COLUMNS}
        return cls(labels, PipelineModel.load(f"{path}/stages"))
