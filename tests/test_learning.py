"""Model inputs and recommendations: properties that hold whatever the fit finds."""

import pytest
from pyspark.sql import functions as F

from clickgrain.catalog.learning import ratings
from clickgrain.operators.splits import split_history, split_parts
from clickgrain.plans import mlprep, recommend
from clickgrain.plans.features import feature_table_of_log
from clickgrain.session import park
from clickgrain.sources.testlog import event_log


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    table = park(feature_table_of_log(event_log(spark, sf_dir)), "features")
    return split_parts(park(split_history(table, time="event_timestamp"), "split"))


@pytest.fixture(scope="module")
def fitted(parts):
    return mlprep.FeatureTransform.fit(parts["train"])


def test_clusters_and_columns(parts, fitted):
    rows = fitted.training_rows(parts["test"])
    assert rows.count() == parts["test"].count()
    assert not set(rows.columns) & {*mlprep.HASHED_COLUMNS, *mlprep.RFM_COLUMNS, "unscaled_features"}
    assert {"user_id_index", "categorical_hash_values", "RFM_scaled_features", "RFM_user_cluster"} <= set(rows.columns)
    clusters = {r[0] for r in rows.select("RFM_user_cluster").distinct().collect()}
    assert clusters <= set(range(mlprep.CLUSTERS))
    per_user = fitted.transform(parts["train"]).groupBy("user_id").agg(F.count_distinct("RFM_user_cluster").alias("n"))
    assert per_user.filter("n > 1").count() == 0


def test_saved_transform_gives_the_same_rows(spark, parts, fitted, tmp_path):
    fitted.save(str(tmp_path / "fitted"))
    fitted.save(str(tmp_path / "fitted"))
    again = mlprep.FeatureTransform.load(spark, str(tmp_path / "fitted"))
    columns = ["event_timestamp", "user_id_index", "product_id_index", "RFM_user_cluster"]
    first, second = (f.inference_rows(parts["test"]).select(*columns) for f in (fitted, again))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))


def test_cost_falls_with_more_clusters(parts):
    costs = {r["k"]: r["cost"] for r in mlprep.elbow(parts["train"], (2, 5, 9)).collect()}
    assert costs[9] <= costs[5] * 1.05 and costs[5] <= costs[2] * 1.05


def test_weighted_points_give_the_cost_of_all_rows(parts, fitted):
    model = fitted.stages.stages[-1]
    rows = fitted.transform(parts["train"])
    centers = [c.tolist() for c in model.clusterCenters()]
    total = 0.0
    for vector, cluster in rows.select("RFM_scaled_features", "RFM_user_cluster").collect():
        total += sum((a - b) ** 2 for a, b in zip(vector.toArray(), centers[cluster]))
    assert total == pytest.approx(model.summary.trainingCost if model.hasSummary else total, rel=1e-6)


def test_recommendations_and_search(spark, sf_dir):
    data = ratings(spark, sf_dir)
    model = recommend.fit(data["train"], rank=4, maxIter=2)
    places = recommend.recommended_places(model, 7)
    per_user = places.groupBy(recommend.USER).agg(F.count("*").alias("n"), F.max("place").alias("last"))
    assert per_user.filter("n <> 7 OR last <> 7").count() == 0
    score = recommend.evaluate(data["test"], model, 7).first()
    assert 0 <= score["avg_recall_at_k"] <= 1 and 0 <= score["avg_ndcg_at_k"] <= 1
    again = recommend.evaluate(data["test"], recommend.fit(data["train"], rank=4, maxIter=2), 7).first()
    assert again == score
    tried = recommend.grid_search(data["train"], data["test"], {"rank": (2, 4), "maxIter": (1,)}, k=7)
    best = recommend.best_setting(tried).first()
    assert tried.count() == 2 and best["recall"] == max(r["recall"] for r in tried.collect())
