"""ML1-ML10, RC1-RC11, IO8, JN7, AG14: model inputs, recommendations and their metrics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clickgrain.catalog.base import parked_clean, query, r, rounded, with_log
from clickgrain.catalog.features import RECENCY_SQL, SCORED, WEIGHT, hot_keys
from clickgrain.catalog.store import parked_features
from clickgrain.catalog.visits import split_sql
from clickgrain.operators import attach, ranking
from clickgrain.operators.skew import find_hot
from clickgrain.operators.splits import split_history, split_parts
from clickgrain.plans import mlprep, recommend, tuning
from clickgrain.session import new_folder, park

EVENT = ["user_id", "product_id", "event_timestamp"]
TOP = 10
LONG_LIST = 100


def feature_parts(spark, sf_dir):
    """Train and test part of the feature table, written once."""
    split = park(split_history(parked_features(spark, sf_dir), time="event_timestamp"), "split")
    return split_parts(split)


def rfm_rows(spark, sf_dir):
    return parked_features(spark, sf_dir).select("user_id", *mlprep.RFM_COLUMNS)


def index_query(key: str, column: str):
    sql = f"""SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS index
FROM (SELECT {column} AS label, count(*) AS n FROM clean GROUP BY {column})"""

    @query(key, with_log(sql))
    def run(spark, sf_dir):
        return mlprep.frequency_index(parked_clean(spark, sf_dir), column)


index_query("ml1_index_of_user_id", "user_id")
index_query("ml1_index_of_product_id", "product_id")
index_query("ml1_index_of_user_session", "user_session")


@query(
    "ml1_indexed_rows",
    with_log(
        """SELECT c.user_id, c.product_id, c.event_time, c.event_type, coalesce(i.index, (SELECT count(*) FROM idx)::DOUBLE) AS user_session_index
FROM clean_all_abs c LEFT JOIN idx i ON c.user_session = i.label""",
        """idx AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS index
FROM (SELECT user_session AS label, count(*) AS n FROM clean WHERE event_type = 'purchase' GROUP BY user_session))""",
    ),
)
def ml1_rows(spark, sf_dir):
    rows = parked_clean(spark, sf_dir, removals=True)
    labels = park(mlprep.frequency_index(rows.filter("event_type = 'purchase'"), "user_session"), "labels")
    indexed = mlprep.with_index(rows, labels, "user_session", hot=hot_keys(rows, "user_session"))
    return indexed.select("user_id", "product_id", "event_time", "event_type", "user_session_index")


@query("ml2_hashed_categories")
def ml2(spark, sf_dir):
    hashed = mlprep.hasher().transform(parked_features(spark, sf_dir))
    return hashed.select(*EVENT, F.col("categorical_hash_values").cast("string").alias("categorical_hash_values"))


@query("ml3_hash_per_column")
def ml3(spark, sf_dir):
    hashed = mlprep.hash_per_column(parked_features(spark, sf_dir))
    return hashed.select(*EVENT, F.col("Assembled_hashed_features").cast("string").alias("hashed_features"))


RFM_SQL = """
rfm AS (SELECT user_id, count(*) AS events, any_value(Recency) AS Recency, count(*) FILTER (event_type = 'purchase') AS Frequency,
        coalesce(sum(price) FILTER (event_type = 'purchase'), 0) AS Monetary FROM clean JOIN recency USING (user_id) GROUP BY user_id),
rfm_rows AS (SELECT c.user_id, r.Recency, r.Frequency, r.Monetary FROM clean c JOIN rfm r USING (user_id))"""


@query("ml4_assembled_rfm", with_log("SELECT user_id, " + ", ".join(f"{r(c)} AS {c.lower()}" for c in ("Recency", "Frequency", "Monetary")) + " FROM rfm_rows", RECENCY_SQL, RFM_SQL))
def ml4(spark, sf_dir):
    entries = vector_to_array("unscaled_features")
    names = ("recency", "frequency", "monetary")
    rows = mlprep.assemble_rfm(rfm_rows(spark, sf_dir))
    return rounded(rows.select("user_id", *[entries[i].alias(n) for i, n in enumerate(names)]))


def scaled_sql() -> str:
    scores = ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()', 6)} AS {c}_scaled" for c in mlprep.RFM_COLUMNS)
    return f"SELECT user_id, {scores} FROM rfm_rows"


@query("ml5_standard_scores", with_log(scaled_sql(), RECENCY_SQL, RFM_SQL))
def ml5(spark, sf_dir):
    rows = mlprep.scale_rfm(rfm_rows(spark, sf_dir))
    return rounded(rows.select("user_id", *[f"{c}_scaled" for c in mlprep.RFM_COLUMNS]), 6)


@query("ml6_rfm_clusters")
def ml6(spark, sf_dir):
    parts = feature_parts(spark, sf_dir)
    fitted = mlprep.FeatureTransform.fit(parts["train"])
    return fitted.transform(parts["train"]).select(*EVENT, *mlprep.RFM_COLUMNS, "RFM_user_cluster")


@query("ml7_elbow")
def ml7(spark, sf_dir):
    return mlprep.elbow(rfm_rows(spark, sf_dir))


@query("ml8_cluster_profile")
def ml8(spark, sf_dir):
    train = feature_parts(spark, sf_dir)["train"]
    return rounded(mlprep.cluster_profile(mlprep.FeatureTransform.fit(train).transform(train)))


def plain_vectors(df):
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if k == "vector" else f"`{c}`" for c, k in df.dtypes])


@query("ml9_transformed_rows")
def ml9(spark, sf_dir):
    parts = feature_parts(spark, sf_dir)
    fitted = mlprep.FeatureTransform.fit(parts["train"])
    both = fitted.training_rows(parts["train"]).unionByName(fitted.training_rows(parts["test"]))
    return plain_vectors(both)


def saved_transform(spark, train):
    folder = new_folder(spark, "transform")
    mlprep.FeatureTransform.fit(train).save(folder)
    return mlprep.FeatureTransform.load(spark, folder)


@query("ml10_inference_rows")
def ml10(spark, sf_dir):
    parts = feature_parts(spark, sf_dir)
    return plain_vectors(saved_transform(spark, parts["train"]).inference_rows(parts["test"]))


@query("io8_saved_transform")
def io8(spark, sf_dir):
    parts = feature_parts(spark, sf_dir)
    return saved_transform(spark, parts["train"]).transform(parts["test"]).select(
        *EVENT, "user_id_index", "product_id_index", "RFM_user_cluster"
    )


INDEXES = [f"{c}_index" for c in mlprep.INDEXED_COLUMNS]


def indexes_sql(split: str) -> str:
    """Rows of a part with the indexes that the train part gives their labels."""
    columns = ", ".join(f"coalesce(idx_{c}.index, (SELECT count(*) FROM idx_{c})::DOUBLE) AS {c}_index" for c in mlprep.INDEXED_COLUMNS)
    joins = " ".join(f"LEFT JOIN idx_{c} ON t.{c} = idx_{c}.label" for c in mlprep.INDEXED_COLUMNS)
    numbered = [
        f"""idx_{c} AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS DOUBLE) AS index
FROM (SELECT {c} AS label, count(*) AS n FROM parts WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c}))"""
        for c in mlprep.INDEXED_COLUMNS
    ]
    source = "events_of AS (SELECT user_id, product_id, event_time AS event_timestamp FROM clean)"
    parts = split_sql("events_of", [("train", 0.8)], 10, "user_id, product_id, event_timestamp", "event_timestamp")
    return with_log(f"SELECT t.event_timestamp, {columns} FROM parts t {joins} WHERE split IN ({split})", source, parts, *numbered)


@query("io8_indexes_of_saved_transform", indexes_sql("'test'"))
def io8_indexes(spark, sf_dir):
    """Indexes that a transform gives the test part after it was saved and loaded."""
    parts = feature_parts(spark, sf_dir)
    return saved_transform(spark, parts["train"]).transform(parts["test"]).select("event_timestamp", *INDEXES)


@query("ml9_indexes_of_training_rows", indexes_sql("'train', 'test'"))
def ml9_indexes(spark, sf_dir):
    """Indexes of the train and test rows that go into the model."""
    parts = feature_parts(spark, sf_dir)
    fitted = mlprep.FeatureTransform.fit(parts["train"])
    both = fitted.training_rows(parts["train"]).unionByName(fitted.training_rows(parts["test"]))
    return both.select("event_timestamp", *INDEXES)


@query("ml10_indexes_of_inference_rows", indexes_sql("'test'"))
def ml10_indexes(spark, sf_dir):
    """Indexes of the rows to be scored, by a loaded transform."""
    parts = feature_parts(spark, sf_dir)
    return saved_transform(spark, parts["train"]).inference_rows(parts["test"]).select("event_timestamp", *INDEXES)


# Recommendations --------------------------------------------------------------------------------


def scored_parts(spark, sf_dir):
    cleaned = parked_clean(spark, sf_dir)
    scored = attach.with_interaction_score(cleaned, hot=hot_keys(cleaned, "user_id", "product_id"))
    return split_parts(park(split_history(scored), "scored"))


def ratings(spark, sf_dir):
    """Train and test interactions that have a score, on indexed ids."""
    parts = {name: rows.filter("interaction_score IS NOT NULL") for name, rows in scored_parts(spark, sf_dir).items()}
    train = parts["train"]
    hot = find_hot(train, {c: [c] for c in mlprep.INDEXED_COLUMNS})
    for column in mlprep.INDEXED_COLUMNS:
        labels = park(mlprep.frequency_index(train, column), "labels")
        parts = {name: mlprep.with_index(rows, labels, column, hot=hot[column]) for name, rows in parts.items()}
    return {
        name: park(rows.select(recommend.USER, recommend.ITEM, recommend.SCORE), f"ratings-{name}")
        for name, rows in parts.items()
    }


@query("rc1_predicted_scores")
def rc1(spark, sf_dir):
    parts = ratings(spark, sf_dir)
    return recommend.fit(parts["train"]).transform(parts["test"])


@query("rc2_top_100_per_user")
def rc2(spark, sf_dir):
    return recommend.recommended_places(recommend.fit(ratings(spark, sf_dir)["train"]), 100)


SCORED_SQL = f"scored AS (SELECT *, ({WEIGHT}) * count(*) {SCORED} OVER (PARTITION BY user_id, product_id) AS score FROM clean)"
PARTS_SQL = split_sql("scored", [("train", 0.8)], 10, "user_id, product_id, score")
PREDICTED_SQL = f"""
best AS (SELECT user_id, product_id, max(score) AS score FROM parts WHERE split = 'train' GROUP BY ALL),
predicted AS (SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) AS place
  FROM best QUALIFY place <= {TOP})"""
TRUTH_SQL = "truth AS (SELECT user_id, product_id, count(*) AS times FROM parts WHERE split = 'test' GROUP BY ALL)"
RC_CTES = [SCORED_SQL, PARTS_SQL, PREDICTED_SQL, TRUTH_SQL]


def fixed_lists(spark, sf_dir):
    """True (user, product, times) and, per user, the train products with the highest score."""
    parts = scored_parts(spark, sf_dir)
    predicted = ranking.top_items(parts["train"], "user_id", "product_id", "interaction_score", TOP)
    return ranking.truth(parts["test"], "user_id", "product_id"), predicted


@query(
    "rc3_recommended_ids",
    with_log(
        "SELECT user_id, string_agg(product_id, ',' ORDER BY place) AS pred_items FROM predicted GROUP BY user_id",
        *RC_CTES,
    ),
)
def rc3(spark, sf_dir):
    lists = ranking.as_lists(fixed_lists(spark, sf_dir)[1], "user_id", "product_id")
    return lists.select("user_id", F.array_join("pred_items", ",").alias("pred_items"))


@query("rc4_true_items_with_repeats", with_log("SELECT * FROM truth", *RC_CTES))
def rc4_list(spark, sf_dir):
    return fixed_lists(spark, sf_dir)[0]


CHUNK = 4


@query(
    "rc4_true_item_lists",
    with_log(
        f"""SELECT user_id, chunk, string_agg(product_id, ',' ORDER BY place) AS items
FROM (SELECT *, CAST((place - 1) // {CHUNK} AS INTEGER) AS chunk FROM (
  SELECT user_id, product_id, row_number() OVER (PARTITION BY user_id ORDER BY event_time, product_id) AS place FROM parts WHERE split = 'test'))
GROUP BY user_id, chunk""",
        SCORED_SQL, split_sql("scored", [("train", 0.8)], 10, "user_id, product_id, event_time, score"),
    ),
)
def rc4_lists(spark, sf_dir):
    """The true items of each user in order of time, repeats kept, in chunks of four."""
    test = scored_parts(spark, sf_dir)["test"]
    lists = ranking.list_chunks(test, ["user_id"], ["event_time"], "product_id", CHUNK)
    return lists.select("user_id", "chunk", F.array_join("items", ",").alias("items"))


@query(
    "rc3_recommended_id_arrays",
    with_log(
        f"""SELECT p.user_id, {LONG_LIST} AS k, (SELECT count(DISTINCT product_id) FROM parts WHERE split = 'train' AND score IS NOT NULL) AS items, TRUE AS distinct_items, TRUE AS known_items
FROM (SELECT DISTINCT user_id FROM parts WHERE split = 'train' AND score IS NOT NULL) p""",
        SCORED_SQL, PARTS_SQL,
    ),
)
def rc3_arrays(spark, sf_dir):
    """Nested recommendations of a fit to one array of product ids per user."""
    parts = scored_parts(spark, sf_dir)
    train, labels = parts["train"].filter("interaction_score IS NOT NULL"), {}
    for column in mlprep.INDEXED_COLUMNS:
        labels[column] = park(mlprep.frequency_index(train, column), "labels")
        train = mlprep.with_index(train, labels[column], column)
    arrays = ranking.recommended_ids(recommend.recommend(recommend.fit(train), LONG_LIST), recommend.USER, recommend.ITEM)
    # Numbers back to ids: one row per place, joined with the labels.
    places = arrays.select(recommend.USER, F.posexplode("pred_items").alias("place", "number"))
    items = labels["product_id"].select(F.col("index").alias("number"), F.col("label").alias("product_id"))
    users = labels["user_id"].select(F.col("index").alias(recommend.USER), F.col("label").alias("user_id"))
    named = places.join(items, "number", "left").join(users, recommend.USER).groupBy("user_id")
    listed = named.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("product_id").alias("different"), F.count("product_id").alias("known"))
    checks = [(F.col("items") == F.col("different")).alias("distinct_items"), (F.col("items") == F.col("known")).alias("known_items")]
    return listed.select("user_id", F.lit(LONG_LIST).alias("k"), "items", *checks)


@query(
    "rc4_true_item_sets",
    with_log(
        "SELECT user_id, string_agg(product_id, ',' ORDER BY product_id) AS true_items FROM truth GROUP BY user_id",
        *RC_CTES,
    ),
)
def rc4_set(spark, sf_dir):
    sets = ranking.truth_sets(fixed_lists(spark, sf_dir)[0], "user_id", "product_id")
    return sets.select("user_id", F.array_join("true_items", ",").alias("true_items"))


def metrics_cte(repeats: bool, k: int = TOP) -> str:
    count = "sum(times)" if repeats else "count(*)"
    return f"""
ideal AS (SELECT n, (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, {k} + 1) t(i) WHERE i <= n) AS best FROM range(1, {k} + 1) s(n)),
counted AS (SELECT user_id, CAST({count} AS BIGINT) AS true_count FROM truth GROUP BY user_id),
hit AS (SELECT user_id, count(*) AS hits, sum(1.0::DOUBLE / log2(place + 1)) AS gain FROM truth JOIN predicted USING (user_id, product_id)
        WHERE place <= {k} GROUP BY user_id),
metric AS (SELECT user_id, true_count, coalesce(hits, 0) AS hits, coalesce(hits, 0) / true_count::DOUBLE AS recall,
           coalesce(hits, 0) / {k}::DOUBLE AS precision, coalesce(gain, 0) / best AS ndcg
           FROM counted SEMI JOIN predicted USING (user_id) LEFT JOIN hit USING (user_id) JOIN ideal ON n = least(true_count, {k}))"""


def metric_query(key: str, column: str, repeats: bool):
    sql = f"SELECT user_id, true_count, hits, {r(column, 6)} AS {column} FROM metric"

    @query(key, with_log(sql, *RC_CTES, metrics_cte(repeats)))
    def run(spark, sf_dir):
        metrics = ranking.user_metrics(*fixed_lists(spark, sf_dir), "user_id", "product_id", TOP, repeats)
        return rounded(metrics.select("user_id", "true_count", "hits", column), 6)


metric_query("rc5_recall_with_repeats", "recall", True)
metric_query("rc5_recall_of_sets", "recall", False)
metric_query("rc6_precision", "precision", True)
metric_query("rc7_ndcg", "ndcg", True)


def mean_query(key: str, repeats: bool):
    sql = f"""SELECT {r('avg(recall)', 6)} AS avg_recall_at_k, {r('avg(precision)', 6)} AS avg_precision_at_k,
{r('avg(ndcg)', 6)} AS avg_ndcg_at_k, count(*) AS users FROM metric"""

    @query(key, with_log(sql, *RC_CTES, metrics_cte(repeats)))
    def run(spark, sf_dir):
        metrics = ranking.user_metrics(*fixed_lists(spark, sf_dir), "user_id", "product_id", TOP, repeats)
        return rounded(ranking.mean_metrics(metrics), 6)


mean_query("rc8_mean_metrics", False)
mean_query("ag14_mean_of_metrics", True)


@query(
    "rc9_equal_lists",
    with_log(
        """SELECT user_id, string_agg(product_id, ',' ORDER BY product_id) AS true_items FROM (SELECT user_id, product_id, range(times) AS rep FROM truth) t,
unnest(rep) GROUP BY user_id INTERSECT SELECT user_id, string_agg(product_id, ',' ORDER BY place) FROM predicted GROUP BY user_id""",
        *RC_CTES,
    ),
)
def rc9(spark, sf_dir):
    same = ranking.equal_lists(*fixed_lists(spark, sf_dir), "user_id", "product_id")
    return same.select("user_id", F.array_join("true_items", ",").alias("true_items"))


# While the catalogue has no more than LONG_LIST products, as it has in these tables, a list holds all of
# them whatever the fit finds, so recall is known: the share of a user's true items that the fit has seen.
# Items it has not seen share one number, so they are one item.
RECALL_SQL = f"""
rated AS (SELECT * FROM parts WHERE score IS NOT NULL),
seen AS (SELECT DISTINCT product_id FROM rated WHERE split = 'train'),
true_item AS (SELECT DISTINCT p.user_id, s.product_id FROM rated p LEFT JOIN seen s ON p.product_id = s.product_id
  WHERE split = 'test' AND p.user_id IN (SELECT user_id FROM rated WHERE split = 'train')),
user_recall AS (SELECT user_id, count(product_id) AS hits, count(product_id) / count(*)::DOUBLE AS recall FROM true_item GROUP BY user_id),
mean_recall AS (SELECT count(*) AS users, {r('avg(recall)', 6)} AS recall, {r(f'avg(hits / {LONG_LIST}::DOUBLE)', 6)} AS precision FROM user_recall)"""


@query(
    "rc10_evaluator",
    with_log(f"SELECT {LONG_LIST} AS k, users, recall AS avg_recall_at_k, precision AS avg_precision_at_k, recall AS evaluator_recall FROM mean_recall", SCORED_SQL, PARTS_SQL, RECALL_SQL),
)
def rc10(spark, sf_dir):
    """The evaluator on a fit with the library's default settings, next to the same mean from the joins."""
    parts = ratings(spark, sf_dir)
    ranked = tuning.RankingALS(k=LONG_LIST).fit(parts["train"])
    recall = tuning.RecallAtK(k=LONG_LIST).evaluate(ranked.transform(parts["test"]))
    joined = recommend.evaluate(parts["test"], ranked.fitted, k=LONG_LIST)
    return rounded(joined.select(F.lit(LONG_LIST).alias("k"), "users", "avg_recall_at_k", "avg_precision_at_k", F.lit(recall).alias("evaluator_recall")), 6)


def grid_sql() -> str:
    """All settings in order; they tie in recall here, so the first is the best."""
    lists = [f"(VALUES {', '.join(f'({i}, {float(v)}::DOUBLE)' for i, v in enumerate(values))}) g{n}(i{n}, \"{name}\")" for n, (name, values) in enumerate(recommend.FULL_GRID.items())]
    number = f"CAST(row_number() OVER (ORDER BY {', '.join(f'i{n}' for n in range(len(lists)))}) - 1 AS INTEGER)"
    columns = ", ".join(f'"{name}"' for name in recommend.FULL_GRID)
    return f"SELECT setting, {columns}, recall, setting = 0 AS best FROM (SELECT *, {number} AS setting FROM {' CROSS JOIN '.join(lists)}), mean_recall"


@query("rc11_grid_search", with_log(grid_sql(), SCORED_SQL, PARTS_SQL, RECALL_SQL))
def rc11(spark, sf_dir):
    """All settings of the full grid with their recall at k = 100; ``best`` marks the best one."""
    parts = ratings(spark, sf_dir)
    tried = rounded(recommend.grid_search(parts["train"], parts["test"], recommend.FULL_GRID, k=LONG_LIST), 6)
    best = recommend.best_setting(tried).first()["setting"]
    return tried.withColumn("best", F.col("setting") == best)


@query(
    "jn7_true_with_predicted",
    with_log(
        """SELECT user_id, count(DISTINCT t.product_id) AS true_items, count(DISTINCT p.product_id) AS pred_items
FROM truth t JOIN predicted p USING (user_id) GROUP BY user_id""",
        *RC_CTES,
    ),
)
def jn7(spark, sf_dir):
    truth_rows, predicted = fixed_lists(spark, sf_dir)
    true_counts = truth_rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("true_items"))
    pred_counts = predicted.groupBy("user_id").agg(F.count(F.lit(1)).alias("pred_items"))
    return true_counts.join(pred_counts, "user_id")
