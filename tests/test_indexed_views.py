"""FV6 returns the rows of the five views, not a summary."""

from compare import connect, difference
from pyspark.sql import functions as F

from clickgrain.catalog import ORACLES, QUERIES
from clickgrain.catalog.store import FITTED, short
from clickgrain.plans import store
from clickgrain.session import park


def test_views_hold_all_keys_and_fields(spark, sf_dir):
    found = park(QUERIES["fv6_indexed_views"](spark, sf_dir), "fv6")
    con = connect(sf_dir)
    for view in store.INDEXED_VIEWS:
        rows = found.filter(F.col("view") == view.name)
        columns = [*view.keys, "event_timestamp", *[n for n in view.names if n not in FITTED]]
        assert difference(rows.select(*columns), con, ORACLES[f"fv6_indexed_{short(view)}"]) is None
    customers = found.filter("view = 'customer_feature_view'")
    assert customers.filter("RFM_user_cluster IS NULL OR size(RFM_scaled_features) <> 3").count() == 0
    assert found.count() > len(store.INDEXED_VIEWS)
