import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from clickgrain.session import build_session, release

    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture()
def make_log(spark):
    """A small log from (time, type, product, category, brand, price, user, session) tuples."""

    def make(rows):
        schema = (
            "event_time string, event_type string, product_id string, category_id string, category_code string,"
            " brand string, price double, user_id string, user_session string"
        )
        full = [(*row[:4], None, *row[4:]) for row in rows]
        log = spark.createDataFrame(full, schema)
        return log.withColumn("event_time", log["event_time"].cast("timestamp"))

    return make
