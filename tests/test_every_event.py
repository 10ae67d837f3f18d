"""The log has all of ``events``, signups too, and earlier names of queries are still there."""

from clickgrain.catalog import ORACLES, QUERIES
from clickgrain.catalog.every import EVERY_ORACLES, EVERY_QUERIES, SUFFIX
from clickgrain.sources.testlog import event_log, table


def test_every_event_is_in_the_log(spark, sf_dir):
    log, events = event_log(spark, sf_dir), table(spark, sf_dir, "events")
    copies = events.filter("event_id % 100 = 0").count()
    assert log.count() == events.count() + copies
    assert log.filter("event_type = 'signup'").count() >= events.filter("event_type = 'signup'").count() > 0


def test_earlier_names_are_the_same_queries():
    assert len(EVERY_QUERIES) > 150
    for name, run in EVERY_QUERIES.items():
        own = name.removesuffix(SUFFIX)
        assert run is QUERIES[own] and EVERY_ORACLES.get(name) == ORACLES.get(own)
