"""The URL list that is keyed by a label anywhere in the host."""

import tracemalloc

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from clickgrain.llm import urlrules
from clickgrain.llm.catalog import PAGE_ORACLES, PAGE_QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_list_is_not_empty_on_the_given_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    assert not urlrules.hosts_below_label(pages, urlrules.BAD_LABELS).isEmpty()


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
@pytest.mark.parametrize("name", sorted(PAGE_ORACLES))
def test_equals_oracle(spark, name, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(PAGE_QUERIES[name](spark, folder), connect(folder), PAGE_ORACLES[name]) is None


def test_labels_anywhere(spark):
    bad = ["http://m.casino-win.example.com/a", "http://blog.ADULT-X.example.net/b?c", "http://casino-win/", "http://www.free-bets.adult-x.net/d"]
    good = ["http://my-casino-win.example.com/a", "http://example.com/casino-win", "casino-win.example.com/a", "http://", "", None]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    listed = urlrules.hosts_below_label(pages, urlrules.BAD_LABELS)
    assert {tuple(r) for r in listed.collect()} == {
        ("casino-win.example.com", "/a"),
        ("adult-x.example.net", "/b"),
        ("casino-win", "/"),
        ("free-bets.adult-x.net", "/d"),
        ("adult-x.net", "/d"),
    }
    rules = urlrules.rule_table(spark, [])
    other = spark.createDataFrame([(90, "http://www.casino-win.example.com/a/x"), (91, "http://casino-win.example.com/z")], "page_id long, url string")
    made = {r.page_id: r.verdict for r in urlrules.filter_pages(pages.unionByName(other), rules, listed).collect()}
    assert [made[i] for i in range(len(bad))] == ["block"] * len(bad)
    assert [made[len(bad) + i] for i in range(len(good))] == ["allow"] * len(good)
    assert (made[90], made[91]) == ("block", "allow")  # below a listed path, and not


@pytest.mark.parametrize("name", sorted(PAGE_QUERIES))
def test_odd_and_no_rows(spark, sf_dir, tmp_path, name):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    nothing = spark.createDataFrame([(None,) * len(pages.columns)], pages.schema)
    pages.unionByName(nothing).unionByName(nothing).write.parquet(str(tmp_path / "odd" / "pages.parquet"))
    pages.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert len(PAGE_QUERIES[name](spark, str(tmp_path / "odd")).collect()) == pages.count() + 2
    assert PAGE_QUERIES[name](spark, str(tmp_path / "none")).collect() == []


def test_very_long_urls(spark):
    """60,000 labels before a listed host, and as many that are on the list themselves."""
    long = "a." * 60_000
    urls = [f"http://{long}casino-win.example.com/a/b", f"http://{long}example.com/a", f"http://casino-win.{long}org/x", f"http://h.com/{'p/' * 60_000}"]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://www.casino-win.example.com/a/b/c"])), "page_id long, url string")
    listed = urlrules.hosts_below_label(pages, urlrules.BAD_LABELS)
    made = {r.page_id: (r.rule, r.verdict) for r in urlrules.filter_pages(pages, urlrules.rule_table(spark, urlrules.RULES), listed).collect()}
    assert made == {0: (None, "block"), 1: (None, "allow"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "block")}


@pytest.mark.parametrize("keys", [0, 1, 500_000])
def test_filter_comes_to_the_driver_as_columns(spark, keys):
    """Rows as Python objects took over ten times the filter: some 90 MB for one of 8 MB."""
    rows = spark.range(keys).select(F.xxhash64("id").alias("key"))
    tracemalloc.start()
    filled = urlrules.build_filter(rows, "key")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros_like(filled)
    hashes = np.array([r.key for r in rows.collect()], np.int64).view(np.uint64)
    np.bitwise_or.at(want, *urlrules._bits(hashes, filled.shape[0]))
    assert (filled == want).all() and filled.any() == (keys > 0)
    assert keys < 1000 or filled.nbytes == 1 << 20 and peak < 4 * filled.nbytes
