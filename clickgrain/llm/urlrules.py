"""URL verdicts from listed rules by a blocked Bloom filter and an exact hash join.

A listed entry is a host with a path prefix (``example.net/en/``). It fits a URL whose host is the
entry's or a subdomain of it and whose path starts with the entry's path. The keys of a URL are its
host suffixes joined to those prefixes of its path that are as long as some listed path. All keys
go through a blocked Bloom filter of the listed keys: one 64-byte block a key, eight bits in it. The
few that pass are hash-joined with the list, which removes the false positives.

The filter has at most ``MOST_BLOCKS`` blocks (8 MB), which is the bound of what is broadcast. A list
too long for it only lets more keys through to the join. URLs are judged once per distinct text, so a
URL that a third of the pages share costs no more than another.

Nulls: a null URL or one without ``://`` has empty host and path and no rule. Without pages or
without a list the result is empty, or no row has a rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickgrain.llm.words import U, mix
from clickgrain.session import park

BLOCK_WORDS = 8
MOST_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 32


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and the eight words of its mask, one bit in each."""
    x = mix(hashes)
    place = (x % U(blocks)).astype(np.int64)
    y = mix(x ^ U(0x5851F42D4C957F2D))
    shifts = (y[:, None] >> (U(6) * np.arange(BLOCK_WORDS, dtype=U))) & U(63)
    return place, U(1) << shifts


def build_filter(keys: DataFrame, column: str = "hash") -> np.ndarray:
    """The blocked Bloom filter of a column of 64-bit hashes, built in the tasks and joined by OR."""
    listed = keys.count()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * KEYS_PER_BLOCK < listed:
        blocks *= 2

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros((blocks, BLOCK_WORDS), U)
        for batch in batches:
            place, masks = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U), blocks)
            np.bitwise_or.at(filled, place, masks)
        used = np.flatnonzero(filled.any(axis=1))
        for some in np.array_split(used, max(1, used.size // 4096)):
            columns = {"block": pa.array(some)} | {f"w{i}": pa.array(filled[some, i].view(np.int64)) for i in range(BLOCK_WORDS)}
            yield pa.RecordBatch.from_pydict(columns)

    names = [f"w{i}" for i in range(BLOCK_WORDS)]
    parts = keys.select(column).mapInArrow(part, ", ".join(f"{n} long" for n in ["block", *names]))
    merged = parts.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])
    out = np.zeros((blocks, BLOCK_WORDS), U)
    # At most MOST_BLOCKS rows of nine numbers, as columns: rows as Python objects take ten times the filter.
    table = merged.toArrow()
    place = table.column("block").to_numpy()
    for i, name in enumerate(names):
        out[place, i] = table.column(name).to_numpy().view(U)
    return out


def may_hold(spark: SparkSession, filled: np.ndarray, hashes: Column) -> Column:
    """Whether the filter may hold the hash: never false for one that was put in."""
    sent = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def test(column: pd.Series) -> pd.Series:
        table = sent.value
        if not len(column):
            return pd.Series([], dtype=bool)
        place, masks = _bits(column.to_numpy(np.int64).view(U), table.shape[0])
        return pd.Series(((table[place] & masks) == masks).all(axis=1))

    return test(hashes)


def _found(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Per distinct non-null URL of ``urls``: url, host, path and the best entry of each kind of ``listed``.

    ``listed`` has host, path, verdict and kind; ``best`` maps a kind to n, n_host, rule and verdict of
    its longest fitting entry. Keys are made only for host and path lengths that entries have, so a URL
    of any length makes no more keys than there are pairs of such lengths.
    """
    spark = urls.sparkSession
    entries = listed.filter(F.col("host").isNotNull()).groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "kind")
    entries = entries.agg(F.min("verdict").alias("verdict"))
    sizes = (F.length("host").alias("n_host"), F.length("path").alias("n_path"))
    entries = park(entries.select(F.concat("host", "path").alias("rule"), "verdict", "kind", F.xxhash64("host", "path").alias("hash"), *sizes), "listed")
    # One number per length: no more than the longest listed host and path have characters.
    hosts, paths = ([r[0] for r in entries.select(n).distinct().collect()] for n in ("n_host", "n_path"))
    distinct = urls.filter(F.col("url").isNotNull()).select("url").distinct()
    split = distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not hosts:
        return split.withColumn("best", F.lit(None).cast("map<string, struct<n: int, n_host: int, rule: string, verdict: string>>"))
    filled = build_filter(entries)
    whole = F.length("host") == F.col("n_suffix")
    keys = (
        split.filter(F.col("host") != "")
        .select("url", "host", "path", F.explode(F.array(*[F.lit(n) for n in hosts])).alias("n_suffix"))
        .filter(whole | F.expr("length(host) > n_suffix AND substring(host, length(host) - n_suffix, 1) = '.'"))
        .select("url", "path", "n_suffix", F.expr("right(host, n_suffix)").alias("suffix"))
        .select("url", "suffix", "n_suffix", "path", F.explode(F.array(*[F.lit(n) for n in paths])).alias("n"))
        .filter(F.length("path") >= F.col("n"))
        .withColumn("prefix", F.expr("left(path, n)"))
        .select("url", F.concat("suffix", "prefix").alias("text"), "n_suffix", F.xxhash64("suffix", "prefix").alias("key"))
    )
    passed = keys.filter(may_hold(spark, filled, F.col("key")))
    exact = passed.join(entries, (F.col("key") == F.col("hash")) & (F.col("text") == F.col("rule")) & (F.col("n_suffix") == F.col("n_host")))
    best = exact.groupBy(F.col("url").alias("judged"), "kind").agg(F.max(F.struct(F.length("rule").alias("n"), "n_host", "rule", "verdict")).alias("top"))
    best = best.groupBy("judged").agg(F.map_from_entries(F.collect_list(F.struct("kind", "top"))).alias("best"))
    return split.join(best, F.col("url") == F.col("judged"), "left").select("url", "host", "path", "best")


def judge(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (url) against ``listed`` (host, path, verdict): one row per distinct non-null URL.

    Columns: url, host, path, rule, verdict; the last two are null where no entry fits. The entry with
    the longest text wins, of those as long the one with the longer host. Listed twice with different
    verdicts, the smaller verdict counts.
    """
    found = _found(urls, listed.select("host", "path", "verdict", F.lit("rule").alias("kind")))
    return found.select("url", "host", "path", F.col("best")["rule"]["rule"].alias("rule"), F.col("best")["rule"]["verdict"].alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules written as (text, verdict); the text up to the first slash is the host."""
    rows = [(text.partition("/")[0], text[len(text.partition("/")[0]) :], verdict) for text, verdict in rules]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def hosts_below_label(pages: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Listed URLs from a table of pages: (host, path) of those with a listed label anywhere in the host.

    The host of an entry begins at the listed label, so ``m.``, ``blog.`` and ``www.`` before it fall under
    the entry. A host with several listed labels makes an entry for each.
    """
    named = pages.select(F.split(host_of(F.col("url")), r"\.", -1).alias("labels"), path_of(F.col("url")).alias("path"))
    places = F.filter(F.transform("labels", lambda label, i: F.when(label.isin(*labels), i + 1)), lambda i: i.isNotNull())
    each = named.select("labels", "path", F.explode(places).alias("i"))
    return each.select(F.array_join(F.slice("labels", F.col("i"), F.size("labels")), ".").alias("host"), "path").distinct()


def filter_pages(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, rule, listed_url and verdict.

    ``rules`` (host, path, verdict) decide; where none fits, a URL in ``listed`` (host, path: canonical
    URLs, without query and fragment, and what lies below them) is blocked and every other allowed.
    Rules and list share one filter: a listed URL is an entry whose verdict is ``listed``.
    """
    entries = rules.select("host", "path", "verdict", F.lit("rule").alias("kind"))
    entries = entries.unionByName(listed.select("host", "path", F.lit("listed").alias("verdict"), F.lit("list").alias("kind")))
    pages = pages.select("page_id", "url")
    rule, entry = F.col("best")["rule"], F.col("best")["list"]
    found = _found(pages, entries).select(F.col("url").alias("r_url"), rule["rule"].alias("rule"), rule["verdict"].alias("r_verdict"), entry["rule"].alias("listed_url"))
    verdict = F.coalesce("r_verdict", F.when(F.col("listed_url").isNotNull(), "block").otherwise("allow"))
    joined = pages.join(found, F.col("url") == F.col("r_url"), "left")
    return joined.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", "listed_url", verdict.alias("verdict"))


#: The rules of the query. Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labels whose pages are listed for blocking wherever they stand in the host.
BAD_LABELS = ("free-bets", "adult-x", "casino-win")

SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
bad_labels(label) AS (VALUES ('free-bets'), ('adult-x'), ('casino-win')),
listed AS (
  SELECT DISTINCT substr(s.host, p.at) AS host, s.path
  FROM (SELECT DISTINCT host, path FROM split) s, LATERAL (SELECT unnest(range(1, length(s.host) + 1)) AS at) p, bad_labels l
  WHERE (p.at = 1 OR substr(s.host, p.at - 1, 1) = '.') AND (substr(s.host, p.at) = l.label OR starts_with(substr(s.host, p.at), l.label || '.'))),
hit AS (
  SELECT s.url, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM split) s
  JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY s.url),
bad AS (
  SELECT DISTINCT s.url FROM (SELECT DISTINCT url, host, path FROM split) s
  JOIN listed l ON (s.host = l.host OR ends_with(s.host, '.' || l.host)) AND starts_with(s.path, l.path))
SELECT s.page_id, s.host, s.path, h.rule, coalesce(h.verdict, CASE WHEN b.url IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split s LEFT JOIN hit h ON s.url = h.url LEFT JOIN bad b ON s.url = b.url
"""
