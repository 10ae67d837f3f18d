"""Secrets in texts: three plain patterns, and guess costs of values in a credential context.

The plain patterns find assignments, access keys and hexadecimal strings. Beyond them, every value
that follows a credential word and ``:`` or ``=`` is given a guess cost: the cheapest way to cut it
into known words, dates, repeats, keyboard walks and spans to be tried by brute force, found by
dynamic programming over its characters. A value that takes ``10 ** LEAST_COST`` guesses or more and
holds at least two kinds of characters is a span of kind ``guess``.

Texts are scanned in map tasks without a shuffle. Bytes decide which texts can hold a credential word,
so the expressions only run on those. Offsets are code points, ends exclusive.

Repeats and walks have any length: they start anywhere and end where they cannot go on (walks also
after ``SHORT_WALK`` characters or fewer). How far they go is known for all characters from one pass
from the end, so the time for a very long value grows in proportion to its length.

Nulls: a null text is empty. Rows repeated exactly are scanned each; without rows the result is empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickgrain.llm.words import LOWER, PIECE, _runs, blocks, text_buffers

#: Patterns of the plain kinds. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[_-]?key|credentials?|auth(?:orization)?|login|bearer)"""
    r"""["']?[\x20\t]{0,8}(?::=|=>|[:=])[\x20\t]{0,8}["']?([^\s"'<>]{6,})""",
    re.I | re.A,
)
TRIGGERS = (b"passw", b"pass", b"pwd", b"secret", b"token", b"apikey", b"api_key", b"api-key", b"key", b"credential", b"auth", b"login", b"bearer")
HEX = np.zeros(256, bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True

LEAST_COST = 10.0
SHORT_WALK = 32
COMMON = (
    "password", "passwd", "qwerty", "letmein", "welcome", "admin", "administrator", "login", "master", "monkey", "dragon", "football", "baseball",
    "iloveyou", "sunshine", "princess", "shadow", "superman", "batman", "trustno", "secret", "token", "change", "changeme", "default", "example",
    "test", "testing", "demo", "sample", "guest", "user", "username", "root", "server", "database", "private", "public", "access", "hello", "world",
    "love", "money", "freedom", "whatever", "summer", "winter", "spring", "autumn", "monday", "friday", "january", "february", "october", "company",
    "service", "system", "manager", "internet", "computer", "pass", "word", "key", "api", "your", "none", "null", "true", "false", "undefined", "here",
)
RANK = {word: i + 1 for i, word in enumerate(COMMON)}
LONGEST_WORD = max(map(len, COMMON))
BLOCKS = (1, 2, 3, 4)
LEET = str.maketrans("4301$57@", "aeoissta")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACES = {c: (y, x + y / 2) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
LOG_DAY, LOG_YEAR = math.log10(365 * 120), math.log10(120)


def _brute(c: str) -> float:
    """Decimal digits of guesses that one character costs."""
    return 1.0 if c.isdigit() else 1.415 if c.isalpha() and c.isascii() else 1.52


def _near(a: str, b: str) -> bool:
    if a not in PLACES or b not in PLACES:
        return False
    (y, x), (v, u) = PLACES[a], PLACES[b]
    return abs(y - v) <= 1 and abs(x - u) <= 1 and a != b


def guess_cost(value: str) -> float:
    """Decimal logarithm of the guesses the cheapest segmentation of ``value`` needs."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    # The walk from i reaches walks[i]; turned[i] counts changes of the keyboard row up to character i.
    # The characters from i on that equal the ones a block later are same[block][i].
    walks, turned = list(range(1, n + 1)), [0] * n
    same = {block: [0] * (n + 1) for block in BLOCKS}
    for i in range(n - 2, -1, -1):
        if _near(low[i], low[i + 1]):
            walks[i] = walks[i + 1]
        for block in BLOCKS:
            if i + block < n and low[i] == low[i + block]:
                same[block][i] = same[block][i + 1] + 1
    for i in range(1, n):
        turned[i] = turned[i - 1] + (PLACES.get(low[i], (0,))[0] != PLACES.get(low[i - 1], (0,))[0])
    # A brute force span is paid character by character; each other segment also pays for being chosen.
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + _brute(value[i]))
        here += 0.3
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = RANK.get(plain[i:j])
            if rank:
                cost = math.log10(rank + 1) + 0.3 * (plain[i:j] != low[i:j]) + 0.3 * (value[i:j] != low[i:j])
                best[j] = min(best[j], here + cost)
        found = DATE.match(low, i)
        if found:
            j = found.end()
            best[j] = min(best[j], here + (LOG_YEAR if j - i == 4 else LOG_DAY))
        for j in {*range(i + 3, min(walks[i], i + SHORT_WALK) + 1), walks[i]}:
            if j - i >= 3:
                best[j] = min(best[j], here + math.log10(47 * (j - i)) + 0.6 * (turned[j - 1] - turned[i + 1]))
        for block in BLOCKS:
            times = 1 + same[block][i] // block
            j = i + times * block
            if times > 1 and j - i >= 3:
                cost = sum(_brute(c) for c in low[i : i + block]) + math.log10(times)
                best[j] = min(best[j], here + cost)
    return best[n]


def _kinds_of_characters(value: str) -> int:
    return any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)


def text_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text by start, then kind. ``hexes`` are its long runs of hexadecimal digits."""
    found = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *span, None) for span in hexes]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:)]}!?")
        if len(value) >= LEAST["assign"] and _kinds_of_characters(value) >= 2 and (cost := guess_cost(value)) >= LEAST_COST:
            found.append(("guess", m.start(1), m.start(1) + len(value), cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _texts_with(own: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts of a block that hold a credential word or the start of an access key."""
    raw, low = own.tobytes(), LOWER[own].tobytes()
    found: set[int] = set()
    for where, needle in [(raw, b"AKIA"), *[(low, t) for t in TRIGGERS]]:
        at = where.find(needle)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            found.add(row)
            at = where.find(needle, int(offsets[row + 1]))
    return found


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (text) with its spans: kind, start, end, cost."""
    rows = docs.select(*keep, F.col("text").alias("scanned_text"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            data, at = text_buffers(batch.column(names.index("scanned_text")))
            for rows in blocks(data, at, PIECE):
                own, offsets = data[at[rows.start] : at[rows.stop]], at[rows.start : rows.stop + 1] - at[rows.start]
                starts, ends, _ = _runs(HEX[own], offsets)
                long = np.flatnonzero(ends - starts >= LEAST["hex"])
                hexes: dict[int, list[tuple[int, int]]] = {}
                for s, e in zip(starts[long].tolist(), ends[long].tolist()):
                    row = int(np.searchsorted(offsets, s, "right")) - 1
                    begin = int(np.count_nonzero((own[offsets[row] : s] & 0xC0) != 0x80))
                    hexes.setdefault(row, []).append((begin, begin + e - s))
                spans = [[] for _ in range(rows.stop - rows.start)]
                for row in _texts_with(own, offsets) | set(hexes):
                    text = own[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
                    spans[row] = [dict(zip(("kind", "start", "end", "cost"), s)) for s in text_spans(text, hexes.get(row, []))]
                kept = [batch.column(i).slice(rows.start, rows.stop - rows.start) for i, n in enumerate(names) if n != "scanned_text"]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kind)], [*[n for n in names if n != "scanned_text"], "spans"])

    types = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "scanned_text")
    return rows.mapInArrow(part, f"{types}, spans array<struct<kind: string, start: int, end: int, cost: double>>")


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
