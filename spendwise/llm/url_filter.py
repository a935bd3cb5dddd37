"""URL filter: host and path rules, then logistic regression on hashed character
n-grams of host and path.

The classifier is trained from a small labelled URL table (rows of (url, blocked));
its weights are 2**BITS numbers, whatever the number of pages, and so many that an
n-gram the table lacks seldom shares the weight of one that it has.  Defined results:
null urls and urls without ``://`` have empty host and path, no rule, and the
classifier's verdict of that (allow: there is no n-gram to block on); the longest
rule wins, ties to the one that sorts first; repeated rows are judged alike.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import mix

BITS = 18
ORDERS = (3, 4, 5)
# Words of blocked and allowed hosts, and paths, of the labelled table.
BLOCKED_HOSTS = ("casino-win", "free-bets", "cheap-pills", "ads-track", "poker-bonus", "slots-online", "bet-now",
                 "viagra-shop", "pills-direct", "ad-server", "click-tracker", "lottery-win", "loan-fast", "crypto-bonus",
                 "spam-mail", "link-farm")
ALLOWED_HOSTS = ("news", "wiki", "library", "museum", "school", "weather", "garden", "travel", "recipes", "science",
                 "history", "forum", "docs", "city-council", "kitchen", "weekend", "northern", "stationery", "theatre", "mother")
PREFIXES = ("", "www.", "m.", "blog.")
DOMAINS = ("example.com", "example.org", "example.net")
PATHS = ("/en/101", "/de/2040/", "/fr/7.html", "/es/55", "/")
#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def labelled_table() -> list[tuple[str, int]]:
    """The small labelled table: every host word with every prefix, domain and path in turn."""
    out = []
    for words, blocked in ((BLOCKED_HOSTS, 1), (ALLOWED_HOSTS, 0)):
        for i, word in enumerate(words):
            for j, prefix in enumerate(PREFIXES):
                for k, domain in enumerate(DOMAINS):
                    out.append((f"https://{prefix}{word}.{domain}{PATHS[(i + j + k) % len(PATHS)]}", blocked))
    return out


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as text) and its verdict; null if none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if name is None:  # no rules at all
        name = verdict = F.lit(None).cast("string")
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and path, told apart by a leading mark."""
    out = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in ORDERS:
            for i in range(len(text) - n + 1):
                out.add(zlib.crc32((mark + text[i:i + n]).encode("utf-8", "surrogatepass")))
    return np.unique(mix(np.array(sorted(out), np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64) if out else np.zeros(0, np.int64)


def _parts(url: str) -> tuple[str, str]:
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def train(table: list[tuple[str, int]] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias from a small labelled table of (url, 1 if to block)."""
    rows = table if table is not None else labelled_table()
    cols = [grams(*_parts(u)) for u, _ in rows]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    value = np.repeat([1 / np.sqrt(max(1, len(c))) for c in cols], [len(c) for c in cols])
    return logistic.fit(row, col, value, np.array([float(y) for _, y in rows]), 1 << BITS, hold_bias=True)


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, table: list[tuple[str, int]] | None = None,
          keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and blocked_p (the classifier's
    probability, whether or not a rule decided)."""
    weights, bias = train(table)
    shared = pages.sparkSession.sparkContext.broadcast((weights, bias))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select(*keep, host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("by_rule"))

    def run(batches):
        w, b0 = shared.value
        for b in batches:
            p = []
            for h, q in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                g = grams(h, q) if h or q else np.zeros(0, np.int64)
                p.append(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(len(g)) + b0))) if len(g) else 0.0)
            own = b.column("by_rule").to_pylist()
            final = [r or ("block" if x >= 0.5 else "allow") for r, x in zip(own, p)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "host", "path", "rule")),
                                              pa.array(final, pa.string()), pa.array(p, pa.float64())],
                                             [*keep, "host", "path", "rule", "verdict", "blocked_p"])

    kinds = dict(pages.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep)
                           + ", host string, path string, rule string, verdict string, blocked_p double")
