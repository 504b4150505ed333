"""URL filter: host and path rules, then logistic regression on character n-grams.

The regression sees hashed n-grams of the host and of the path. It is trained from a
small labelled table of URLs; ``seed_labels`` makes one from words in host names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
# The regression is fitted on at most so many labelled URLs of each class, those of the
# smallest hashes.
TRAIN_PER_CLASS = 10_000
BLOCK_AT = 0.5


@dataclass(frozen=True)
class Rule:
    """Fits ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the URL query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


# Words that mark a host as one to block in the labelled table.
SEED_WORDS = (
    "ads", "adult", "bet", "bets", "betting", "casino", "escort", "gamble", "jackpot", "loans",
    "lottery", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "viagra",
    "warez", "xxx",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty for a null URL and one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``struct(name, verdict)``; null where none does.

    The rules are a small constant of the plan; a tie goes to the earlier one.
    """
    pick = F.lit(None).cast("struct<name:string,verdict:string>")
    # sorted() is stable, and the last rule applied wins
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        own = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        pick = F.when(fits, own).otherwise(pick)
    return pick


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of both parts, their ends marked."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(max(1, len(part) - n + 1)):
                found.add(crc32((mark + part[i : i + n]).encode("utf-8", "replace")) % BUCKETS)
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def block(self, host: str, path: str) -> float:
        """Probability that the URL is one to block."""
        own = grams(host, path)
        raw = self.bias + self.weights[own].sum() / np.sqrt(len(own))
        return float(1 / (1 + np.exp(-np.clip(raw, -500, 500))))


def fit(hosts: list[str], paths: list[str], bad: np.ndarray, rounds: int = 300, ridge: float = 1e-5) -> UrlModel:
    """Accelerated gradient descent on the logistic loss, both classes weighing the same.

    Without both classes there is nothing to tell apart: the weights are zero, and
    everything is allowed.
    """
    weights, bias, rows = np.zeros(BUCKETS), -1.0, len(bad)
    if not rows or bad.all() or not bad.any():
        return UrlModel(weights, bias)
    own = [grams(h, p) for h, p in zip(hosts, paths, strict=True)]
    size = np.array([len(g) for g in own])
    flat, row = np.concatenate(own), np.repeat(np.arange(rows), size)
    value = (1 / np.sqrt(size))[row]
    weigh = np.where(bad > 0, 0.5 / bad.sum(), 0.5 / (rows - bad.sum()))
    ahead, ahead_bias, last, last_bias = weights.copy(), bias, weights, bias
    for k in range(rounds):
        raw = np.bincount(row, ahead[flat] * value, rows) + ahead_bias
        error = weigh * (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - bad)
        slope = np.bincount(flat, error[row] * value, BUCKETS) + ridge * ahead
        weights, bias = ahead - 2.0 * slope, ahead_bias - 2.0 * error.sum()
        speed = k / (k + 3)
        ahead, ahead_bias = weights + speed * (weights - last), bias + speed * (bias - last_bias)
        last, last_bias = weights, bias
    return UrlModel(weights, float(bias))


def seed_labels(pages: DataFrame, url_col: str = "url", words: tuple[str, ...] = SEED_WORDS) -> DataFrame:
    """``url, bad``: whether a part of the host name is one of ``words``. Null URLs and
    those without a host are left out."""
    host, _ = host_and_path(F.col(url_col))
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*map(F.lit, words)))
    return pages.filter(host != "").select(F.col(url_col).alias("url"), bad.alias("bad"))


def train(labelled: DataFrame) -> UrlModel:
    """Fits on ``labelled(url, bad)``; null labels are left out, and at most
    ``TRAIN_PER_CLASS`` rows of each class reach the driver."""
    host, path = host_and_path(F.col("url"))
    known = (
        labelled.filter("bad is not null")
        .select(host.alias("host"), path.alias("path"), F.col("bad").cast("int").alias("bad"))
        .distinct()
    )
    hosts, paths, bad = [], [], []
    for kind in (0, 1):
        rows = (
            known.filter(F.col("bad") == kind)
            .orderBy(F.xxhash64("host", "path"), "host", "path")
            .limit(TRAIN_PER_CLASS)
            .toArrow()
        )
        hosts += rows.column("host").to_pylist()
        paths += rows.column("path").to_pylist()
        bad += rows.column("bad").to_pylist()
    return fit(hosts, paths, np.array(bad, np.float64))


def judged(pages: DataFrame, model: UrlModel, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict, block_score`` per row, without a shuffle.

    The longest rule that fits decides, else the regression: block at a score of
    ``BLOCK_AT`` or more. A null URL has an empty host and path and is judged too.
    """
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = parts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            scored = pa.array([model.block(h, p) for h, p in pairs], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scored], names=[*batch.schema.names, "block_score"])

    scored = parts.mapInArrow(run, f"id {kind}, host string, path string, block_score double")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(
        "id", "host", "path", rule["name"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("block_score") >= BLOCK_AT, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
