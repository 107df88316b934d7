"""URL filtering by rules on hosts and paths.

Rules live in a trie over reversed host labels; each host node carries a trie over path
segments. The trie goes to every executor once and each address walks it: the deepest host
that has a fitting path wins, and on that host the longest path. Rules are counted first:
more than ``MAX_TRIE_RULES`` are joined to the addresses' host suffixes by a shuffle instead,
with the same results.

Defined cases: a null address or one without ``://`` has an empty host and path; an empty
path starts with no rule but the empty one; equal rules that differ in action block; repeated
pages are judged each; other columns of the pages, of any name, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRIE_RULES = 500_000

_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _A_Z, _A_Z.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass
class _Paths:
    deeper: dict[str, _Paths] = field(default_factory=dict)
    # (start of the next segment, rule, action), longest first
    tails: list[tuple[str, str, str]] = field(default_factory=list)


@dataclass
class _Hosts:
    deeper: dict[str, _Hosts] = field(default_factory=dict)
    paths: _Paths | None = None
    any_path: tuple[str, str] | None = None


class RuleTrie:
    """Longest-match lookup of (action, host, path) rules."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root = _Hosts()
        for action, host, path in rules:
            self._add(action, host, path)

    def _add(self, action: str, host: str, path: str) -> None:
        node, rule = self.root, host + path
        for label in reversed(host.split(".")) if host else ():
            node = node.deeper.setdefault(label, _Hosts())
        if not path:
            if node.any_path is None or action == "block":
                node.any_path = (rule, action)
            return
        if not path.startswith("/"):
            raise ValueError(f"a rule's path starts with a slash: {path!r}")
        node.paths = place = node.paths or _Paths()
        *whole, tail = path[1:].split("/")
        for segment in whole:
            place = place.deeper.setdefault(segment, _Paths())
        same = [t for t in place.tails if t[0] == tail]
        if same and action != "block":
            return
        place.tails = sorted(
            [t for t in place.tails if t[0] != tail] + [(tail, rule, action)],
            key=lambda t: -len(t[0]),
        )

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule that fits best and its action."""
        node, chain = self.root, [self.root]
        for label in reversed(host.split(".")) if host else ():
            node = node.deeper.get(label)
            if node is None:
                break
            chain.append(node)
        segments = path[1:].split("/") if path else []
        for place in reversed(chain):
            found = place.paths and self._path(place.paths, segments)
            if found or place.any_path:
                return found or place.any_path
        return None

    @staticmethod
    def _path(place: _Paths, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for tail, rule, action in place.tails:
                if segment.startswith(tail):
                    best = (rule, action)
                    break
            place = place.deeper.get(segment)
            if place is None:
                break
        return best


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    max_trie_rules: int = MAX_TRIE_RULES,
) -> DataFrame:
    """``pages`` with columns ``host``, ``path``, ``rule`` and ``verdict`` in place of any of
    these names. ``rules`` has the string columns ``action``, ``host`` and ``path``."""
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if rules.limit(max_trie_rules + 1).count() > max_trie_rules:
        return _judge_joined(judged, rules, default)
    return _judge_trie(judged, rules, default)


def _judge_trie(judged: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    rows = rules.select("action", "host", "path").collect()  # bounded by max_trie_rules
    trie = judged.sparkSession.sparkContext.broadcast(RuleTrie(map(tuple, rows)))

    @F.pandas_udf("struct<rule string, verdict string>")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {
                    "rule": [f and f[0] for f in found],
                    "verdict": [f[1] if f else default for f in found],
                },
                dtype="object",
            )

    answer = look_up("host", "path")
    return (
        judged.withColumn("_answer", answer)
        .withColumns({"rule": F.col("_answer.rule"), "verdict": F.col("_answer.verdict")})
        .drop("_answer")
    )


def _judge_joined(judged: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same through joins: each host's suffixes against the rules' hosts."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))),
    )
    asked = judged.select("host", "path").distinct()
    fitting = (
        asked.withColumn("_host", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))))
        .join(rules.select("action", F.col("host").alias("_host"), F.col("path").alias("_path")), "_host")
        .filter(F.col("path").startswith(F.col("_path")))
    )
    best = fitting.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length("_host").alias("a"),
                F.length("_path").alias("b"),
                (F.col("action") == "block").alias("c"),
                F.concat("_host", "_path").alias("rule"),
                F.col("action").alias("action"),
            )
        ).alias("_best")
    )
    kept = [c for c in judged.columns if c not in ("rule", "verdict")]
    return judged.select(*kept).join(best, ["host", "path"], "left").select(
        *kept,
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
