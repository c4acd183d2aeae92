"""URL filters: pattern rules indexed by their rarest literal token.

Two kinds of rules: scopes (host and path prefix, the longest fitting one wins) and patterns (regular expressions over
host and path). Every rule lists tokens that any URL it fits must hold; it is filed under the rarest of them, measured
on the URLs themselves. A URL's own tokens fetch the candidates, and only their regular expressions run. Rules without
a token are candidates of every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")
MAX_RULE_BYTES = 64 << 20  # rules go to every task


@dataclass(frozen=True)
class Rule:
    verdict: str
    regex: str  # searched in host + path
    tokens: tuple[str, ...]  # each is a whole token of every host + path that fits, lower case
    name: str | None = None  # of a scope; the longest fitting scope decides
    size: int = 0


def scope(verdict: str, host: str, path: str) -> Rule:
    """host and its subdomains, paths that start with path. A path prefix may end inside a token, so its last one isn't literal."""
    parts = TOKEN.findall(path.lower())
    closed = parts if path and not path[-1].isalnum() else parts[:-1]
    return Rule(verdict, rf"^(?:[^/]*\.)?{re.escape(host)}(?={re.escape(path)})(?:(?=/)|$)", (*TOKEN.findall(host), *closed), host + path, len(host + path))


def pattern(verdict: str, token: str) -> Rule:
    """A word of the host, whole between its separators."""
    return Rule(verdict, rf"^(?:[^/]*[.-])?{re.escape(token)}(?:[.-][^/]*)?(?:/|$)", (token,))


#: The scopes of production use.
SCOPES = (scope("allow", "org", "/"), scope("block", "example.org", "/es/"), scope("block", "example.org", "/en/1"), scope("allow", "com", "/fr/"), scope("block", "com", "/de/"))
#: Words of hosts that the method blocks where no scope decides.
PATTERNS = tuple(pattern("block", t) for t in ("adult", "bet", "bets", "betting", "casino", "casinos", "gambling", "jackpot", "lottery", "pills", "poker", "porn", "pharma", "slots", "viagra", "warez", "xxx"))


def host_of(url: Column) -> Column:
    """Behind the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    rest = F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1)
    return F.translate(F.substring_index(rest, "#", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


class RuleIndex:
    def __init__(self, rules: tuple[Rule, ...], frequency: dict[str, int]):
        self.by_token: dict[str, list] = defaultdict(list)
        self.always: list = []
        for r in rules:
            entry = (re.compile(r.regex, re.S), r)
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (frequency.get(t, 0), t))].append(entry)
            else:
                self.always.append(entry)

    def candidates(self, place: str) -> Iterator[tuple]:
        yield from self.always
        for t in set(TOKEN.findall(place.lower())):
            yield from self.by_token.get(t, ())

    def judge(self, place: str, default: str) -> tuple[str | None, str]:
        best, blocked = None, None
        for regex, r in self.candidates(place):
            if (r.name is not None or blocked is None) and regex.search(place):
                if r.name is None:
                    blocked = r.verdict
                elif best is None or (r.size, r.name) > (best.size, best.name):
                    best = r
        return (best.name, best.verdict) if best else (None, blocked or default)


def judge_urls(pages: DataFrame, scopes: tuple[Rule, ...] = SCOPES, patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    Null URLs and those without :// have empty host and path, no rule and the default verdict. Of equally long scopes
    the one whose text is greater wins; a blocking pattern beats the default. Rows stay in place, repeated ones and null
    ids too; other columns are not read. An empty table gives no rows.
    """
    rules = scopes + patterns
    if sum(len(r.regex) for r in rules) > MAX_RULE_BYTES:
        raise ValueError("rules go to every task and must stay below MAX_RULE_BYTES")
    urls = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    literal = sorted({t for r in rules for t in r.tokens})
    tokens = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]+)")))).alias("t"))
    frequency = {r["t"]: r["n"] for r in tokens.where(F.col("t").isin(literal)).groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most one row a literal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, frequency)
        for b in batches:
            hosts, paths = b.column(1), b.column(2)
            got = [index.judge(h + p, default) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), hosts, paths, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
