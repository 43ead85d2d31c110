"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with words that every match holds as whole tokens.  Tokens of all
urls are counted; a rule is filed under the one of its tokens that the fewest urls hold.  The tokens of a url fetch its
candidate rules, and only those run their expressions.  Rules without a token are candidates everywhere.

The index travels to the tasks in blocks of ``BLOCK_RULES`` rules, one pass over the urls for each block, so what a task holds
is bounded however many rules there are.  Nothing is shuffled but the counts of the rules' tokens.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import quoted

BLOCK_RULES = 100_000
TOKEN = "[a-z0-9]+"
_NO_RULE = -1


@dataclass(frozen=True)
class Rule:
    """``name`` and ``action`` are given back; of the rules that fit, the one with the largest ``weight`` wins, then the first."""

    name: str | None
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(action: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the path begins with ``path``; longer rules win."""
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}"
    # a word at the end of the path may go on in a url, so it is no whole token
    tokens = re.findall(TOKEN, host) + [m[0] for m in re.finditer(TOKEN, path) if 0 < m.start() and m.end() < len(path)]
    return Rule(host + path, action, pattern, tuple(dict.fromkeys(tokens)), len(host) + len(path))


# Hosts of advertisers and counters.  Their names are not given back, and any host rule goes before them.
PATTERNS = (
    Rule(None, "block", r"(?:[^/]*[.-])?ads(?=[.-])", ("ads",), -1),
    Rule(None, "block", r"(?:[^/]*[.-])?track(?=[.-])", ("track",), -1),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", otherwise: str = "allow",
          block_rules: int = BLOCK_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    The host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
    path is what follows up to ``?``, ``#`` or the end.  A url that is null or has no ``://`` has neither.  Where no rule
    fits, ``rule`` is null and the verdict is ``otherwise``.

    Repeated rows are judged alike, null ids are kept, an empty table gives an empty result and no rules leave every url to
    ``otherwise``.  Of rules of equal weight the first of the list wins.  Other columns are not looked at.
    """
    link = pages[quoted(url)].cast("string")
    rows = pages.select(pages[quoted(page_id)].alias("id"), host_of(link).alias("host"), path_of(link).alias("path"))
    indexed = rows.withColumn("best", F.lit(_NO_RULE))
    held = token_counts(rows, sorted({t for r in rules for t in r.tokens}))
    kind = rows.schema["id"].dataType.simpleString()
    for begin in range(0, len(rules), block_rules):
        block = {i: rules[i] for i in range(begin, min(begin + block_rules, len(rules)))}
        weights = [r.weight for r in rules]
        indexed = indexed.mapInArrow(_fitted(block, held, weights), f"id {kind}, host string, path string, best int")
    names, actions = [r.name for r in rules], [r.action for r in rules]
    return indexed.mapInArrow(
        _named(names, actions, otherwise), f"id {kind}, host string, path string, rule string, verdict string",
    ).withColumnsRenamed({"id": page_id})


def token_counts(rows: DataFrame, wanted: list[str]) -> dict[str, int]:
    """Number of urls that hold each of the rules' tokens: at most as many rows as the rules have tokens."""
    if not wanted:
        return {}
    tokens = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), 1))).alias("token"))
    listed = rows.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    found = tokens.join(F.broadcast(listed), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in found.collect()}


def index_of(rules: dict[int, Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and those without one."""
    by_token, always = defaultdict(list), []
    for i, rule in rules.items():
        if rule.tokens:
            by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(by_token), always


def _fitted(rules: dict[int, Rule], counts: dict[str, int], weights: list[int]):
    by_token, always = index_of(rules, counts)
    patterns = {i: r.pattern for i, r in rules.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}
        tokens = re.compile(TOKEN).findall
        for batch in batches:
            best = batch.column("best").to_pylist()
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            for row, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                subject = host + path
                candidates = [i for t in set(tokens(subject)) if t in by_token for i in by_token[t]] + always
                for i in candidates:
                    expression = compiled.get(i)
                    if expression is None:
                        expression = compiled[i] = re.compile(patterns[i], re.DOTALL)
                    now = best[row]
                    if (now == _NO_RULE or (weights[i], -i) > (weights[now], -now)) and expression.match(subject):
                        best[row] = i
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(best, pa.int32())], ["id", "host", "path", "best"])

    return run


def _named(names: list[str], actions: list[str], otherwise: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("best").to_pylist()
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([None if b == _NO_RULE else names[b] for b in best], pa.string()),
                pa.array([otherwise if b == _NO_RULE else actions[b] for b in best], pa.string()),
            ], ["id", "host", "path", "rule", "verdict"])

    return run
