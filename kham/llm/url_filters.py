"""URL filters as a sort-merge range join.

A host is keyed by its reversed labels, each closed by a dot (`net.example.blog.`), so a rule for a host and all its
subdomains is the interval of keys that start with the rule's key. Pages are range-partitioned and sorted by key; each
task sweeps its pages beside the sorted rules with a stack of the nested rule hosts that are active. A task starts
anywhere: the stack at its first key follows from each rule host's enclosing rule host.

A page whose url is null or has no `://` has empty host and path and gets the default verdict. Of the rules that fit,
the one with the longest host + path wins, at the same length the longer host; of two verdicts for one rule, `block`.
Rules with a null part are ignored. Repeated pages are judged each; a hot host or url is split by path and id.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crosswise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that one sweep takes at once; more are swept in several rounds.
RULE_BLOCK = 500_000


def host_key(host: str) -> str:
    return "".join(f"{x}." for x in reversed(host.split(".")))


class Sweep:
    """Sorted rule hosts with their paths, and the stack of those active at the current key."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        by: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in rules:
            paths = by.setdefault(host_key(host), {})
            if path not in paths or verdict == "block":
                paths[path] = (host + path, verdict)
        self.keys = sorted(by)
        self.paths = [by[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in x}, reverse=True) for x in self.paths]
        self.up: list[int] = []  # the enclosing rule host of each, -1 if none
        stack: list[int] = []
        for i, k in enumerate(self.keys):
            while stack and not k.startswith(self.keys[stack[-1]]):
                stack.pop()
            self.up.append(stack[-1] if stack else -1)
            stack.append(i)
        self.next, self.stack = None, []

    def start(self, key: str) -> None:
        self.next = bisect_right(self.keys, key)
        i, chain = self.next - 1, []
        while i >= 0:
            if key.startswith(self.keys[i]):
                chain.append(i)
            i = self.up[i]
        self.stack = chain[::-1]

    def match(self, key: str, path: str) -> tuple[str, str] | None:
        """The winning (rule, verdict) of a page; keys must not fall between calls."""
        if self.next is None:
            self.start(key)
        stack, keys = self.stack, self.keys
        while stack and not key.startswith(keys[stack[-1]]):
            stack.pop()
        while self.next < len(keys) and keys[self.next] <= key:
            if key.startswith(keys[self.next]):
                stack.append(self.next)
            self.next += 1
        best = None
        for i in reversed(stack):  # the longest host first: a tie stays with it
            for n in self.lengths[i]:
                if n <= len(path) and (got := self.paths[i].get(path[:n])):
                    if best is None or len(got[0]) > len(best[0]):
                        best = got
                    break
        return best


def url_filters(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *,
                default: str = "allow", rule_block: int = RULE_BLOCK) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; `rules` has host, path, verdict."""
    host = F.coalesce(F.translate(F.regexp_extract(pages[url_col], "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(pages[url_col], "://[^/?#]*([^?#]*)", 1), F.lit(""))
    kind = pages.schema[id_col].dataType
    key = F.concat(F.array_join(F.reverse(F.split("host", "\\.")), "."), F.lit("."))
    df = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path")).withColumn("key", key)
    df = df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    df = df.repartitionByRange(crosswise(pages.sparkSession), "key", "path", F.xxhash64("id")).sortWithinPartitions("key")

    good = rules.select("host", "path", "verdict").dropna()
    blocks = max(1, -(-good.count() // rule_block))
    for k in range(blocks):
        part = good.where(F.pmod(F.xxhash64("host", "path"), F.lit(blocks)) == k) if blocks > 1 else good
        df = _swept(df, [tuple(r) for r in part.collect()], kind)  # bounded by rule_block
    return df.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _weight(rule: str) -> tuple[int, int]:
    """Length of a rule, then of its host: paths of rules that fit are empty or start with a slash."""
    return len(rule), (rule + "/").index("/")


def _swept(df: DataFrame, rules: list[tuple[str, str, str]], kind) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(shared.value)
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (3, 2, 4, 5)]
            rule, verdict = [], []
            for key, path, r, v in zip(*cols, strict=True):
                got = sweep.match(key, path)
                if got and (r is None or _weight(got[0]) > _weight(r)):
                    r, v = got
                rule.append(r)
                verdict.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["id", "host", "path", "key", "rule", "verdict"])

    return df.mapInArrow(run, f"id {kind.simpleString()}, host string, path string, key string, rule string, verdict string")
