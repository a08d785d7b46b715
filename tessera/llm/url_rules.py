"""URL filters: a sort-merge range join of urls against host and path rules.

Hosts become reversed keys with a terminator after every label
(``www.example.org`` -> ``org.example.www.``). The urls a rule's host covers are
then one interval of the sorted keys, and intervals of different rules nest or
are disjoint. A sweep over the sorted keys of a batch keeps a stack of the rules
whose interval is open; between two interval ends the stack does not change, so
the urls there are matched as one slice. Paths are swept the same way inside a
slice: a rule's path prefix is an interval of the sorted paths.

No shuffle happens: a batch is sorted where it was read, so a host that holds a
third of all rows costs no more than others. Rules go to the tasks in blocks of
at most ``block_rules``; more rules take further sweeps over the same rows and
the longest match is kept, so nothing that grows without bound is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``.`` ends every label of a key and ``/`` is the next code point, so ``key[:-1] + "/"`` ends the interval.
_END = "/"
_LAST = "\U0010ffff"
#: A-Z and a-z.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``action`` is allow or block; the rule fits ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def _successor(prefix: str) -> str | None:
    """The least string above every string with this prefix; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            c += 1
            if 0xD800 <= c <= 0xDFFF:
                c = 0xE000
            return prefix[:i] + chr(c)
    return None


def sweep(keys: list[str], paths: list[str], rules: list[Rule]) -> list[int]:
    """For each url the index of its longest rule in ``rules``, or -1. ``rules`` ascend by (length, host)."""
    found = [-1] * len(keys)
    order = sorted(range(len(keys)), key=lambda i: (keys[i], paths[i]))
    ordered = [keys[i] for i in order]
    events = []
    for r, rule in enumerate(rules):
        key = host_key(rule.host)
        events += [(key, 1, r), (key[:-1] + _END, 0, r)]
    events.sort()
    stack: list[int] = []
    for n, (at, opens, r) in enumerate(events):
        stack.append(r) if opens else stack.remove(r)
        until = events[n + 1][0] if n + 1 < len(events) else at
        if not stack or until == at:
            continue
        lo, hi = bisect_left(ordered, at), bisect_left(ordered, until)
        if lo < hi:
            _sweep_paths(order[lo:hi], paths, rules, sorted(stack), found)
    return found


def _sweep_paths(members: list[int], paths: list[str], rules: list[Rule], active: list[int], found: list[int]) -> None:
    """Within one slice every active rule covers an interval of the sorted paths; longer rules overwrite shorter ones."""
    members = sorted(members, key=lambda i: paths[i])
    ordered = [paths[i] for i in members]
    for r in active:
        lo, after = bisect_left(ordered, rules[r].path), _successor(rules[r].path)
        hi = len(ordered) if after is None else bisect_left(ordered, after)
        for i in members[lo:hi]:
            found[i] = r


def split_url(url: str = "url"):
    """Columns (host, path) of a url: both empty for null and for urls without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.expr(f"substring(coalesce({url}, ''), locate('://', coalesce({url}, '')) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def match_rules(urls: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", block_rules: int = 5_000) -> DataFrame:
    """One row per input row: ``id_col, host, path, rule, verdict``.

    Null urls and urls without ``://`` have an empty host and path, match no rule
    and get ``default``. Repeated rows give repeated results; of two equal rules
    the later one holds; of two fitting rules of one length the one with the
    longer host holds. Very long urls are read whole. An empty table gives no rows,
    and no rules give every row ``default``. Other input columns are not read.
    """
    host, path = split_url("__url")
    rows = urls.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    rows = rows.select("__id", host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    unique = {(r.host, r.path): r for r in (Rule(a, h.translate(str.maketrans(_UPPER, _LOWER)), p) for a, h, p in rules)}
    ranked = sorted(unique.values(), key=lambda r: host_key(r.host))
    for start in range(0, len(ranked), block_rules):
        block = sorted(ranked[start : start + block_rules], key=lambda r: (len(r.text), len(r.host), r.text))
        rows = rows.mapInArrow(_matcher(block), rows.schema)
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", "verdict")


def _matcher(block: list[Rule]):
    texts, actions = [r.text for r in block], [r.action for r in block]

    def run(batches):
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            for i, r in enumerate(sweep([host_key(h) for h in hosts], paths, block)):
                if r >= 0 and (rule[i] is None or (len(texts[r]), len(block[r].host)) > (len(rule[i]), len(rule[i].partition("/")[0]))):
                    rule[i], verdict[i] = texts[r], actions[r]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=batch.schema.names)

    return run


def rule_counts(matched: DataFrame) -> DataFrame:
    """Rows by rule and verdict, for reviewing a rule set."""
    return matched.groupBy("rule", "verdict").agg(F.count(F.lit(1)).cast(T.LongType()).alias("n_urls"))
