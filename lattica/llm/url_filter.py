"""URL filters by a sort-merge range join.

A host with its labels reversed (``www.example.net`` is ``net/example/www/``) starts with the reversed host of every
rule that fits it, so a rule's host is an interval of keys: from its reversed host up to the last key that starts with it.
Intervals either nest or don't meet. Each partition sorts its URLs by that key and merges them with the sorted rules; a stack
holds the rules whose intervals are open, innermost on top. No row is shuffled: the rules are broadcast in parts of ``PART_BYTES`` at most, and a sorted partition is swept
once for each part; the stronger of a row's rules is kept from part to part, so any number of rules is exact.

Defined results: a URL that is null or has no ``://`` has empty host and path, fits no rule and gets the default verdict; an
empty path fits only rules with an empty path; of rules that fit, the one with the longest host plus path wins, then the longer host, then ``block``;
repeated rows stay, each judged alone; columns of the input other than the two named, whatever their names, are not read; URLs may be of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.util import quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rules in one broadcast part.
PART_BYTES = 32 << 20


def host_and_path(url):
    """Columns host and path of a URL column: all in JVM expressions."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host):
    """``www.example.net`` to ``net/example/www/``; the slash, which no host of a URL holds, closes each label, so that ``ample.net`` isn't a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def _key(host: str) -> str:
    return "/".join(reversed(host.split("."))) + "/"


def _prepared(rules) -> list[tuple[str, str, str, str, tuple]]:
    """(key, path, rule, verdict, strength), sorted by key as bytes; of equal rules the blocking one counts."""
    best = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict of a rule must be allow or block, not {verdict!r}")
        if "/" in host:  # fits no URL's host
            continue
        host = host.translate(str.maketrans(UPPER, LOWER))
        if best.get((host, path)) != "block":
            best[host, path] = verdict
    return sorted((_key(h).encode(), p, h + p, v, (len(h) + len(p), len(h), v == "block")) for (h, p), v in best.items())


def _parts(rules: list) -> list[list]:
    """Runs of the sorted rules, each of PART_BYTES at most; one at least."""
    out, held = [[]], 0
    for r in rules:
        size = len(r[0]) + len(r[1]) + len(r[2])
        if out[-1] and held + size > PART_BYTES:
            out.append([])
            held = 0
        out[-1].append(r)
        held += size
    return out


def _open_at(rules: list, key: bytes) -> tuple[list, int]:
    """The stack as a sweep has it when it reaches ``key``, and the place of the next rule: found by bisection for the key and each label's end before it."""
    at = bisect.bisect_right(rules, key, key=lambda r: r[0])
    stack, end = [], key.find(b"/")
    while end >= 0:
        own = key[: end + 1]
        a, b = (f(rules, own, key=lambda r: r[0]) for f in (bisect.bisect_left, bisect.bisect_right))
        if a < b:
            stack.append(rules[a:b])
        end = key.find(b"/", end + 1)
    return stack, at


def sweep(keys: list[bytes], paths: list[str], rules: list) -> list[tuple | None]:
    """The strongest rule that fits, or None, for each URL of a run sorted by key. The stack's depth is that of nested rule hosts."""
    if not keys:
        return []
    out = []
    stack, at = _open_at(rules, keys[0])
    for key, path in zip(keys, paths, strict=True):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0][0]):
                stack.pop()
            if stack and stack[-1][0][0] == rules[at][0]:
                stack[-1].append(rules[at])
            else:
                stack.append([rules[at]])
            at += 1
        while stack and not key.startswith(stack[-1][0][0]):
            stack.pop()
        out.append(max((r for level in stack for r in level if path.startswith(r[1])), key=lambda r: r[4], default=None))
    return out


def filter_urls(df: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule, verdict for every row. rules: (host, path prefix, allow or block) triples."""
    spark = df.sparkSession
    parts = [spark.sparkContext.broadcast(part) for part in _parts(_prepared(rules))]
    host, path = host_and_path(F.col(url_col))
    keyed = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    kind = keyed.schema[0].dataType.simpleString()
    keyed = keyed.toDF("c0", "c1", "c2").withColumn("c3", reversed_host("c1")).sortWithinPartitions("c3")
    out_type = f"{quoted(id_col)} {kind}, host string, path string, rule string, verdict string"

    def run(batches):
        for b in batches:  # of a sorted partition, so each batch is a sorted run
            keys, paths = [k.encode() for k in b.column(3).to_pylist()], b.column(2).to_pylist()
            found = sweep(keys, paths, parts[0].value)
            for part in parts[1:]:
                found = [max((r for r in pair if r), key=lambda r: r[4], default=None) for pair in zip(found, sweep(keys, paths, part.value), strict=True)]
            rule, verdict = pa.array([r and r[2] for r in found], pa.string()), pa.array([r[3] if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), rule, verdict], names=[id_col, "host", "path", "rule", "verdict"])

    return keyed.mapInArrow(run, out_type)
