"""URL filters by a cascade of Bloom filters.

A rule is a host with the beginning of a path, like ``net/es/``. The keys that a
URL asks for are its host and every parent domain, each with the beginnings of
its path that are as long as some rule's path. A cascade holds the
listed keys exactly over all keys of the corpus: its first filter holds
the listed keys, the second those other keys that pass the first, the third
the listed keys that pass the second, and so on until none pass. A key's answer
is given by the first level that it doesn't pass, so no join is done.

The first filter is made so large that about as many other keys pass it as are
listed, so the levels grow with the list and the logarithm of the corpus only.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Rules listed at most; their filters go to every executor. More are an error.
MOST_RULES = 5_000_000
#: A-Z to lower case.
LOWER = {ord(a): ord(b) for a, b in zip(string.ascii_uppercase, string.ascii_lowercase, strict=True)}
#: Levels at most; each has half of the one before, so far fewer are used.
MOST_LEVELS = 200


class Bloom:
    """A Bloom filter of strings; ``salt`` tells the levels of a cascade apart."""

    def __init__(self, keys: Iterable[str], rate: float, salt: int) -> None:
        keys = list(keys)
        self.salt = salt
        self.hashes = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)
        for key in keys:
            for at in self.places(key):
                self.bits[at >> 3] |= 1 << (at & 7)
        self.raw = self.bits.tobytes()

    def places(self, key: str) -> Iterator[int]:
        whole = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.salt)
        one, two = whole >> 64, whole & (2**64 - 1) | 1
        return ((one + k * two) % self.size for k in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.raw[at >> 3] >> (at & 7) & 1 for at in self.places(key))


class Cascade:
    """Exact membership for listed keys among a universe whose first false positives are known."""

    def __init__(self, first: Bloom, listed: Iterable[str], others: Iterable[str]) -> None:
        self.levels = [first]
        inside, outside = list(listed), list(others)
        while outside and len(self.levels) < MOST_LEVELS:
            self.levels.append(Bloom(outside, 0.5, len(self.levels) + (first.salt << 16)))
            inside = [key for key in inside if key in self.levels[-1]]
            inside, outside = outside, inside
        if outside:
            raise ValueError("the cascade didn't end")

    def __contains__(self, key: str) -> bool:
        return next((k for k, level in enumerate(self.levels) if key not in level), len(self.levels)) % 2 == 1


class Shape:
    """What of a URL can be a rule: parent domains and beginnings of the path, by length."""

    def __init__(self, rules: Iterable[str]) -> None:
        parts = [(rule.index("/"), len(rule) - rule.index("/")) for rule in rules]
        self.longest_host = max((host for host, _ in parts), default=-1)
        self.paths = sorted({path for _, path in parts})

    def keys(self, host: str, path: str) -> list[str]:
        """Keys that a URL asks for, longest first; of two that are equally long the longer host first."""
        low = len(host) - self.longest_host
        hosts = [host] if low <= 0 else []
        at = host.find(".", max(0, low - 1))
        while at >= 0:
            hosts.append(host[at + 1 :])
            at = host.find(".", at + 1)
        pairs = [(h, path[:n]) for h in hosts for n in self.paths if n <= len(path)]
        return [h + p for h, p in sorted(pairs, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


def split_urls(frame: DataFrame, id_column: str, url_column: str) -> DataFrame:
    """``id``, ``host`` and ``path`` of every row; both empty where the URL is null or has no ``://``."""
    url = F.col(url_column).cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return frame.select(F.col(id_column).alias("id"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))


def build_cascades(urls: DataFrame, lists: dict[str, list[str]], shape: Shape) -> dict[str, Cascade]:
    """A cascade for each list of keys, exact over all keys that ``urls`` ask for.

    One pass counts the keys asked for, one gathers those that pass a first filter
    without being listed; these are expected to be as few as the listed ones. Where
    they aren't, the first filter is made larger and the pass is done anew.
    """
    labels = F.size(F.split("host", r"\."))
    asked = urls.agg(F.sum(labels * F.lit(max(1, len(shape.paths))))).head()[0] or 1
    listed = {name: set(keys) for name, keys in lists.items()}
    rate = min(0.5, max(1, max(map(len, listed.values()), default=1)) / asked)
    while True:
        first = {name: Bloom(sorted(keys), rate, salt) for salt, (name, keys) in enumerate(sorted(listed.items()), 1)}

        filters = urls.sparkSession.sparkContext.broadcast(first)

        def passing(batches: Iterator[pa.RecordBatch], filters: Broadcast[dict[str, Bloom]] = filters) -> Iterator[pa.RecordBatch]:
            first = filters.value
            for batch in batches:
                found: set[tuple[str, str]] = set()
                for host, path in set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    for key in shape.keys(host, path):
                        found.update((name, key) for name, bloom in first.items() if key in bloom)
                names, keys = ([x[i] for x in found] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys, pa.string())], ["list", "key"])

        # The listed keys that are asked for pass, and beside them about as many others.
        most = 17 * sum(map(len, listed.values())) + 1000
        rows = urls.select("host", "path").mapInArrow(passing, StructType().add("list", StringType()).add("key", StringType())).distinct().limit(most + 1).collect()
        filters.unpersist()
        if len(rows) <= most:
            return {name: Cascade(first[name], sorted(listed[name]), sorted(r["key"] for r in rows if r["list"] == name and r["key"] not in listed[name])) for name in listed}
        rate /= 64


def judge(frame: DataFrame, allow: list[str], block: list[str], id_column: str = "page_id", url_column: str = "url", default: str = "allow") -> DataFrame:
    """The rule and verdict of every URL.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; the path goes on up to ``?``, ``#`` or the end. A rule fits its host and
    all subdomains where the URL's path starts with the rule's; the longest wins (of
    equally long ones the longer host). A rule without a path, or with A-Z in its host, is an error. Returns ``id_column``, ``host``, ``path``, ``rule``
    (null where none fits) and ``verdict``: ``allow`` or ``block``, by the rule, or
    ``default`` without one, as a key that no cascade holds isn't listed. A rule in
    both lists blocks. Null URLs and those without ``://`` have empty host and path;
    ids may be null or repeat; other columns are left aside; an empty table gives none.
    """
    lists = {"allow": allow, "block": block}
    if sum(map(len, lists.values())) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if bad := [rule for rules in lists.values() for rule in rules if "/" not in rule]:
        raise ValueError(f"rules without a path: {bad[:5]}")
    if bad := [rule for rules in lists.values() for rule in rules if (host := rule.partition("/")[0]) != host.translate(LOWER)]:
        raise ValueError(f"rules whose host isn't in lower case, and so could never fit: {bad[:5]}")
    shape = Shape(rule for rules in lists.values() for rule in rules)
    urls = split_urls(frame, id_column, url_column)
    cascades = urls.sparkSession.sparkContext.broadcast(build_cascades(urls, lists, shape))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cascades.value
        for batch in batches:
            rules: list[str | None] = []
            verdicts: list[str] = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for key in shape.keys(host, path):
                    if verdict := next((v for v in ("block", "allow") if key in held[v]), None):
                        rules.append(key)
                        verdicts.append(verdict)
                        break
                else:
                    rules.append(None)
                    verdicts.append(default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    schema = StructType().add("id", frame.schema[id_column].dataType)
    for name in ("host", "path", "rule", "verdict"):
        schema.add(name, StringType())
    return urls.mapInArrow(judged, schema).withColumnRenamed("id", id_column)
