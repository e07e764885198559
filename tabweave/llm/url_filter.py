"""Operator 9: URL filters with a sorted digest array.

Blocked hosts (a host stands for itself and its subdomains) are kept as an array of
64-bit xxhash keys in order, beside the full strings. The array is cut by the keys'
leading bits into shards of about `SHARD` entries; a task sorts one shard, writes the
keys to a file of its own, maps that file into memory and probes it by binary search,
a whole array of probes at a time; equal keys count only if the full strings agree.

Only distinct probes are looked up: each distinct host of the URLs gives itself and
its parent domains, so a host with a third of all pages is probed once. What the
probes say comes back to the pages by a join on the host. Rules by host and path
prefix go before the array; the longest fitting one wins.

Defined results: a null URL or one without `://` has an empty host and path, fits no
rule and is allowed; rows stay apart even where keys repeat; null and empty entries
of the list are left out, repeated ones count once; an empty list blocks nothing; an
empty table gives an empty result; URLs and hosts of any length are read whole (a host
gives a probe for each of its labels); other columns are not read.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Entries of a shard: 8 MB of keys and some 30 MB of strings.
SHARD = 1 << 20
#: Rows up to which a table of listed hosts is broadcast (some 60 bytes a row).
BROADCAST_HOSTS = 200_000


def host_of(url: str = "url") -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest fitting rule (verdict, host, path), else null."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
    whens = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*whens) if whens else F.lit(None).cast("struct<rule:string,verdict:string>")


def _digests(strings: Sequence[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in strings), np.uint64, len(strings))


class DigestArray:
    """64-bit keys in order in a memory-mapped file, with the full strings beside them."""

    def __init__(self, strings: Sequence[str]):
        distinct = sorted(set(strings))
        keys = _digests(distinct)
        order = np.argsort(keys, kind="stable")
        self.strings = [distinct[i] for i in order]
        with tempfile.TemporaryFile() as f:
            f.write(keys[order].tobytes() or b"\0" * 8)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.keys = np.frombuffer(self.map, np.uint64, len(distinct))

    def holds(self, probes: Sequence[str]) -> np.ndarray:
        keys = _digests(probes)
        at, found = np.searchsorted(self.keys, keys), np.zeros(len(keys), bool)
        todo = np.arange(len(keys))
        while len(todo):  # once, but for entries whose keys collide
            todo = todo[at[todo] < len(self.keys)]
            todo = todo[self.keys[at[todo]] == keys[todo]]
            same = np.array([self.strings[at[i]] == probes[i] for i in todo], bool)
            found[todo[same]] = True
            todo = todo[~same]
            at[todo] += 1
        return found


def listed(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of probes(probe) that entries(entry) holds; both are made distinct first."""
    entries = entries.where("entry is not null and entry <> ''").select("entry").distinct()
    shards = entries.count() // SHARD + 1
    shard = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(c), 32), F.lit(shards))

    def probe(own: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(have):
            return pd.DataFrame({"probe": pd.Series([], dtype=str)})
        return own.loc[DigestArray(list(have["entry"])).holds(list(own["probe"])), ["probe"]]

    # a shard's probes are dealt over groups of about as many rows, each with the shard's entries
    probes = keep(probes.select("probe").distinct())
    parts = probes.count() // (shards * SHARD) + 1
    dealt = probes.withColumn("shard", shard(F.col("probe"))).withColumn("part", F.pmod(F.xxhash64("probe", F.lit("part")), F.lit(parts)))
    have = entries.withColumn("shard", shard(F.col("entry"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    return dealt.groupBy("shard", "part").cogroup(have.groupBy("shard", "part")).applyInPandas(probe, "probe string")


def judge(pages: DataFrame, blocked: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict of every row; `blocked` has hosts in column `entry`."""
    df = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = df.where("host <> ''").select("host").distinct()
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    probes = hosts.select("host", F.explode(parents).alias("probe"))
    hits = keep(listed(probes.select("probe"), blocked))
    bad = keep(probes.join(beside(hits), "probe").select("host").distinct())
    out = df.join(beside(bad.withColumn("bad", F.lit(True))), "host", "left").withColumn("by_rule", rule_of(rules))
    verdict = F.coalesce("by_rule.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("by_rule.rule").alias("rule"), verdict.alias("verdict"))


def beside(hosts: DataFrame) -> DataFrame:
    """hosts, to be broadcast if its rows are few enough; else its join is one that can be split where a host is hot."""
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
