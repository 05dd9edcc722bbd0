"""URL filters: ordered host/path rules, then a Bloom filter cascade with exact membership.

All work is DataFrame expressions. The cascade is built over the distinct hosts of the corpus (its complete
key universe): level 1 encodes the listed hosts, level 2 the unlisted hosts that level 1 lets through, level 3 the listed
hosts that level 2 lets through, and so on until a level has no false positive. A probe is exact for every host of
the universe, and needs no join: the levels are binary literals inside the expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdoc.llm.common import ascii_lower, written

#: Hosts that are listed with all their subdomains where the caller gives no list.
DEFAULT_LISTED = tuple(
    f"{name}.example.{top}" for name in ("casino-win", "cheap-pills", "free-prizes", "spam-farm") for top in ("com", "net", "org")
)

#: Listed hosts that one shard's cascade encodes at most, about; more listed hosts make more shards.
SHARD_KEYS = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
CONTRACT_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(after), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (ties: the first given), null without one."""
    text = verdict = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    seeds: tuple[int, ...]

    def may_hold(self, key: Column) -> Column:
        found = F.lit(True)
        for seed in self.seeds:
            at = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(self.size))
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            found = found & (byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0)
        return found


def _level(keys: DataFrame, n: int, wrong: float, seed: int) -> Level:
    """A Bloom filter of the ``n`` hosts in ``keys`` with about the given false-positive rate."""
    k = max(1, math.ceil(math.log2(1 / wrong)))
    size = max(64, 8 * math.ceil(n * k / math.log(2) / 8))
    seeds = tuple(seed * 64 + i for i in range(k))
    at = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64("host", F.lit(s)), F.lit(size)) for s in seeds])).alias("at"))
    parts = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.pmod("at", F.lit(8))).cast("int")).alias("bits"))
    held = bytearray(size // 8)
    for row in parts.toLocalIterator():
        held[row["byte"]] = row["bits"]
    return Level(bytes(held), size, seeds)


@dataclass(frozen=True)
class Cascade:
    """Levels for each shard of the key universe."""

    shards: tuple[tuple[Level, ...], ...]

    def holds(self, key: Column) -> Column:
        """True for the listed keys of the universe, false for its others."""
        answer = F.lit(False)
        for number, levels in enumerate(self.shards):
            inside = F.lit(len(levels) % 2 == 1)
            for depth in range(len(levels), 0, -1):
                inside = F.when(levels[depth - 1].may_hold(key), inside).otherwise(F.lit(depth % 2 == 0))
            if len(self.shards) == 1:
                return inside
            answer = F.when(F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.shards))) == number, inside).otherwise(answer)
        return answer

    @property
    def n_bytes(self) -> int:
        return sum(len(level.bits) for levels in self.shards for level in levels)


def build_cascade(universe: DataFrame, max_depth: int = 60) -> Cascade:
    """A cascade over ``universe``: distinct rows ``(host string, listed boolean)``. Empty or unlisted universes give one that holds nothing."""
    counts = {row["listed"]: row["n"] for row in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    n_shards = max(1, math.ceil(counts.get(True, 0) / SHARD_KEYS))
    shards = []
    for number in range(n_shards):
        part = universe if n_shards == 1 else universe.where(F.pmod(F.xxhash64("host", F.lit(-1)), F.lit(n_shards)) == number)
        here, there = part.where("listed"), part.where("NOT listed")
        n_here = counts.get(True, 0) if n_shards == 1 else here.count()
        n_there = max(1, counts.get(False, 0) // n_shards)
        levels: list[Level] = []
        wrong = min(0.5, max(1e-9, n_here * math.sqrt(0.5) / n_there))
        while n_here:
            if len(levels) == max_depth:
                raise RuntimeError(f"the cascade needs more than {max_depth} levels")
            levels.append(_level(here, n_here, wrong if not levels else 0.5, len(levels) + 1))
            here, there = there.where(levels[-1].may_hold(F.col("host"))), here
            n_here = here.count()
        shards.append(tuple(levels))
    return Cascade(tuple(shards))


def host_universe(pages: DataFrame, listed: Sequence[str], url_col: str = "url") -> DataFrame:
    """The distinct hosts of ``pages`` and whether the host or a domain above it is in ``listed``."""
    hosts = pages.select(url_host(F.col(url_col)).alias("host")).distinct()
    if not listed:
        return hosts.withColumn("listed", F.lit(False))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.withColumn("listed", F.arrays_overlap(above, F.array(*[F.lit(x) for x in listed])))


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = CONTRACT_RULES, listed: Sequence[str] = DEFAULT_LISTED, url_col: str = "url"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` added (columns of these names are replaced).

    A rule's verdict goes first; without one, hosts that the cascade holds are blocked and others allowed. Null urls and urls
    without ``://`` have an empty host and path, fit no rule and are allowed. Repeated rows stay.
    """
    cascade = build_cascade(written(host_universe(pages, listed, url_col), "hosts"))
    url = F.col(url_col)
    judged = pages.withColumns({"host": url_host(url), "path": url_path(url)})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(cascade.holds(F.col("host")), "block").otherwise("allow"))})


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """The same verdicts by plain comparison with the list, for DuckDB."""
    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    ordered = sorted(CONTRACT_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"WHEN {fits(r.host, r.path)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r.host, r.path)} THEN '{r.verdict}'" for r in ordered)
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in DEFAULT_LISTED)
    return f"""
    WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM cut)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""
