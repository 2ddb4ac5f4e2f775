"""URL rules and block lists through Bloom filter cascades.

A cascade answers exact membership for every key of a known universe. Level 1 is a Bloom filter of the listed keys;
level 2 holds the universe's keys that pass level 1 without being listed, level 3 the listed keys that pass level 2,
and so on, each far smaller than the one before, until a level has no false positives. The universe is every key of
the corpus, so no URL that is judged can be answered wrongly, and judging needs no join: a filter is an array of bits
of bounded size inside the expression.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionflow.llm.common import stored

#: Bits per key and hashes per key of a level.
BITS_PER_KEY, HASHES = 12, 7
#: The largest filter, in bits (2 MB): what a cascade adds to a plan is bounded by this times its levels.
MOST_BITS = 1 << 24
MOST_LEVELS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(keys: DataFrame, key: str, size: int, level: int) -> DataFrame:
    """One row with the filter as an array of ``size / 64`` words."""
    spots = F.array(*[F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(size)) for k in range(HASHES)])
    words = (keys.select(F.explode(F.array_distinct(spots)).alias("spot"))
             .groupBy(F.expr("spot div 64").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(spot % 64 AS INT))")).alias("bits")))
    every = keys.sparkSession.range(size // 64).withColumnRenamed("id", "word")
    return (every.join(words, "word", "left")
            .agg(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
            .select(F.transform("a", lambda x: x["bits"]).alias("bits")))


@dataclass
class Cascade:
    """Levels of filters; ``contains`` is exact for keys of the universe that the cascade was built over."""

    levels: list[tuple[DataFrame, int]] = field(default_factory=list)

    def _passes(self, key: Column, level: int) -> Column:
        words, size = self.levels[level]
        bits = words.scalar()
        test = F.lit(True)
        for k in range(HASHES):
            spot = F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(size))
            word = F.element_at(bits, (F.floor(spot / 64) + 1).cast("int"))
            test = test & (F.getbit(word, (spot % 64).cast("int")) == 1)
        return test

    def contains(self, key: Column) -> Column:
        answer = F.lit(False)
        for level in reversed(range(len(self.levels))):
            answer = self._passes(key, level) & (~answer if level + 1 < len(self.levels) else F.lit(True))
        return F.coalesce(answer, F.lit(False))


def build_cascade(listed: DataFrame, universe: DataFrame, key: str) -> Cascade:
    """A cascade that tells ``listed`` keys among all keys of ``universe`` (both have a column ``key``; NULLs are left out).

    Listed keys outside the universe need no answer and are left out. An empty list gives a cascade that contains
    nothing. Raises if the listed keys of the corpus are too many for the bounded filters to end.
    """
    cascade = Cascade()
    universe = universe.select(key).filter(F.col(key).isNotNull())
    inside = stored(listed.select(key).filter(F.col(key).isNotNull()).distinct()
                    .join(universe.distinct(), key, "left_semi"))
    other, now = universe, inside
    while True:
        n = now.count()
        if n == 0:
            return cascade
        if len(cascade.levels) == MOST_LEVELS:
            raise ValueError(f"{n} keys are left after {MOST_LEVELS} levels of at most {MOST_BITS} bits")
        level = len(cascade.levels)
        size = min(MOST_BITS, max(1024, 1 << (BITS_PER_KEY * n - 1).bit_length()))
        cascade.levels.append((stored(_bits(now, key, size, level)), size))
        # The keys on the other side that this level lets through make the next level.
        wrong = other.filter(cascade._passes(F.col(key), level)).distinct()
        if level == 0:
            wrong = wrong.join(inside, key, "left_anti")
        other, now = now, stored(wrong)


def superset_filter(keys: DataFrame, key: str) -> Cascade:
    """One level over ``keys``: it passes all of them and few others (more, if the keys are too many for its bound)."""
    keys = stored(keys.select(key))
    size = min(MOST_BITS, max(1024, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    return Cascade([(stored(_bits(keys, key, size, 0)), size)])


def listed_hosts(hosts: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """Distinct hosts with one of ``terms`` between dots and hyphens: the block list that a term list stands for."""
    return hosts.select("host").distinct().filter(
        F.arrays_overlap(F.split("host", r"[.-]"), F.array(*map(F.lit, terms))))


# Rules of host, path and verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Terms of hosts that are blocked where no rule fits.
BLOCK_TERMS = ("adult", "bet", "casino", "gambling", "poker", "porn", "sex", "xxx")


def judge_urls(pages: DataFrame, rules=RULES, blocked: DataFrame | None = None, page_id: str = "page_id",
               url: str = "url") -> DataFrame:
    """One row ``page_id, host, path, rule, verdict`` per row of ``pages``.

    A rule ``(host, path, verdict)`` fits its host and subdomains where the path starts with its own; the longest
    that fits decides (of equal ones, block). Elsewhere a host of ``blocked`` (column ``host``; by default those with
    a block term) is blocked, all others are allowed. NULL and odd URLs have empty host and path, fit no rule and are
    allowed. Repeated rows stay; other columns are left out, whatever their names; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    parts = stored(pages.select(pages[page_id].alias("page_id"), host_of(pages[url]).alias("host"),
                                path_of(pages[url]).alias("path")))
    # A key is as many labels of the host and characters of the path as some rule has.
    shapes = sorted({(host.count(".") + 1, len(path)) for host, path, _ in rules})
    keys = [F.when((F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= n),
                   F.concat(F.substring_index("host", ".", -labels), F.left("path", F.lit(n))))
            for labels, n in shapes]
    universe = parts.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct() if keys else None
    lists = {}
    for verdict in ("allow", "block"):
        mine = [(host + path,) for host, path, v in rules if v == verdict]
        if mine:
            lists[verdict] = build_cascade(spark.createDataFrame(mine, "key string"), universe, "key")
    hosts = parts.select("host").filter("host <> ''").distinct()
    hosts_listed = build_cascade(listed_hosts(hosts, BLOCK_TERMS) if blocked is None else blocked, hosts, "host")
    fits = [F.when(cascade.contains(key), F.struct(F.length(key).alias("n"), F.lit(verdict).alias("verdict"),
                                                   key.alias("rule")))
            for verdict, cascade in lists.items() if cascade.levels for key in keys]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast(
        "struct<n:int,verdict:string,rule:string>")
    default = F.when(hosts_listed.contains(F.col("host")), "block").otherwise("allow")
    return parts.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), default).alias("verdict"))
