"""URL filters: rules on host and path, and a list of canonical URLs behind a blocked Bloom filter.

A rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. URLs without a
rule are held against the list: the filter, one 256-bit block per URL with two bits in each of its four words, lets
possible hits through to an exact join with the list, which removes its false positives; all others never shuffle.

Nulls: a null URL, or one without ``://``, has an empty host and path, fits no rule and is on no list. Repeated rows
are judged alike. An empty list blocks nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import without

WORDS = 4
BITS_PER_URL = 16
#: The filter has so many blocks at most (4 MB of bits), so it may be broadcast whatever the list's length; a longer
#: list makes more false positives, which the exact join removes.
MAX_BLOCKS = 1 << 17
#: The production rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Scheme, fragment, default port, tracking parameters and a last slash do not tell URLs apart; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)=")))
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.lit("?"), F.array_join(kept, "&")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict; null if none fits."""
    found = F.lit(None)
    for verdict, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """A URL's block and the two bits it has in each word."""
    spread = F.xxhash64(url, F.lit(1))
    words = []
    for i in range(WORDS):
        one, two = (F.shiftrightunsigned(spread, 12 * i + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(2))
        words.append(F.call_function("shiftleft", F.lit(1).cast("long"), one).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), two)))
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long")), words


def bloom(listed: DataFrame, name: str = "url") -> tuple[DataFrame, int]:
    """The filter of a list of canonical URLs: one row per used block, combined before the shuffle; and its block count."""
    blocks = max(1, min(MAX_BLOCKS, listed.count() * BITS_PER_URL // (64 * WORDS)))
    block, words = _bits(F.col(name), blocks)
    return listed.groupBy(block.alias("_block")).agg(*(F.bit_or(w).alias(f"_word{i}") for i, w in enumerate(words))), blocks


def listed_rows(rows: DataFrame, listed: DataFrame, name: str = "canonical") -> DataFrame:
    """Adds ``listed``: whether the row's canonical URL is on the list (one column ``url``, distinct, durable)."""
    filled, blocks = bloom(listed)
    block, words = _bits(F.col(name), blocks)
    # At most MAX_BLOCKS rows of five longs.
    probed = rows.withColumn("_block", block).join(F.broadcast(filled), "_block", "left")
    possible = F.col(name).isNotNull()
    for i, w in enumerate(words):
        possible = possible & F.coalesce(F.col(f"_word{i}").bitwiseAND(w) == w, F.lit(False))
    probed = probed.withColumn("_possible", possible).drop("_block", *(f"_word{i}" for i in range(WORDS)))
    exact = listed.select(F.col("url").alias(name), F.lit(True).alias("listed"))
    hits = probed.where("_possible").join(exact, name, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return hits.unionByName(probed.where(~F.col("_possible")).withColumn("listed", F.lit(False))).drop("_possible")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, canonical, rule and verdict to rows with a url."""
    pages = without(pages, "host", "path", "canonical", "rule", "verdict", "listed")
    url = F.col("url")
    rows = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(url))
    ruled = rows.where(F.col("_rule").isNotNull()).withColumn("listed", F.lit(None).cast("boolean"))
    free = listed_rows(rows.where(F.col("_rule").isNull()), listed)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.unionByName(free).withColumn("rule", F.col("_rule.rule")).withColumn("verdict", verdict).drop("_rule", "listed")


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The canonical URLs that several pages share: durable, one row each."""
    keys = pages.select(canonical(F.col("url")).alias("url")).where(F.col("url").isNotNull())
    return durable(keys.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url"))
