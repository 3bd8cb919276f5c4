"""URL filters: host and path rules, then a blocked Bloom filter before an exact join.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are configuration and become part of the plan; lists of URLs are data.
MOST_RULES = 2_000
#: Filter bits per listed URL and 64-bit words per block; two bits of each word are set.
BITS, WORDS = 16, 4
#: Bytes of the filter up to which it is broadcast to the pages (some six million listed
#: URLs); a larger one meets them by shuffle.
FILTER_BYTES = 16 << 20


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without its last slash, query without tracking fields; no scheme or fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    fields = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    rest = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit("")))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The fitting rule with the longest text, as a struct of rule and verdict, or null.

    Ties go to the longer host, then to block.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: list single URLs instead")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    out = None
    for rule in reversed(order):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else F.when(fits, found).otherwise(out)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _probe(key: Column, blocks: int) -> list[Column]:
    """Block number and the bits of a key in each word of its block."""
    spread = F.xxhash64(key, F.lit(1))
    masks = []
    for k in range(WORDS):
        low, high = (F.shiftrightunsigned(spread, 16 * k + 8 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1))
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), low).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), high)).alias(f"m{k}"))
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *masks]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: one row per block that is not empty."""
    bits = listed.select(*_probe(F.col(key), blocks))
    return bits.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    id_column: str = "page_id",
    url_column: str = "url",
    listed_column: str = "url",
    bits: int = BITS,
) -> DataFrame:
    """A verdict for each row: page_id, host, path, rule, verdict, listed.

    The longest fitting rule decides. Without one, a URL is blocked if its canonical form is
    that of a URL in ``listed``: the filter, a table of blocks that is joined on the block
    number, lets all listed URLs and few others through, and only those meet the list in
    an exact join. The filter is broadcast up to ``FILTER_BYTES``; the exact join goes by size.

    A null or broken URL has empty host and path and fits no rule or list. An empty list
    blocks nothing. Repeated rows are judged each by itself; repeated list entries count
    once. Other columns are not read.
    """
    known = stage(
        listed.select(canonical(listed[listed_column]).alias("known")).filter("known <> ''").distinct(), "listed"
    )
    blocks = max(1, -(-known.count() * bits // (64 * WORDS)))
    bloom = stage(bloom_blocks(known, "known", blocks), "bloom")
    if blocks * 8 * (WORDS + 1) <= FILTER_BYTES:
        bloom = F.broadcast(bloom)
    url = pages[url_column]
    rows = pages.select(
        pages[id_column].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key")
    )
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    probed = rows.select("*", *_probe(F.col("key"), blocks)).join(bloom, "block", "left")
    there = F.lit(True)
    for k in range(WORDS):
        there = there & (F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}"))
    columns = [F.col("page_id"), F.col("host"), F.col("path"), F.col("found.rule").alias("rule")]

    def verdict(listed: Column) -> list[Column]:
        own = F.when(listed, "block").otherwise("allow")
        return [*columns, F.coalesce("found.verdict", own).alias("verdict"), listed.alias("listed")]

    # Pages are read and parsed once; what is written has urls only, no bodies.
    probed = stage(probed.select("page_id", "host", "path", "found", "key", there.alias("there")), "probed")
    maybe = F.col("there") & (F.col("key") != "")
    passed = probed.filter(maybe).join(known.withColumn("hit", F.lit(True)), F.col("key") == F.col("known"), "left")
    return (
        passed.select(*verdict(F.coalesce("hit", F.lit(False))))
        .unionByName(probed.filter(~maybe).select(*verdict(F.lit(False))))
    )
