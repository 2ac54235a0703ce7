"""URL filter: host rules, and a list of URLs behind a blocked Bloom filter whose hits an exact join confirms.

The filter is a table with one row per block of eight 32-bit words. A listed
URL sets one bit in each word of one block; it is built by ``bit_or`` and
looked up by a join on the block, so it grows with the list and needs no
driver or task to hold it. It is broadcast only up to a size that is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written

#: Bits of the filter per listed URL, and bits of a block.
BITS_PER_URL = 12
_BLOCK_BITS = 256
_WORDS = 8
#: A filter of no more blocks than this (32 bytes each) is sent to all executors.
BROADCAST_BLOCKS = 1 << 18
#: Odd numbers that spread one hash over the words of a block; fixed values.
_SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


@dataclass(frozen=True)
class Rule:
    """verdict for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def _lowered(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(_lowered(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., and path without .html and closing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first in order), as text, and its verdict; null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):  # what is put on last is asked first
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _placed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """``df`` with the block of each key and its bit in each word of the block."""
    hashed = F.xxhash64(key)
    placed = df.withColumns({"_block": F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(blocks)), "_low": hashed.bitwiseAND(F.lit(0x7FFFFFFF))})
    bits = (f"shiftleft(1L, CAST(shiftright(_low * {salt}L & 4294967295L, 27) AS INT))" for salt in _SALTS)
    return placed.withColumns({f"_w{i}": F.expr(b) for i, b in enumerate(bits)}).drop("_low")


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _f0.._f7): the words of every block in which a bit is set."""
    return _placed(keys.select(key), key, blocks).groupBy("_block").agg(*(F.bit_or(f"_w{i}").alias(f"_f{i}") for i in range(_WORDS)))


def possible_hits(df: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``df`` whose key the filter may hold; none that it holds is missed."""
    placed = _placed(df, key, blocks)
    # 32 bytes a block, so this bound is one on the bytes sent; beyond it the join shuffles and a hot block is split
    side = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    held = placed.join(side, "_block")
    for i in range(_WORDS):
        held = held.where(f"(_w{i} & _f{i}) <> 0")
    return held.select(*df.columns)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", listed_verdict: str = "block", other_verdict: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every page.

    The longest rule that fits decides; without one, a URL whose canonical form
    is that of a listed URL gets ``listed_verdict``, any other ``other_verdict``.
    Null URLs and those without :// have neither host nor path and are not
    listed. The list may hold nulls and repeats, or be empty. Repeated pages and
    null ids stay. Other columns are not read.
    """
    source = columns_of(pages, [id_col, url_col])
    url = F.col(url_col)
    source = source.select(F.col(id_col).alias("_page"), host_of(url).alias("host"), path_of(url).alias("path"))
    source = source.withColumn("_key", canonical(F.col("host"), F.col("path")))
    column = F.col(listed_col)
    keys = listed.select(canonical(host_of(column), path_of(column)).alias("_key")).where("_key IS NOT NULL").distinct()
    keys = written(keys, "listed-urls")
    blocks = max(1, -(-keys.count() * BITS_PER_URL // _BLOCK_BITS))
    # distinct URLs are probed, so a URL that a third of the pages have is looked up once
    asked = source.select("_key").where("_key IS NOT NULL").distinct()
    hits = possible_hits(asked, "_key", bloom_filter(keys, "_key", blocks), blocks)
    confirmed = hits.join(keys, "_key", "left_semi").withColumn("_listed", F.lit(True))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return source.join(confirmed, "_key", "left").select(
        F.col("_page").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_listed"), listed_verdict).otherwise(other_verdict)).alias("verdict"),
        F.coalesce("_listed", F.lit(False)).alias("listed"),
    )
