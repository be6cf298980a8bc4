"""Operator 2, URL filters: a blocked Bloom filter before an exact join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 512-bit blocks, eight words of 64 bits each; a key sets one bit in each word.
WORDS = 8
#: The filter never has more blocks than this: 131,072 x 64 bytes = 8 MiB.
MAX_BLOCKS = 1 << 17
KEYS_PER_BLOCK = 32
SALTS = 16
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def host_of(url: Column) -> Column:
    """After the first ``://`` to ``/``, ``?``, ``#`` or the end; '' without one."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for a page: no scheme, query, fragment, leading www., m. or
    blog. label, final ``.html`` or final slash."""
    bare = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    return F.concat(bare, F.regexp_replace(path, r"(\.html|/+)$", ""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _bits(hashed: str) -> list[Column]:
    """Bit masks, one a word, from six bits each of a 64-bit hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {6 * k}) & 63 as int))") for k in range(WORDS)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, w0..w7): the filter as a table of at most ``blocks`` rows.

    Words are joined by bit_or with map-side combination; nothing is collected.
    """
    h = listed.select(F.xxhash64(F.lit(1), key).alias("_a"), F.xxhash64(F.lit(2), key).alias("_b"))
    masks = h.select(F.pmod("_a", F.lit(blocks)).alias("_block"), *[m.alias(f"w{k}") for k, m in enumerate(_bits("_b"))])
    return masks.groupBy("_block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def block_count(n_keys: int) -> int:
    """Blocks for ``n_keys`` keys: a power of two, at most MAX_BLOCKS."""
    blocks = 16
    while blocks * KEYS_PER_BLOCK < n_keys and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdicts for every row of ``pages``; ``listed`` has a column ``canon`` of blocked pages.

    Returns page_id, host, path, rule, verdict, listed. Null or malformed urls
    have empty host and path and are allowed; null list entries are ignored;
    repeated rows stay; other columns are not read. Beyond MAX_BLOCKS *
    KEYS_PER_BLOCK listed urls the filter passes more rows, and the exact join
    decides as before. The filter is broadcast (8 MiB at most); the list never is.
    """
    keys = listed.select("canon").where(F.col("canon").isNotNull()).distinct()
    blocks = block_count(keys.count())
    u = F.coalesce(F.col(url), F.lit(""))
    base = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("_ruled"), canonical(F.col("host"), F.col("path")).alias("canon"))
    base = base.withColumn("_block", F.when(F.col("host") != "", F.pmod(F.xxhash64(F.lit(1), "canon"), F.lit(blocks))))
    base = base.withColumn("_b", F.xxhash64(F.lit(2), "canon"))
    table = bloom(keys, "canon", blocks)
    probed = base.join(F.broadcast(table), "_block", "left")
    hit = F.lit(True)
    for k, m in enumerate(_bits("_b")):
        hit = hit & (F.col(f"w{k}").bitwiseAND(m) != 0)
    probed = probed.withColumn("_maybe", F.coalesce(hit, F.lit(False)))
    # distinct possible hits meet the list; confirmed ones are copied over the salts
    # of the pages, so that one page holding much of the table is split
    confirmed = probed.where("_maybe").select("canon").distinct().join(keys, "canon", "left_semi")
    confirmed = confirmed.select("canon", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_listed"))
    salted = probed.withColumn("_salt", F.when(F.col("_maybe"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")))
    sure = salted.where("_maybe").join(confirmed, ["canon", "_salt"], "left")
    out = sure.unionByName(salted.where(~F.col("_maybe")).withColumn("_listed", F.lit(None).cast("boolean")))
    is_listed = F.coalesce(F.col("_listed"), F.lit(False))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("_ruled"), F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        is_listed.alias("listed"),
    )


def spam_list(pages: DataFrame, url: str = "url", label: str = "spam-farm") -> DataFrame:
    """The production list: canonical urls of pages on hosts that carry ``label``."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(u), path_of(u)
    return pages.where(F.array_contains(F.split(host, r"\."), label)).select(canonical(host, path).alias("canon"))
