"""Cosmetic filter rules: lines to selectors for a host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.urls import domain_suffixes

LINES = r"\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}]"


def lines_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines at any Unicode line end."""
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.split(text, LINES)).alias("line_no", "line"))


def parse_rules(lines: DataFrame, line: str = "line") -> DataFrame:
    """(domain, selector, exception) of hiding rules; domain null for rules of every site."""
    rule = r"^([^#]*)#(@?)#(.+)\z"
    kept = lines.where(F.col(line).rlike(rule) & ~F.col(line).startswith("!"))
    domains = F.split(F.regexp_extract(line, rule, 1), ",")
    out = kept.select(F.explode(domains).alias("_d"), (F.regexp_extract(line, rule, 2) == "@").alias("exception"), F.trim(F.regexp_extract(line, rule, 3)).alias("selector"))
    return out.select(F.nullif(F.lower(F.trim("_d")), F.lit("")).alias("domain"), "selector", "exception")


def css_for(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, css): rules of the host and its parents, less exceptions; generic rules where none is its own."""
    own = hosts.select(host).distinct().select(host, F.explode(domain_suffixes(F.col(host))).alias("domain"))
    hit = own.join(rules.where("domain is not null"), "domain")
    refused = hit.where("exception").select(host, "selector").distinct()
    named = hit.where("not exception").select(host, "selector").distinct().join(refused, [host, "selector"], "left_anti")
    mine = named.groupBy(host).agg(F.array_sort(F.collect_list("selector")).alias("_own"))
    generic = rules.where("domain is null and not exception").select("selector").distinct().agg(F.array_sort(F.collect_list("selector")).alias("_all"))
    both = hosts.select(host).distinct().join(mine, host, "left").crossJoin(F.broadcast(generic))  # one row
    chosen = F.coalesce("_own", "_all")
    return both.select(host, F.when(F.size(chosen) > 0, F.concat(F.array_join(chosen, ", "), F.lit(" { display: none !important; }"))).otherwise("").alias("css"))
