"""Fuzzy lookup: the capture most like a request that has no exact one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.fuzzy_match import RULES, Candidate, FuzzyRule, best_match, rule_for

#: Shares in which a request meets the captures of its prefix.
SALTS = 8


def _route(rules: tuple[FuzzyRule, ...]):  # noqa: ANN202
    kind = T.StructType([T.StructField("rule", T.IntegerType()), T.StructField("prefix", T.StringType()), T.StructField("canon", T.StringType())])

    @F.pandas_udf(kind)
    def run(url: pd.Series) -> pd.DataFrame:
        out = []
        for u in url:
            rule, prefix, canon = rule_for(u or "", rules)
            out.append((rules.index(rule) if rule else -1, prefix, canon))
        return pd.DataFrame(out, columns=["rule", "prefix", "canon"])

    return run


def routed(url: Column, rules: tuple[FuzzyRule, ...] = RULES) -> Column:
    """rule (its number, -1 for none), prefix of candidates and canonical URL of requests."""
    return _route(rules)(url)


def _scorer(rules: tuple[FuzzyRule, ...]):  # noqa: ANN202
    @F.pandas_udf(T.DoubleType())
    def run(url: pd.Series, candidate: pd.Series, status: pd.Series, rule: pd.Series, crowded: pd.Series) -> pd.Series:
        out = []
        for u, c, s, r, many in zip(url, candidate, status, rule, crowded, strict=True):
            own = rules[int(r)] if r >= 0 else None
            if many and own is not None and own.max_results:
                own = FuzzyRule(own.match, None, own.split, own.split_last, own.args, own.fuzzy_args, own.fuzzy_set)
            found = best_match(u, [Candidate(c, int(s))], own)
            out.append(None if found is None else min(found[1], 1e18))
        return pd.Series(out, dtype="float64")

    return run


def _own_cuts(rules: tuple[FuzzyRule, ...]) -> list[Column]:
    """Prefixes of a captured URL that end at a rule's own split; null without one past the start."""
    out = []
    for mark, last in dict.fromkeys((r.split, r.split_last) for r in rules if r.split and (r.split != "?" or r.split_last)):
        head = F.regexp_extract("url", rf"(?s)\A(.{'+' if last else '+?'}\Q{mark}\E)", 1)
        out.append(F.when(head != "", head))
    return out


def best_matches(requests: DataFrame, captures: DataFrame, rules: tuple[FuzzyRule, ...] = RULES) -> DataFrame:
    """``requests`` (req_id, url) with hit_url, hit_ts_ms and score.

    Requests and captures meet in an equi-join on the prefix up to the query or a rule's split;
    the score is an Arrow UDF over what meets; the best is an aggregate, so a
    prefix with many captures is not gathered. A request whose prefix is its
    whole URL and that no rule covers has no match. Scores have no threshold.
    """
    route = _route(rules)("url")
    asked = requests.withColumn("_r", route).select("*", "_r.rule", "_r.prefix", "_r.canon").drop("_r")
    asked = asked.where((F.col("rule") >= 0) | (F.col("prefix") != F.col("url")) | (F.col("canon") != F.col("url")) | F.col("url").endswith("?"))
    cuts = F.array_distinct(F.array(F.regexp_extract("url", r"^([^?]*\?)", 1), F.col("url"), F.regexp_replace("url", r"[?#].*", "?"), F.substring_index("url", "?", 1), *_own_cuts(rules)))
    held = captures.select(F.col("url").alias("hit_url"), "status", F.col("ts_ms").alias("hit_ts_ms"), F.explode(cuts).alias("prefix")).where("prefix <> ''")
    many = held.groupBy("prefix").agg((F.count("*") > 2).alias("_many"))  # told to the requests before the pairs are made
    met = _salted(asked.join(many, "prefix"), held, "prefix")
    scored = met.withColumn("score", _scorer(rules)("url", "hit_url", "status", "rule", "_many")).where("score is not null")
    # an exact capture of the canonical URL settles the matter: the newest
    newest = captures.groupBy(F.col("url").alias("canon")).agg(F.max("ts_ms").alias("hit_ts_ms"))
    exact = asked.where(F.col("canon") != F.col("url")).join(newest, "canon").select("req_id", "url", F.col("canon").alias("hit_url"), "hit_ts_ms", F.lit(2e18).alias("score"))
    return first_in_order(scored.select("req_id", "url", "hit_url", "hit_ts_ms", "score").unionByName(exact)).withColumn("score", F.round("score", 6))


def _salted(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Equi-join in which every request meets its candidates in SALTS shares, so that a prefix with
    a third of all captures is not one task's work."""
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt")
    right = held.withColumn("_salt", F.pmod(F.xxhash64("hit_url", "hit_ts_ms"), F.lit(SALTS)).cast("int"))
    return asked.select("*", salts).join(right, [key, "_salt"]).drop("_salt")


def first_in_order(scored: DataFrame) -> DataFrame:
    """Of each request's candidates the best score, of equals the first by URL, then by time.

    An aggregate with map-side combination: no window over a request's candidates.
    """
    best = scored.groupBy("req_id", "url").agg(F.min(F.struct((-F.col("score")).alias("_s"), "hit_url", "hit_ts_ms")).alias("_b"))
    return best.select("req_id", "url", F.col("_b.hit_url").alias("hit_url"), F.col("_b.hit_ts_ms").alias("hit_ts_ms"), (-F.col("_b._s")).alias("score"))
