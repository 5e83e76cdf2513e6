"""URL filters by listed rules and by association rules mined from their verdicts.

Listed rules (host, path) judge what they fit. Their verdicts are labels: Spark's FP-growth mines
the combinations of the labelled URLs' tokens that go with a verdict. A rule needs ``MIN_ROWS``
URLs and a share ``MIN_SUPPORT`` of the labelled ones, a confidence above that of the verdict
among all, and is pruned where a part of its tokens is as sure. What pruning would take away is
kept out of the mining where that is plain: tokens that occur in the same URLs are one item, and
a token whose URLs have one verdict is a rule by itself and in no other.
Each rule is filed under its rarest token; a URL meets, by its tokens, the rules filed under
one of them, and takes the surest that it holds whole. URLs that no rule fits are allowed.

Cases: a null URL, or one without ``://``, has an empty host and path and no token, and is
allowed; rule hosts fit on label boundaries only; among listed rules the longest wins; without
labels there are no mined rules; repeated rows and null ids give rows of their own; a URL of any
length is a row of its tokens; an empty table gives no rows; columns other than the id and the
URL are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: The listed rules, each with its verdict.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
MIN_ROWS = 10
MIN_CONFIDENCE = 0.9
BROADCAST_RULES = 10_000  # more are joined without a broadcast


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column, query: Column, rules=RULES) -> Column:
    """Distinct words (letters and digits of any script) of the host, the path and the query, but for those of the listed rules.

    Labels come from the listed rules, so their own words would only say again where a rule
    fits, and would carry it to places that its author left out.
    """
    said = [w for _, rule in rules for w in re.split("[^a-z]+", rule.lower()) if w]
    fresh = lambda w: (F.length(w) > 1) & ~w.isin(said)
    named = lambda kind, text: F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), fresh), lambda w: F.concat(F.lit(f"{kind}:"), w))
    return F.array_distinct(F.concat(named("host", host), named("path", path), named("query", query)))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; null if none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rest}"))
        which = F.when(fits, F.lit(rule)).otherwise(which)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return which, verdict


def judged_by_list(pages: DataFrame, id_column: str, url_column: str, rules=RULES) -> DataFrame:
    """id, host, path, rule, listed (the rule's verdict) and tokens."""
    url = F.col(url_column).cast("string")
    rows = pages.select(id_column, host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"))
    which, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    tokens = tokens_of(F.col("host"), F.col("path"), F.col("query"), rules)
    return rows.select(id_column, "host", "path", which.alias("rule"), verdict.alias("listed"), tokens.alias("tokens"))


_VERDICT = "verdict:"  # no token begins like this


def _items(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """What FP-growth mines, and the frequent tokens with their items.

    rows have row_id, label and tokens. Tokens of equal row sets, told by their number and two
    sums of hashes, are one item, named by the least of them.
    """
    each = rows.select("row_id", "label", F.explode(F.array_distinct("tokens")).alias("token"))
    per = each.groupBy("token", "label").agg(F.count("*").alias("own"), F.bit_xor(F.xxhash64("row_id")).alias("x"), F.bit_xor(F.xxhash64("row_id", F.lit(1))).alias("y"))
    totals = per.groupBy("token").agg(F.sum("own").alias("n"), F.max("own").alias("most"), F.max_by("label", "own").alias("label"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    frequent = durable(totals.where(F.col("most") >= least), "url-tokens")
    item = frequent.groupBy("n", "x", "y").agg(F.min("token").alias("item"))
    return each, durable(frequent.join(item, ["n", "x", "y"]).select("token", "item", "n", "most", "label"), "url-items")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """tokens, verdict, confidence and support of every rule of which no part is as sure, from rows of tokens and a label.

    Of tokens that occur in the same URLs the least stands for all in rules of several tokens.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    rows = durable(labelled.where(F.col("label").isNotNull()).select(F.monotonically_increasing_id().alias("row_id"), "label", "tokens"), "url-labels")
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a verdict
    total = sum(shares.values())
    if not total:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    least = max(min_rows, math.ceil(min_support * total))
    share = F.lit(0.0)
    for label, n in shares.items():
        share = F.when(F.col("label") == label, F.lit(n / total)).otherwise(share)
    each, items = _items(rows, least)
    pure = items.where("most = n")
    mixed = items.where("most < n and token = item").select("token")
    baskets = each.join(mixed, "token").groupBy("row_id", "label").agg(F.collect_list("token").alias("own"))
    baskets = baskets.select(F.concat("own", F.array(F.concat(F.lit(_VERDICT), "label"))).alias("items"))
    singles = pure.select(F.array("token").alias("tokens"), "label", F.col("most").alias("own"), "n")
    mined = durable(FPGrowth(itemsCol="items", minSupport=least / total * (1 - 1e-9) * total / max(1, baskets.count()), minConfidence=1.0).fit(baskets).freqItemsets, "url-sets") if not mixed.isEmpty() else None
    if mined is not None:
        labels = F.filter("items", lambda t: F.startswith(t, F.lit(_VERDICT)))
        split = mined.select(F.array_sort(F.filter("items", lambda t: ~F.startswith(t, F.lit(_VERDICT)))).alias("tokens"), F.get(labels, F.lit(0)).alias("verdict"), "freq")
        with_label = split.where("verdict is not null and size(tokens) > 0").select("tokens", F.substring("verdict", len(_VERDICT) + 1, 1 << 30).alias("label"), F.col("freq").alias("own"))
        counts = with_label.join(split.where("verdict is null").select("tokens", F.col("freq").alias("n")), "tokens").where(F.col("own") >= least)
        # tokens of equal URLs are rules of one token each
        alike = items.where("most < n").select("token", "item")
        one = counts.where("size(tokens) = 1").withColumn("item", F.get("tokens", F.lit(0))).join(alike, "item").select(F.array("token").alias("tokens"), "label", "own", "n")
        singles = singles.unionByName(one)
    scored = lambda df: df.select("tokens", "label", "own", (F.col("own") / F.col("n")).alias("confidence"))
    level = durable(scored(singles).withColumn("best", share), "url-rules-1")
    rules, k = level, 1
    while mined is not None:
        k += 1
        now = scored(counts.where(F.size("tokens") == k))
        parts = now.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda at: F.concat(F.slice("tokens", 1, at - 1), F.slice("tokens", at + 1, F.lit(k))))).alias("part"))
        before = level.select(F.col("tokens").alias("part"), "label", F.greatest("confidence", "best").alias("b"))
        # all parts of a frequent set are frequent, so each meets its row
        level = durable(parts.join(before, ["part", "label"]).groupBy("tokens", "label", "own", "confidence").agg(F.max("b").alias("best")), f"url-rules-{k}")
        if level.isEmpty():
            break
        rules = rules.unionByName(level)
    sure = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("best")))
    return sure.select("tokens", F.col("label").alias("verdict"), "confidence", (F.col("own") / total).alias("support"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> list[Rule]:
    """The rules of mine_rules as a list, for few of them."""
    return [Rule(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in mine_rules(labelled, min_support, min_confidence, min_rows).collect()]


def _filed(mined: DataFrame) -> DataFrame:
    """token (the rarest of a rule's own), needs, says and confidence."""
    each = mined.select("*", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.sum("support").alias("seen"))
    rarest = each.join(seen, "token").groupBy("tokens", "verdict", "confidence").agg(F.min(F.struct("seen", "token"))["token"].alias("token"))
    return rarest.select("token", F.col("tokens").alias("needs"), F.col("verdict").alias("says"), "confidence")


def judge(pages: DataFrame, mined: DataFrame | list[Rule], id_column: str = "page_id", url_column: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, and mined: the tokens of the mined rule that decided, if one did."""
    if isinstance(mined, list):
        mined = pages.sparkSession.createDataFrame([(list(r.tokens), r.verdict, r.confidence, r.support) for r in mined], "tokens array<string>, verdict string, confidence double, support double")
    index = durable(_filed(mined), "url-rules")
    if index.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    # a row's number is made and used in one evaluation: its tokens meet the rules and come back to it
    rows = judged_by_list(pages, id_column, url_column, rules).withColumn("row_id", F.monotonically_increasing_id())
    asked = rows.select("*", F.explode_outer(F.when(F.col("listed").isNull(), F.col("tokens"))).alias("token"))
    fits = F.col("needs").isNotNull() & (F.size(F.array_except("needs", "tokens")) == 0)
    # the surest, then the longest, then the first in order of tokens; block before allow
    order = F.struct((-F.col("confidence")).alias("c"), (-F.size("needs")).alias("n"), F.array_join("needs", " ").alias("mined"), F.when(F.col("says") == "block", 0).otherwise(1).alias("o"), "says")
    own = [id_column, "host", "path", "rule", "listed"]
    asked = asked.join(index, "token", "left")
    best = asked.groupBy("row_id").agg(F.first(F.struct(*own)).alias("row"), F.min(F.when(fits, order)).alias("best"))
    verdict = F.coalesce("row.listed", "best.says", F.lit("allow"))
    return best.select(*[F.col(f"row.{c}") for c in own[:-1]], verdict.alias("verdict"), F.col("best.mined").alias("mined"))
