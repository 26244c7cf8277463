"""URL filters: host and path rules, then rules that FP-growth mines from labels. DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BAD = "#bad"


@dataclass(frozen=True)
class UrlParams:
    """Mined rules hold for ``min_support`` of the labelled URLs, ``min_count`` at least, with ``min_confidence``, and ``min_lift`` times as often as URLs are bad at all.

    Every token that enough bad URLs have goes into the mining; those that occur
    in the same URLs count as one. Rules of up to ``compared`` tokens are
    compared with their parts.
    """

    min_support: float = 0.002
    min_count: int = 10
    min_confidence: float = 0.5
    min_lift: float = 1.5
    compared: int = 10
    inline_rules: int = 2000


DEFAULT = UrlParams()


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, longer than one character."""
    parts = F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+")
    return F.filter(F.array_distinct(parts), lambda t: F.length(t) > 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of ``rules(host, path, verdict)`` that fits, else null.

    Rules are found by host: each suffix of a URL's host at a dot is looked up
    in a map from hosts to their paths. Equal lengths go by the rule's text.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((p, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    deepest = max(h.count(".") for h in by_host) + 1
    entry = lambda h, p, v: F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    table = F.create_map(*(x for h, ps in by_host.items() for x in (F.lit(h), F.array(*(entry(h, p, v) for p, v in ps)))))
    found = []
    for k in range(1, deepest + 1):
        suffix = F.substring_index(host, ".", -k)
        whole = (F.lit(k) == 1) | (F.length(suffix) != F.length(F.substring_index(host, ".", -(k - 1))))
        found.append(F.when(whole, F.coalesce(table[suffix], F.array())).otherwise(F.array()))
    fits = F.filter(F.concat(*found), lambda r: F.startswith(path, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def mine_rules(labelled: DataFrame, params: UrlParams = DEFAULT) -> DataFrame:
    """(antecedent, confidence, support) of token combinations in ``labelled(url, bad)`` that tell bad URLs.

    Rules that one of their parts makes needless go; null urls or labels are not
    learned from, and no bad URL gives no rules. Tokens that stand in the same
    URLs, such as a site's constant path, make the same rules, and their itemsets
    would double with each: the least of them is mined for all. Tokens that
    nearly always stand together are still mined apart.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("url is not null and bad is not null").select(F.col("url").cast("string").alias("url"), tokens_of(F.col("url")).alias("t"), F.col("bad").cast("boolean").alias("bad"))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    empty = spark.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if not n or not bad:
        return empty
    support = max(params.min_support, params.min_count / n)
    if support > 1:
        return empty
    # tokens of the same URLs have the same sums of their rows' hashes
    rows = rows.withColumn("id", F.xxhash64("url")).withColumn("id2", F.xxhash64("url", F.lit(1)))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    counts = rows.select("bad", "id", "id2", F.explode("t").alias("t")).groupBy("t").agg(F.sum(F.col("bad").cast("long")).alias("b"), F.count("*").alias("c"), total("id").alias("s"), total("id2").alias("s2"))
    # no rule can hold any other token; there are at most (tokens a URL) / support, and of those of the same URLs the least stands for all
    words = [r["t"] for r in counts.filter(F.col("b") >= support * n).groupBy("b", "c", "s", "s2").agg(F.min("t").alias("t")).orderBy("t").collect()]
    if not words:
        return empty
    known = F.array(*(F.lit(w) for w in words))
    baskets = rows.select(F.concat(F.array_intersect("t", known), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=params.min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") >= params.min_lift))
    rules = Scratch(spark, "rules").save(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"), "mined")
    return rules.join(_needless(rules, params.compared), "antecedent", "left_anti")


def _needless(rules: DataFrame, compared: int) -> DataFrame:
    """(antecedent) of rules of which a part is a rule as confident: it fires wherever they do.

    Each rule names its parts, by the bits of the numbers below 2 to its size,
    and meets those that are rules; longer ones than ``compared`` may stay, which
    changes no verdict.
    """
    size = F.size("antecedent")
    part = lambda m: F.filter("antecedent", lambda t, i: F.getbit(m, i) == 1)
    numbers = F.expr("sequence(1, shiftleft(1, size(antecedent)) - 2)")
    parts = rules.filter((size > 1) & (size <= compared)).select("antecedent", "confidence", F.explode(F.transform(numbers, part)).alias("part"))
    known = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("its"))
    return parts.join(known, "part").filter("its >= confidence").select("antecedent").distinct()


def _fires(tokens: Column, rules: list[list[str]]) -> Column:
    """Whether all tokens of a rule are there; rules are indexed by their first token."""
    index: dict[str, list[list[str]]] = {}
    for rule in rules:
        index.setdefault(rule[0], []).append(rule)
    if not index:
        return F.lit(False)
    table = F.create_map(*(x for head, rs in index.items() for x in (F.lit(head), F.array(*(F.array(*(F.lit(t) for t in r)) for r in rs)))))
    heads = F.filter(tokens, lambda t: t.isin(list(index)))
    return F.exists(heads, lambda t: F.exists(table[t], lambda rule: F.size(F.array_except(rule, tokens)) == 0))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], mined: DataFrame, params: UrlParams = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict): one row per row of ``pages(page_id, url)``.

    The longest listed rule decides; where none fits, a URL is blocked if a
    mined rule's tokens are all in it, else allowed. Null URLs and those without
    ``://`` have an empty host and path, so no listed rule fits them. Up to
    ``inline_rules`` mined rules are looked up in a map within the scan; more
    are joined on their first token, over distinct URLs. Repeated rows are
    judged one by one; other columns are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url")).select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    some = mined.select("antecedent").limit(params.inline_rules + 1).collect()
    if len(some) <= params.inline_rules:
        rows = rows.withColumn("fires", _fires(tokens_of(F.col("url")), [list(r[0]) for r in some]))
    else:
        urls = rows.filter("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
        index = mined.select(F.col("antecedent")[0].alias("t"), "antecedent")
        hits = urls.select("url", "tokens", F.explode("tokens").alias("t")).join(index, "t").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
        rows = rows.join(hits.select("url").distinct().withColumn("hit", F.lit(True)), "url", "left").withColumn("fires", F.coalesce("hit", F.lit(False)))
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("fires"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))
