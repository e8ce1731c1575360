"""URL filters: explicit host and path rules first, association rules mined from labels for the rest.

FP-growth finds combinations of URL tokens that go with bad labels in a bounded sample of labelled URLs. A URL has nine
tokens at most, for its scheme, host and parts, so an itemset has at most 2 ** 9 subsets whatever the URL. A rule is kept
with LEAST_COUNT bad urls (a count, the same at every size), a bad share of LIFT times the base rate or more, and a share
that lies DEVIATIONS standard deviations above the base rate, so that chance among many combinations makes no rule. An
inverted index lists each rule under its rarest token; a URL's tokens probe it by an equi join, and a rule fires when the
URL has all its tokens.

Defined cases: a null url, or one without ``://``, has an empty host and path and no token; without labelled URLs no
rule is mined and the method allows; of explicit rules of equal length the first in the list wins (two that fit one url
differ in length, or are the same, unless a host holds a slash); rows that repeat an id or a url keep a row each; clashing
columns are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialmill.runtime import fits_broadcast, lookup_join, stash, without

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
LIFT, DEVIATIONS, LEAST_COUNT, SAMPLE_ROWS, BAD = 1.5, 4.0, 20, 200_000, "label:bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(url.isNull() | (at == 0), "").otherwise(F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def explicit(h: Column, p: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict; null where none fits."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((h == r[1]) | h.endswith("." + r[1])) & p.startswith(r[2])
    pick = lambda value: reduce(lambda c, r: c.when(fits(r), value(r)), longest[1:], F.when(fits(longest[0]), value(longest[0])))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its first label and its last two, first path segment, folders, file, its ending, query keys.

    Numbers in paths count as #. All of the url is in some token, whatever its length.
    """
    h, p = host(url), F.regexp_replace(path(url), r"[0-9]+", "#")
    labels = F.split(h, r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1)))), "&")
    named = lambda kind, value: F.when(value != "", F.concat(F.lit(f"{kind}:"), value))
    found = F.array(
        named("scheme", F.substring_index(url, "://", 1)), named("host", h), named("sub", F.when(F.size(labels) > 2, F.get(labels, F.lit(0)))), named("site", F.substring_index(h, ".", -2)),
        named("first", F.regexp_extract(p, r"^/([^/]+)", 1)), named("folders", F.regexp_extract(p, r"(?s)^(/.*)/", 1)), named("file", F.regexp_extract(p, r"([^/]+)$", 1)), named("ending", F.regexp_extract(p, r"\.([^./]+)$", 1)), named("keys", keys),
    )
    return F.when(url.isNull() | (F.instr(url, "://") == 0), F.array().cast("array<string>")).otherwise(F.array_compact(found))


def mine(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url_col: str = "url", label_id: str = "doc_id", lift: float = LIFT, deviations: float = DEVIATIONS, least: int = LEAST_COUNT, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Index rows (token, items, confidence): each kept rule under its rarest token. A label is bad if quality is 0 or toxic is 1."""
    bad = labels.groupBy(F.col(label_id).alias("__id")).agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    seen = stash(pages.select(F.col(page_id).alias("__id"), tokens(F.col(url_col)).alias("items")).join(bad, "__id").filter(F.size("items") > 0), "url-labelled")
    n = seen.count()
    spark = pages.sparkSession
    empty = spark.createDataFrame([], "token string, items array<string>, confidence double")
    if not n:
        return empty
    sample = seen.filter(F.pmod(F.xxhash64("__id", "items"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / n)))
    taken, wrong = sample.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if wrong < least:
        return empty
    base = wrong / taken
    baskets = sample.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / taken, minConfidence=min(1.0, lift * base)).fit(baskets)
    of = F.round(F.col("support") * taken / F.col("confidence"))  # urls with the antecedent
    sure = F.col("confidence") - base >= deviations * F.sqrt(base * (1 - base) / of)
    found = model.associationRules.filter((F.col("consequent")[0] == BAD) & sure).select(F.array_sort("antecedent").alias("items"), "confidence")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    rules = stash(found, "url-rules").withColumn("rule", F.monotonically_increasing_id())
    by_token = rules.withColumn("token", F.explode("items")).join(single, "token")
    return stash(by_token.groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("t"), F.first("items").alias("items"), F.first("confidence").alias("confidence")).select(F.col("t.token").alias("token"), "items", "confidence"), "url-index")


def judge(pages: DataFrame, index: DataFrame, page_id: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """pages' columns with host, path, rule and verdict.

    Distinct urls probe the index; those with a firing rule come back to the pages by a broadcast, or by a salted join on
    url where they don't fit, so that a hot url is spread.
    """
    pages = without(pages, ["host", "path", "rule", "verdict", "__hit", "__salt_by"])
    url = F.col(url_col)
    rule, said = explicit(host(url), path(url), rules)
    method = F.lit("allow")
    out = pages
    if index.limit(1).count():
        side = F.broadcast(index) if fits_broadcast(index) else index
        probes = pages.filter(url.isNotNull()).select(url.alias(url_col)).distinct().select(url_col, tokens(url).alias("own")).withColumn("token", F.explode("own"))
        hits = stash(probes.join(side, "token").filter(F.size(F.array_except("items", "own")) == 0).select(url_col).distinct().withColumn("__hit", F.lit(True)), "url-hits")
        out = lookup_join(pages.withColumn("__salt_by", F.col(page_id)), hits, url_col, F.col("__salt_by"))
        method = F.when(F.col("__hit"), "block").otherwise("allow")
    return out.select(*pages.columns, host(url).alias("host"), path(url).alias("path"), rule.alias("rule"), F.coalesce(said, method).alias("verdict"))
