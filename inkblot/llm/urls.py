"""URL filters: a list of host and path rules, and association rules mined from labelled URLs.

A URL becomes a set of tokens: labels of its host (``h:``), segments of its path (``p:``), keys of its
query (``q:``). Tokens of at least five bad URLs take part in mining, and those that the same labelled URLs
have are one item. FP-growth mines item sets that go with the label ``block``; those with enough support
and confidence are kept as rules. They are matched by an inverted index: each rule stands under its
rarest item only, and the other items are checked on what that one brings together. Where the
list has no rule, a URL is blocked if a mined rule fits it.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what follows
up to ``?``, ``#`` or the end. Both are empty where the URL is null or has no ``://``; such URLs have
no tokens and are allowed. Rows repeat as they do in the input; no labels give no mined rules; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkblot.llm.common import ascii_lower, written

BAD, LEAST = "y:block", 5


class ListRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    ListRule("net", "/", "block"), ListRule("example.net", "/en/", "allow"),
    ListRule("example.com", "/de/", "block"), ListRule("org", "/fr/", "allow"),
)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")


def host_and_path(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``."""
    urls = pages.select("page_id", "url")
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return urls.select(
        "page_id", "url", ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def list_rule(host: Column, path: Column, rules: Sequence[ListRule] = RULES) -> Column:
    """The longest rule that fits: struct of rule and verdict, or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    own = F.concat(marked("h:", F.split(host, r"\.")), marked("p:", F.split(path, "/")), marked("q:", keys))
    return F.when(host != "", F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, least: int) -> DataFrame:
    """``token``, ``item``: tokens that ``least`` bad URLs have; those of exactly the same URLs are one item.

    To the labels, such tokens are the same thing, in any combination. Mined as one, a URL of many segments
    that is there several times makes one item set, and not one for each choice of its segments.
    """
    rows = labelled.select("bad", F.explode("tokens").alias("token"), F.col("_basket"))
    places = [F.sum(F.xxhash64(F.col("_basket"), F.lit(seed)).cast("decimal(38,0)")).alias(f"at{seed}") for seed in (1, 2)]
    found = rows.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), *places).where(F.col("n_bad") >= least)
    return found.withColumn("item", F.min("token").over(Window.partitionBy("n", "at1", "at2"))).select("token", "item")


def _itemized(urls: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """``by`` and ``items``: the items of each row, which has any of their tokens."""
    found = urls.select(by, F.explode("tokens").alias("token")).join(items, "token")
    return found.groupBy(by).agg(F.collect_set("item").alias("items"))  # bounded by the tokens of a URL


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_lift: float = 1.5, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Rules from ``tokens``, ``bad`` (boolean): ``items``, ``confidence``, ``lift``, ``support``, ``key``; and
    which item each token is.

    At least ``least`` bad URLs stand behind every rule. ``key`` is the rule's rarest item among the labelled,
    under which the index holds the rule.
    """
    known = labelled.where("bad is not null and size(tokens) > 0").select("bad", "tokens", F.monotonically_increasing_id().alias("_basket"))
    known = written(known, "url-labelled")
    items = written(items_of(known, least), "url-items")
    of_basket = known.select("_basket", "bad").join(_itemized(known, items, "_basket"), "_basket", "left")
    held = F.coalesce("items", F.array().cast("array<string>"))
    baskets = of_basket.select(F.when(F.col("bad"), F.concat(held, F.array(F.lit(BAD)))).otherwise(held).alias("items"))
    n = known.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, least / max(n, 1))), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift))
    counts = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("item"), "freq")
    ruled = rules.select(F.sort_array("antecedent").alias("items"), "confidence", "lift", "support")
    rarest = ruled.withColumn("item", F.explode("items")).join(counts, "item")
    return rarest.groupBy("items").agg(
        F.first("confidence").alias("confidence"), F.first("lift").alias("lift"), F.first("support").alias("support"),
        F.min(F.struct("freq", "item"))["item"].alias("key"),
    ), items


def matches(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``url`` and the most confident mined rule that fits it, for distinct ``url``, ``tokens``."""
    seen = _itemized(urls, items, "url").withColumn("key", F.explode("items"))
    index = rules.select("key", F.col("items").alias("wanted"), "confidence")
    hits = seen.join(index, "key").where(F.size(F.array_except("wanted", "items")) == 0)
    best = F.max(F.struct("confidence", (-F.size("wanted")).alias("short"), "wanted"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.wanted").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[ListRule] = RULES, **mining) -> DataFrame:
    """Every page with host, path, rule and verdict, and the mined rule that decided, if one did.

    ``labels``: page_id, bad (boolean, null: unknown). Pages are joined by URL, so that each distinct URL
    is matched once.
    """
    parsed = host_and_path(pages)
    parsed = parsed.withColumn("_rule", list_rule(F.col("host"), F.col("path"), rules))
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")
    known = labels.select("page_id", "bad").where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined, items = mine(parsed.select("page_id", tokens).join(known, "page_id"), **mining)
    mined = written(mined, "url-rules")
    open_urls = parsed.where("_rule is null and host <> ''").select("url", tokens).distinct()
    found = matches(open_urls, mined, items)
    verdict = F.when(F.col("_rule").isNotNull(), F.col("_rule.verdict")).when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return parsed.join(found, "url", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        F.when(F.col("_rule").isNull(), F.array_join("mined", " ")).alias("mined_rule"),
    )
