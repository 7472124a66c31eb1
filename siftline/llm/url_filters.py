"""URL filters: listed host and path rules first, mined association rules for the rest, in DataFrame functions only.

FP-growth (spark.ml, on the JVM) mines token sets of labelled urls together with a label token; rules "tokens imply
bad" are kept by support, confidence and lift over the base rate. They are matched through an inverted index: each
rule is posted once under each of its tokens, the distinct urls' tokens are joined to the index, and a rule holds
where as many of its tokens were met as it has.

Defined cases: a null url or one without "://" has an empty host and path and no tokens, so it is allowed unless a
rule fits. Repeated urls share one judgement. Without labelled urls nothing is mined and the mined verdict is allow.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm._common import small, stored

#: The listed rules of the contract: host with path, and verdict.
LISTED = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Pruning of mined rules: a rule's urls are this share of the labelled ones and MIN_URLS at least, whatever their number.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_URLS = 0.002, 0.8, 1.5, 10
BAD = "\u0001bad"


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, host endings, path parts, names of query parameters; digits count as one token."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, r"[/._-]+"), lambda x: x != "")
    query = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), "&"), lambda x: x != "")
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.split(F.coalesce(F.get(F.slice(F.reverse(labels), 2, 1), 0), F.lit("")), "-"), lambda x: F.concat(F.lit("w:"), x)),
        F.transform(parts, lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"\d+", "0"))),
        F.transform(query, lambda x: F.concat(F.lit("q:"), F.regexp_replace(x, "=.*", ""))),
    )
    return F.array_distinct(F.filter(found, lambda x: F.length(x) > 2))


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, or null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def mined_classes(labelled: DataFrame, url: str = "url", bad: str = "bad") -> tuple[DataFrame, DataFrame]:
    """(rules: rule_id, classes, confidence, n_classes; members: class, token) from urls with a boolean label.

    Tokens that stand in the same labelled urls are one class, named by the least of them: any of them says the same about a
    url, and 30 tokens that always come together are one item to mine and not 2^30 sets. Two tokens' sets of urls are told apart
    by their size and two 64-bit sums.
    """
    spark = labelled.sparkSession
    items = F.concat(url_tokens(F.col(url)), F.when(F.col(bad), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>")))
    baskets = stored(labelled.filter(F.col(bad).isNotNull() & F.col(url).isNotNull()).select(F.monotonically_increasing_id().alias("basket"), items.alias("items")).filter(F.size("items") > 0), "baskets")
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BAD))).first()
    least = max(MIN_URLS, ceil(MIN_SUPPORT * n))
    if not n_bad or n_bad < least:
        return spark.createDataFrame([], "rule_id bigint, classes array<string>, confidence double, n_classes int"), spark.createDataFrame([], "class string, token string")
    # A rule's tokens are each in as many bad urls as its support asks; other tokens go by exact count, which loses no rule.
    each = baskets.select("basket", F.array_contains("items", BAD).alias("bad"), F.explode("items").alias("token"))
    told = each.groupBy("token").agg(F.count_if("bad").alias("n_bad"), F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(i), "basket")).alias(f"h{i}") for i in (1, 2)]).filter(F.col("n_bad") >= least)
    often = stored(told, "frequent_tokens")
    same = ["n", "h1", "h2"]
    named = often.filter(F.col("token") != BAD).groupBy(*same).agg(F.min("token").alias("class"))
    members = stored(often.filter(F.col("token") != BAD).join(named, same).select("class", "token"), "token_classes")
    one = members.select("class").distinct().select(F.col("class").alias("token")).union(spark.createDataFrame([(BAD,)], "token string"))
    one = stored(one, "class_names")
    kept = stored(each.join(small(one, one.count()), "token").groupBy("basket").agg(F.collect_list("token").alias("items")), "mined")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / kept.count(), minConfidence=MIN_CONFIDENCE).fit(kept)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == BAD) & (F.col("confidence") >= MIN_LIFT * n_bad / n))
    return rules.select(F.xxhash64(F.array_join(F.array_sort("antecedent"), "\u0001")).alias("rule_id"), F.col("antecedent").alias("classes"), "confidence", F.size("antecedent").alias("n_classes")), members


def mined_rules(labelled: DataFrame, url: str = "url", bad: str = "bad") -> DataFrame:
    """All rules, spelled out in tokens: rule_id, tokens, confidence, n_tokens. A class of n tokens gives 2^n - 1 of them, so this is for reading; urls are matched by classes."""
    rules, members = mined_classes(labelled, url, bad)
    of = members.groupBy("class").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    lists = rules.select("rule_id", "confidence", F.explode("classes").alias("class")).join(of, "class").groupBy("rule_id", "confidence").agg(F.collect_list("tokens").alias("lists"))
    nothing = F.array(F.array().cast("array<string>"))
    subsets = lambda tokens: F.filter(F.aggregate(tokens, nothing, lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(t))))), lambda s: F.size(s) > 0)
    spelled = F.aggregate("lists", nothing, lambda acc, tokens: F.flatten(F.transform(acc, lambda left: F.transform(subsets(tokens), lambda s: F.concat(left, s)))))
    out = lists.select("confidence", F.explode(spelled).alias("tokens"))
    return out.select(F.xxhash64(F.array_join(F.array_sort("tokens"), "\u0001")).alias("rule_id"), "tokens", "confidence", F.size("tokens").alias("n_tokens"))


def matched_urls(urls: DataFrame, rules: DataFrame, members: DataFrame, url: str = "url") -> DataFrame:
    """Distinct urls that some rule fits (that have a token of each of its classes), with the best confidence, through the inverted index."""
    rules = stored(rules, "url_rules")
    index = rules.select(F.explode("classes").alias("class"), "rule_id", "n_classes", "confidence")
    n_postings = rules.agg(F.coalesce(F.sum("n_classes"), F.lit(0))).first()[0]
    tokens = urls.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    classes = tokens.join(small(members, members.count()), "token").select("url", "class").distinct()
    met = classes.join(small(index, n_postings), "class").groupBy("url", "rule_id").agg(F.count(F.lit(1)).alias("met"), F.max("n_classes").alias("need"), F.max("confidence").alias("confidence"))
    return met.filter("met = need").groupBy("url").agg(F.max("confidence").alias("mined_confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "page_id", bad: str = "bad") -> DataFrame:
    """Every page's host, path, listed rule, verdict and mined confidence. labels: label_id and a boolean bad."""
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    known = labels.select(F.col(label_id).alias("_id"), F.col(bad).alias("bad"))
    labelled = base.join(known, F.col("page_id") == F.col("_id")).select("url", "bad")
    hits = matched_urls(base, *mined_classes(labelled)).withColumnRenamed("url", "_url")
    judged = base.join(hits, F.col("url") == F.col("_url"), "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = judged.withColumns({"host": host, "path": path}).withColumn("_listed", listed_rule(F.col("host"), F.col("path")))
    mined = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), F.coalesce(F.col("_listed.verdict"), mined).alias("verdict"), "mined_confidence")
