"""URL filtering by association rules, in DataFrame functions only (Spark's FP-growth runs in the JVM).

Labelled URLs become token sets: host labels, pairs of labels that stand side by side, path words (digits as one token),
the path's depth and its extension. FP-growth mines the token combinations that come with the label "block" in all labelled
URLs. A rule needs a number of URLs that bear it out, a confidence, and a lift over the share of "block" among all labelled
URLs; a rule that contains a rule of at least its confidence is dropped. Rules are matched through an inverted index that
lists each rule under its rarest token; a candidate counts when the URL has all of its tokens. Fixed rules (host and path
prefixes) go before mined ones. Nothing but labels makes a rule: where they say nothing about URLs, none is mined.

A URL's label is that of the document whose number ends its path: "block" if it is of low quality or toxic.

Defined cases: a null URL, or one without "://", has empty host and path, no tokens, no rule and the verdict "allow";
repeated URLs are judged once and all get that verdict; without labelled URLs no rules are mined and only the fixed rules
decide. Of pages and labels only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage

#: (verdict, host, path) of the fixed rules.
FIXED_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
NO_RULES = "antecedent array<string>, confidence double, support double"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    lower = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    named = lambda kind, words: F.transform(words, lambda x: F.concat(F.lit(kind), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    parts = lambda text, cut: F.filter(F.split(text, cut), lambda x: x != "")
    labels = parts(host, "[.]")
    pairs = F.zip_with(labels, F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), lambda x, y: F.concat(x, F.lit("."), y))
    lower = F.lower(path)
    depth = F.array(F.concat(F.lit("depth:"), F.size(parts(lower, "/")).cast("string")))
    extension = F.filter(F.array(F.regexp_extract(lower, "[.]([a-z0-9]{1,5})$", 1)), lambda x: x != "")
    kinds = [named("host:", parts(host, "[._-]+")), named("hosts:", F.filter(pairs, lambda x: x.isNotNull())), named("path:", parts(lower, "[./_-]+")), named("", depth), named("ext:", extension)]
    return F.array_distinct(F.concat(*kinds))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = FIXED_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting fixed rule; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, own, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(own + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def known_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, path, tokens, bad of every URL: 1 if the document whose number ends the path is of low quality or toxic, 0 if it
    is labelled and neither, else null."""
    host, path = url_parts(F.col("url"))
    urls = pages.select(host.alias("host"), path.alias("path")).distinct()
    urls = urls.withColumn("doc_id", F.regexp_extract("path", r"^/[a-z]+/(\d{1,18})(?:\.html|/)?$", 1).try_cast("long"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return urls.join(marks, "doc_id", "left").select("host", "path", url_tokens(F.col("host"), F.col("path")).alias("tokens"), "bad")


def labelled_urls(urls: DataFrame) -> DataFrame:
    """tokens, label of those known_urls that have a label."""
    return urls.where((F.col("host") != "") & F.col("bad").isNotNull()).select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("label"))


def mine_rules(labelled: DataFrame, min_confidence: float = 0.9, min_count: int = 10, min_share: float = 1e-4, min_lift: float = 1.5) -> DataFrame:
    """antecedent, confidence, support of the rules for "block" that stay after pruning. min_count URLs, and min_share of all
    labelled ones, must bear a rule out (the share keeps the number of combinations from growing with the labels), with a
    confidence of min_confidence and of min_lift times the share of "block" among all. Tokens of so many URLs that none could
    reach that lift by itself are not mined."""
    n, base = labelled.agg(F.count(F.lit(1)), F.avg((F.col("label") == "block").cast("double"))).first()
    if n < max(1, min_count):
        return labelled.sparkSession.createDataFrame([], NO_RULES)
    # a URL has few tokens, so few can be that common
    common = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") * min_lift > n).select("token").collect()
    telling = F.array_except("tokens", F.array(*[F.lit(r.token) for r in common]).cast("array<string>"))
    baskets = labelled.select(F.concat(telling, F.array(F.concat(F.lit("="), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max((min_count - 0.5) / n, min_share)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", "=block") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    rules = rules.where(F.col("confidence") >= min_lift * base).select("antecedent", "confidence", "support")
    rules = stage(rules, "url-rules").withColumn("rule_id", F.xxhash64(F.array_sort("antecedent")))
    parts = rules.select(F.col("rule_id").alias("part_id"), F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"), F.col("antecedent")[0].alias("token"))
    wholes = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    covered = wholes.join(parts, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    )
    return rules.join(covered.select("rule_id").distinct(), "rule_id", "left_anti").drop("rule_id")


def rule_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """token, antecedent, confidence: each rule under the token that is rarest among the labelled URLs."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    postings = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(counts, "token", "left")
    postings = postings.withColumn("count", F.coalesce("count", F.lit(0)))
    return postings.groupBy("antecedent").agg(F.min(F.struct("count", "token")).alias("key"), F.max("confidence").alias("confidence")).select(F.col("key.token").alias("token"), "antecedent", "confidence")


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = FIXED_RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, matched (the tokens of the best mined rule, else null) of every page."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = stage(known_urls(pages, labels), "url-tokens")
    labelled = labelled_urls(urls)
    index = rule_index(mine_rules(labelled, **mining).select("antecedent", "confidence"), labelled)
    # the rules are few however many URLs there are (mine_rules); by estimate Spark would broadcast the URLs' tokens instead
    hits = urls.select("host", "path", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("host", "path").agg(F.max(F.struct("confidence", F.concat_ws(" ", F.array_sort("antecedent")).alias("matched"))).alias("best"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    found = F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    judged = parts.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, found).alias("verdict"), F.col("best.matched").alias("matched"))
