"""URL filters: host and path rules first; URLs that no rule covers are judged
by gradient-boosted trees on lexical features, trained on the URLs that a rule
labels (at most ``SAMPLE`` of them, taken in hash order: a documented bound).
Suffix statistics (rows and share of blocked rows for each last host label)
cover all labelled rows. Null URLs have empty host and path; with only one
label present, that label is the verdict, and with none, allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
SAMPLE = 20_000
FEATURES = ["length", "depth", "digit_ratio", "entropy", "params", "host_labels", "suffix_rate", "suffix_log_n"]


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(u, F.lit("://")), F.regexp_extract(u, "(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest fitting rule (null where none fits)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(s: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    chars = F.split(s, "")
    return F.element_at(F.transform(F.array(chars), lambda cs: F.aggregate(
        F.array_distinct(cs), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(
            F.size(F.filter(cs, lambda x: x == c)) / n * F.log2(F.size(F.filter(cs, lambda x: x == c)) / n)))), 1)


def features(df: DataFrame, suffixes: DataFrame) -> DataFrame:
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    d = df.withColumns({
        "length": F.length(u).cast("double"), "depth": F.regexp_count(F.col("path"), F.lit("/")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n, "entropy": _entropy(u),
        "params": F.regexp_count(u, F.lit("[?&][^=&#]+=")).cast("double"),
        "host_labels": F.regexp_count(F.col("host"), F.lit("\\.")).cast("double")})
    d = d.join(suffixes, "suffix", "left")
    return d.withColumns({"suffix_rate": F.coalesce("rate", F.lit(0.5)),
                          "suffix_log_n": F.log1p(F.coalesce("n", F.lit(0)).cast("double"))})


def judge_urls(pages: DataFrame, rules=RULES, sample: int = SAMPLE, trees: int = 10, depth: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``."""
    host, path = host_path(F.col("url"))
    d = with_rule(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    d = d.withColumn("suffix", F.substring_index("host", ".", -1))
    label = F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)
    known = d.filter(F.col("rule_verdict").isNotNull()).withColumn("label", label)
    suffixes = known.groupBy("suffix").agg(F.count("*").alias("n"),
                                           ((F.sum("label") + 1) / (F.count("*") + 2)).alias("rate"))
    seen = known.groupBy("label").count().collect()       # two rows at most
    if len(seen) < 2:
        method = F.lit("block" if seen and seen[0]["label"] == 1.0 else "allow")
        out = d.withColumn("method", method)
    else:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler
        vec = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = known.orderBy(F.xxhash64("url"), "url").limit(sample)
        fit = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(
            vec.transform(features(train, suffixes)).select("features", "label").coalesce(4))
        out = fit.transform(vec.transform(features(d, suffixes))).withColumn(
            "method", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "method").alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
