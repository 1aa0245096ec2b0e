"""URL filter: hand-made host and path rules, then association rules mined by FP-growth from labelled URLs.

DataFrame operations and Spark's own FP-growth only.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame

from veriframe.session import cut_lineage

#: (host, path, verdict)
HAND_RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
BAD = "label=bad"


def _lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host and path: both empty for a null URL or one without ``://``."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = _lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def hand_rule(rules: tuple = HAND_RULES) -> Column:
    """struct(rule, verdict) of the longest hand-made rule that fits host and path; null if none does."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path)),
            F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for host, path, verdict in rules
    ]
    return F.greatest(*fits)


def url_tokens() -> Column:
    """Distinct tokens of a URL: host words and labels, path segments without digits, extension, query keys, depth."""
    host_part = lambda p: F.transform(p, lambda x: F.concat(F.lit("host="), x))
    labels = F.split("host", r"\.")
    segments = F.filter(F.split("path", "/"), lambda x: (x != "") & ~x.rlike(r"\d"))
    keys = F.transform(
        F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)\?([^#]*)", 1), "[&;]"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)
    )
    parts = F.concat(
        host_part(labels), host_part(F.split("host", r"[.\-]")),
        F.array(F.concat(F.lit("site="), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))),
        F.transform(segments, lambda x: F.concat(F.lit("path="), x)),
        F.array(F.concat(F.lit("ext="), F.regexp_extract("path", r"\.([A-Za-z]{1,5})$", 1))),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
        F.array(F.concat(F.lit("depth="), F.least(F.size(F.split("path", "/")), F.lit(9)).cast("string"))),
    )
    return F.filter(F.array_distinct(parts), lambda x: ~x.endswith("="))


def mine_rules(
    labelled: DataFrame, min_support: float = 0.004, min_confidence: float = 0.6, min_lift: float = 1.5
) -> DataFrame:
    """(tokens, bad) rows to pruned rules (antecedent, confidence, support) whose consequence is BAD.

    The fit takes all tokens of a URL that can stand in a rule: those that reach ``min_support`` together with BAD.
    The others can't, since a rule is as rare as its rarest token. No token is lost by its place in the URL.
    Tokens of exactly the same rows are mined as one, so a long URL does not make all combinations of its tokens, and
    every kept rule is written out for each of them. A rule goes when one with a part of its antecedent is at least as
    sure, so no rule holds two such tokens.
    """
    spark = labelled.sparkSession
    schema = "antecedent array<string>, confidence double, support double"
    if labelled.where("bad").isEmpty():
        return spark.createDataFrame([], schema)
    mark = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.expr("array()").cast("array<string>"))
    labelled = cut_lineage(labelled.withColumn("row", F.monotonically_increasing_id()))
    tokens = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), "bad", "row").groupBy("token").agg(
        F.count_if("bad").alias("n_bad"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"),
    ).where(F.col("n_bad") >= min_support * labelled.count())
    classes = tokens.groupBy("n", "x", "y").agg(F.min("token").alias("name"), F.collect_set("token").alias("members"))
    known = cut_lineage(classes.agg(F.map_from_entries(F.collect_list(F.struct("name", "members"))).alias("known")))
    kept = F.array_intersect("tokens", F.map_keys("known"))
    baskets = labelled.crossJoin(F.broadcast(known)).select(F.concat(kept, mark).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift)
    ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    # Inverted index on one token: shorter rules that a longer one contains.
    by_token = rules.select(F.explode("antecedent").alias("token"), "antecedent", "confidence")
    shorter = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("part"), F.col("confidence").alias("sure"))
    needless = by_token.join(shorter, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("sure") >= F.col("confidence"))
    ).select("antecedent").distinct()
    names = rules.join(needless, "antecedent", "left_anti").crossJoin(F.broadcast(known))
    written = F.aggregate(
        "antecedent", F.expr("array(array())").cast("array<array<string>>"),
        lambda sets, name: F.flatten(F.transform(
            sets, lambda s: F.transform(F.element_at("known", name), lambda token: F.array_append(s, token)))),
    )
    return names.select(F.explode(written).alias("antecedent"), "confidence", "support").select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = HAND_RULES, **mining) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, mined_rule, confidence), one per row of ``pages``.

    A page is labelled by the row of ``labels`` with its page_id as doc_id: bad if any such row has quality 0 or
    toxic 1. The longest hand-made rule decides; else a URL that holds all tokens of a mined rule is blocked, by the
    surest rule; else it is allowed. Rules are found by the first token of their antecedent and checked whole.
    Null labels say nothing; without labelled bad pages there are no mined rules. Null and odd URLs are allowed.
    """
    urls = with_host_path(pages.select("page_id", "url"))
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(bad)
    labelled = urls.join(known, F.col("page_id") == F.col("doc_id")).select(url_tokens().alias("tokens"), "bad")
    mined = mine_rules(labelled, **mining).select(F.element_at("antecedent", 1).alias("token"), "antecedent", "confidence")
    plain = urls.withColumn("hand", hand_rule(rules))
    open_urls = plain.where("hand is null and url is not null").select("url", "host", "path").distinct()
    tokens = open_urls.select("url", url_tokens().alias("tokens"))
    hits = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(mined, "token").where(
        F.size(F.array_except("antecedent", "tokens")) == 0
    )
    surest = hits.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("mined_rule"))).alias("m"))
    judged = plain.join(surest, "url", "left")
    return judged.select(
        "page_id", "host", "path", "hand.rule",
        F.coalesce("hand.verdict", F.when(F.col("m").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("hand").isNull(), F.col("m.mined_rule")).alias("mined_rule"),
        F.when(F.col("hand").isNull(), F.col("m.confidence")).alias("confidence"),
    )
