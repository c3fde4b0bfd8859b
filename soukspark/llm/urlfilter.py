"""URL filters: host and path rules, then a ratio of two character language models, in DataFrame expressions.

URLs that a rule decides teach two smoothed variable-order Markov models, one of accepted and one of rejected
URLs. Characters are folded to a fixed alphabet, so a model of order 3 has at most 38^4 counts whatever the input;
in practice some thousands. The other URLs are blocked where the log-likelihood difference per character is below a
threshold, set on a fifth of the taught URLs that the models do not see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukspark.llm.common import cut

ORDER = 3
#: Letters, 0 for any digit, these marks, ~ for anything else, ^ as the start: 38 characters.
MARKS = "./-_?=&#%:"
ALPHABET = 26 + 1 + len(MARKS) + 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of so many taught URLs calibrates the threshold.
FOLDS = 5


def host(url: str) -> Column:
    found = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(found, F.lit(""))


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(f"/{p}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def folded(url: str) -> Column:
    low = F.translate(F.translate(F.coalesce(F.col(url), F.lit("")), _UPPER, _LOWER), "123456789", "0" * 9)
    marks = "".join(f"\\{c}" for c in MARKS)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(low, f"(?s)[^a-z0{marks}]", "~"))


def grams(urls: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row for each character of a folded URL, with its ORDER predecessors: ``gram``."""
    at = F.explode(F.sequence(F.lit(1), F.length(text) - ORDER))
    return urls.where(F.length(text) > ORDER).select(*keep, text, at.alias("_at")).select(*keep, F.substring(F.col(text), F.col("_at"), F.lit(ORDER + 1)).alias("gram"))


def model(taught: DataFrame) -> DataFrame:
    """``(gram, delta)``: how much more likely the last character is after the others among accepted URLs, as
    a difference of logarithms, for every gram of either class.

    ``taught``: ``gram, accepted``. Each order's estimate is (count + types * the order below's) / (total + types)
    (Witten and Bell); below order 0 all characters are equally likely.
    """
    full = taught.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    out = full.select("gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for order in range(ORDER + 1):
        sub = full.select(F.substring("gram", ORDER + 1 - order, order + 1).alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        sub = sub.withColumn("c", F.substring("g", 1, order))
        w = Window.partitionBy("c")  # at most ALPHABET rows each
        for k in "ar":
            sub = sub.withColumn(f"n{k}", F.sum(k).over(w)).withColumn(f"t{k}", F.count_if(F.col(k) > 0).over(w))
        # at most ALPHABET^(order + 1) rows
        out = out.withColumn("g", F.substring("gram", ORDER + 1 - order, order + 1)).join(sub.drop("c"), "g")
        for k in "ar":
            n, t, p = F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"p{k}")
            out = out.withColumn(f"p{k}", F.when(n > 0, (F.col(k) + t * p) / (n + t)).otherwise(p))
        out = out.select("gram", "pa", "pr")
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("delta"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, score``: one row for each row of ``pages``.

    score: the log-likelihood difference per character, null where a rule decides. A null URL or one without
    ``://`` has an empty host and path, so no rule fits it; an empty one has score 0. Where rules teach only one class,
    or none, the models say nothing and what no rule decides is allowed. Grams that neither class has count 0.
    Equal URLs get equal verdicts; keys may repeat or be null; an empty table gives an empty table.
    """
    base = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = rule_of("host", "path", rules)
    base = base.withColumns({"rule": rule, "said": verdict})
    # equal URLs are scored once; a boolean, unlike a string, stays in a hash aggregate
    distinct = base.groupBy("url").agg(F.max(F.col("said") == "allow").alias("accepted")).withColumn("text", folded("url"))
    digest = F.conv(F.substring(F.md5(F.coalesce("url", F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    distinct = distinct.withColumn("held", digest % FOLDS == 0)
    taught = grams(distinct.where("accepted is not null and not held"), "text", ["accepted"])
    # at most ALPHABET^(ORDER + 1) rows of a few bytes: bounded by the alphabet, not by the input
    known = F.broadcast(model(taught.select("gram", "accepted")))
    wanted = distinct.where("accepted is null or held")
    scored = grams(wanted, "text", ["url", "accepted"]).join(known, "gram", "left")
    summed = cut(scored.groupBy("url").agg(F.avg(F.coalesce("delta", F.lit(0.0))).alias("score"), F.max("accepted").alias("accepted")))
    held = summed.where("accepted is not null").groupBy("accepted").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s"))
    limits = {r.accepted: r for r in held.collect()}  # two rows at most
    limit = threshold(limits.get(True), limits.get(False))
    scores = summed.where("accepted is null").select(F.col("url").alias("u"), "score")
    out = base.join(scores, F.col("url").eqNullSafe(F.col("u")), "left").drop("u")
    method = F.when(F.coalesce("score", F.lit(0.0)) < limit, "block").otherwise("allow") if limit is not None else F.lit("allow")
    score = F.when(F.col("said").isNull(), F.coalesce("score", F.lit(0.0)))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), score.alias("score"))


def threshold(allow, block) -> float | None:
    """Where both classes' normal curves leave equal shares on the wrong side; None without both classes."""
    if allow is None or block is None:
        return None
    if allow.s + block.s == 0:
        return (allow.m + block.m) / 2
    return (allow.m * block.s + block.m * allow.s) / (allow.s + block.s)
