"""Judge URLs: fixed rules first, then the ratio of two character language models.

Method. The URLs that a rule decides train two smoothed variable-order Markov models over folded
characters, one for accepted and one for rejected URLs: up to three characters of context, each
order interpolated with the next shorter one by Witten-Bell weights, so a context never seen falls
back by itself. Every other URL is judged by its log-likelihood difference per character against a
threshold calibrated on the decided URLs.

The alphabet is folded to 31 symbols, so a model never has more than 31^4 rows whatever the input;
that is the proven bound of the only broadcast.

Defined results. A null url, or one without ``://``, has an empty host and path and a difference of
0. Repeated pages keep their rows. With no decided URL of one kind the threshold is 0. No rows in,
no rows out. Columns other than page_id and url are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableinsight.llm.common import ascii_lower, stored

# (host, path, verdict): the fixed rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
ORDER = 4  # characters of a gram: three of context and the one predicted
SYMBOLS = 31
_START, _END = "^" * (ORDER - 1), "$"
_MICRO = 1_000_000  # scores are summed as integers: the same in any order


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r_host, r_path, r_verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit(r_path))
        rule = F.when(fits, r_host + r_path).otherwise(rule)
        verdict = F.when(fits, r_verdict).otherwise(verdict)
    return rule, verdict


def folded(host: Column, path: Column) -> Column:
    """Letters in lower case, digits as 0, the marks of a URL, and ~ for the rest."""
    plain = F.translate(ascii_lower(F.concat(host, path)), "123456789", "000000000")
    return F.concat(F.lit(_START), F.regexp_replace(plain, r"[^a-z0/.\-]", "~"), F.lit(_END))


def _grams(strings: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(1), F.length("s") - (ORDER - 1))
    return strings.withColumn("at", F.explode(places)).withColumn("gram", F.expr(f"substring(s, at, {ORDER})"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, micro): a million times ln p_accepted - ln p_rejected of the gram's last character.

    ``counts`` has gram, yes, no for every gram of the corpus; at most 31^4 rows.
    """
    model = None
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.expr(f"right(gram, {k})").alias("g")).agg(
            F.sum("yes").alias("yes"), F.sum("no").alias("no")
        )
        contexts = own.groupBy(F.expr(f"left(g, {k - 1})").alias("context")).agg(
            F.sum("yes").alias("n_yes"), F.sum("no").alias("n_no"),
            F.count_if(F.col("yes") > 0).alias("t_yes"), F.count_if(F.col("no") > 0).alias("t_no"),
        )
        rows = own.withColumn("context", F.expr(f"left(g, {k - 1})")).join(contexts, "context")
        if model is None:
            rows = rows.withColumn("p_yes", F.lit(1 / SYMBOLS)).withColumn("p_no", F.lit(1 / SYMBOLS))
        else:
            shorter = model.select(F.col("g").alias("shorter"), "p_yes", "p_no")
            rows = rows.withColumn("shorter", F.expr(f"right(g, {k - 1})")).join(shorter, "shorter")

        def smoothed(kind: str) -> Column:
            c, n, t, p = (F.col(x + kind) for x in ("", "n_", "t_", "p_"))
            return F.when(n > 0, (c + t * p) / (n + t)).otherwise(p)

        model = rows.select("g", smoothed("yes").alias("p_yes"), smoothed("no").alias("p_no"))
    micro = F.round((F.ln("p_yes") - F.ln("p_no")) * _MICRO).cast("long")
    return model.select(F.col("g").alias("gram"), micro.alias("micro"))


def threshold(scored: DataFrame) -> float:
    """Where two normal curves of equal variance, fitted to the decided URLs, are equally likely."""
    moments = scored.filter(F.col("known").isNotNull()).groupBy("known").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("micro") / F.col("chars")) / F.sum("n") / _MICRO).alias("mean"),
        (F.sum(F.col("n") * F.pow(F.col("micro") / F.col("chars") / _MICRO, 2)) / F.sum("n")).alias("square"),
    )
    by = {r["known"]: r for r in moments.collect()}  # two rows
    if len(by) < 2 or by["allow"]["mean"] <= by["block"]["mean"]:
        return 0.0
    yes, no = by["allow"], by["block"]
    spread = sum(r["n"] * max(r["square"] - r["mean"] ** 2, 0.0) for r in (yes, no)) / (yes["n"] + no["n"])
    gap = yes["mean"] - no["mean"]
    return round((yes["mean"] + no["mean"]) / 2 + spread / gap * math.log(no["n"] / yes["n"]), 6)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and score (mean difference, null under a rule)."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, known = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("known", known)
    parts = parts.withColumn("s", folded(F.col("host"), F.col("path")))
    distinct = stored(
        parts.groupBy("s", "known").agg(F.count(F.lit(1)).alias("n")), "url-strings"
    )
    counts = stored(
        _grams(distinct).groupBy("gram").agg(
            F.sum(F.when(F.col("known") == "allow", F.col("n")).otherwise(0)).alias("yes"),
            F.sum(F.when(F.col("known") == "block", F.col("n")).otherwise(0)).alias("no"),
        ),
        "url-grams",
    )
    ratios = stored(log_ratios(counts), "url-model")
    nothing = F.col("s") == _START + _END
    scored = stored(
        _grams(distinct).join(F.broadcast(ratios), "gram")
        .groupBy("s", "known", "n")
        .agg(F.sum("micro").alias("micro"))
        .withColumn("chars", F.length("s") - (ORDER - 1))
        .withColumn("micro", F.when(nothing, 0).otherwise(F.col("micro"))),
        "url-scores",
    )
    at_least = threshold(scored)
    undecided = scored.filter(F.col("known").isNull()).select(
        "s", (F.col("micro") / F.col("chars") / _MICRO).alias("score")
    )
    verdict = F.coalesce("known", F.when(F.col("score") >= at_least, "allow").otherwise("block"))
    open_key = F.when(F.col("known").isNull(), F.col("s"))
    return parts.withColumn("open", open_key).drop("s").join(
        undecided, F.col("open") == F.col("s"), "left"
    ).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
