"""URL filter: domain rules, then a ratio of character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted over raw characters by grouped
aggregation: every character with up to ``ORDER`` before it, as far as it occurs. Witten-Bell smoothing mixes each
context with the one a character shorter. A URL's score is the difference of its log-likelihoods by character; a
threshold between the classes, taken from labelled URLs that the models did not count, makes the verdict. All work is
DataFrame functions, on different URLs and different grams; counts grow with the URLs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import saved, skew_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of context at most, and what stands before a URL.
ORDER, PAD = 5, "\u0002"
#: One labelled URL of so many is kept from the models and sets the threshold.
HELD = 4
#: Different URLs of one task, about; grams in over one of so many places are broadcast, so this many at most.
URLS, FREQUENT = 4000, 65_536
#: Parts of one that log-ratios are rounded to, so that sums do not depend on their order.
UNIT = 1_000_000
KINDS = ("accepted", "rejected")
#: (host and path, verdict) of domain rules.
Rules = Sequence[tuple[str, str]]


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end; empty without a host's ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Rules) -> Column:
    """The longest rule whose host is the URL's or above it and whose path the URL's begins with, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Rules) -> Column:
    return reduce(lambda out, r: F.when(rule == r[0], F.lit(r[1])).otherwise(out), rules, F.lit(None).cast("string"))


def is_held(url: Column) -> Column:
    """Whether a labelled URL calibrates instead of being counted."""
    return F.pmod(F.xxhash64(url), F.lit(HELD)) == 0


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each character of ``url``: ``gram``, the characters of its context and itself."""
    rows = urls.filter(F.length("url") > 0).withColumn("chars", F.regexp_extract_all(F.concat(F.lit(PAD * order), "url"), F.lit("(?s)(.)"), F.lit(1)))
    at = F.sequence(F.lit(1), F.size("chars") - order)
    return rows.withColumn("gram", F.explode(F.transform(at, lambda i: F.array_join(F.slice("chars", i, order + 1), "")))).drop("chars")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, ratio): for every gram of ``counts`` the log of its probability if accepted over that if rejected, in units.

    ``counts`` has gram (order + 1 characters), n (places), accepted and rejected (places in labelled URLs). Order k
    mixes a context's own counts with order k - 1 by the number of different characters seen after it; a context not
    seen is passed over; order 0 starts from equal probabilities. No join has more rows of a key than there are
    characters: a gram meets its context and the gram a character shorter.
    """
    level = None
    for k in range(order + 1):
        seen = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("gram")).agg(*(F.sum(c).alias(c) for c in ("n", *KINDS)))
        after = seen.groupBy(F.expr(f"left(gram, {k})").alias("context")).agg(
            *(F.sum(c).alias(f"n_{c}") for c in KINDS), *(F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in KINDS)
        )
        joined = seen.withColumn("context", F.expr(f"left(gram, {k})")).join(after, "context")
        if level is None:
            characters = seen.count() + 1
            joined = joined.withColumns({f"q_{c}": F.lit(1 / characters) for c in KINDS})
        else:
            below = level.select(F.col("gram").alias("low"), *(F.col(f"p_{c}").alias(f"q_{c}") for c in KINDS))
            joined = joined.withColumn("low", F.expr(f"right(gram, {k})")).join(below, "low")
        mixed = {c: (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")) for c in KINDS}
        p = [F.when(F.col(f"n_{c}") > 0, mixed[c]).otherwise(F.col(f"q_{c}")).alias(f"p_{c}") for c in KINDS]
        level = joined.select("gram", "n", *p)
    return level.select("gram", "n", F.round(F.log(F.col("p_accepted") / F.col("p_rejected")) * UNIT).cast("long").alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score): the mean ratio over the characters of every URL that is not empty.

    Frequent grams meet the places without a shuffle, the others by a join on the gram.
    """
    places = grams(urls.select("url"), order)
    total = ratios.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(ratios.filter(F.col("n") > total // FREQUENT).select("gram", "ratio"))
    cold = ratios.filter(F.col("n") <= total // FREQUENT).select("gram", "ratio")
    parts = [places.join(hot, "gram"), places.join(hot.select("gram"), "gram", "left_anti").join(cold.hint("merge"), "gram")]
    sums = [p.groupBy("url").agg(F.sum("ratio").alias("ratio"), F.count(F.lit(1)).alias("n")) for p in parts]
    return sums[0].union(sums[1]).groupBy("url").agg((F.sum("ratio") / UNIT / F.sum("n")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """A score between the two classes' means, in proportion to their deviations.

    From labelled URLs that the models did not count, or all labelled ones if those lack a class; without URLs of both
    classes every score passes.
    """
    spread = scored.filter("label is not null").groupBy("held", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(F.col("score") ** 2).alias("q")).collect()
    for rows in ([r for r in spread if r["held"]], spread):
        kinds = {}
        for label in ("allow", "block"):
            n, s, q = (sum(r[c] for r in rows if r["label"] == label) for c in "nsq")
            if n:
                kinds[label] = (s / n, math.sqrt(max(0.0, q / n - (s / n) ** 2)))
        if len(kinds) == 2:
            (a, da), (b, db) = kinds["allow"], kinds["block"]
            return (a * db + b * da) / (da + db) if da + db > 0 else (a + b) / 2
    return float("-inf")


def judge(pages: DataFrame, rules: Rules, url_col: str = "url", order: int = ORDER) -> DataFrame:
    """Add host, path, rule, score and verdict ("allow" or "block") to every row; columns of these names are replaced.

    URLs that a rule fits are the labelled ones: allowed for the accepted model, blocked for the rejected one; each
    different URL counts once. The score is the mean over characters; null and empty URLs score 0. Repeated rows stay.
    """
    total = pages.count()
    known = rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)
    every = pages.select(F.coalesce(F.col(url_col), F.lit("")).alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    every = every.withColumn("label", verdict_of(known, rules)).withColumn("held", is_held(F.col("url")))
    urls = saved(every.repartition(max(1, -(-total // URLS)), "url"), "urls")
    counted = {"accepted": F.count_if((F.col("label") == "allow") & ~F.col("held")), "rejected": F.count_if((F.col("label") == "block") & ~F.col("held"))}
    counts = saved(grams(urls, order).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counted.items())), "grams")
    ratios = saved(model(counts, order), "ratios")
    scored = saved(urls.join(scores(urls, ratios, order).hint("merge"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "scores")
    least = threshold(scored)
    own = F.struct(*(F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")))
    rows = pages.select(own.alias("row"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    rows = skew_join(rows, scored.select("url", "n", "score"), "url", "n", total)
    out = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("score") >= least, "allow").otherwise("block"))
    return out.select("row.*", "host", "path", "rule", "score", verdict.alias("verdict"))
