"""How filters interact: what each keeps, removes, repeats and costs, in every order of application.

Each filter is a relation of its own: one stored table of the ids that fail it. A set of filters, the prefix of some
order, leaves the ids that a chain of left-anti joins with its relations leaves; what the next filter removes there is
their left-semi join with its relation. Only ids move, never texts, and documents that fail no filter are counted
without entering a join with prefixes. Everything is summed by part before it is laid out by order and step.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import WORD, saved, skew_join

#: Filters that ``audit`` takes at most: there are 2^n prefixes and n! orders of them.
MOST = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the four filters that judge a text by itself; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(ids, fails): one row a document with key, part, good, toxic; and for each filter the keys of those failing it.

    Keys are the library's own, so repeated rows and rows without an id count one by one. ``part`` is the language,
    empty if null. A document counts as good or toxic if one of its labels says so; labels without an id fit nothing.
    E fails a text that some smaller id has as well; rows without an id, and rows of one id, do not fail each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in text_filters(F.col("text")).items()))
    judged = saved(judged, "judged")
    least = judged.filter("id is not null").groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    again = saved(least.filter("least < most").drop("most"), "copies")
    repeated = skew_join(judged.filter("id is not null").select("key", "id", "digest"), again, "digest", "n", judged.count()).filter("id > least").select("key")
    labelled = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for n, c in (("good", "quality"), ("toxic", "toxic"))))
    ids = judged.select("key", "id", "part").join(labelled, "id", "left").select("key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return ids, {**{f: judged.filter(f).select("key") for f in "ABCD"}, "E": repeated}


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("part", *by).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def prefixes(ids: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """(part, before, filter, documents, fails, survivors, removed, good_lost, toxic_lost), zeros included.

    ``before`` is the bit set of the filters that ran already, ``filter`` the position of the one that runs next. Of a
    part, ``documents`` is all rows, ``fails`` those failing the filter, ``survivors`` those that fail nothing before.
    ``ids`` has key, part, good and toxic; ``fails`` has a table of keys for each filter.
    """
    names, ids = sorted(fails), saved(ids, "ids")
    relation = {f: saved(fails[f].select("key").distinct(), f"fails-{f}") for f in names}
    bit = {f: 1 << i for i, f in enumerate(names)}
    whole = (1 << len(names)) - 1
    failing = ids.join(_union([relation[f] for f in names]), "key", "left_semi")
    # every failing id with every prefix; then each filter's relation takes its ids out of the prefixes that hold it
    left = failing.repartition("key").withColumn("before", F.explode(F.sequence(F.lit(0), F.lit(whole))))
    for f in names:
        gone = relation[f].select(F.col("key").alias("_gone"))
        left = left.join(gone.hint("merge"), (F.col("key") == F.col("_gone")) & (F.col("before").bitwiseAND(bit[f]) > 0), "left_anti")
    left = saved(left, "survivors")
    removed = _union([
        _sums(left.filter(F.col("before").bitwiseAND(bit[f]) == 0).join(relation[f].hint("merge"), "key", "left_semi"), "before").withColumn("filter", F.lit(i))
        for i, f in enumerate(names)
    ])
    parts = _sums(ids).select("part", F.col("n").alias("documents"))
    clean = parts.join(_sums(failing).select("part", F.col("n").alias("failing")), "part", "left").select("part", "documents", (F.col("documents") - F.coalesce("failing", F.lit(0))).alias("clean"))
    steps = [(s, i) for s in range(whole + 1) for i in range(len(names)) if not s >> i & 1]
    grid = clean.withColumn("at", F.explode(F.array(*(F.struct(F.lit(s).alias("before"), F.lit(i).alias("filter")) for s, i in steps)))).select("part", "documents", "clean", "at.*")
    stayed = left.groupBy("part", "before").agg(F.count(F.lit(1)).alias("stayed"))
    out = grid.join(stayed, ["part", "before"], "left").join(removed, ["part", "before", "filter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = out.select("part", "before", "filter", "documents", (F.col("clean") + zero("stayed")).alias("survivors"), zero("n").alias("removed"), zero("good").alias("good_lost"), zero("toxic").alias("toxic_lost"))
    alone = out.filter("before = 0").select("part", "filter", F.col("removed").alias("fails"))
    return saved(out.join(alone, ["part", "filter"]), "prefixes")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def audit(ids: DataFrame, fails: Mapping[str, DataFrame]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order.

    Filter names are single characters. ``redundant`` fails the step's filter but was removed earlier, ``unique_fails``
    fails it only, ``shapley`` is what the filter removes, summed over all orders. An empty table has no parts, so no
    rows; a filter that fails nothing has rows of zeros.
    """
    names = sorted(fails)
    if not 1 <= len(names) <= MOST or any(len(f) != 1 for f in names):
        raise ValueError(f"takes 1 to {MOST} filters with names of one character")
    n = len(names)
    rows = prefixes(ids, fails)
    size = F.bit_count("before")
    weight = F.element_at(F.array(*(F.lit(math.factorial(s) * math.factorial(n - 1 - s)).cast("long") for s in range(n))), size + 1)
    every = rows.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"))
    steps = [(sum(1 << j for j in order[:k]), order[k], "".join(names[j] for j in order), k + 1) for order in itertools.permutations(range(n)) for k in range(n)]
    spark = ids.sparkSession
    laid = F.broadcast(spark.createDataFrame(steps, "before int, filter int, filter_order string, step int"))  # n * n! rows, whatever the input
    out = rows.join(every, ["part", "filter"]).join(laid, ["before", "filter"])
    return out.select("part", "filter_order", "step", (F.col("survivors") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
