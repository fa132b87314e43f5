"""Mixing sources to target weights, in DataFrame functions.

The words of a source are laid end to end in a pseudorandom order of its documents and packed into blocks of fixed
length. Every output shard draws how many of its slots go to each source (a multinomial draw, slot by slot). A source's
slots, numbered over all shards, run through pseudorandom permutations of its blocks, one for each epoch; slots are
joined with blocks by that index. Every source gets its target to the word: slots beyond it are left out, slots that
the draws lack fill further shards, and the last slot takes a part of its block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import WORD, position_in_group, saved

WEIGHTS = (3, 1, 2)
#: Words of all targets together, and of one target at most, by the words there are.
TOTAL, MOST = 1.5, 2
#: Words of a block, slots of a shard, cells for the draw, rows ranked in one task (about).
BLOCK, SHARD, CELLS, RANKED = 256, 1024, 4096, 2_000
SEED = 20_240_101
#: Units of one copy of a document.
FRACTION = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, s, source_size, target): one row for each source.

    Sources by code point, null last, take ``weights`` in turn. Targets share ``total`` times all words by weight; one
    over ``most`` times its size stops there and the rest is shared again. So a target is the lesser of its limit and
    level times weight, with one level for all. Windows here run over one row for each source.
    """
    every = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = every.withColumn("s", F.row_number().over(by_name) - 1)
    weighed = named.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("s") % len(weights) + 1).cast("int")))
    weighed = saved(weighed.withColumn("limit", F.col("source_size") * most), "sources")
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), "s")
    capped = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("w").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    words = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = weighed.withColumn("level", (F.lit(words * total) - capped) / open_).filter(F.col("level") <= F.col("limit") / F.col("w")).agg(F.min_by("level", F.col("limit") / F.col("w")))
    at = level.first()[0]
    share = F.col("limit") if at is None else F.least("limit", F.col("w") * at)
    return weighed.select("source", "s", "source_size", share.cast("double").alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def draws(sources: DataFrame, shards: int, slots: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, s, n): how many slots of each output shard go to each source, drawn by target."""
    total = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    upto = F.sum("target").over(Window.orderBy("s"))
    ranges = sources.withColumn("below", upto / total).withColumn("from", (upto - F.col("target")) / total).filter("target > 0")
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.lit(CELLS - 1).cast("long"), F.floor(F.col("below") * CELLS)))))
    slot = sources.sparkSession.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    drawn = slot.withColumn("u", _uniform(F.lit(seed), "shard", "slot")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = drawn.join(cells.select("s", "from", "below", "cell").hint("merge"), "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("below")))
    return hit.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[int] = WEIGHTS, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(slots, documents) of the mix.

    slots: shard, s, k (number among the source's slots), epoch, block, words (taken from the block's start).
    documents: id, source, mark (hash of the text), size, source_size, target, taken. Null texts have no words; null
    ids and repeated rows are documents like others; without words all is empty or zero. Equal input gives equal output.
    """
    sizes = saved(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("mark"), word_count(F.col(text_col)).alias("size")), "sizes")
    sources = saved(targets(sizes, weights), "targets")
    n = F.ceil(F.col("source_size") / block)
    goal = F.round("target").cast("long")
    plan = sources.withColumn("n", n).withColumn("goal", F.least(goal, F.col("source_size") * MOST))
    plan = plan.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.greatest("source_size", F.lit(1)))).otherwise(0)).withColumn("rest", F.col("goal") - F.col("full") * F.col("source_size"))
    plan = saved(plan.withColumn("short", F.col("source_size") - (F.col("n") - 1) * block), "plan")
    words, blocks = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs = sizes.count()

    known = sizes.join(plan.select("source", "s", "source_size", "target"), sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    placed = saved(position_in_group(known, ["s"], [F.lit(seed), F.col("id"), F.col("mark"), F.col("size")], max(1, n_docs // RANKED), "at", F.col("size")), "placed")

    # blocks in the order of each epoch
    each = plan.filter("n > 0 and goal > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("full"), F.lit(MOST - 1)).cast("int"))))
    each = each.filter("epoch < full or rest > 0")
    numbered = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANKED))))
    numbered = numbered.withColumn("block", F.explode(F.sequence(F.col("part") * RANKED, F.least(F.col("n"), (F.col("part") + 1) * RANKED) - 1)))
    order = saved(position_in_group(numbered.select("s", "epoch", "block", "n", "full", "rest", "short"), ["s", "epoch"], [F.lit(seed), F.col("s"), F.col("epoch"), F.col("block")], max(1, blocks // RANKED), "pos"), "order")
    last = order.filter("block = n - 1").select("s", "epoch", F.col("pos").alias("short_pos"))  # two rows for a source at most
    paced = order.join(last, ["s", "epoch"])
    before = F.col("pos") * block - F.when(F.col("pos") > F.col("short_pos"), block - F.col("short")).otherwise(0)
    length = F.when(F.col("block") == F.col("n") - 1, F.col("short")).otherwise(block)
    paced = paced.withColumn("words", F.when(F.col("epoch") < F.col("full"), length).otherwise(F.least(length, F.col("rest") - before))).filter("words > 0")
    wanted = saved(paced.select("s", (F.col("epoch") * F.col("n") + F.col("pos")).alias("k"), "epoch", "block", "words"), "wanted")

    # shards draw sources; a source's slots are numbered through its shards
    shards = max(1, -(-int(words * TOTAL) // (block * SHARD))) if words else 0
    counts = saved(draws(sources, shards, SHARD, seed) if shards else sources.select(F.lit(0).cast("long").alias("shard"), "s", F.lit(0).cast("long").alias("n")).limit(0), "draws")
    ranked = position_in_group(counts, ["s"], [F.lit(seed), F.col("shard")], max(1, shards // RANKED), "first", F.col("n"))
    drawn = ranked.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).select("shard", "s", "k")
    have = counts.groupBy("s").agg(F.sum("n").alias("have"))
    # drawn and wanted grow with the words, so neither is broadcast
    slots = wanted.join(drawn.hint("merge"), ["s", "k"], "left").join(have, "s", "left")
    more = F.lit(shards) + F.floor((F.col("k") - F.coalesce("have", F.lit(0))) / SHARD)
    slots = saved(slots.select(F.coalesce("shard", more).alias("shard"), "s", "k", "epoch", "block", "words"), "slots")

    # slots meet the documents of their block
    begin, end = F.col("at"), F.col("at") + F.col("size")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(begin / block), F.floor((end - 1) / block))))
    pieces = pieces.withColumn("b", F.greatest(begin - F.col("block") * block, F.lit(0))).withColumn("e", F.least(end - F.col("block") * block, F.lit(block)))
    met = pieces.select("s", "at", "block", "b", "e").join(slots.select("s", "block", "words").hint("merge"), ["s", "block"])
    taken = met.groupBy("s", "at").agg(F.sum(F.greatest(F.least("e", "words") - F.col("b"), F.lit(0))).alias("taken"))
    found = placed.withColumn("key", F.when(F.col("size") > 0, F.col("at"))).join(taken.withColumnRenamed("at", "key").hint("merge"), ["s", "key"], "left")
    return slots, found.select("id", "source", "mark", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them: taken words by size, rounded without bias, none to twice.

    The fractions are laid end to end within a source and power of two of the size, from a pseudorandom start; a
    document that a whole number falls into is rounded up. So the words of a source stay near its target, whatever the
    fraction. Documents without words are kept once. Rows with equal id, source and text share what they got. Columns
    are those of ``docs``.
    """
    _, found = mix(docs)
    keys = ["_id", "_source", "_mark"]
    units = F.when(F.max("size") == 0, FRACTION).otherwise(F.round(FRACTION * F.sum("taken") / F.sum(F.greatest("size", F.lit(1))))).cast("long")
    by_key = found.groupBy(F.struct("id").alias("_id"), F.struct("source").alias("_source"), F.struct("mark").alias("_mark"))
    # repeated rows get the same number of copies, so they are one document of all their words
    shares = saved(by_key.agg(units.alias("_units"), F.floor(F.log2(F.greatest(F.sum("size"), F.lit(1)))).alias("_power")), "shares")
    part = F.pmod("_units", F.lit(FRACTION))
    ranked = position_in_group(shares, ["_source", "_power"], [F.lit(SEED), *(F.col(k) for k in keys)], max(1, shares.count() // RANKED), "_from", part)
    start = F.col("_from") + F.pmod(F.xxhash64(F.lit(SEED), "_source", "_power"), F.lit(FRACTION))
    times = F.floor(F.col("_units") / FRACTION) + F.floor((start + part) / FRACTION) - F.floor(start / FRACTION)
    copies = ranked.select(*keys, times.cast("int").alias("_times"))
    own = docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns})
    keyed = own.withColumns({"_id": F.struct(F.col("in_doc_id").alias("id")), "_source": F.struct(F.col("in_source").alias("source")), "_mark": F.struct(F.xxhash64("in_text").alias("mark"))})
    kept = keyed.join(copies.filter("_times > 0"), keys).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return kept.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))
