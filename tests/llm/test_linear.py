"""Work that must not grow with the square of one text, one page or one cell."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from vigil.llm import embdup, langid, pii


def took(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def test_a_text_of_many_matches(spark):
    """200 000 numbers in 1 MB; a fold that copies its list at each step took 44 s for 16 000."""
    df = spark.createDataFrame([(1, "ab12 " * 200_000)], "doc_id long, text string")
    pii.detect(df.limit(0)).collect()
    assert took(lambda: pii.detect(df).select(F.size("spans")).collect()) < 40


def test_spans_beyond_one_block_keep_their_places(spark):
    text = "é " + " ".join(f"a{i}@b{i}.co x" for i in range(700)) + " 1.2.3.4"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "none"), (4, "q@r.st"), (5, "\u0001a@b.c\u0002d@e.f")], "doc_id long, text string")
    found = df.select("doc_id", "text", pii.found_spans(F.col("text"), pii.BASE["email"]).alias("s")).collect()
    for r in found:
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"])]
        assert [(s["start"], s["end"], s["text"]) for s in r["s"]] == want
    assert found[0]["s"][300]["before"].endswith(" x ") and len(found[0]["s"]) == 700


def test_pages_of_open_tags(spark):
    pages = ["<a " * 100_000, "<p>a</p> b < c", "a<b", "<!-- x", "<b>x</b><style>q", "x > y < z &amp; <b", "", ">", "<script>a</script>b<i>c", "<a <b>c", "x<script>y"]
    df = spark.createDataFrame([(p,) for p in pages], "t string")
    found = []
    assert took(lambda: found.extend(df.select(langid.without_markup(F.col("t")).alias("x")).collect())) < 20
    for p, r in list(zip(pages, found, strict=True))[1:]:
        assert r["x"] == re.sub(langid.MARKUP.replace(r"\z", r"\Z"), " ", p).replace("<", " ")


def test_large_cells_of_visitors_alone_are_dropped(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("label"), F.lit(0).alias("b"), F.lit(7).cast("long").alias("cell"), F.col("id").alias("node"), F.lit(False).alias("home"))
    some = spark.range(3).select(F.lit(1).alias("label"), F.lit(0).alias("b"), F.lit(8).cast("long").alias("cell"), F.col("id").alias("node"), (F.col("id") == 0).alias("home"))
    full = spark.createDataFrame([(1, 0, 7, 0)], "label int, b int, cell long, parts int")
    assert embdup.dealt_to_buckets(rows.union(some), full).groupBy("cell").count().collect() == [(8, 3)]
