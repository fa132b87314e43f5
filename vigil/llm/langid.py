"""Language of web pages by Bayesian evidence fusion.

Four pieces of evidence meet in one posterior: the likelihood of the text under character models, the language that the
markup declares, the address (its suffix and a language-like first part of the path), and a prior of the host. What a
declared language or an address says about the true one, and the host priors, are grouped aggregations of the text's
posteriors over all pages; host priors are smoothed by those of the domain, and these by the share over all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import saved, skew_join

#: Hash buckets of character trigrams; documents of a language the text model is fitted to, about.
BUCKETS, SAMPLE = 8192, 3000
#: Trigrams that a text counts as at most: neighbouring ones are not independent.
EVIDENCE = 40.0
#: Weight of the level above, in pages, in smoothed shares.
SMOOTH = 4.0
MARKUP = r"(?is)<(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*>|&#?\w+;"


#: An angle bracket that opens no tag, where none is closed any more: elements whose text is dropped, and comments, are kept.
OPENS_NOTHING = r"(?i)<(?!(?:script|style|noscript|template)\b|!--)"


def without_markup(page: Column) -> Column:
    """The page with a space for every tag, reference, comment and unseen element.

    After the last closing bracket no tag ends, and looking for its end from every opening one would take time in the
    square of the page; there they become spaces first, which for the text model they are in any case.
    """
    tail = F.substring_index(page, ">", -1)
    head = F.left(page, F.char_length(page) - F.char_length(tail))
    return F.regexp_replace(F.concat(head, F.regexp_replace(tail, OPENS_NOTHING, " ")), MARKUP, " ")


def trigrams(text: str) -> np.ndarray:
    """Hash buckets of the character trigrams of the lower-cased text, digits and signs being spaces."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    code = np.where((code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 170)), 32, code)
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])] if len(code) else code
    if len(code) < 3:
        return np.zeros(0, dtype=np.int64)
    mixed = (code[:-2] * np.uint64(2654435761) ^ code[1:-1] * np.uint64(40503) ^ code[2:]) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS


def text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and the log-probabilities of trigram buckets (BUCKETS x languages) from labelled documents.

    Every language that labels name is modelled on about ``sample`` documents, those with the least hash of their text.
    Counts are summed per task before they move; the model has ``BUCKETS`` numbers for each language.
    """
    known = labelled.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((BUCKETS, 0))
    part = F.create_map(*(F.lit(y) for x in languages for y in (x, min(1.0, sample / sizes[x]))))[F.col("lang")]
    chosen = known.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {x: np.zeros(BUCKETS, dtype=np.int64) for x in languages}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = np.full((BUCKETS, len(languages)), 0.5)
    for r in chosen.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], languages.index(r["lang"])] += r["n"]
    return languages, np.log(counts / counts.sum(axis=0))


def _likelihoods(model: np.ndarray, evidence: float = EVIDENCE):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            g = trigrams(t or "")
            total = model[g].sum(axis=0) * min(1.0, evidence / len(g)) if len(g) else np.zeros(model.shape[1])
            out.append(total - (total.max() if len(total) else 0.0))
        return pd.Series(out)

    return score


def _shares(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Sums of the text posteriors, and the number of rows, by ``key``."""
    sums = [F.sum(F.col("t")[i]) for i in range(n)]
    return rows.groupBy(key).agg(F.array(*sums).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))


def identify(pages: DataFrame, labelled: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add host, declared, lang and probability to every row; columns of these names are replaced, the markup is dropped.

    Null or textless pages have no text evidence and follow the other three; null URLs share one host. Without any
    labelled document lang is null and probability 0. Repeated rows stay and count as often in the aggregations.
    """
    languages, model = text_model(labelled)
    own = [c for c in pages.columns if c not in ("host", "declared", "lang", "probability")]
    url, page = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/([a-zA-Z]{2})(?:[/?#].*)?$", 1)
    declared = F.lower(F.regexp_extract(page, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    n = len(languages)
    if not n:
        none = pages.select(*own, host.alias("host"), declared.alias("declared"))
        return none.withColumn("lang", F.lit(None).cast("string")).withColumn("probability", F.lit(0.0))
    address = F.concat(F.regexp_extract(host, r"([^.]*)$", 1), F.lit("/"), F.lower(path))
    domain = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    # other columns go along in one struct, so none of theirs can clash with those below
    kept = F.struct(*(F.col(c) for c in own if c != html_col))
    like = _likelihoods(model)(without_markup(page))
    scored = pages.select(kept.alias("row"), host.alias("host"), declared.alias("declared"), domain.alias("domain"), address.alias("address"), like.alias("l"))
    likely = F.transform("l", F.exp)
    soft = F.transform(likely, lambda x: x / F.aggregate(likely, F.lit(0.0), lambda a, b: a + b))
    scored = saved(scored.withColumn("t", soft), "evidence")

    total, sums = scored.agg(F.count(F.lit(1)), F.array(*(F.coalesce(F.sum(F.col("t")[i]), F.lit(0.0)) for i in range(n)))).first()
    share = F.array(*(F.lit((x + 1) / (total + n)) for x in sums))
    out = scored
    for key, name in (("declared", "d"), ("address", "a"), ("domain", "m"), ("host", "h")):
        out = skew_join(out, saved(_shares(scored, key, n, name), name), key, f"{name}_n", total)

    def smoothed(name: str, i: Column, above: Column) -> Column:
        """The share of language i among the other rows of the key, smoothed by that of the level above."""
        return (F.greatest(F.col(name)[i] - F.col("t")[i], F.lit(0.0)) + SMOOTH * above) / (F.col(f"{name}_n") - 1 + SMOOTH)

    def weight(i: Column) -> Column:
        """Text likelihood x what declared language and address say of language i over its own share x host prior."""
        speaks = [smoothed(name, i, share[i]) / share[i] for name in ("d", "a")]
        return F.exp(F.col("l")[i]) * speaks[0] * speaks[1] * smoothed("h", i, smoothed("m", i, share[i]))

    out = out.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), weight))
    best = F.array_max(F.transform("w", lambda w, i: F.struct(w.alias("w"), (-i).alias("i"))))
    out = out.withColumn("best", best).withColumn("sum", F.aggregate("w", F.lit(0.0), lambda a, b: a + b))
    named = F.array(*(F.lit(x) for x in languages))[-F.col("best.i")]
    return out.select("row.*", "host", "declared", named.alias("lang"), (F.col("best.w") / F.col("sum")).alias("probability"))
