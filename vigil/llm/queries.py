"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import codes, embdup, filter_audit, html_mincut, kneser_ney, langid, mixing, packing, pii, simhash, topk, toxicity, url_markov
from vigil.llm.common import table


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdup.linked(table(spark, sf_dir, "embeddings"))


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_mincut.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: Rules on domains and paths of op2.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_markov.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [pii.number_of(k, F.col("base")).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return langid.identify(pages, table(spark, sf_dir, "documents").select("text", "lang")).select("page_id", "url", "host", "declared", "lang", "probability")


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(*filter_audit.documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_held_out(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_lm_scores": op13_lm_scores,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_interactions": op12_filter_interactions,
    "op5_language_id": op5_language_id,
    "op7_pii": op7_pii,
    "op4_mix_sources": op4_mix_sources,
    "op2_url_filter": op2_url_filter,
    "op1_html_main_text": op1_html_main_text,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op3_top_k_search": op3_top_k_search,
    "op10_toxicity": op10_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op6_simhash": op6_simhash,
}

#: Nearest entry of book ``c`` for every part ``p``: its distance and, of entries as near, the first.
_NEAREST = """SELECT id, label, n, part, x, min(d * 64 + entry) AS m
            FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) ** 2))::BIGINT AS d FROM p JOIN {c} c USING (part)) GROUP BY ALL"""
_REPLACED = """SELECT c.part, c.entry, coalesce(r.x, c.x) AS x FROM {c} c LEFT JOIN (
                SELECT part, entry, list(v ORDER BY pos) AS x FROM (
                    SELECT part, m % 64 AS entry, pos, ((sum(x[pos]) - ((sum(x[pos]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
                    FROM {a}, unnest(range(1, len(x) + 1)) u(pos) GROUP BY ALL) GROUP BY ALL) r USING (part, entry)"""

SQL: dict[str, str] = {
    "op11_vector_codes": f"""
        WITH k AS MATERIALIZED (
            SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
                   row_number() OVER (ORDER BY vec_id) - 1 AS n
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT id, label, n, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS x FROM k, unnest(range(16)) u(part)
        ), c0 AS MATERIALIZED (SELECT part, n AS entry, x FROM p WHERE n < 64
        ), a0 AS MATERIALIZED ({_NEAREST.format(c="c0")}), c1 AS MATERIALIZED ({_REPLACED.format(c="c0", a="a0")}
        ), a1 AS MATERIALIZED ({_NEAREST.format(c="c1")}), c2 AS MATERIALIZED ({_REPLACED.format(c="c1", a="a1")}
        ), a2 AS MATERIALIZED ({_NEAREST.format(c="c2")}
        ), r AS (SELECT id, label, n, string_agg(format('{{:02x}}', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY ALL
        ), h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h""",
    "op12_filter_interactions": """
        WITH RECURSIVE d AS (
            SELECT doc_id AS id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), b AS (
            SELECT id, part, [
                len(w) < 100,
                100 * len(list_distinct(w)) < 80 * len(w),
                100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
                regexp_matches(t, '[#$%&*|]'),
                coalesce(id > min(id) OVER (PARTITION BY t), false)] AS f FROM d
        ), l AS (SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
        ), x AS (SELECT part, f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM b LEFT JOIN l USING (id)
        ), o(filter_order) AS (
            SELECT '' UNION ALL SELECT filter_order || n FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(n) WHERE NOT contains(filter_order, n)
        ), s AS (
            SELECT filter_order, k AS step, ascii(filter_order[k]) - 64 AS i,
                   list_transform(string_split(filter_order[1:k - 1], ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ascii(c) - 64 END) AS before
            FROM o, unnest([1, 2, 3, 4, 5]) u(k) WHERE length(filter_order) = 5
        ), c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL
        ), r AS (
            SELECT part, filter_order, step, i, n, good, toxic, f[i] AS fails,
                   len(list_filter(before, lambda j: j > 0 AND f[j])) > 0 AS gone, len(list_filter(f, lambda v: v)) = 1 AND f[i] AS alone
            FROM c, s
        ), a AS (
            SELECT part, filter_order, step, i,
                   sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
            FROM r GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
        FROM a""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r(a, b) AS (
            SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        ), n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN m ON e.vec_id = m.a""",
    "op3_top_k_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
