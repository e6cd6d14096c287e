"""The registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import alignment, bpe_transducer, collocations, decontaminate, packing, pii, quality_knn, quality_rules, secrets, simhash, substrings, token_counts, url_rules

Runner = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality_knn.score(docs, quality_knn.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_knn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_table(spark, sf_dir, "documents"))[0]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_transducer.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), read_back=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Runner] = {
    f.__name__: f for f in (
        op1_token_counts,
        op2_decontamination,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_quality_rules,
        op6_personal_data,
        op7_quality_classifier,
        op8_secret_scan,
        op9_url_rules,
        op10_substring_dedup,
        op11_cross_tokenizer_alignment,
        op12_phrase_collocations,
        op13_byte_level_bpe,
    )
}

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
#: The secret rules for SQL: kind, pattern, and what a match must satisfy.
_SECRETS = (
    ("assign", _ASSIGN, f"length(regexp_extract(m[i], '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 1)) >= 8"),
    ("access", r"AKIA[A-Z0-9]{12,}", "true"),
    ("hex", r"[0-9a-f]{32,}", "true"),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "true"),
    ("provider_token", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", "true"),
)


def _secret_spans() -> str:
    """Places by the lengths of what stands between matches and of the matches themselves."""
    parts = []
    for rank, (kind, pattern, passes) in enumerate(_SECRETS):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, length(m[i]) AS size,
            list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
          FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_split_to_array(t, '{quoted}') AS g FROM d)) WHERE {passes}""")
    return " UNION ALL ".join(parts)


#: SQL that gives the same rows, where SQL can express them.
ORACLES: dict[str, str] = {
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
        ), first AS (
            SELECT g, min(doc_id) AS m FROM win GROUP BY g
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS pos
            FROM win JOIN first USING (g), (SELECT unnest(range(0, 13)) AS k) WHERE m < doc_id
        ), word AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d
        ), kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
            FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op12_phrase_collocations": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece
        ), f AS (
            SELECT lang, g, len(g) AS k, count(*) AS f
            FROM (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM w)
            GROUP BY lang, g HAVING count(*) >= 100
        ), total AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
        ), inside AS (
            SELECT lang, g, max(f) AS widest
            FROM (SELECT lang, g[1:k - 1] AS g, f FROM f WHERE k > 2 UNION ALL SELECT lang, g[2:k] AS g, f FROM f WHERE k > 2)
            GROUP BY lang, g
        ), cut AS (
            SELECT f.lang, f.g, f.f AS a, unnest(range(1, f.k)) AS k
            FROM f LEFT JOIN inside USING (lang, g) WHERE f.k > 1 AND (widest IS NULL OR 100 * widest < 100 * f.f)
        ), scored AS (
            SELECT cut.lang, cut.g, cut.k, a, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.g = cut.g[1:cut.k] JOIN f y ON y.lang = cut.lang AND y.g = cut.g[cut.k + 1:] JOIN total ON total.lang = cut.lang
        ), best AS (
            SELECT *, array_to_string(g, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM best QUALIFY rank <= 2000
    """,
    "op8_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({_secret_spans()}),
        a AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
                   string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, rank) AS spans
            FROM s GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN a USING (doc_id)
    """,
}
