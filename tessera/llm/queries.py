"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.chat_format import END, collect_turns, format_pairs, parroted
from tessera.llm.embedding_dedup import embedding_near_dedup
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.hmm import hmm_scores
from tessera.llm.license_scan import TEMPLATES, license_scan, template_weights, word_weights
from tessera.llm.packing import best_fit_packing
from tessera.llm.quality import quality_scores
from tessera.llm.simhash import simhash_near_dedup
from tessera.llm.substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(_table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with a parroted last answer."""
    turns = collect_turns(_table(spark, sf_dir, "conversations"), "conv_id", "chosen")
    found = format_pairs(turns.withColumn("rejected", parroted(F.col("chosen"))), "conv_id")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return found.withColumns({"chosen_mask": written(F.col("chosen_mask")), "rejected_mask": written(F.col("rejected_mask"))})


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near_dedup(_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at four depths: source, source/lang and two below."""
    docs = _table(spark, sf_dir, "documents")
    deep = [F.col("source"), F.concat(F.lit("/"), "lang"), F.concat(F.lit("/d"), F.pmod(F.expr("doc_id div 4"), F.lit(5)).cast("string")), F.concat(F.lit("/e"), F.pmod(F.expr("doc_id div 20"), F.lit(3)).cast("string"))]
    depth = F.pmod("doc_id", F.lit(4))
    folder = F.concat(*(F.when(depth >= n, part).otherwise("") if n else part for n, part in enumerate(deep)))
    files = docs.withColumn("path", F.concat(folder, F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(files).withColumn("score", F.round("score", 6))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3, max_train_rows=20_000)


def vocabulary_path() -> str:
    """The public vocabulary of the packing and encoding queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = best_fit_packing(_table(spark, sf_dir, "documents"), vocabulary_path(), capacity=2048, with_ids=False)
    return found.drop("ids")


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _license_sql() -> str:
    """The scan in SQL; template weights are written out as a table."""
    idf, unknown = word_weights(TEMPLATES)
    rows = ", ".join(f"({n}, '{name}', '{w}', {v!r}, {idf[w]!r})" for n, (name, t) in enumerate(template_weights(TEMPLATES)) for w, v in t.items())
    return rf"""
        WITH t(template, license, w, v, idf) AS (VALUES {rows}),
        f AS (
            SELECT doc_id, coalesce(text, '') AS text, source || CASE WHEN doc_id % 4 >= 1 THEN '/' || lang ELSE '' END
                   || CASE WHEN doc_id % 4 >= 2 THEN '/d' || doc_id // 4 % 5 ELSE '' END || CASE WHEN doc_id % 4 >= 3 THEN '/e' || doc_id // 20 % 3 ELSE '' END AS dir
            FROM documents
        ),
        p AS (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS parts, string_split(text, chr(10)) AS lines, text FROM f),
        u AS (
            SELECT doc_id, 0 AS kind, i AS line, lines[i + 1] AS s FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM p)
            UNION ALL SELECT doc_id, 1, i, parts[i + 1] FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM p) WHERE contains(parts[i + 1], chr(10))
            UNION ALL SELECT doc_id, 2, 0, text FROM p WHERE len(parts) > 1
        ),
        w AS (SELECT doc_id, kind, line, unnest(regexp_extract_all(lower(s), '[a-z0-9]+')) AS w FROM u),
        c AS (SELECT doc_id, kind, line, w.w, count(*) AS n, any_value(idf) AS idf FROM w LEFT JOIN (SELECT DISTINCT w, idf FROM t) i ON i.w = w.w GROUP BY ALL),
        n AS (SELECT doc_id, kind, line, sqrt(sum(((1 + ln(n)) * coalesce(idf, {unknown!r})) ** 2)) AS norm, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY ALL),
        d AS (SELECT c.doc_id, c.kind, c.line, t.template, t.license, sum((1 + ln(c.n)) * c.idf * t.v) AS dot FROM c JOIN t ON t.w = c.w GROUP BY ALL),
        s AS (SELECT d.doc_id, d.kind, d.line, d.license, dot / norm AS score, words FROM d JOIN n ON n.doc_id = d.doc_id AND n.kind = d.kind AND n.line = d.line WHERE dot / norm >= 0.8),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, kind, line ORDER BY score DESC, license DESC) = 1),
        own AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license DESC, kind DESC, line DESC) = 1),
        total AS (SELECT doc_id, sum(words) AS words FROM n WHERE kind = 0 GROUP BY ALL),
        hit AS (SELECT doc_id, max(words) AS words FROM (SELECT doc_id, kind, sum(words) AS words FROM b GROUP BY ALL) GROUP BY ALL),
        cover AS (
            SELECT f.dir AS up, own.license, own.score FROM f JOIN own ON own.doc_id = f.doc_id
            JOIN hit ON hit.doc_id = f.doc_id JOIN total ON total.doc_id = f.doc_id WHERE hit.words >= 0.5 * total.words
            QUALIFY row_number() OVER (PARTITION BY f.dir ORDER BY own.score DESC, own.license DESC) = 1
        ),
        near AS (
            SELECT dir, cover.* FROM (SELECT DISTINCT dir FROM f) JOIN cover ON up = dir OR starts_with(dir, up || '/')
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1
        )
        SELECT f.doc_id, f.dir || '/doc' || f.doc_id || '.txt' AS path, coalesce(own.license, near.license) AS license, round(coalesce(own.score, near.score), 6) AS score,
               ['line', 'paragraph', 'file'][own.kind + 1] AS unit, CAST(own.line AS INT) AS line,
               CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               CASE WHEN own.license IS NULL THEN near.up END AS directory
        FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN near ON near.dir = f.dir
    """


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
        ),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
        cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM rep)),
        word AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
        res AS (
            SELECT word.doc_id, count(*) AS n_words, count(cov.p) AS n_removed,
                   string_agg(word, ' ' ORDER BY word.p) FILTER (cov.p IS NULL) AS kept
            FROM word LEFT JOIN cov ON word.doc_id = cov.doc_id AND word.p = cov.p GROUP BY 1
        )
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN res ON w.doc_id = res.doc_id
    """,
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)
    """,
    "op4_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ),
        l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
        ),
        r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.m FROM r JOIN l ON l.b = r.n),
        c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.n = vec_id
    """,
    "op2_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS c,
                   CASE WHEN turn = max(turn) FILTER (role = 'assistant') OVER w
                        THEN coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')
                        ELSE coalesce(text, '') END AS r
            FROM conversations WINDOW w AS (PARTITION BY conv_id)
        ),
        k AS (SELECT *, turn < coalesce(min(turn) FILTER (c <> r) OVER (PARTITION BY conv_id), 1000000000) AS shared FROM t),
        x AS (
            SELECT *, '<|' || role || '|>\n' AS h, h || c || '{END}' AS fc, h || r || '{END}' AS fr,
                   sum(length(fc)) OVER p AS ec, sum(length(fr)) OVER p AS er
            FROM k WINDOW p AS (PARTITION BY conv_id, shared ORDER BY turn)
        )
        SELECT conv_id, CAST(count_if(shared) AS INT) AS prompt_turns,
               coalesce(string_agg(fc, '' ORDER BY turn) FILTER (shared), '') AS prompt,
               coalesce(string_agg(fc, '' ORDER BY turn) FILTER (NOT shared), '') AS chosen,
               coalesce(string_agg(fr, '' ORDER BY turn) FILTER (NOT shared), '') AS rejected,
               coalesce(string_agg((ec - length(fc) + length(h)) || '-' || ec, ';' ORDER BY turn) FILTER (NOT shared AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg((er - length(fr) + length(h)) || '-' || er, ';' ORDER BY turn) FILTER (NOT shared AND role = 'assistant'), '') AS rejected_mask
        FROM x GROUP BY conv_id
    """,
    "op6_license_scan": _license_sql(),
}
