"""One registered query per training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegauge.llm import jaccard, language, lengths, lines, merkle, mixing, packed, packing, resampling, simhash, toxicity, vectors
from pulsegauge.sources.tables import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    learn = lambda doc_id: ~language.held_out(doc_id, 5, 0)
    return toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), learn)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), language.held_out(F.col("row.doc_id"), 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence",
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, capacity=2048, end_id=0)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), k=10, divisor=100)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.approximate_neighbours(table(spark, sf_dir, "embeddings"), k=20, divisor=20)


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.packed_round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=2)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"), 4, 2)
    model = language.train_language_model(docs.filter(F.col("doc_id").isNotNull() & ~apart))
    return language.identify_languages(docs, model).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(lengths.length_histogram(table(spark, sf_dir, "documents"), BYTE_VOCABULARY))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text (null: empty) and what was cut from the original."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce("clean_text", F.lit("")).alias("clean_text"),
        F.size("removed").cast("bigint").alias("removed_stretches"), F.concat_ws(",", spans).alias("removed_spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.Mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    shown = F.coalesce("tampered_leaf", "leaf")
    found = found.withColumn("folded_root", merkle.folded(shown, F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"), shingle=3, percent=90)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash, op3_packing, op4_exact_top_k, op5_neighbours,
        op6_packed_ids, op7_language, op8_token_counts, op9_line_dedup, op10_mixing,
        op11_merkle, op12_resampling, op13_jaccard,
    )
}

LLM_ORACLES: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op9_line_dedup": r"""
        WITH marked AS (
            SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
                '(\n+)', '\1' || chr(30), 'g'), '([.!?]) ', '\1 ' || chr(30), 'g'),
                '([^.!?\s]) ([A-ZÀ-ÖØ-Þ])', '\1 ' || chr(30) || '\2', 'g'),
                '([^.!?\s]) ([A-ZÀ-ÖØ-Þ])', '\1 ' || chr(30) || '\2', 'g') AS text
            FROM documents
        ), numbered AS (
            SELECT doc_id, unnest(range(len(string_split(text, chr(30))))) AS unit, unnest(string_split(text, chr(30))) AS part FROM marked
        ), worded AS (
            SELECT doc_id, unit, part, CAST(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY unit) AS BIGINT) AS upto,
                   list_filter(regexp_split_to_array(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM numbered
        ), ranked AS (
            SELECT *, len(words) > 0 AND row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, unit) > 1 AS later FROM worded
        ), stretched AS (
            SELECT *, unit - row_number() OVER (PARTITION BY doc_id, later ORDER BY unit) AS run FROM ranked
        ), judged AS (
            SELECT *, later AND sum(len(words)) OVER (PARTITION BY doc_id, later, run) >= 25 AS gone FROM stretched
        ), spans AS (
            SELECT doc_id, min(upto - length(part)) AS low, max(upto) AS high FROM judged WHERE gone GROUP BY doc_id, run
        ), cut AS (
            SELECT doc_id, count(*) AS n, string_agg(low || '-' || high, ',' ORDER BY low) AS listed FROM spans GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, coalesce(string_agg(part, '' ORDER BY unit) FILTER (NOT gone), '') AS clean_text FROM judged GROUP BY doc_id
        )
        SELECT kept.doc_id, clean_text, coalesce(n, 0) AS removed_stretches, coalesce(listed, '') AS removed_spans
        FROM kept LEFT JOIN cut ON kept.doc_id = cut.doc_id""",
    "op11_merkle": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, text, concat(
                coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
            FROM documents
        ), leaves AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS forged,
                   list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0, 0, 0, 0, 0, 0, 0, 0]),
                           lambda x, y: xor(x // 2, 3988292384 * (x % 2)))) AS crc
            FROM docs
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS spot FROM leaves
        ), low AS (
            SELECT source, 0 AS level, list(leaf ORDER BY spot) AS nodes FROM placed GROUP BY source
            UNION ALL
            SELECT source, level + 1, list_transform(range((len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1:i * 16 + 16], '')))
            FROM low WHERE len(nodes) > 1
        ), subroots AS (
            SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE len(nodes) = 1
        ), high AS (
            SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range((len(nodes) + 15) // 16), lambda i: sha256(array_to_string(nodes[i * 16 + 1:i * 16 + 16], '')))
            FROM high WHERE len(nodes) > 1
        ), steps AS (
            SELECT doc_id, leaf, 0 AS tree, level, nodes, spot // CAST(16 ** level AS BIGINT) AS i
            FROM placed JOIN low ON placed.source IS NOT DISTINCT FROM low.source WHERE len(nodes) > 1
            UNION ALL
            SELECT doc_id, leaf, 1, level, nodes, place // CAST(16 ** level AS BIGINT)
            FROM placed JOIN subroots ON placed.source IS NOT DISTINCT FROM subroots.source CROSS JOIN high WHERE len(nodes) > 1
        ), sides AS (
            SELECT doc_id, leaf, list(array_to_string(nodes[i // 16 * 16 + 1:i], '') || '|' || array_to_string(nodes[i + 2:i // 16 * 16 + 16], '')
                   ORDER BY tree, level) AS path
            FROM steps GROUP BY doc_id, leaf
        ), folded AS (
            SELECT p.doc_id, p.leaf, subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
                   sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
                   list_reduce(list_prepend(CASE WHEN (4294967295 - crc) % 5 = 0 THEN forged ELSE p.leaf END, coalesce(path, [])),
                       lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
            FROM placed p JOIN subroots ON p.source IS NOT DISTINCT FROM subroots.source
            LEFT JOIN sides ON p.doc_id = sides.doc_id AND p.leaf = sides.leaf
        )
        SELECT *, folded_root = root AS verified FROM folded""",
    "op13_jaccard": r"""
        WITH RECURSIVE worded AS (
            SELECT row_number() OVER () AS id, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), sets AS (
            SELECT id, doc_id, list_sort(list_distinct(CASE WHEN len(words) BETWEEN 1 AND 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(len(words) - 2), lambda i: array_to_string(words[i + 1:i + 3], ' ')) END)) AS items
            FROM worded
        ), classes AS (
            SELECT items, min(id) AS class FROM sets WHERE len(items) > 0 GROUP BY items
        ), shingles AS (
            SELECT class, len(items) AS n, unnest(items) AS item FROM classes
        ), links AS (
            SELECT a.class AS x, b.class AS y FROM shingles a JOIN shingles b ON a.item = b.item AND a.class <> b.class
            GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT class AS x, class AS y FROM classes
            UNION
            SELECT reached.x, links.y FROM reached JOIN links ON reached.y = links.x
        ), members AS (
            SELECT class, sets.id, sets.doc_id FROM classes JOIN sets USING (items)
        ), smallest AS (
            SELECT x AS class, min(doc_id) AS component_id FROM reached JOIN members ON members.class = reached.y GROUP BY x
        )
        SELECT sets.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, CASE WHEN len(items) = 0 THEN sets.doc_id ELSE component_id END AS component_id
        FROM sets LEFT JOIN members ON members.id = sets.id LEFT JOIN smallest ON smallest.class = members.class""",
}
