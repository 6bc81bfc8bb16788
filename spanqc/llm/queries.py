"""The queries of this subpackage, over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..sources.tables import read_table
from .bm25 import top_k
from .chat import render
from .collocations import collocations
from .decontamination import contamination, digest
from .hard_negatives import hard_negatives
from .html_text import main_texts
from .language_id import identify
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import score
from .token_counts import token_counts
from .url_filter import judge
from .warc import page_digests, read_archives, write_archives


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(read_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "archives")
    write_archives(read_table(spark, sf_dir, "pages"), folder)
    return page_digests(read_archives(spark, folder, data=False))


#: The rules of op7: a host with the beginning of a path.
ALLOWED = ["com/", "www.example.com/en/"]
BLOCKED = ["example.com/en/", "net/es/", "net/fr/"]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), ALLOWED, BLOCKED)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), anchors=F.col("id") % 100 == 0)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_chat_formatting,
        op3_language_id,
        op4_simhash_near_dedup,
        op5_benchmark_decontamination,
        op6_warc_chunks,
        op7_url_filter,
        op8_source_mixing,
        op9_bm25_top_k,
        op10_quality_classifier,
        op11_hard_negatives,
        op12_phrase_collocations,
        op13_html_extraction,
    )
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": """
        WITH lists AS (
            SELECT conv_id, count(*)::bigint AS n_turns,
                   list(length(role)::varchar || ':' || role || length(text)::varchar || ':' || text ORDER BY turn) AS turns,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
            UNION ALL
            SELECT NULL, 1, [length(role)::varchar || ':' || role || length(text)::varchar || ':' || text], '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
            FROM conversations WHERE conv_id IS NULL
        ), begun AS (
            SELECT DISTINCT list_slice(turns, 1, k)::varchar AS beginning, k FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM lists)
        )
        SELECT conv_id, n_turns, rendered FROM lists
        WHERE NOT EXISTS (SELECT 1 FROM begun WHERE k = n_turns AND beginning = turns::varchar)
    """,
    "op5_benchmark_decontamination": """
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
        ), item_starts AS (
            SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM item_words WHERE len(words) > 0
        ), windows AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(list_slice(words, k, k + least(len(words), 10) - 1), ' ') AS key FROM item_starts
        ), sizes AS (
            SELECT DISTINCT size FROM windows
        ), starts AS (
            SELECT doc_id, size, words, unnest(range(1, len(words) - size + 2)) AS k FROM doc_words, sizes WHERE len(words) >= size
        ), keyed AS (
            SELECT doc_id, size, k, array_to_string(list_slice(words, k, k + size - 1), ' ') AS key FROM starts
        ), found AS (
            SELECT doc_id, item_id, k, size FROM keyed JOIN windows USING (size, key)
        ), places AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + size)) AS place FROM found
        ), hits AS (
            SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id
        ), names AS (
            SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS listed FROM (SELECT DISTINCT doc_id, item_id::varchar AS name FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN names n ON d.doc_id = n.doc_id
    """,
    "op6_warc_chunks": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), shared AS (
            SELECT payload_digest AS d, max(page_id) AS original FROM sized WHERE payload_bytes >= 1000 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> original THEN original END AS refers_to
        FROM sized LEFT JOIN shared ON payload_digest = d AND payload_bytes >= 1000
    """,
    "op7_url_filter": """
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), rules(rule, verdict) AS (
            VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
        ), fits AS (
            SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM parts JOIN rules
              ON (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1)))
             AND starts_with(path, substr(rule, strpos(rule, '/')))
            GROUP BY page_id
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
    """,
    "op8_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size FROM documents
        ), totals AS (
            SELECT source, sum(size)::bigint AS source_size, count(*) AS documents FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::double WHEN 1 THEN 1.0::double ELSE 2.0::double END AS weight FROM totals
        ), summed AS (
            SELECT *, row_number() OVER line AS pos, sum(source_size) OVER ()::double AS total,
                   coalesce(sum(source_size) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double AS stopped,
                   sum(weight) OVER () - coalesce(sum(weight) OVER (line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
            FROM weighed WINDOW line AS (ORDER BY source_size / weight, source NULLS LAST)
        ), levels AS (
            SELECT *, (1.5::double * total - 2 * stopped) / weight_left AS level FROM summed
        ), chosen AS (
            SELECT arg_min(level, pos) AS level FROM levels WHERE level * weight <= 2 * source_size
        ), targets AS (
            SELECT l.source, l.source_size, l.documents, least(2.0::double * l.source_size, c.level * l.weight) AS target FROM levels l, chosen c
        ), placed AS (
            SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
                   ('0x' || substr(md5(concat_ws(':', '42', coalesce(s.doc_id::varchar, 'null'), s.size::varchar)), 1, 8))::bigint
                     % greatest(1, ceil(t.documents::double / greatest(2048, floor(sqrt(t.documents))))::bigint) AS block
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), lined AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY block, CASE WHEN block % 2 = 0 THEN size ELSE -size END, doc_id NULLS LAST) - 1 AS place,
                   CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::double END AS ratio,
                   ('0x' || substr(md5('offset 42:' || coalesce('=' || source, 'null')), 1, 8))::bigint / 4294967296.0::double AS start
            FROM placed
        )
        SELECT doc_id, size, source_size, target, ((floor((place + 1) * ratio + start) - floor(place * ratio + start))::bigint * size)::bigint AS taken
        FROM lined
    """,
    "op9_bm25_top_k": """
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
            FROM documents
        ), counts AS (
            SELECT doc_id, word, count(*) AS n FROM words GROUP BY doc_id, word
        ), lengths AS (
            SELECT doc_id, sum(n)::double AS length FROM counts GROUP BY doc_id
        ), size AS (
            SELECT (SELECT count(*) FROM documents) AS documents, (SELECT sum(n) FROM counts)::double / (SELECT count(*) FROM documents) AS mean
        ), frequencies AS (
            SELECT word, ln(1 + (documents - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM counts, size GROUP BY word, documents
        ), shares AS (
            SELECT c.doc_id, c.word, f.weight, f.weight * (c.n * 2.2 / (c.n + 1.2 * (1 - 0.75 + 0.75 * l.length / s.mean)))::double AS share
            FROM counts c JOIN lengths l ON c.doc_id = l.doc_id JOIN frequencies f ON c.word = f.word, size s
        ), asked AS (
            SELECT doc_id AS query_id, word FROM counts WHERE doc_id % 20 = 0
        ), scored AS (
            SELECT query_id, doc_id, round(sum(share), 6) AS score FROM asked JOIN shares USING (word) GROUP BY query_id, doc_id
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored
        )
        SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_hard_negatives": """
        WITH known AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.v, b.v)::bigint AS score
            FROM known a JOIN known b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM pairs WHERE label = anchor_label
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::int AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN pairs q ON p.anchor_id = q.anchor_id AND q.label <> p.anchor_label AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op12_phrase_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL
        ), lists AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), starts AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
        ), grams AS (
            SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f
            FROM starts, (VALUES (1), (2), (3)) sizes(size) WHERE i + size - 1 <= len(w) GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(f)::bigint AS n FROM grams WHERE size = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE size > 1 AND f >= 10
        ), cuts AS (
            SELECT lang, size, phrase, a, unnest(range(1, size)) AS k, w FROM candidates
        ), scored AS (
            SELECT c.lang, c.size, c.phrase, c.a, k, p.f AS l, q.f AS r, ((1000000::hugeint * c.a * c.a) // (p.f::hugeint * q.f))::bigint AS score
            FROM cuts c JOIN grams p ON p.lang = c.lang AND p.size = k AND p.phrase = array_to_string(c.w[1:k], ' ')
                        JOIN grams q ON q.lang = c.lang AND q.size = c.size - k AND q.phrase = array_to_string(c.w[k + 1:], ' ')
        ), weakest AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS pick FROM scored
        ), parts AS (
            SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
            UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3
        ), holders AS (
            SELECT lang, phrase, max(a) AS most FROM parts GROUP BY lang, phrase
        ), ranked AS (
            SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, x.a DESC, x.phrase) AS rank, x.phrase, x.a, l, r, score
            FROM weakest x LEFT JOIN holders h ON x.lang = h.lang AND x.phrase = h.phrase
            WHERE pick = 1 AND NOT coalesce(100 * most >= 50 * x.a, false)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
