"""Queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    packed = pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_mixture

    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    placed = shard_by_mixture(docs, 40, ties=("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import with_kept_text

    kept = with_kept_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_dropped").alias("n_dropped"), F.sha2(F.col("__line_kept").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT keyed.*, coalesce(keyed.doc_id > first_doc, false) AS gone FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


def op4_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similar import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract_main_text

    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import materialise
    from .mixing import count_words, with_copies

    sized = table(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
    mixed = with_copies(materialise(sized, "document-sizes"), F.col("size"), F.col("content"))
    return mixed.select("doc_id", "size", F.col("__mix_total").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("size") * F.col("__mix_copies")).alias("taken"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_pairs

    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import as_wav, describe_wav

    return describe_wav(as_wav(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, fit, held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    manifest, folder = write_token_files(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return read_token_files(manifest, folder)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, CAST(sum(total) AS BIGINT) AS n, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
sums AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT d.lang, d.source, coalesce(s.n, 0) AS n FROM docs d LEFT JOIN sums s ON d.lang = s.lang AND d.source = s.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN apart a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
told AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM told)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 200
UNION ALL SELECT lang, source, 'pair', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM pairs
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_pieces

    found = encode_pieces(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {q.__name__: q for q in (op1_pack, op2_shards, op3_line_dedup, op4_similar, op5_main_text, op6_mix, op7_fingerprints, op8_media, op9_toxicity, op10_token_files, op11_divergence, op12_alignment, op13_pieces)}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op11_divergence": OP11_SQL}
