"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import approximate_neighbours
from .byte_bpe import decode_bytes, encode_bytes
from .common import fold_of, table
from .conversations import repair_conversations
from .hamming import hamming_top_k, sign_codes
from .lengths import token_counts
from .line_runs import drop_common_lines
from .ngram import deleted_interpolation
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import quality_scores
from .secret_scan import KINDS, scan_secrets
from .simhash import near_duplicates
from .token_files import token_file_round_trip


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = deleted_interpolation(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = approximate_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamming_top_k(sign_codes(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", F.col("piece_crc32").alias("ids_crc32"), "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_file_round_trip(table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode_bytes(encode_bytes(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents"))
    place = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform("findings", lambda f: F.struct(f["start"].alias("start"), F.array_position(place, f["kind"]).alias("kind_place"), f["kind"].alias("kind"), f["end"].alias("end"))))
    base = F.filter("ordered", lambda f: f["kind"] != "model")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    counts = [F.size(F.expr(f"filter(ordered, f -> f.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return scanned.select("doc_id", ordered.alias("ordered")).select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("ordered")).alias("spans"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True, whole=False)


QUERIES = {
    f.__name__: f
    for f in (
        op1_deleted_interpolation,
        op2_simhash_near_dedup,
        op3_token_counts,
        op4_quality_discriminant,
        op5_multiprobe_neighbours,
        op6_best_fit_packing,
        op7_hamming_top_k,
        op8_token_files,
        op9_byte_bpe,
        op10_secret_scan,
        op11_line_dedup,
        op12_conversation_repair,
        op13_periodic_runs,
    )
}
ORACLES = {
    "op7_hamming_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0E0 ELSE -1.0E0 END) AS s FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS integer) AS rank, c.vec_id, CAST((len(q.s) - list_dot_product(q.s, c.s)) / 2 AS bigint) AS distance
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.s) = len(c.s) WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY (len(q.s) - list_dot_product(q.s, c.s)) / 2, c.vec_id) QUALIFY row_number() OVER w <= 10
""",
    "op11_line_dedup": """
WITH doc AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
part AS (SELECT row_no, unnest(line) AS line, unnest(range(len(line))) AS pos FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM part),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_no) >= 10),
kept AS (SELECT row_no, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS text FROM keyed ANTI JOIN common USING (key) GROUP BY row_no)
SELECT doc_id, len(line) AS n_lines, len(line) - coalesce(n_kept, 0) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (row_no)
""",
}
"""The others need a tokenizer, a classifier or XXH64, or are approximate; tests hold them against brute force."""
