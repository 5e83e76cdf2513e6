"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bytebpe, licenses, lines, lzprint, neardup, packing, planes, secrets, toxicity, urlrules, whitening
from .common import shared_dir, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
BYTE_JSON, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(ann.build_index(rows), rows.where("vec_id % 20 = 0"), k=20)


def op2_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = urlrules.judged_by_list(pages, "page_id", "url").withColumnRenamed("listed", "label")
    return urlrules.judge(pages, urlrules.mine_rules(labelled))


def op3_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/planes-{uuid.uuid4().hex}"
    planes.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD_BPE), END_ID)
    return planes.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path(BYTE_BPE)
    decoded = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_lzprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_rows")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_JSON), tokenizer_path(PIECES))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_urlrules": op2_urlrules,
    "op3_bitplanes": op3_bitplanes,
    "op4_neardup": op4_neardup,
    "op5_secrets": op5_secrets,
    "op6_bytebpe": op6_bytebpe,
    "op7_licenses": op7_licenses,
    "op8_lzprint": op8_lzprint,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_align": op12_align,
    "op13_lines": op13_lines,
}
SQL: dict[str, str] = {"op7_licenses": licenses.containment_sql(), "op13_lines": lines.sql()}
