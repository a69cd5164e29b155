"""The opN_ queries over the document tables and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm import common, fingerprint, htmltext, packing, sentencepiece_bpe, substring, tokenfile, topk, toxicity, warc
from geostrata.llm.common import table, tokenizer_path
from geostrata.llm.minhash import near_duplicates


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled fingerprints of every text and of its edited form."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and what they decode to, as digests."""
    path = tokenizer_path("piece_bpe_32k.model")
    both = sentencepiece_bpe.decode(sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text; one label in five is held out of training."""
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 25 words or more that an earlier document has."""
    return substring.dedup_substrings(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: four-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, num=80, den=100)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in id order, written and read back."""
    folder = common.shared_dir(spark)
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(manifest, folder, digest=True)


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC, a replica in which every record of id 97k + 13 has a flipped byte, and what the audit of the
    two replicas says about each record."""
    one, two = common.shared_dir(spark), common.shared_dir(spark)
    index = warc.write_warc(table(spark, sf_dir, "pages"), one)
    warc.copy_replica(index, one, two, lambda i: i is not None and i % 97 == 13)
    found = warc.audit(index, warc.trees(index, one), warc.trees(index, two)).select("file", "seq", F.lit(True).alias("corrupt"))
    records = warc.read_warc(index, one).select("file", "seq", F.col("id").alias("page_id"), "url", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"))
    both = records.join(found, ["file", "seq"], "left")
    return both.select("page_id", "url", "payload_bytes", "payload_sha256", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprint, op2_sentencepiece, op3_toxicity, op4_substring_dedup, op5_html_text, op6_best_fit_packing, op7_minhash_near_dedup, op8_token_files, op9_exact_topk, op10_warc_audit)}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_warc_audit": """
            SELECT page_id, coalesce(url, '') AS url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_sha256, coalesce(page_id % 97 = 13, false) AS corrupt
            FROM pages""",
        "op9_exact_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
                 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    }
