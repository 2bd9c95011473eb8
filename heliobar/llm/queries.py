"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(docs: DataFrame, modulus: int, remainder: int):
    """Whether crc32 of the id's text has that remainder; a null id counts as an empty text."""
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % modulus == remainder


def op1_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rotation import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", held_out(docs, 3, 1))
    model = language.fit(docs.where("NOT held_out"))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import concatenate_and_cut

    pieces = concatenate_and_cut(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k, quantised

    return exact_top_k(quantised(table(spark, sf_dir, "embeddings")), "vec_id % 100 = 0")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kneser_ney

    docs = table(spark, sf_dir, "documents")
    held = held_out(docs, 7, 2)
    model = kneser_ney.fit(docs.where(~held))
    scored = kneser_ney.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", held_out(docs, 5, 0))
    net = toxicity.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, ["doc_id", "held_out"])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))

    def n(kind: int):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.as_text("base_spans"), 256).alias("base_sha256"), secrets.as_text("spans").alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rotation": op1_rotation,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_minhash": op7_minhash,
    "op8_lm": op8_lm,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
}
ORACLES: dict[str, str] = {
    "op6_warc": """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest,
           CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), w AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n >= 1000) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to
FROM w
""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh FROM w
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (n + m - c)), e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN r ON r.node = s.doc_id GROUP BY 1, 2
""",
    "op4_topk": """
WITH base AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, b.vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
    FROM base q, base b
    WHERE q.vec_id % 100 = 0 AND b.vec_id <> q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
}
