"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing, each written and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliobar.llm import kneser_ney as _  # noqa: F401  the subpackage has to be there as a whole
from heliobar.llm import minhash, mixing, packing, queries, secrets, toxicity
from heliobar.llm.common import drop_stage, free_name, give_back_driver, stage, table

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on labelled rows outside the held-out fold, doesn't reject."""
    net = toxicity.fit(docs.where(~queries.held_out(docs, 5, 0)), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, docs.columns).where("predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (similarity 0.8 or more), that of the smallest id.

    Rows go by id and text: unrelated texts that share an id all stay, of rows that repeat an id and its text one
    does, texts without words all stay, null ids come last. An empty table stays empty; all columns stay as they are.
    """
    key, staged = free_name(docs.columns, "text_hash"), []
    found = minhash.near_duplicates(docs, hash_col=key, staged=staged)
    rows = found.groupBy("doc_id", key).agg(F.min("chosen").alias("chosen"), F.max("n_shingles").alias("n"), F.count("*").alias("times"))
    rows = stage(rows.where("NOT chosen OR times > 1 AND n > 0").select(F.col("doc_id").alias("_id"), F.col(key).alias("_hash"), "chosen"), "pipeline-near")
    for done in staged:
        drop_stage(done)
    gone, again = rows.where("NOT chosen"), rows.where("chosen")
    hashed = docs.withColumn(key, F.xxhash64("text"))
    left = _by_text(hashed, gone, key, "left_anti")
    if not again.isEmpty():
        every = [F.col(f"`{c}`") for c in hashed.columns]
        once = _by_text(left, again, key, "left_semi").groupBy("doc_id", key).agg(F.first(F.struct(*every)).alias("row")).select("row.*")
        left = _by_text(left, again, key, "left_anti").unionByName(once)
    return left.select([F.col(f"`{c}`") for c in docs.columns])


def _by_text(docs: DataFrame, rows: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of ``docs`` that are, or aren't, among ``rows`` (_id, _hash), which go to the texts unless they are very many."""
    rows = F.broadcast(rows) if rows.count() <= minhash.BROADCAST_ROWS else rows
    return docs.join(rows, docs["doc_id"].eqNullSafe(rows["_id"]) & (docs[key] == rows["_hash"]), how)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark; n_chars follows the new text.

    Null, empty and clean texts stay as they are, and so do all other columns.
    """
    base, spans = free_name(docs.columns, "base_spans"), free_name(docs.columns, "spans")
    found = secrets.scan(docs, secrets.fit(docs), base, spans)
    clean = F.size(F.col(spans)) == 0
    text = F.when(clean, F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans)))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(clean, F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; those without words, or left out by their source's target, go."""
    repeats = free_name(docs.columns, "repeats")
    mixed = mixing.repeated(docs, repeats)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(repeats)))
    return mixed.where(F.col(repeats) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies.alias(repeats)).drop(repeats)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids (little-endian unsigned 32-bit)."""
    return packing.concatenate_and_cut(docs, queries.tokenizer_path())


def _lean(step):
    """``step`` between two times that the driver, which all stages share, gives freed memory back."""

    @functools.wraps(step)
    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_driver(spark)
        out = step(spark, docs, sf_dir)
        give_back_driver(spark)
        return out

    return run_lean


STAGES = [
    ("toxicity", _lean(drop_toxic)),
    ("minhash", _lean(drop_near_duplicates)),
    ("secrets", _lean(redact_secrets)),
    ("mixing", _lean(mix)),
    ("packing", _lean(pack)),
]

#: SQL expresses neither the network nor the tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
