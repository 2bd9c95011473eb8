"""Exact top-k search: exhaustive term-at-a-time accumulation over integer vectors.

Queries are written in files of a bounded size. A task turns a block of candidate rows into postings by component
and takes the queries file by file; every non-zero component of a query scatters its weighted postings into a dense
array of scores. It keeps the best k of each query, and a partial-to-final selection merges the blocks'. So one plan
serves any number of queries, nothing is broadcast, and a task holds a block of either side at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import scratch_path, stage
from .shared import open_fs

#: Queries of one file at most, candidate rows scored at a time at most, and bytes of either.
QUERY_BLOCK = 4096
ROWS = 1 << 16
BLOCK_BYTES = 32 << 20


def _ragged(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of each component; the values are whole numbers."""
    lists = lists.cast(pa.large_list(pa.int64()))
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    sizes = np.diff(at)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(values)) - (at[:-1] - at[0])[rows], values


def _postings(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    rows, places, values = _ragged(lists)
    keep = values != 0
    rows, places, values = rows[keep], places[keep], values[keep]
    order = np.argsort(places, kind="stable")
    rows, places, values = rows[order], places[order], values[order]
    at = np.flatnonzero(np.diff(places, prepend=-1))
    ends = np.append(at[1:], len(places))
    return {int(places[a]): (rows[a:b], values[a:b]) for a, b in zip(at, ends, strict=True)}


def _best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, null ids last."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= floor)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], none[pick], -scores[pick]))[:k]]


def _queries(files: list[str]) -> Iterator[tuple[np.ndarray, pa.Array, list]]:
    """Rows, ids and non-zero components of the queries of each file."""
    import pyarrow.parquet as pq

    for uri in files:
        fs, path = open_fs(uri)
        t = pq.read_table(path, columns=["row", "id", "v"], filesystem=fs, partitioning=None)
        v = t["v"].combine_chunks()
        at, values = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        terms = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        if terms:
            yield t["row"].to_numpy(), t["id"].combine_chunks(), terms


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together, or cut, to ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _search(batches: Iterator[pa.RecordBatch], files: list[str], rows: int, k: int) -> Iterator[pa.RecordBatch]:
    names = ["query_row", "query_id", "vec_id", "score"]
    for part in _blocks(batches, rows):
        numbers, null = part["row"].to_numpy(), part["id"].is_null().to_numpy()
        ids, postings = part["id"].fill_null(0).to_numpy(), _postings(part["v"].combine_chunks())
        for q_rows, q_ids, terms in _queries(files):
            found = []
            for q, values in enumerate(terms):
                scores = np.zeros(len(ids), np.int64)
                for place in np.flatnonzero(values).tolist():
                    if place in postings:
                        at, weights = postings[place]
                        if len(at) == len(scores):
                            scores += weights * values[place]
                        else:
                            scores[at] += weights * values[place]
                own = np.flatnonzero(numbers == q_rows[q])  # the query's own row, if it is among these
                pick = _best(scores, ids, null, k + len(own))
                found.append((pick[~np.isin(pick, own)][:k], scores))
            sizes = [len(p) for p, _ in found]
            pick = np.concatenate([p for p, _ in found])
            score = np.concatenate([s[p] for p, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_rows, sizes)), q_ids.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(ids[pick], mask=null[pick]), pa.array(score)], names=names)


def exact_top_k(vectors: DataFrame, asked: str | Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query with all other rows.

    The rows of ``vectors`` that ``asked`` holds for are the queries; each is compared with every row but itself.
    Vectors are arrays of whole numbers; those that are null or hold nulls take no part. Components missing from a
    shorter vector count as zero; scores must fit 64 bits. Ties go to the smaller id, null ids last. Ids may repeat:
    each row is a candidate of its own, also of a query with the same id, and each query row has its own answer.
    Rows with a null id are candidates, and queries if ``asked`` holds. An empty table, or no query, gives no rows.
    Other columns aren't read, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    condition = F.expr(asked) if isinstance(asked, str) else asked
    v = F.col(vec_col).cast("array<bigint>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(condition, F.lit(False)).alias("asked"))
    rows = rows.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)").withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "topk-rows", "lz4")  # numbers are fixed from here on
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 1
    room = max(1, BLOCK_BYTES // (8 * widest))
    path = scratch_path(spark, "topk-queries")
    rows.where("asked").select("row", "id", "v").write.option("maxRecordsPerFile", min(room, QUERY_BLOCK)).parquet(path)
    files = sorted(spark.read.schema("row long, id long, v array<bigint>").parquet(path).inputFiles())  # a name for thousands of queries
    found = rows.select("row", "id", "v").mapInArrow(lambda it: _search(it, files, min(room, ROWS), k), "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 1024, vec_col: str = "embedding") -> DataFrame:
    """Vectors with components floor(scale * x), x as double; those null or with null or non-finite ones go."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & ~bad).withColumn(vec_col, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))
