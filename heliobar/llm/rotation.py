"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector is rotated at random and only the signs are kept, with the correction factor f, the inner product
of the vector and its code. <code, q> / f is an unbiased estimate of <x, q>, its error bounded with high
probability by sqrt((1 - f^2) / f^2) * e / sqrt(dimension - 1). Runs of code bits of several rotations are bucket
keys. Only codes are dealt to the buckets, where those of too many different bits pass each other by; vectors follow
for the rows that are left, and estimates and their bounds decide which pairs need the exact cosine in double
precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import connected_components, drop_stage, stage

#: Width of the confidence bound, in standard errors.
EPSILON = 4.0
#: Expected rows in a bucket of unrelated vectors, which sets the bits of a key, and bounds of those.
BUCKET_ROWS = 256
BITS = (8, 60)
#: 64-bit words of the code that rows of a bucket are compared by first, and how many standard deviations of the
#: number of different bits of a pair at the threshold are let pass: about 3 of 10 million such pairs don't.
CODE_WORDS = 3
PASS = 5.0
#: Share of the links exactly at the threshold that may be missed.
MISS = 0.002
#: Rows of one side of a comparison inside a bucket, rows that a task takes at once, pairs compared at a time.
BLOCK = 2048
CELL_ROWS = 4096
PAIRS = 1 << 17


@lru_cache(maxsize=64)
def rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def layout(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables: a link at the threshold is missed with probability MISS."""
    bits = min(max(math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS + 1)), BITS[0]), BITS[1])
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _unit(lists: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length of vector, and their unit vectors in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        x = flat[at[rows][:, None] + np.arange(d)].astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _signs(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors of the first rotation, and signs of ``bits`` coordinates of as many rotations as it takes."""
    d = x.shape[1]
    y = [x @ rotation(d, seed + i) for i in range(-(-bits // d))]
    return y[0], (np.concatenate(y, axis=1) > 0)[:, :bits]


def _keys(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    power = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) * power).sum(axis=2)


def _codes(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    names = ["class", "d", "keys", "code"]
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            b = whole.slice(i, 4096)
            for rows, x in _unit(b.column("v")):
                _, signs = _signs(x, max(bits * tables, 64 * CODE_WORDS), seed)
                keys = _keys(signs, bits, tables)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                code = np.packbits(signs[:, : 64 * CODE_WORDS], axis=1)
                yield pa.RecordBatch.from_arrays([b.column("class").take(pa.array(rows)), pa.array(np.full(len(x), x.shape[1], np.int32)), lists, pa.array([c.tobytes() for c in code], pa.binary())], names=names)


def _most_different(threshold: float) -> float:
    n, p = 64 * CODE_WORDS, math.acos(threshold) / math.pi
    return n * p + PASS * math.sqrt(n * p * (1 - p))


def _screen(t: pa.Table, most: float) -> pa.Table:
    """The rows of some buckets of a table, or of a pair of blocks, whose codes are near that of another row."""
    code = np.frombuffer(b"".join(t["code"].to_pylist()), "<u8").reshape(t.num_rows, CODE_WORDS)
    bucket, side = t["bucket"].to_numpy(), t["side"].to_numpy()
    near = np.zeros(t.num_rows, bool)

    def meet(left, right, same):
        step = max(1, PAIRS // max(len(right), 1))
        for i in range(0, len(left), step):
            some = left[i : i + step]
            apart = np.zeros((len(some), len(right)), np.int16)
            for w in range(CODE_WORDS):
                apart += np.bitwise_count(code[some, w][:, None] ^ code[right, w][None, :])
            hit = apart <= most
            if same:
                hit[np.arange(len(some)), np.arange(i, i + len(some))] = False
            near[some] |= hit.any(axis=1)
            near[right] |= hit.any(axis=0)

    if side[0] != 2:
        meet(np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)
    else:
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a > 1:
                meet(order[a:b], order[a:b], True)
    return t.drop_columns(["code"]).filter(pa.array(near))


def _pairs(bucket: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal buckets, or of the two sides of a block pair, a bounded number at a time."""
    if side[0] != 2:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, PAIRS // max(len(right), 1))
        for i in range(0, len(left), step):
            some = left[i : i + step]
            yield np.repeat(some, len(right)), np.tile(right, len(some))
        return
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], bucket[order], "right")
    count = ends - np.arange(len(order)) - 1
    total = np.cumsum(count)
    i = 0
    while i < len(order):
        j = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")), i + 1)
        rows = np.repeat(np.arange(i, j), count[i:j])
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(count[i:j]) - count[i:j], count[i:j])
        yield order[rows], order[rows + 1 + inside]
        i = j


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes rows that links (a, b) connect have one root, the smallest; ``parent`` points to roots before and after."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _meet(t: pa.Table, bits: int, tables: int, seed: int, threshold: float) -> pa.Table:
    """Links within some buckets of a table: how many each class has, and edges that span them."""
    n = t.num_rows
    side, copies, ids, now = t["side"].to_numpy(), t["copies"].to_numpy(), t["class"].to_numpy(), int(t["table"][0].as_py())
    (_, x), *_ = _unit(t["v"])  # a group has vectors of one length
    d = x.shape[1]
    turned, signs = _signs(x, bits * tables, seed)
    keys = _keys(signs, bits, tables)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    code = (np.sign(turned) + (turned == 0)) / math.sqrt(d)
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor * EPSILON / math.sqrt(max(d - 1, 1))
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for a, b in _pairs(t["bucket"].to_numpy(), side):
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)  # the same estimate in every table
        guess = np.einsum("ij,ij->i", turned[a], code[b]) / factor[b]
        maybe = guess + spread[b] >= threshold
        a, b = a[maybe], b[maybe]
        exact = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        a, b = a[exact], b[exact]
        if now and len(a):  # the first table in which two rows meet counts their link
            new = ~(keys[a, :now] == keys[b, :now]).any(axis=1)
            a, b = a[new], b[new]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        _join(parent, a, b)
    some, child = np.flatnonzero(links), np.flatnonzero(parent != np.arange(n))
    u, v = np.concatenate([ids[some], ids[child]]), np.concatenate([np.full(len(some), -1, np.int64), ids[parent[child]]])
    count = np.concatenate([links[some], np.zeros(len(child), np.int64)])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "edge": pa.array(np.arange(len(u)) >= len(some)), "n": pa.array(count, pa.int64())})


def near_vectors(vectors: DataFrame, threshold: float = 0.9, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each of ``vectors``: id, n_links, component_id, kept.

    Links join vectors whose cosine in double precision reaches ``threshold``; every link returned is exact, and
    one at the threshold is missed with probability MISS at most. Null, zero and non-finite vectors, and those with
    null components, link with nothing. Equal vectors form one class; its copies are all linked. Vectors of
    different lengths are compared with their own length only. Ids may repeat or be null: a row is linked by its own
    vector; component_id is null where all of a component's are. An empty table gives no rows; other columns aren't
    read, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    good = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v"))
    key = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"), F.size("v"))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), key))
    ids = stage(rows.select("id", "key"), "vec-ids", "lz4")
    classes = rows.where("v IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.first("v").alias("v"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "vec-classes", "lz4")
    count = classes.count()
    bits, tables = layout(count, threshold)
    coded = stage(classes.select("class", "v").mapInArrow(lambda it: _codes(it, bits, tables, seed), "class long, d int, keys array<long>, code binary"), "vec-codes", "lz4")
    # large buckets go by pairs of blocks; small ones go together, some thousand rows to a task's group
    big = coded.select("d", F.posexplode("keys").alias("table", "bucket")).groupBy("d", "table", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
    big = stage(big, "vec-big")
    here = coded.select("class", "d", "code", F.posexplode("keys").alias("table", "bucket")).join(big, ["d", "table", "bucket"], "left")
    here = here.withColumn("_blocks", F.coalesce(F.ceil(F.col("rows") / BLOCK), F.lit(1)).cast("int")).withColumn("_mine", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    here = here.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    here = here.withColumns({"lo": F.least("_mine", "_other"), "hi": F.greatest("_mine", "_other")})
    here = here.withColumn("side", F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") == F.col("lo"), 0).otherwise(1))
    cells = max(1, count // CELL_ROWS)
    here = here.withColumn("cell", F.when(F.col("_blocks") == 1, F.pmod("bucket", F.lit(cells))).otherwise(-1 - F.col("bucket")))
    group, most = ["d", "table", "cell", "lo", "hi"], _most_different(threshold)
    screened = here.select("class", *group, "bucket", "side", "code").groupBy(*group).applyInArrow(lambda t: _screen(t, most), "class long, d int, table int, cell long, lo int, hi int, bucket long, side int")
    screened = stage(screened, "vec-screened")
    full = screened.join(classes.select("class", "copies", "v"), "class")
    found = full.groupBy(*group).applyInArrow(lambda t: _meet(t, bits, tables, seed, threshold), "u long, v long, edge boolean, n long")
    found = stage(found, "vec-found")
    links = found.where("NOT edge").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("edge").select("u", "v"))
    per = classes.select("key", "class", "first", "copies").join(links, "class", "left").where("copies > 1 OR links IS NOT NULL")
    per = stage(per.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class")), "vec-linked")
    top = per.groupBy("root").agg(F.min("first").alias("component_id"))
    per = per.join(top, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    per = stage(per, "vec-classed")
    # rows without a usable vector would all meet under one null key
    out = ids.where("key IS NOT NULL").join(per, "key", "left").drop("key").unionByName(ids.where("key IS NULL").select("id"), allowMissingColumns=True)
    component = F.when(F.coalesce("linked", F.lit(False)), F.col("component_id")).otherwise(F.col("id"))
    for done in (classes, coded, big, screened, found):
        drop_stage(done)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
