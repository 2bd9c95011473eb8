"""MinHash near-duplicates by min-max hashing, with links confirmed on full shingle sets.

Each permutation gives two signature values, the least and the greatest hash of the set, so that half as many
hash functions do. Documents with equal sets form one class and are joined once. In every band bucket the other
classes are compared with one hub; components of the confirmed links follow; only then do members of one bucket
that are still in different components meet each other inside a task, by their signatures alone, and those that
look alike once more, with their sets; only edges that join components leave it. So no bucket gives all pairs, and every two classes that share a bucket are either
connected or compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textkernel as tk
from .common import connected_components, drop_stage, stage, trimmed

#: Bands, and permutations in each: three permutations give six values. A pair at similarity 0.85 is missed with
#: probability (1 - 0.85**6)**24, about 1e-5.
BANDS = 24
PERMUTATIONS_IN_BAND = 3
#: Rows of 16 bytes, classes whose texts are wanted, that are broadcast at most.
BROADCAST_ROWS = 2_000_000
#: Rows of one side of a comparison inside a bucket.
BLOCK = 2048


def _sets(batch: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    buf, bounds = tk.utf8(batch.column("text"))
    starts, ends, ranges = tk.words(tk.FOLD[buf], bounds)
    h = tk.hashes(tk.FOLD[buf], starts, ends)
    sh, at = tk.shingles(h, ranges, k)
    sets = [np.unique(sh[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return sets, np.array([len(s) for s in sets], np.int64)


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits of each set; None for an empty one."""
    out = []
    for s in sets:
        if not len(s):
            out.append(None)
            continue
        a = tk.mix(s + np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        b = tk.mix(s ^ np.uint64(0x5BF03635C4A1B2D3)).sum(dtype=np.uint64)
        out.append(np.array([a, b + np.uint64(len(s))], "<u8").tobytes())
    return out


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Rows of 2 * permutations values: least and greatest of each permutation, side by side."""
    flips, factors = tk.constants(permutations, 101), tk.constants(permutations, 202)
    out = np.zeros((len(sets), 2 * permutations), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 1 << 15):
            n += len(sets[j])
            j += 1
        some = [x for x in range(i, j) if len(sets[x])]
        if some:
            x = np.concatenate([sets[s] for s in some])
            at = np.concatenate([[0], np.cumsum([len(sets[s]) for s in some])[:-1]])
            for p in range(permutations):
                y = (x ^ flips[p]) * factors[p]
                y ^= y >> np.uint64(32)
                y *= factors[p - 1]
                out[some, 2 * p] = np.minimum.reduceat(y, at)
                out[some, 2 * p + 1] = np.maximum.reduceat(y, at)
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch], k: int, bands: int, per: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            sets, n = _sets(batch, k)
            sig = signatures(sets, bands * per)
            mixer = tk.constants(2 * per, 303)
            b = (sig.reshape(len(sets), bands, 2 * per) * mixer).sum(axis=2, dtype=np.uint64)
            b = tk.mix(b + np.arange(bands, dtype=np.uint64)).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(b.ravel()))
            short = (sig >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("hash"), pa.array(n), pa.array(_keys(sets), pa.binary()), lists, pa.array([r.tobytes() for r in short], pa.binary())],
                names=["doc", "hash", "n", "key", "bands", "sig"],
            )


def _only_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 1000):
            batch = whole.slice(i, 1000)
            sets, _ = _sets(batch, k)
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(_keys(sets), pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["key", "set"])


def _binary_sets(t: pa.Table) -> pa.Table:
    """The sets as bytes: one copy less than lists of Python numbers."""
    col = t["set"].combine_chunks()
    at, flat = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    blobs = [flat[a:b].astype("<i8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return t.set_column(t.column_names.index("set"), "set", pa.array(blobs, pa.binary()))


def _keyed(some: DataFrame) -> DataFrame:
    """Classes that rows are looked up for by key: sent to where the rows stand, up to BROADCAST_ROWS of them."""
    some = stage(some, "near-keyed")
    return F.broadcast(some) if some.count() <= BROADCAST_ROWS else some


def _full_sets(texts: DataFrame, classes: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """(cls, set) of the classes in ``some`` (cls), from the text of each one's first row, found by id and hash.

    Up to BROADCAST_ROWS of them are sent to where the texts stand; beyond, the texts are dealt by their hash.
    """
    wanted = stage(classes.join(some.distinct(), "cls", "left_semi").select("key", "cls", F.col("rep.doc").alias("_d"), F.col("rep.hash").alias("_h")), "near-wanted")
    ends = wanted.select("_d", "_h")
    ends = F.broadcast(ends) if wanted.count() <= BROADCAST_ROWS else ends
    found = texts.join(ends, (texts["hash"] == ends["_h"]) & texts["doc"].eqNullSafe(ends["_d"]), "left_semi")
    sets = found.select("text").mapInArrow(lambda it: trimmed(_only_sets(it, k)), "key binary, set array<long>")
    return sets.where("key IS NOT NULL").join(wanted.select("key", "cls"), "key").drop("key").dropDuplicates(["cls"])


def _confirm(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are similar enough."""
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls")))
    sets = stage(_full_sets(texts, classes, ends, k), "near-sets", "lz4")
    a, b = sets.select(F.col("cls").alias("v"), F.col("set").alias("sv")), sets.select(F.col("cls").alias("u"), F.col("set").alias("su"))
    both = pairs.select("u", "v").join(a, "v").join(b, "u")
    same = F.size(F.array_intersect("su", "sv"))
    kept = stage(both.where(100 * same >= percent * (F.size("su") + F.size("sv") - same)).select("u", "v"), "near-links")
    drop_stage(sets)
    return kept


def _candidates(t: pa.Table, comp: np.ndarray, size: np.ndarray, least: float, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likeness and places of the pairs of a block that are to be compared by sets.

    They are of different components, their sizes allow a link, their signatures agree in ``least`` of the values,
    and no earlier band has them in one bucket.
    """
    n = t.num_rows
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u4").reshape(n, -1)
    bands = np.array(t["bands"].to_pylist(), np.int64).reshape(n, -1)
    side, band = t["side"].to_numpy(), int(t["band"][0].as_py())
    right = np.flatnonzero(side != 0)
    found = []
    for i in np.flatnonzero(side != 1):
        other = right[(comp[right] != comp[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        if side[i] == 2:
            other = other[other > i]
        if len(other) and band:
            other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
        if len(other):
            like = (sig[other] == sig[i]).mean(axis=1, dtype=np.float32)
            ok = like >= least
            found.append((like[ok], np.full(int(ok.sum()), i, np.int32), other[ok].astype(np.int32)))
    like, left, other = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
    return like, left, other


def _roots(t: pa.Table) -> pa.DictionaryArray:
    return t["root"].combine_chunks().dictionary_encode()


def _open_members(t: pa.Table, least: float, percent: int) -> pa.Table:
    """The members of one block pair that look like a member of another component."""
    _, left, other = _candidates(t, _roots(t).indices.to_numpy(), t["n"].to_numpy(), least, percent)
    return t.select(["band", "bucket", "lo", "hi", "side", "cls"]).take(pa.array(np.union1d(left, other).astype(np.int64)))


def _compare(t: pa.Table, least: float, percent: int) -> pa.Table:
    """Edges that join components of one block pair.

    The candidates are taken the likeliest first and compared by full sets unless an earlier link has joined them.
    """
    sets = [np.frombuffer(x, "<u8") for x in t["set"].to_pylist()]
    roots = _roots(t)
    comp = roots.indices.to_numpy()
    parent = list(range(len(roots.dictionary)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    like, left, other = _candidates(t, comp, np.array([len(x) for x in sets]), least, percent)
    order = np.argsort(-like, kind="stable")
    edges = []
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        now = np.array([root(c) for c in range(len(parent))])  # pairs that earlier links have joined are passed over
        some = some[now[comp[left[some]]] != now[comp[other[some]]]]
        for i, j in zip(left[some].tolist(), other[some].tolist(), strict=True):
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a == b:
                continue
            same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                parent[max(a, b)] = min(a, b)
                edges.append((int(comp[i]), int(comp[j])))
    take = lambda k: roots.dictionary.take(pa.array([e[k] for e in edges], pa.int64()))
    return pa.table({"u": take(0), "v": take(1)})


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = BANDS, permutations_in_band: int = PERMUTATIONS_IN_BAND, id_col: str = "doc_id", hash_col: str | None = None, staged: list | None = None) -> DataFrame:
    """A row for each of ``docs``: id, n_shingles, component_id, kept; with ``hash_col`` also that and chosen.

    Sets are the distinct ``k``-word shingles of the whole text, however long; with fewer words the sequence of all
    is the one shingle; a text without words, or null, has an empty set, links with nothing and is kept. Two sets
    are linked if 100 * intersection >= ``percent`` * union. ``percent`` is to be 80 or more.

    Rows with equal sets are one class, which all joins go by, so ids may repeat or be null: a row that repeats an
    id is linked by its own text; a null id is larger than all others, and component_id is null where all of a
    component's are. Repeated rows are returned as often as they stand, an empty table gives no rows, and columns
    that aren't named here are neither read nor returned, whatever their names. ``hash_col`` names a column for the
    text's xxhash64; chosen is then true for the rows of one id and text of each component, the smallest id and,
    with that, the smallest hash, and for all rows without a set. ``staged`` takes in the tables that the result
    reads, for a caller that writes it to drop.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text")
    signed = stage(texts.mapInArrow(lambda it: trimmed(_sign(it, k, bands, permutations_in_band)), "doc long, hash long, n long, key binary, bands array<long>, sig binary"), "near-signed")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "hash"))
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(first.alias("rep"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")  # numbers are fixed from here on
    spread = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    hubs = spread.groupBy("band", "bucket").agg(F.count("*").alias("rows"), F.min("cls").alias("hub")).where("rows > 1")
    members = stage(spread.join(hubs, ["band", "bucket"]), "near-members")
    # a pair whose sizes differ more than the threshold allows can't be linked
    size = classes.select("cls", "n")
    star = members.where("cls <> hub").select(F.col("hub").alias("u"), F.col("cls").alias("v")).distinct()
    star = star.join(size.withColumnsRenamed({"cls": "u", "n": "nu"}), "u").join(size.withColumnsRenamed({"cls": "v", "n": "nv"}), "v")
    star = stage(star.where(F.least("nu", "nv") * 100 >= percent * F.greatest("nu", "nv")).select("u", "v"), "near-star")
    links = _confirm(star, texts, classes, percent, k)
    roots = stage(connected_components(links), "near-roots")
    # second pass: buckets with several components left
    here = members.select("band", "bucket", "cls", "rows").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    here = stage(here.withColumn("root", F.coalesce("root", "cls")), "near-here")
    drop_stage(members)
    split = here.groupBy("band", "bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "bucket")
    left = stage(here.join(split, ["band", "bucket"], "left_semi"), "near-left")
    some = _keyed(classes.join(left.select("cls").distinct(), "cls", "left_semi").select("key", "cls"))
    sigs = signed.select("key", "n", "sig", "bands").join(some, "key").groupBy("cls").agg(*[F.min(c).alias(c) for c in ("n", "sig", "bands")])
    sigs = stage(sigs, "near-sigs", "lz4")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    dealt = left.withColumn("_blocks", blocks).withColumn("_mine", F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("_mine", "_other"), "hi": F.greatest("_mine", "_other")})
    dealt = dealt.withColumn("side", F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") == F.col("lo"), 0).otherwise(1))
    share = percent / 100
    least = share - 5 * (share * (1 - share) / (2 * bands * permutations_in_band)) ** 0.5
    block = ["band", "bucket", "lo", "hi"]
    alike = dealt.join(sigs, "cls").select(*block, "side", "cls", "root", "n", "sig", "bands").groupBy(*block)
    opened = stage(alike.applyInArrow(lambda t: _open_members(t, least, percent), "band int, bucket long, lo int, hi int, side int, cls long"), "near-open")
    sets = _full_sets(texts, classes, opened.select("cls"), k)
    full = stage(sigs.select("cls", "sig", "bands").join(sets, "cls"), "near-full", "lz4")
    rooted = left.select("cls", "root").distinct()
    alike = opened.join(rooted, "cls").join(full, "cls").select(*block, "side", "root", "sig", "bands", "set")
    second = alike.groupBy(*block).applyInArrow(lambda t: _compare(_binary_sets(t), least, percent), "u long, v long")
    top = connected_components(second)
    final = classes.select("cls", "key", "rep", "copies").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    final = final.withColumn("root", F.coalesce("root", "cls"))
    final = final.join(top.select(F.col("node").alias("root"), F.col("root").alias("upper")), "root", "left")
    final = final.withColumn("root", F.coalesce("upper", "root"))
    least_doc = final.groupBy("root").agg(F.min("rep").alias("top"), F.sum("copies").alias("docs")).where("docs > 1").drop("docs")
    named = stage(final.join(least_doc, "root").select("key", F.col("top.doc").alias("component_id"), F.col("top.hash").alias("first_hash"), F.lit(True).alias("grouped")), "near-named")
    # rows without a set would all meet under one null key
    out = signed.where("key IS NOT NULL").select("doc", "hash", "n", "key").join(named, "key", "left").drop("key")
    out = out.unionByName(signed.where("key IS NULL").select("doc", "hash", "n"), allowMissingColumns=True)
    grouped = F.coalesce("grouped", F.lit(False))
    component = F.when(grouped, F.col("component_id")).otherwise(F.col("doc"))
    chosen = [F.col("hash").alias(hash_col), (~grouped | F.col("doc").eqNullSafe(component) & (F.col("hash") == F.col("first_hash"))).alias("chosen")] if hash_col else []
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"), *chosen)
    for done in (star, links, roots, here, left, sigs, opened, full, classes):
        drop_stage(done)
    if staged is not None:
        staged += [signed, named]
    return out
