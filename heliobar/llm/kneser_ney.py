"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark.

Tasks count pairs locally and send each shard of contexts compact sorted blocks; frequent contexts are split over
several shards. A shard merges its blocks and stores sorted arrays of pair hashes with counts; what it knows of its
words, as followers and as contexts, goes on to shards of words, stored likewise. Workers memory-map the arrays and
look hashes up by binary search, so that neither driver nor worker memory grows with the corpus.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textkernel as tk
from .common import give_back, scratch_path, stage, trimmed
from .shared import map_arrays, save_arrays

BOS, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Tokens whose pairs are counted together in a task, tokens of them read, and sorted, at a time, and tokens scored at a time.
TOKENS = 3_000_000
SORTED_TOKENS = 500_000
SCORED_TOKENS = 900_000
#: Bytes of text that make a shard, and bytes that tell which contexts are frequent enough to be split.
SHARD_BYTES = 16 << 20
SAMPLE_BYTES = 32 << 20
#: Files that a worker keeps mapped, one for each shard.
MAPPED = 8192
_OPEN: OrderedDict = OrderedDict()


def tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and ends of all texts in order, those of what precedes each, and each text's range."""
    low = tk.FOLD[buf]
    starts, ends, ranges = tk.words(low, bounds)
    h = tk.hashes(low, starts, ends)
    n = np.diff(ranges)
    at = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(int(at[-1]), np.uint64)
    place = np.ones(len(out), bool)
    place[at[1:] - 1] = False
    out[place], out[~place] = h, END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = BOS
    return out, before, at


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tk.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Places where a run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def _pieces(column: pa.Array, some: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts a few at a time: about six bytes for each of ``some`` tokens, or one long text."""
    buf, bounds = tk.utf8(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + 6 * some, "right")) - 1, i + 1), n)
        yield buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i, j
        i = j


def pair_shard(ctx: np.ndarray, word: np.ndarray, model: dict) -> np.ndarray:
    """The shard of each pair: that of its context, or one of several where the context is frequent."""
    spot = np.minimum(np.searchsorted(model["hot"], ctx), max(len(model["hot"]) - 1, 0))
    part = np.zeros(len(ctx), np.uint64)
    if len(model["hot"]):
        hot = np.flatnonzero(model["hot"][spot] == ctx)
        part[hot] = tk.mix(word[hot]) % model["spread"][spot[hot]]
    return (tk.mix(ctx + part * np.uint64(0xD1B54A32D192ED03)) % np.uint64(model["shards"])).astype(np.int64)


def node_shard(word: np.ndarray, model: dict) -> np.ndarray:
    return (word % np.uint64(model["shards"])).astype(np.int64)


_BLOCK = ["shard", "ctx", "many", "word", "count"]


def _count(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    def emit(held):
        """Blocks of the pairs of ``held``, a group of contexts at a time: a pair has all its occurrences in one group."""
        groups = -(-sum(len(t) for t, _, _ in held) // SORTED_TOKENS)
        for group in range(groups):
            some = []
            for token, before, shard in held:
                here = np.flatnonzero((shard if model["shards"] >= groups else before) % groups == group)
                some.append((token[here], before[here], shard[here]))
            if sum(len(t) for t, _, _ in some):
                yield blocks(*(np.concatenate(x) for x in zip(*some, strict=True)))

    def blocks(token, before, shard):
        key = pair(before, token)
        order = np.argsort(key)
        at = _runs(key[order])
        first = order[at]
        count = np.diff(np.append(at, len(key))).astype("<u4")
        del key, order, at
        ctx, word, shard = before[first], token[first], shard[first]
        order = np.lexsort((ctx, shard))
        ctx, word, count, shard = ctx[order], word[order], count[order], shard[order]
        rows = []
        cuts = np.append(_runs(shard), len(shard))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            c = _runs(ctx[a:b])
            many = np.diff(np.append(c, b - a)).astype("<u4")
            rows.append((int(shard[a]), ctx[a:b][c].tobytes(), many.tobytes(), word[a:b].tobytes(), count[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if not i else pa.binary()) for i in range(5)], names=_BLOCK)

    held, size = [], 0
    for batch in batches:
        for buf, bounds, _, _ in _pieces(batch.column("text"), SORTED_TOKENS):
            t, b, _ = tokens(buf, bounds)
            held.append((t, b, pair_shard(b, t, model).astype(np.uint32)))
            size += len(t)
            if size >= TOKENS:
                yield from emit(held)
                held, size = [], 0
    yield from emit(held)


def _u(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _small(count: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 and more in a sorted list beside them."""
    big = np.flatnonzero(count >= 255)
    return {"n": np.minimum(count, 255).astype(np.uint8), "over": np.stack([big, count[big]]).astype(np.int64)}


#: What is known of a word: contexts it follows, its count; its count as a context, followers seen once, twice, more.
_NODE = ["follows", "count", "total", "m1", "m2", "m3"]
_STATS = ["shard", "word", "stat", "n1", "n2", "n3", "n4"]


def _sums(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of each column over their rows."""
    order = np.argsort(keys)
    at = _runs(keys[order])
    sums = [np.add.reduceat(c[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for c in columns]
    return keys[order][at], np.stack(sums, axis=1)


def _merge(t: pa.Table, folder: str, model: dict) -> pa.Table:
    """One shard of pairs: stores them; gives what it knows of words, and the tally of its counts as shard -1."""
    shard = int(t["shard"][0].as_py())
    ctx = np.repeat(_u(t["ctx"], "<u8"), _u(t["many"], "<u4"))
    word, count = _u(t["word"], "<u8"), _u(t["count"], "<u4").astype(np.int64)
    key = pair(ctx, word)
    order = np.argsort(key)
    at = _runs(key[order])
    count, first = np.add.reduceat(count[order], at), order[at]
    key, ctx, word = key[first], ctx[first], word[first]
    save_arrays(f"{folder}/pair-{shard}", {"key": key, **_small(count)})
    tally = [int((count == i).sum()) for i in (1, 2, 3, 4)]
    del t, key, order, first, at
    one, none = np.ones(len(count), np.int64), np.zeros(len(count), np.int64)
    ahead = _sums(word, [one, count, none, none, none, none])
    behind = _sums(ctx, [none, none, count, count == 1, count == 2, count >= 3])
    word, stat = _sums(np.concatenate([ahead[0], behind[0]]), list(np.concatenate([ahead[1], behind[1]]).T))
    to = node_shard(word, model)
    order = np.argsort(to, kind="stable")
    cuts = np.append(_runs(to[order]), len(order))
    rows = [(int(to[order[a]]), word[order[a:b]].tobytes(), stat[order[a:b]].astype("<i8").tobytes(), 0, 0, 0, 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    rows.append((-1, b"", b"", *tally))
    del one, none, ahead, behind, word, stat, to, order, ctx, count
    give_back()
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(_STATS)})


_TOTALS = ["shard", "words", "tokens", "pairs", "n1", "n2", "n3", "n4"]


def _merge_words(t: pa.Table, folder: str) -> pa.Table:
    """One shard of words: stores what is known of each; gives sums. Shard -1 sums pairs' tallies."""
    shard = int(t["shard"][0].as_py())
    if shard < 0:
        row = [-1, 0, 0, 0, *(sum(t[n].to_pylist()) for n in ("n1", "n2", "n3", "n4"))]
    else:
        word, stat = _sums(_u(t["word"], "<u8"), list(_u(t["stat"], "<i8").reshape(-1, len(_NODE)).T))
        save_arrays(f"{folder}/word-{shard}", {"key": word, "stat": stat})
        follows, count = stat[:, 0], stat[:, 1]
        row = [shard, int((count > 0).sum()), int(count.sum()), int(follows.sum()), *(int((follows == i).sum()) for i in (1, 2, 3, 4))]
    return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(_TOTALS, row, strict=True)})


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of some texts with their counts; those of one occurrence go together as an unnamed rest."""
    for batch in batches:
        for buf, bounds, _, _ in _pieces(batch.column("text"), SORTED_TOKENS):
            ctx, n = np.unique(tokens(buf, bounds)[1], return_counts=True)
            rest = int(n[n == 1].sum())
            ctx, n = np.append(ctx[n > 1].view(np.int64), 0), np.append(n[n > 1], rest)
            yield pa.RecordBatch.from_arrays([pa.array(ctx), pa.array(n.astype(np.int64))], names=["ctx", "n"])


def _split_contexts(docs: DataFrame, size: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with more than half a shard's tokens, and over how many shards each is dealt.

    This sets where counts are kept, not what they are: it comes from SAMPLE_BYTES of texts, picked by hash.
    """
    if shards < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(-(-size // SAMPLE_BYTES))) == 0).select("text")
    found = stage(some.mapInArrow(lambda it: trimmed(_frequencies(it)), "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n")), "kneser-ney-contexts")
    total = found.agg(F.sum("n")).first()[0] or 1
    rows = found.where(F.col("n") * 2 * shards > total).where("ctx <> 0").collect()  # fewer than 2 * shards
    rows = sorted((r["ctx"] % (1 << 64), -(-r["n"] * shards // total)) for r in rows)
    return np.array([c for c, _ in rows], np.uint64), np.array([n for _, n in rows], np.uint64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts 1, 2 and 3 or more; where too few counts are known, a fixed share of the count."""
    if min(n1, n2, n3) == 0:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]


def fit(docs: DataFrame, shards: int | None = None) -> dict:
    """Counts every text of ``docs`` and stores the model in the shared folder; returns its place and totals.

    The number of shards follows from the bytes of text. Null and empty texts are an end alone; rows that repeat
    count each time; an empty table gives a model of nothing. Columns other than text aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = scratch_path(spark, "kneser-ney")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shards = shards or max(1, -(-size // SHARD_BYTES))
    hot, spread = _split_contexts(docs, max(size, 1), shards)
    at = {"folder": folder, "shards": shards, "hot": hot, "spread": spread}
    blocks = docs.select("text").mapInArrow(lambda it: trimmed(_count(it, at)), "shard long, ctx binary, many binary, word binary, count binary")
    merged = blocks.groupBy("shard").applyInArrow(lambda t: _merge(t, folder, at), "shard long, word binary, stat binary, n1 long, n2 long, n3 long, n4 long")
    totals = merged.groupBy("shard").applyInArrow(lambda t: _merge_words(t, folder), ", ".join(f"{c} long" for c in _TOTALS))
    sums = stage(totals, "kneser-ney-totals").groupBy((F.col("shard") < 0).alias("tally")).agg(*[F.sum(c).alias(c) for c in _TOTALS[1:]])
    rows = {r["tally"]: r for r in sums.collect()}
    get = lambda tally, c: int(rows[tally][c]) if tally in rows else 0
    once, pairs = ([get(k, n) for n in ("n1", "n2", "n3", "n4")] for k in (False, True))
    return {
        **at, "words": get(False, "words"), "tokens": get(False, "tokens"), "pairs": get(False, "pairs"),
        "d2": discounts(*pairs), "d1": discounts(*once), "once": once,
    }


def _open(uri: str) -> dict[str, np.ndarray] | None:
    if uri in _OPEN:
        _OPEN.move_to_end(uri)
        return _OPEN[uri]
    try:
        found = map_arrays(uri)
    except FileNotFoundError:
        found = None
    _OPEN[uri] = found
    if len(_OPEN) > MAPPED:
        _OPEN.popitem(last=False)
    return found


def _lookup(folder: str, kind: str, values: np.ndarray, shard: np.ndarray, read, width: int) -> np.ndarray:
    """Rows of stored statistics for sorted distinct ``values`` by their shards; zeros where unknown."""
    out = np.zeros((len(values), width), np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.append(_runs(shard[order]), len(order))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = order[a:b]
        stored = _open(f"{folder}/{kind}-{int(shard[some[0]])}")
        if stored is None or not len(stored["key"]):
            continue
        keys = stored["key"]
        at = np.searchsorted(keys, values[some])
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == values[some][hit]
        out[some[hit]] = read(stored, at[hit])
    return out


def _counts(stored: dict, at: np.ndarray) -> np.ndarray:
    n = np.asarray(stored["n"][at]).astype(np.int64)
    big = np.flatnonzero(n == 255)
    if len(big):
        n[big] = stored["over"][1][np.searchsorted(stored["over"][0], at[big])]
    return n[:, None]


def _tokens_scored(model: dict, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability and training count of each token."""
    folder = model["folder"]
    words, back = np.unique(np.concatenate([token, before]), return_inverse=True)
    stat = _lookup(folder, "word", words, node_shard(words, model), lambda stored, at: stored["stat"][at], len(_NODE))
    follows, count, total, m1, m2, m3 = stat.T
    back, ctx_back = back[: len(token)], back[len(token) :]
    d1, pairs, v = np.array([0.0, *model["d1"]]), max(model["pairs"], 1), model["words"]
    once = model["once"]
    rest = (d1[1] * once[0] + d1[2] * once[1] + d1[3] * (v - once[0] - once[1])) / pairs if v else 1.0
    p1 = np.maximum(follows - d1[np.minimum(follows, 3)], 0) / pairs + rest / (v + 1)
    d2 = np.array([0.0, *model["d2"]])
    gamma = np.where(total > 0, (d2[1] * m1 + d2[2] * m2 + d2[3] * m3) / np.maximum(total, 1), 1.0)
    keys, first, key_back = np.unique(pair(before, token), return_index=True, return_inverse=True)
    seen = _lookup(folder, "pair", keys, pair_shard(before[first], token[first], model), _counts, 1)[:, 0]
    kept = np.maximum(seen - d2[np.minimum(seen, 3)], 0)[key_back] / np.maximum(total, 1)[ctx_back]
    return np.log10(kept + gamma[ctx_back] * p1[back]), count[back]


def _score(batches: Iterator[pa.RecordBatch], model: dict, keep: list[str]) -> Iterator[pa.RecordBatch]:
    n_all, v = model["tokens"], model["words"]
    for batch in batches:
        for buf, bounds, i, j in _pieces(batch.column("text"), SCORED_TOKENS):
            token, before, at = tokens(buf, bounds)
            score, count = _tokens_scored(model, token, before)
            base = np.log10((count + 1) / (n_all + v + 1))
            sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), base, score)]
            cols = [batch.column(c).slice(i, j - i) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(at)), *map(pa.array, sums)], names=[*keep, "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Kept columns, n_tokens, n_known, train_tokens, base_score, score and perplexity of every text.

    Null and empty texts have one token, the end; a long one is scored whole. With nothing learned every token is
    unknown and has probability 1. Repeated rows are scored each; an empty table gives no rows. A kept column that
    has the name of one of these gives way to it.
    """
    keep = [c for c in keep if c not in ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")]
    ship(docs.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    out = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: trimmed(_score(it, model, keep)), f"{kept}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model["tokens"]).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
