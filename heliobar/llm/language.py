"""Language identification by hierarchical discrimination.

Languages are joined to families by the likeness of their mean character n-gram profiles. One linear support
vector machine against the rest for each family picks the family; one-versus-one machines inside it vote for the
language. Profiles are byte 2- and 4-grams of the whole text, letters only, hashed. They stay sparse, and every
machine is trained in a task of its own, so that the driver holds a mean for each language and the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textkernel as tk
from .common import stage

#: Hashed profile cells of each gram length.
CELLS = 1 << 13
#: Labelled documents of each language that the machines learn from, about.
SAMPLE_PER_LANGUAGE = 500
#: Machines whose margins are summed at a time.
TOGETHER = 8
SCALE = 30.0
_BYTES = 1 << 20

_LUT = np.full(256, 0x20, np.uint8)
_LUT[97:123] = np.arange(97, 123)
_LUT[65:91] = np.arange(97, 123)
_LUT[128:] = np.arange(128, 256)


def _cells(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the 2- and 4-gram that begin at each byte (2 * CELLS where none does), and the texts' new bounds."""
    c = _LUT[buf]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0x20) | (c[:-1] != 0x20)
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    c = c[keep].astype(np.uint32)
    n = len(c)
    two, four = np.full(n, 2 * CELLS, np.int64), np.full(n, 2 * CELLS, np.int64)
    if n >= 2:
        two[:-1] = (((c[:-1] << np.uint32(8)) | c[1:]) * np.uint32(2654435761)) >> np.uint32(19)
    if n >= 4:
        g = (c[:-3] << np.uint32(24)) | (c[1:-2] << np.uint32(16)) | (c[2:-1] << np.uint32(8)) | c[3:]
        four[:-3] = ((g * np.uint32(2246822519)) >> np.uint32(19)) + np.uint32(CELLS)
    ends = at[1:][np.diff(at) > 0]
    two[ends - 1] = 2 * CELLS
    for back in (1, 2, 3):
        four[np.maximum(ends - back, 0)] = 2 * CELLS
    return two, four, at


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    buf, bounds = tk.utf8(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + _BYTES, "right")) - 1, i + 1), n)
        yield buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i, j
        i = j


def _sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, x.shape[1]), x.dtype)
    some = np.diff(at) > 0
    if some.any():
        out[some] = np.add.reduceat(x, at[:-1][some], axis=0)
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for buf, bounds, i, j in _parts(batch.column("text")):
            two, four, at = _cells(buf, bounds)
            cells, counts = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                k, n = np.unique(np.concatenate([two[a:b], four[a:b]]), return_counts=True)
                cells.append(k[k < 2 * CELLS].astype("<u2").tobytes())
                counts.append(n[k < 2 * CELLS].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "cells", "counts"])


def _sparse(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cells and scaled shares of each profile."""
    out = []
    for cells, counts in zip(t["cells"].to_pylist(), t["counts"].to_pylist(), strict=True):
        n = np.frombuffer(counts, "<u4")
        out.append((np.frombuffer(cells, "<u2").astype(np.int64), (SCALE * n / max(n.sum(), 1)).astype(np.float32)))
    return out


def _mean(t: pa.Table) -> pa.Table:
    mean = np.zeros(2 * CELLS, np.float32)
    for cells, x in _sparse(t):
        mean[cells] += x / t.num_rows
    return pa.table({"lang": t["lang"].slice(0, 1), "mean": pa.array([mean.astype("<f4").tobytes()], pa.binary())})


def _machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised hinge-loss machine, by dual coordinate descent; y is +1 or -1."""
    rng, n = np.random.default_rng(3), len(y)
    norm = np.array([float(v @ v) + 1.0 for _, v in x])
    alpha, w, b = np.zeros(n), np.zeros(2 * CELLS, np.float32), 0.0
    costs = np.where(y > 0, cost * n / max(2 * (y > 0).sum(), 1), cost * n / max(2 * (y < 0).sum(), 1))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            cells, v = x[i]
            g = y[i] * (float(v @ w[cells]) + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), costs[i])
            d = (new - alpha[i]) * y[i]
            if d:
                w[cells] += np.float32(d) * v
                b += d
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, b


def _train(t: pa.Table) -> pa.Table:
    """The machine of one group of rows (machine, side, cells, counts), whatever order they come in."""
    t = t.take(pa.compute.sort_indices(t, [("side", "ascending"), ("cells", "ascending"), ("counts", "ascending")]))
    w, b = _machine(_sparse(t), t["side"].to_numpy().astype(np.float64))
    return pa.table({"machine": t["machine"].slice(0, 1), "w": pa.array([w.astype("<f4").tobytes()], pa.binary()), "b": pa.array([float(b)])})


def families(means: np.ndarray) -> list[list[int]]:
    """Average-linkage clusters of languages, joined while they are more alike than languages are on average."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    like = unit @ unit.T
    n = len(means)
    groups = [[i] for i in range(n)]
    level = like[np.triu_indices(n, 1)].mean() if n > 1 else 0.0
    while len(groups) > 1:
        best = max((like[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if best[0] < level:
            break
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    return [sorted(g) for g in groups]


def fit(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id") -> dict:
    """Learns from text and non-null lang of ``docs``; a hash of the id picks ``sample`` rows a language, about.

    The number of languages isn't limited: machines are trained in tasks. The driver and the model hold 64 KB for
    each language, each family and each pair of languages of one family.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), sample / F.count("*")).alias("_share"))
    drawn = rows.select(F.col(id_col).alias("_id"), "lang", "text").join(F.broadcast(shares), "lang")  # a row a language
    drawn = drawn.where(F.pmod(F.xxhash64(F.lit(41), "_id"), F.lit(1 << 30)) < F.col("_share") * (1 << 30))
    found = stage(drawn.select("lang", "text").mapInArrow(_profiles, "lang string, cells binary, counts binary"), "lang-profiles")
    means = {r["lang"]: np.frombuffer(r["mean"], "<f4") for r in found.groupBy("lang").applyInArrow(_mean, "lang string, mean binary").collect()}
    names = sorted(means)
    if not names:
        return {"names": [], "families": []}
    groups = families(np.stack([means[k] for k in names]))
    pairs = [[(a, b) for i, a in enumerate(g) for b in g[i + 1 :]] for g in groups]
    sides, heads = [], len(groups) if len(groups) > 1 else 0
    for f in range(heads):
        sides += [(name, f, 1 if k in groups[f] else -1) for k, name in enumerate(names)]
    number = heads
    for some in pairs:
        for a, b in some:
            sides += [(names[a], number, 1), (names[b], number, -1)]
            number += 1
    weights, biases = np.zeros((number, 2 * CELLS), np.float32), np.zeros(number)
    if number:
        dealt = found.join(F.broadcast(spark.createDataFrame(sides, "lang string, machine int, side int")), "lang")
        trained = dealt.select("machine", "side", "cells", "counts").groupBy("machine").applyInArrow(_train, "machine int, w binary, b double")
        for r in trained.collect():  # a row a machine
            weights[r["machine"]], biases[r["machine"]] = np.frombuffer(r["w"], "<f4"), r["b"]
    at = np.cumsum([heads, *map(len, pairs)])
    return {
        "names": names, "families": groups, "pairs": pairs, "heads": _blocks(weights[:heads]), "head_bias": biases[:heads],
        "tables": [_blocks(weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)],
        "biases": [biases[a:b] for a, b in zip(at[:-1], at[1:], strict=True)],
    }


def _blocks(weights: np.ndarray) -> list[np.ndarray]:
    """Weights by cell, some machines together; the row after the last is that of no cell."""
    padded = np.concatenate([weights, np.zeros((len(weights), 1), np.float32)], axis=1)
    return [np.ascontiguousarray(padded[i : i + TOGETHER].T) for i in range(0, len(weights), TOGETHER)]


def _margins(blocks: list[np.ndarray], bias: np.ndarray, two: np.ndarray, four: np.ndarray, at: np.ndarray) -> np.ndarray:
    count = np.maximum(_sums(((two < 2 * CELLS).astype(np.int64) + (four < 2 * CELLS))[:, None], at), 1)
    sums = [_sums(b[two] + b[four], at) for b in blocks]
    return SCALE * np.concatenate([*sums, np.zeros((len(at) - 1, 0), np.float32)], axis=1) / count + bias


def _near(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))


def decide(model: dict, two: np.ndarray, four: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text: its family's machine first, then the pairs of that family only."""
    n = len(at) - 1
    best, score, family = np.zeros(n, int), np.ones(n), np.zeros(n, int)
    if len(model["families"]) > 1:
        margins = _margins(model["heads"], model["head_bias"], two, four, at)
        family = margins.argmax(axis=1)
        score = _near(margins[np.arange(n), family])
    for f, g in enumerate(model["families"]):
        here = np.flatnonzero(family == f)
        if len(here) and len(g) > 1:
            size = np.diff(at)[here]
            ends = np.concatenate([[0], np.cumsum(size)])
            place = np.repeat(at[here] - ends[:-1], size) + np.arange(int(ends[-1]))
            margins = _margins(model["tables"][f], model["biases"][f], two[place], four[place], ends)
            votes, margin, chance = (np.full((len(here), len(g)), x) for x in (0.0, 0.0, 1.0))
            for k, (a, b) in enumerate(model["pairs"][f]):
                m, i, j = margins[:, k], g.index(a), g.index(b)
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                margin[:, i] += m
                margin[:, j] -= m
                chance[:, i], chance[:, j] = np.minimum(chance[:, i], _near(m)), np.minimum(chance[:, j], _near(-m))
            pick = (votes + 1e-3 * np.tanh(margin)).argmax(axis=1)
            best[here] = np.array(g)[pick]
            score[here] *= chance[np.arange(len(here)), pick]
        else:
            best[here] = g[0]
    return best, score


def _predict(batches: Iterator[pa.RecordBatch], held, keep: list[str]) -> Iterator[pa.RecordBatch]:
    model = held.value
    names = np.array(model["names"], object)
    for batch in batches:
        for buf, bounds, i, j in _parts(batch.column("text")):
            texts = batch.column("text").slice(i, j - i)
            ascii_letter = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((_LUT[buf] != 0x20) & (buf < 128), out=ascii_letter[1:])
            letters = np.diff(ascii_letter[bounds]) > 0
            for k in np.flatnonzero(~letters & (np.diff(bounds) > 0)):
                letters[k] = any(ch.isalpha() for ch in texts[int(k)].as_py() or "")
            lang, score = np.full(j - i, "und", object), np.zeros(j - i)
            if len(names):
                best, s = decide(model, *_cells(buf, bounds))
                lang[letters], score[letters] = names[best[letters]], s[letters]
            cols = [batch.column(c).slice(i, j - i) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Kept columns, lang_pred and score (0 to 1) of every whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is all with nothing learned. Long texts are
    read whole; of equal votes the larger sum of margins decides, then the first language. The model is broadcast: its
    size is set by CELLS and the languages (see ``fit``). Repeated rows are predicted each; an empty table gives no
    rows; a kept column named lang_pred or score gives way to the operator's.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda it: _predict(it, held, keep), f"{kept}, lang_pred string, score double")
