"""Packing by concatenate-and-cut: two-pass prefix sums over partition token totals, then fixed windows.

Pass 1 tokenises each text once and writes its ids with the place inside its partition. The partition totals
(one row for each task) give global offsets by a prefix sum; pass 2 cuts the ids at multiples of the window, and
a document that crosses a bound leaves one boundary record in each window.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textkernel as tk
from .common import stage, trimmed

#: Units that a task keeps from one slice of texts to the next, and bytes of text it handles at a time.
CACHE_UNITS = 400_000
TEXT_BYTES = 2 << 20
#: Units encoded as one text, and compared at a time; the mark that stands between two of them.
RUN = 8000
MARK = "\U0010fffe"
_STATE: dict = {}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


class UnitTokenizer:
    """Token ids of whole texts; each distinct blank-led unit of a batch is encoded once, and kept for the next.

    The byte-level pre-tokenizer always breaks before a blank that follows a visible ASCII character or precedes
    one, and between an ASCII letter and a mark after it; what stands on either side doesn't change the other's
    tokens. So texts are cut there, and the ids of a text are those of its units, one after another.

    Units are encoded many at a time, with a mark between them that is a token of its own: the tokenizer takes what
    stands between two marks by itself. Units among which the mark occurs are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads keep memory of their own
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer, self.marked = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.marked.encode_special_tokens = True
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.marked.add_tokens([AddedToken(MARK, normalized=False, special=False)])
        self.mark = self.marked.token_to_id(MARK)
        self.clear()

    def clear(self):
        """Forgets all units: a worker outlives its tasks, and other operators need its memory."""
        self.known = np.zeros(0, np.uint64)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.byte_at, self.bytes, self.raw = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _encode(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all ids, of units of ``size`` bytes that stand one after another in ``raw``."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, self.dtype)]
        at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        for i in range(0, len(size), RUN):
            cuts = at[i : i + RUN + 1] - at[i]
            some = raw[at[i] : at[i] + cuts[-1]]
            if MARK.encode() in some.tobytes():
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    ids = self.tokenizer.encode(some[a:b].tobytes().decode(), add_special_tokens=False).ids
                    sizes.append(np.array([len(ids)], np.int64))
                    flat.append(np.array(ids, self.dtype))
                continue
            # no byte of UTF-8 is 0xFF
            text = np.insert(some, cuts[1:-1], 0xFF).tobytes().replace(b"\xff", MARK.encode()).decode()
            ids = np.array(self.marked.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            between = ids == self.mark
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1)
            flat.append(ids[~between].astype(self.dtype))
        return np.concatenate(sizes), np.concatenate(flat)

    def ids(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and their number in each."""
        texts = len(bounds) - 1
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        visible = (buf > 0x20) & (buf < 0x7F)
        cut = np.zeros(len(buf), bool)
        cut[1:-1] = (buf[1:-1] == 0x20) & (visible[:-2] | visible[2:])
        cut[-1] = len(buf) > 1 and buf[-1] == 0x20 and visible[-2]
        first = bounds[:-1][np.diff(bounds) > 0]
        cut[1:] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
        # a blank at a text's start or end has a neighbour of another text; both are cut or kept safely
        cut[np.minimum(first, len(buf) - 1)] = True
        last = bounds[1:][np.diff(bounds) > 0] - 1
        before = np.maximum(last - 1, 0)
        cut[last] &= np.isin(last, first) | ((buf[last] == 0x20) & visible[before]) | (_MARK[buf[last]] & _LETTER[buf[before]])
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(buf))
        back, h = pd.factorize(tk.hashes(buf, starts, ends))
        where = np.empty(len(h), np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        spot = np.searchsorted(self.known, h)
        old = np.zeros(len(h), bool)
        inside = spot < len(self.known)
        old[inside] = self.known[spot[inside]] == h[inside]
        if not (_alike(buf, starts, ends, buf, starts[where[back]], (ends - starts)[where[back]]) and _alike(buf, starts[where[old]], ends[where[old]], self.raw, self.byte_at[spot[old]], self.bytes[spot[old]])):
            return self._one_by_one(buf, starts, ends, bounds)
        new = np.flatnonzero(~old)
        first, n = starts[where[new]], (ends - starts)[where[new]]
        sizes, flat = self._encode(buf[_places(first, n)], n)
        at, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        at[old], size[old] = self.at[spot[old]], self.size[spot[old]]
        at[new], size[new] = len(self.flat) + np.cumsum(sizes) - sizes, sizes
        flat = np.concatenate([self.flat, flat])
        length = size.astype(np.int32)[back]
        out = flat[_places(at[back], length)]
        if len(self.known) + len(new) > CACHE_UNITS:
            self.clear()  # over the bound only this slice's units stay
            new, flat, at = np.arange(len(h)), flat[_places(at, size)], np.cumsum(size) - size
        first, n = starts[where[new]], (ends - starts)[where[new]]
        byte_at = np.concatenate([self.byte_at, len(self.raw) + np.cumsum(n) - n])
        known, at, size, n_all = np.concatenate([self.known, h[new]]), np.concatenate([self.at, at[new]]), np.concatenate([self.size, size[new]]), np.concatenate([self.bytes, n])
        order = np.argsort(known)
        self.known, self.at, self.size, self.byte_at, self.bytes = known[order], at[order], size[order], byte_at[order], n_all[order]
        self.flat, self.raw = flat, np.concatenate([self.raw, buf[_places(first, n)]])
        return out, _per_text(length, starts, bounds)

    def _one_by_one(self, buf, starts, ends, bounds) -> tuple[np.ndarray, np.ndarray]:
        """The same for a slice in which two units share a hash: every unit is encoded where it stands."""
        sizes, flat = self._encode(buf, ends - starts)
        return flat, _per_text(sizes, starts, bounds)


def _places(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places at..at + size of each run, one after another."""
    begin = np.cumsum(size, dtype=np.int64) - size
    return np.repeat(at - begin, size) + np.arange(int(size.sum(dtype=np.int64)))


def _per_text(length: np.ndarray, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    return np.diff(total[np.searchsorted(starts, bounds)])


def _alike(buf, starts, ends, other, at, size) -> bool:
    """Whether all spans have the bytes of the spans that stand for them: equal hashes alone don't say so."""
    if not np.array_equal(ends - starts, size):
        return False
    for i in range(0, len(size), RUN):
        a, b, n = starts[i : i + RUN], at[i : i + RUN], size[i : i + RUN]
        if not np.array_equal(buf[_places(a, n)], other[_places(b, n)]):
            return False
    return True


def _slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about TEXT_BYTES."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(max(int(np.searchsorted(bounds, bounds[i] + TEXT_BYTES, "right")) - 1, i + 1), n)
        yield i, j
        i = j


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if path not in _STATE:
        _STATE[path] = UnitTokenizer(path)
    tok: UnitTokenizer = _STATE[path]
    part, place = TaskContext.get().partitionId(), 0
    try:
        for batch in batches:
            buf, bounds = tk.utf8(batch.column("text"))
            for i, j in _slices(bounds):
                ids, n = tok.ids(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                ends = np.cumsum(n + 1)
                full = np.empty(len(ids) + len(n), tok.dtype)
                mask = np.ones(len(full), bool)
                mask[ends - 1] = False
                full[mask], full[~mask] = ids, end_id
                offsets = np.concatenate([[0], ends]) * full.itemsize
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(full)]).cast(pa.binary())
                cols = [batch.column(c).slice(i, j - i) for c in keep]
                at = place + ends - (n + 1)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(n), part, np.int64)), pa.array(at), pa.array(n + 1), blobs], names=[*keep, "_part", "_at", "_n", "_ids"])
                place += int(ends[-1])
    finally:
        tok.clear()


def _cut(batches: Iterator[pa.RecordBatch], keep: list[str], window: int, dtype: str) -> Iterator[pa.RecordBatch]:
    names = [*keep, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    for batch in batches:
        rows, start, length, total, seq, off, ids, held = [], [], [], [], [], [], [], 0

        def flush():
            take = pa.array(rows, pa.int64())
            cols = [batch.column(c).take(take) for c in keep]  # noqa: B023
            return pa.RecordBatch.from_arrays(
                [*cols, *(pa.array(x, pa.int64()) for x in (start, length, total, seq, off)), pa.array(ids, pa.binary())],
                names=names,
            )

        at_all, n_all, blobs = batch.column("_at").to_numpy(), batch.column("_n").to_numpy(), batch.column("_ids")
        for r in range(batch.num_rows):
            at, n = int(at_all[r]), int(n_all[r])
            wide = np.frombuffer(blobs[r].as_buffer(), dtype).astype("<u4")
            done = 0
            while done < n:
                here = min(n - done, window - (at + done) % window)
                rows.append(r)
                start.append(done)
                length.append(here)
                total.append(n)
                seq.append((at + done) // window)
                off.append((at + done) % window)
                ids.append(wide[done : done + here].tobytes())
                held += here
                done += here
                if held > 4_000_000:
                    yield flush()
                    rows, start, length, total, seq, off, ids, held = [], [], [], [], [], [], [], 0
        if rows:
            yield flush()


def concatenate_and_cut(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Pieces (id, kept columns, start, length, doc_tokens, sequence_id, offset, ids) of all rows of ``docs``.

    Sequences hold ``window`` tokens each, but for the last. ``ids`` are little-endian unsigned 32-bit. Null
    and empty texts are the end id alone; repeated rows, ids that repeat and null ids are packed as often as they
    stand; a long text is tokenised whole and cut into as many pieces as it takes; an empty table gives no rows;
    columns not named in ``keep`` are left out, whatever their names.
    """
    if window < 1:
        raise ValueError("window must be positive")
    ship(docs.sparkSession)
    keep = [id_col, *(keep or [])]
    source = docs.select(*keep, "text")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text" or "text" in keep]
    first = source.mapInArrow(lambda it: trimmed(_tokenise(it, tokenizer_path, end_id, keep)), ", ".join([*kept, "_part long", "_at long", "_n long", "_ids binary"]))
    tokens = stage(first, "packed-ids")
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("n")).orderBy("_part").collect()  # one row a task
    offsets = np.concatenate([[0], np.cumsum([r["n"] for r in totals])]).tolist()
    spark = docs.sparkSession
    bases = spark.createDataFrame([(r["_part"], int(o)) for r, o in zip(totals, offsets, strict=False)], "_part long, _base long")
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    placed = tokens.join(F.broadcast(bases), "_part").select(*keep, (F.col("_at") + F.col("_base")).alias("_at"), "_n", "_ids")
    return placed.mapInArrow(lambda it: trimmed(_cut(it, keep, window, dtype)), ", ".join([*kept, "start long", "length long", "doc_tokens long", "sequence_id long", "offset long", "ids binary"]))
