import hashlib
import math
import random
import re
import string
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliobar.llm import kneser_ney, language, minhash, mixing, packing, queries, rotation, secrets, topk, toxicity, warc
from heliobar.llm import textkernel as tk
from heliobar.llm.common import connected_components

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ODD = [None, "", " ", "\n\t", "a", "A a", "one two three four", "one two three four five", "x" * 50_000, "ä ö " * 9000, "日本 語", "é", "12 34", "###"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, v string, key string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, None if i % 5 == 0 else f"s{i % 3}", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeiou") for _ in range(r.randint(2, 6))) for _ in range(200)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(n)]


def components(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_words_and_hashes_follow_the_pattern():
    texts = ["", " a b", "ab\x0bc\x1cd e", "ä b c", "a" * 300_000 + " b"]
    buf, bounds = tk.utf8(pa.array([*texts, None]))
    starts, ends, ranges = tk.words(buf, bounds)
    raw = buf.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(ranges[i], ranges[i + 1])] for i in range(6)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts] + [[]]
    h = tk.hashes(buf, starts, ends)
    flat = [w for g in got for w in g]
    assert len(set(flat)) == len(set(h.tolist()))
    assert all(h[i] == h[j] for i, a in enumerate(flat) for j, b in enumerate(flat) if a == b)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 99)] + [(5, 5)]
    want = components(100, [(a, b) for a, b in links if a != b])
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = [*ODD, "<|endoftext|> x", "a  b   c \n d", *corpus(20), *corpus(5)]
    got = packing.concatenate_and_cut(docs(spark, texts), path, window=64).collect()
    assert sorted({r["sequence_id"] for r in got}) == list(range(max(r["sequence_id"] for r in got) + 1))
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum((list(struct.unpack(f"<{r['length']}I", r["ids"])) for r in pieces), []) == ids
        assert all(r["doc_tokens"] == len(ids) for r in pieces)
    places = sorted((r["sequence_id"] * 64 + r["offset"], r["length"]) for r in got)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert packing.concatenate_and_cut(docs(spark, ["a"]).limit(0), path).count() == 0


def test_units_that_share_a_hash_are_encoded_apart(monkeypatch):
    path = queries.tokenizer_path()
    texts = [*corpus(10), "plain words, and marks; (some)", ""]
    tok = packing.UnitTokenizer(path)
    buf, bounds = tk.utf8(pa.array(texts))
    want = tok.ids(buf, bounds)
    assert all(np.array_equal(a, b) for a, b in zip(tok.ids(buf, bounds), want, strict=True))  # all from memory
    monkeypatch.setattr(packing.tk, "hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    got = packing.UnitTokenizer(path).ids(buf, bounds)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    monkeypatch.setattr(packing.tk, "hashes", lambda buf, starts, ends: np.full(len(starts), tok.known[0], np.uint64))
    assert all(np.array_equal(a, b) for a, b in zip(tok.ids(buf, bounds), want, strict=True))


def test_units_are_encoded_many_at_a_time(monkeypatch):
    """Runs of units make one text for the tokenizer, also where the mark between them stands in a text; the ids are those of whole texts."""
    from tokenizers import Tokenizer

    path, asked = queries.tokenizer_path(), []
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **more):
            asked.append(1)
            return self.inner.encode(text, **more)

        def encode_batch_fast(self, some, **more):
            asked.append(len(some))
            return self.inner.encode_batch_fast(some, **more)

    texts = [x or "" for x in ODD] + corpus(60)
    for more, most in ([], 10), (["\U0010fffe", "a\U0010fffe b \U0010fffe\U0010fffe.", "<|endoftext|>\U0010fffe"], 10_000):
        tok = packing.UnitTokenizer(path)
        for name, value in list(vars(tok).items()):
            if isinstance(value, Tokenizer):
                setattr(tok, name, Counted(value))
        ids, n = tok.ids(*tk.utf8(pa.array([*texts, *more])))
        want = [t.encode(x, add_special_tokens=False).ids for x in [*texts, *more]]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(x) for x in want]
        assert sum(asked) <= most
        asked.clear()


def test_packing_takes_little_memory():
    """Arrays stay below 100 MB however much text a batch holds: it is handled in slices."""
    import tracemalloc

    r = np.random.default_rng(5)
    letters = r.integers(97, 123, 4_500_000).astype(np.uint8)
    letters[r.random(len(letters)) < 0.2] = 32
    tok = packing.UnitTokenizer(queries.tokenizer_path())
    buf, bounds = letters, np.linspace(0, len(letters), 1001).astype(np.int64)
    tracemalloc.start()
    try:
        for i, j in packing._slices(bounds):
            tok.ids(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_packing_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "d", "x"), (None, None, "x")], "doc_id long, text string, start string")
    got = packing.concatenate_and_cut(df, queries.tokenizer_path(), window=4).collect()
    assert sum(r["length"] for r in got) == 4 + 4 + 2 + 1
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == [("1", 4), ("1", 4), ("None", 1), ("None", 2)]


def test_water_filling():
    assert mixing.water_fill([10, 10], [1, 3], 3) == [5, 15]
    assert mixing.water_fill([1, 99], [3, 1], 3) == [3, 97]
    assert mixing.water_fill([0, 10], [1, 1], 3) == [0, 10]
    with pytest.raises(ValueError):
        mixing.water_fill([1], [0], 3)


def test_mixing_meets_targets_and_reruns_agree(spark):
    texts = [*ODD, *corpus(300)]
    rows = docs(spark, texts)
    a = mixing.mix_sources(rows).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, mixing.mix_sources(rows.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=repr)
    assert all(r["size"] == len(words(texts[r["doc_id"]])) and r["taken"] <= 3 * r["size"] for r in a)
    for s in {r["source"] for r in a}:
        mine = [r for r in a if r["source"] == s]
        assert 0 <= mine[0]["target"] - sum(r["taken"] for r in mine) < 60 or any(r["size"] == 18_000 for r in mine)
    assert mixing.mix_sources(docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_against_brute_force(spark, percent):
    r = random.Random(4)
    texts = [*ODD, *corpus(30, 9)]
    base = corpus(4, 11)
    long = [" ".join(corpus(6, k)) for k in range(3)]
    for t in [*base, *long]:
        w = t.split()
        for edits in (0, 1, 1, 2, 3, 5, 8):
            c = list(w)
            for _ in range(edits):
                c[r.randrange(len(c))] = "zz" + str(r.randrange(99))
            texts += [" ".join(c), " ".join(c).upper()]
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    got = minhash.near_duplicates(docs(spark, texts), percent).collect()
    assert len(got) == len(texts)
    for x in got:
        assert (x["n_shingles"], x["component_id"], x["kept"]) == (len(sets[x["doc_id"]]), want[x["doc_id"]], want[x["doc_id"]] == x["doc_id"])
    assert minhash.near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_minhash_with_repeated_and_null_ids(spark, monkeypatch, broadcast):
    """Rows are linked by their own texts; chosen are the rows of the first id and text of a component."""
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    w = [f"w{i}" for i in range(200)]
    near = " ".join([*w[:100], "other", *w[101:]])
    base, apart = " ".join(w), " ".join(w[::-1])
    rows = [(7, base), (None, near), (7, apart), (None, base), (None, "alone of its kind"), (None, ""), (7, base), (None, None), (3, apart), (None, "z y x"), (None, "z y x")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, key string").withColumn("h", F.xxhash64("text"))
    text = {r["h"]: r["text"] for r in df.collect()}
    got = [(x["doc_id"], text[x["h"]], x["component_id"], x["kept"], x["chosen"]) for x in minhash.near_duplicates(df, hash_col="h").collect()]
    want = [(7, 7, True, True), (None, 7, False, False), (7, 3, False, False), (None, 7, False, False), (None, None, True, True), (None, None, True, True), (7, 7, True, True), (None, None, True, True), (3, 3, True, True), (None, None, True, True), (None, None, True, True)]
    assert sorted(map(repr, got)) == sorted(repr((i, t or ("" if t == "" else None), *x[1:])) for (i, t), x in zip(rows, want, strict=True))


def test_members_of_a_bucket_meet_once_their_hub_fails():
    """Signatures agree, the hub is far from both: the two others are joined by their sets."""
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64) + 500, np.arange(13, 113, dtype=np.uint64) + 500]
    t = pa.table({
        "sig": [np.zeros(8, "<u4").tobytes()] * 3, "bands": [[1, 2]] * 3, "set": [s.tobytes() for s in sets], "root": [b"a", b"b", b"c"],
        "side": [2] * 3, "band": [0] * 3,
    })
    assert minhash._compare(t, 0.5, 85).to_pylist() == [{"u": b"b", "v": b"c"}]


def test_sets_are_read_only_for_members_that_look_alike(spark, monkeypatch):
    """Texts of similarity 0.6 share buckets; once signatures tell them apart, no set of theirs is read or dealt."""
    r = random.Random(12)
    texts = []
    for _ in range(30):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        near = list(w)
        near[150] = "other"
        apart = [x for i, x in enumerate(w) if i < 225] + [f"v{r.randrange(10**6)}" for _ in range(75)]
        texts += [" ".join(w), " ".join(near), " ".join(apart)]
    asked, full_sets = [], minhash._full_sets
    monkeypatch.setattr(minhash, "_full_sets", lambda texts, classes, some, k: asked.append(some.distinct().count()) or full_sets(texts, classes, some, k))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs(spark, texts), 85).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(90)}
    assert asked[0] > 60 and asked[1] < 10


@pytest.mark.parametrize("block", [7, 4096])
def test_topk_against_brute_force(spark, monkeypatch, block):
    """Rows that share an id, with equal and other vectors, are candidates and queries each; blocks of either side are small."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "ROWS", block)
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(60)] + [(100, None), (101, [None, 1.0]), (102, [float("nan")]), (103, [0.0] * 8), (104, rows0 := [0.5] * 8), (105, rows0), (200, [1.0, 2.0]), (120, rows0), (120, rows0), (120, [-0.5] * 8), (None, rows0), (None, [2.0] * 8), (140, [])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, row string").repartition(4)
    got = topk.exact_top_k(topk.quantised(df), "vec_id % 20 = 0", 10).collect()
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (i, v) in enumerate(ints):
        if i is not None and i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, x)), j is None, j or 0) for k, (j, x) in enumerate(ints) if k != at)[:10]
            want += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert topk.exact_top_k(topk.quantised(df.limit(0)), "vec_id % 20 = 0").count() == 0
    assert topk.exact_top_k(topk.quantised(df), F.lit(False)).count() == 0


def test_rotation_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 16))
    near = np.repeat(x[:10], 12, axis=0) + 0.12 * rng.standard_normal((120, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, near, x[:5], 2 * x[:5]]))]
    rows += [(900, None), (901, [0.0] * 16), (902, [None] * 16), (903, [float("inf")] * 16), (904, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in rotation.near_vectors(df).collect()}
    m = np.array([v for _, v in rows[:170]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    want = components(170, list(zip(*np.nonzero(np.triu(link)))))
    assert len(got) == len(rows)
    assert sum(got[i]["n_links"] for i in range(170)) >= 0.99 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(170))
    assert [got[i]["component_id"] for i in range(170)] == want
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(900, 905))
    assert rotation.near_vectors(df.limit(0)).count() == 0


def test_rotation_with_repeated_and_null_ids(spark, monkeypatch):
    """Blocks of a few rows, ids that repeat or are null, a length that few vectors have, columns that clash."""
    monkeypatch.setattr(rotation, "BLOCK", 8)
    rng = np.random.default_rng(3)
    x = np.concatenate([v + 0.02 * rng.standard_normal((30, 16)) for v in rng.standard_normal((4, 16))])
    ids = [None if i % 5 == 4 else i // 2 for i in range(len(x))]
    rows = [(i, v.tolist(), "clash", "clash") for i, v in zip(ids, x, strict=True)] + [(7, [1.0, 2.0], "c", "c"), (6, [2.0, 4.0], "c", "c"), (5, [-1.0], "c", "c")]
    got = rotation.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class string, key string")).collect()
    want = []
    for g in range(4):
        mine = ids[30 * g : 30 * g + 30]
        want += [(i, 29, min(k for k in mine if k is not None)) for i in mine]
    want += [(7, 1, 6), (6, 1, 6), (5, 0, 5)]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal(64), rng.standard_normal(64)
    x, q = x / np.linalg.norm(x), q / np.linalg.norm(q)
    found = []
    for s in range(400):
        t = rotation.rotation(64, s)
        y, z = x @ t, q @ t
        f = np.abs(y).sum() / 8
        found.append((np.sign(y) / 8) @ z / f)
    assert abs(np.mean(found) - x @ q) < 0.02


def test_warc_round_trip_and_ranges(spark, monkeypatch):
    body = "<html>ä</html>" * 100
    rows = [(1, "http://a/", body), (2, None, body), (3, "http://c/\r\nx y", body), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (7, "u", "short"), (8, "u", "\x1f\x8b\x08" * 2000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages)
    for size in (64, 300, 1 << 20):
        got = sorted(map(tuple, warc.read_archives(manifest, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], size).collect()), key=repr)
        want = []
        for i, _, h in rows:
            p = (h or "").encode()
            again = len(p) >= 1000 and i < max(k for k, _, x in rows if x == h)
            want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 3 if again else None))
        assert got == sorted(want, key=repr)
    back = warc.read_archives(manifest).collect()
    payloads = {r["page_id"]: r["payload"] for r in back}
    assert sorted((r["page_id"], str(r["url"])) for r in back) == sorted((i, str(u)) for i, u, _ in rows)
    assert bytes(payloads[3]) == body.encode() and payloads[1] is None and bytes(payloads[4]) == b""
    monkeypatch.setattr(warc, "SHARD_DIGESTS", 1)
    big = [(None, "u", "x" * 300_000), (5, "u", "x" * 300_000), (5, None, "x" * 300_000), (None, None, None)] + [(10 + i, "u", f"{i % 40}" * 1000) for i in range(200)]
    df = spark.createDataFrame(big, "page_id long, url string, html string").repartition(5)
    got = warc.read_archives(warc.write_archives(df, archive_bytes=5000), ["page_id", "payload_bytes", "record_type", "refers_to"], 999).collect()
    last = {h: max((i for i, _, x in big if x == h and i is not None), default=None) for _, _, h in big}
    want = [(i, len(h or ""), "response" if not h or i == last[h] else "revisit", None if not h or i == last[h] else last[h]) for i, _, h in big]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(empty).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 64])
def test_pairs_are_counted_in_groups(monkeypatch, shards):
    """However few tokens are sorted at a time, every pair of a task is sent once, with its count, to its shard."""
    monkeypatch.setattr(kneser_ney, "SORTED_TOKENS", 70, raising=False)
    texts = pa.array([*ODD[:8], *corpus(50, 8), *["the same words over and over " * 30] * 3])
    hot, spread = kneser_ney.tokens(*tk.utf8(pa.array(["the"])))[0][:1], np.array([3], np.uint64)
    model = {"shards": shards, "hot": hot, "spread": spread}
    token, before, _ = kneser_ney.tokens(*tk.utf8(texts))
    want = {}
    for b, t, s in zip(before.tolist(), token.tolist(), kneser_ney.pair_shard(before, token, model).tolist(), strict=True):
        want[s, b, t] = want.get((s, b, t), 0) + 1
    got = []
    for block in kneser_ney._count(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), model):
        for r in block.to_pylist():
            ctx = np.repeat(np.frombuffer(r["ctx"], "<u8"), np.frombuffer(r["many"], "<u4"))
            got += [((r["shard"], b, t), n) for b, t, n in zip(ctx.tolist(), np.frombuffer(r["word"], "<u8").tolist(), np.frombuffer(r["count"], "<u4").tolist(), strict=True)]
    assert len(got) == len(want) and dict(got) == want


def test_counting_takes_little_memory():
    """What a task holds for three million tokens are their hashes and shards; the rest goes by groups."""
    import tracemalloc

    r = np.random.default_rng(5)
    letters = r.integers(97, 123, 9_000_000).astype(np.uint8)
    letters[r.random(len(letters)) < 0.3] = 32
    texts = pa.array([letters[i : i + 9000].tobytes().decode() for i in range(0, len(letters), 9000)])
    model = {"shards": 8, "hot": np.zeros(0, np.uint64), "spread": np.zeros(0, np.uint64)}
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in kneser_ney._count(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), model)) >= 8
        assert tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("shards", [1, 16])
def test_kneser_ney_is_a_distribution_and_matches_by_hand(spark, shards):
    texts = [*ODD, *corpus(80, 8), *["the same words over and over " * 30] * 3]
    rows = docs(spark, texts)
    model = kneser_ney.fit(rows.where("doc_id % 4 <> 1"), shards=shards)
    assert (len(model["hot"]) > 0) == (shards > 1)
    got = {r["doc_id"]: r for r in kneser_ney.score(rows, model, ["doc_id"]).collect()}
    toks = [[*words(t), "</s>"] for t in texts]
    uni, bi = {}, {}
    for i, t in enumerate(toks):
        if i % 4 != 1:
            for u, w in zip(["<s>", *t], t):
                uni[w] = uni.get(w, 0) + 1
                bi[u, w] = bi.get((u, w), 0) + 1
    follows, total, kinds = {}, {}, {}
    for (u, w), c in bi.items():
        follows[w] = follows.get(w, 0) + 1
        total[u] = total.get(u, 0) + c
        kinds.setdefault(u, [0, 0, 0])[min(c, 3) - 1] += 1
    tally = lambda d: kneser_ney.discounts(*(sum(v == i for v in d.values()) for i in (1, 2, 3, 4)))
    d1, d2, n, v, pairs = [0, *tally(follows)], [0, *tally(bi)], sum(uni.values()), len(uni), len(bi)
    rest = sum(d1[min(f, 3)] for f in follows.values()) / pairs

    def p(u, w):
        f, c = follows.get(w, 0), bi.get((u, w), 0)
        low = max(f - d1[min(f, 3)], 0) / pairs + rest / (v + 1)
        if u not in total:
            return low
        return max(c - d2[min(c, 3)], 0) / total[u] + sum(a * b for a, b in zip(d2[1:], kinds[u])) / total[u] * low

    assert abs(sum(p("<s>", w) for w in uni) + p("<s>", "unseen") - 1) < 1e-9
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in uni for w in t), n)
        assert abs(r["score"] - sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t))) < 1e-6 * max(1, len(t))
        assert abs(r["base_score"] - sum(math.log10((uni.get(w, 0) + 1) / (n + v + 1)) for w in t)) < 1e-6 * max(1, len(t))
    again = kneser_ney.score(rows.withColumn("score", F.lit("clash")).withColumn("doc_id", F.lit(None).cast("long")), model, ["doc_id", "score"]).collect()
    assert sorted(round(r["score"], 6) for r in again) == sorted(round(r["score"], 6) for r in got.values())
    nothing = kneser_ney.fit(rows.limit(0), shards=2)
    assert kneser_ney.score(rows, nothing, ["doc_id"]).where("score <> 0 OR base_score <> 0").count() == 0


def test_language(spark):
    r = random.Random(7)
    syllables = {"aa": "ka ta mo ri", "ab": "ka ta mo ru", "zz": "sch pf ung heit", "zy": "sch pf ung keit"}
    rows = []
    for i in range(240):
        lang = sorted(syllables)[i % 4]
        rows.append((i, " ".join("".join(r.choice(syllables[lang].split()) for _ in range(3)) for _ in range(r.randint(5, 60))), lang))
    rows += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (903, "語", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 3 <> 1"))
    assert sorted(map(len, model["families"])) == [2, 2]
    got = {x["doc_id"]: x for x in language.predict(df, model, ["doc_id"]).collect()}
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in range(240) if i % 3 == 1) >= 76
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in syllables
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.predict(df.limit(0), model, ["doc_id"]).count() == 0
    none = language.fit(df.limit(0))
    assert {x["lang_pred"] for x in language.predict(df, none, ["doc_id"]).collect()} == {"und"}


def test_language_follows_its_machines(spark):
    """Prediction against dense products, on repeated rows, a very long text and columns that clash."""
    r = random.Random(11)
    rows = [(i % 7, " ".join("".join(r.choice(x) for _ in range(4)) for _ in range(20)), x) for i, x in enumerate(["abcä", "abdä", "xyzq", "xywq", "mnop"] * 12)]
    rows += [(1, "ab cd " * 200_000, "abcä"), (None, rows[0][1], None)]
    df = spark.createDataFrame([(*x, 0.5, "clash") for x in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    model = language.fit(df)
    got = language.predict(df, model, ["doc_id", "text", "score", "lang_pred"]).collect()
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(x[0]) for x in rows)
    dense = lambda blocks: np.concatenate([b[:-1].T for b in blocks]) if blocks else np.zeros((0, 2 * language.CELLS))
    for x in got:
        two, four, _ = language._cells(*tk.utf8(pa.array([x["text"]])))
        p = np.bincount(np.concatenate([two, four]), minlength=2 * language.CELLS + 1)[:-1].astype(float)
        p *= language.SCALE / max(p.sum(), 1)
        heads = dense(model["heads"]) @ p + model["head_bias"]
        f = int(heads.argmax()) if len(heads) else 0
        group, votes = model["families"][f], {k: [0, 0.0] for k in model["families"][f]}
        for m, (a, b) in zip(dense(model["tables"][f]) @ p + model["biases"][f], model["pairs"][f], strict=True):
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        assert x["lang_pred"] == model["names"][max(group, key=lambda k: (votes[k][0], votes[k][1]))]


def test_sixty_languages(spark):
    r = random.Random(12)
    rows = []
    for k in range(70):
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(r.choice(own) for _ in range(30)), f"l{k:02d}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id % 3 <> 1"))
    got = language.predict(df.where("doc_id % 3 = 1"), model, ["doc_id", "lang"]).collect()
    assert len(model["names"]) == 70 and sum(x["lang"] == x["lang_pred"] for x in got) >= 0.95 * len(got)


def test_toxicity(spark):
    r = random.Random(8)
    plain = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(3, 8))) for _ in range(150)]
    texts, labels = [], []
    for i in range(300):
        w = [r.choice(plain) for _ in range(r.randint(3, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w) + 1), r.choice(["vilex", "gromp", "snark"]))
        texts.append(" ".join(w))
        labels.append(int(bad))
    net = toxicity.learn(pa.array(texts[:240]), np.array(labels[:240], np.float32))
    buf, bounds = tk.utf8(pa.array([*texts[240:], "", None, "12 34"]))
    s = toxicity.score_texts(net, buf, bounds)
    assert ((s[:60] >= 0.5) == (np.array(labels[240:]) == 1)).mean() >= 0.9
    assert all(0 <= x < 0.5 for x in s[60:])
    none = toxicity.learn(pa.array([], pa.string()), np.zeros(0, np.float32))
    assert toxicity.score_texts(none, *tk.utf8(pa.array(["a b"])))[0] < 0.5


def test_toxicity_scores_against_brute_force(spark):
    """Scores of Spark's path are those of every window on its own; repeated and null ids, clashing columns."""
    r = random.Random(9)
    plain = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(3, 8))) for _ in range(80)]
    texts = [" ".join([r.choice(plain) for _ in range(r.randint(1, 90))] + ["gromp"] * (i % 3 == 0)) for i in range(120)] + [*ODD, "Gromp " * 9000]
    df = spark.createDataFrame([(None if i % 10 == 9 else i // 2 * 2, t, 7.0, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(500, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    net = toxicity.fit(df, labels)
    got = toxicity.score(df, net, ["doc_id", "text", "score", "predicted"]).collect()
    assert len(got) == len(texts)
    for x in got:
        w = re.findall(r"(?:[A-Za-z]|[^\x00-\x7f])+", x["text"] or "")
        n = len(w)
        places = range(1) if n <= 32 else [*range(0, n - 32, 16), n - 32]
        some = [" ".join(w[p : p + 32]) for p in places] if len(places) < 40 or n > 9000 else []
        if n and some:
            buf, bounds = tk.utf8(pa.array(some[:50]))
            best = max(toxicity.score_texts(net, buf[bounds[i] : bounds[i + 1]], np.array([0, bounds[i + 1] - bounds[i]]))[0] for i in range(len(some[:50])))
            assert x["score"] == pytest.approx(best, abs=1e-4)
        assert x["predicted"] == int(x["score"] >= 0.5) and 0 <= x["score"] <= 1
    assert toxicity.score(df.limit(0), net, ["doc_id"]).count() == 0
    nothing = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df, nothing, ["doc_id"]).where("predicted = 1").count() == 0


def test_threshold_errs_least():
    low, high = np.array([-3.0, -2.0, -1.0, 0.5]), np.array([-1.5, 1.0, 2.0])
    assert 0.5 < toxicity.threshold(low, high) <= 1.0
    assert toxicity.threshold(low, np.array([-9.0])) > 0.5  # a label that nothing bears out raises no alarms


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.arange(1, 6, dtype=np.uint64), np.zeros(5))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq, mask = rng.integers(0, 5, (4, 6)), np.arange(6) < np.array([[6], [3], [1], [5]])
    rows, cells, at, y = np.arange(5) + 1, rng.integers(0, 50, 12), np.array([0, 3, 5, 8, 10, 12]), np.array([1.0, 0, 1, 0])
    g = net.gradients(seq, rows, cells, at, mask, y)

    def loss():
        z = net.forward(seq, net.inputs(rows, cells, at), mask)[0]
        return float(np.mean(np.log1p(np.exp(-z)) + (1 - y) * z))

    for k in ("word", "char", "wf", "ub", "att", "out", "bf", "att_v"):
        flat = net.p[k].reshape(-1)
        i = int(np.argmax(np.abs(g[k]).ravel()))
        old = flat[i]
        flat[i] = old + 1e-3
        up = loss()
        flat[i] = old - 1e-3
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-3 - g[k].ravel()[i]) < 2e-3 * max(1, abs(g[k].ravel()[i])) + 1e-4


def base_spans(text):
    t = text or ""
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(a + b + c)


def test_secrets(spark):
    noise = random.Random(9)
    wild = "".join(noise.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [*ODD, "é password: 'abcdefghijkl' x", "token=secret: abcdefghijklmnop", "API_KEY = short", "apikey=0123456789abcdef0123", "AKIA" + "B" * 13, "AKIA" + "B" * 14 + " AKIAAKIA" + "Z" * 20, "deadbeef" * 4, "ſecret=abcdefghijklmnop", f"so {wild} it is", "internationalisation_of_characters plain_old_identifier_name", *corpus(20)]
    syllables = [c + v for c in "bcdfghjklmnpqrstvwxyz" for v in "aeiou"]
    texts += [" ".join("".join(noise.choice(syllables) for _ in range(3)) for _ in range(400)) for _ in range(10)]
    df = docs(spark, texts)
    got = {r["doc_id"]: r for r in secrets.scan(df, secrets.fit(df)).withColumn("clean", secrets.redact(F.coalesce("text", F.lit("")), F.col("spans"))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert [tuple(s) for s in got[i]["base_spans"]] == want, t
        assert set(want) <= {tuple(s) for s in got[i]["spans"]}
        out, at = [], 0
        for a, _, b in (tuple(s) for s in got[i]["spans"]):
            if a >= at:
                out += [(t or "")[at:a], "[REDACTED]"]
            at = max(at, b)
        assert got[i]["clean"] == "".join(out) + (t or "")[at:]
    assert any(s["kind"] == 3 for s in got[texts.index(f"so {wild} it is")]["spans"])
    assert not got[len(ODD) + 9]["spans"]


def test_held_out_fold(spark):
    df = docs(spark, ["a"] * 40)
    got = df.withColumn("h", queries.held_out(df, 3, 1)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
