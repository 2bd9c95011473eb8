"""The stages of the corpus pipeline on rows with nulls, repeats, clashing columns and very long texts."""

import random
import re
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from heliobar.llm import common, queries, toxicity

from .test_operators import base_spans, components, corpus, words

SCHEMA = "doc_id long, text string"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, row_number string, size string, target string, taken string, repeats string, spans string, score string, _t string, predicted string"


def rows(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    got = [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), f"r{k}", *["clash"] * 8) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(got, WIDE).repartition(3)


def mixture():
    r = random.Random(3)
    texts = corpus(40, 5)
    for t in texts[:8]:
        w = t.split() + [f"x{i}" for i in range(60)]
        texts += [" ".join(w), " ".join([*w[:30], "changed", *w[31:]])]
    texts += [texts[9], texts[9], None, "", " \n", "word", "long " * 30_000, "password = " + "".join(r.choice("abcdef0123456789") for _ in range(32))]
    ids = [None if i % 11 == 0 else (5 if i % 7 == 0 else i) for i in range(len(texts))]
    return texts, ids


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_duplicate_stage_removes_pairs_from_four_fifths_on(spark):
    texts, gone = [], []
    for pair, n in enumerate((50, 52, 54, 56, 58, 60, 62, 40, 44)):
        w = [f"p{pair}w{i}" for i in range(n)]
        texts += [" ".join(w), " ".join([*w[: n // 2], "other", *w[n // 2 + 1 :]])]
        if jaccard(*texts[-2:]) >= 0.8:
            gone.append(2 * pair + 1)
    assert sum(0.8 <= jaccard(texts[i], texts[i + 1]) < 0.85 for i in range(0, len(texts), 2)) == 7 == len(gone)
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in left) == [i for i in range(len(texts)) if i not in gone]


def test_near_duplicate_stage_keeps_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    stage = lambda some: sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(some, SCHEMA), "").collect()))
    assert stage([(1, a), (1, b)]) == [(1, a), (1, b)]
    assert stage([(1, a), (5, a), (5, b)]) == [(1, a), (5, b)]


def test_near_duplicate_stage_against_brute_force(spark):
    texts, ids = mixture()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(len(sets), links)
    left = corpus_pipeline.drop_near_duplicates(spark, rows(spark, texts, ids), "")
    assert left.columns == rows(spark, texts, ids).columns
    kept = {int(r["row_number"][1:]) for r in left.collect()}
    for k in set(root):
        group = [i for i in range(len(texts)) if root[i] == k]
        least = min(group, key=lambda i: (ids[i] is None, ids[i] or 0))
        stay = [i for i in group if i in kept]
        assert len(stay) == 1 and ids[stay[0]] == ids[least], (k, group, stay)


def test_secrets_stage_replaces_spans_only(spark):
    texts, ids = mixture()
    got = {int(r["row_number"][1:]): r for r in corpus_pipeline.redact_secrets(spark, rows(spark, texts, ids), "").collect()}
    assert len(got) == len(texts) and got[0].asDict().keys() == set(rows(spark, ["a"]).columns)
    for i, t in enumerate(texts):
        assert got[i]["doc_id"] == ids[i] and got[i]["spans"] == "clash"
        if base_spans(t):
            assert "[REDACTED]" in got[i]["text"] and got[i]["n_chars"] == len(got[i]["text"])
        elif "[REDACTED]" not in (got[i]["text"] or ""):
            assert got[i]["text"] == t


def test_mixing_stage_takes_whole_rows(spark):
    texts, ids = mixture()
    got = corpus_pipeline.mix(spark, rows(spark, texts, ids), "").collect()
    assert got[0].asDict().keys() == set(rows(spark, ["a"]).columns)
    for r in got:
        i = int(r["row_number"][1:])
        assert (r["doc_id"], r["text"], r["target"]) == (ids[i], texts[i], "clash")
    assert max(sum(r["row_number"] == f"r{i}" for r in got) for i in range(len(texts))) <= 3
    sizes = {}
    for k, t in enumerate(texts):
        s = None if k % 4 == 0 else f"s{k % 3}"
        sizes[s] = sizes.get(s, 0) + len(words(t))
    names = sorted((s for s in sizes if s), key=str) + [None]
    from heliobar.llm.mixing import water_fill

    targets = dict(zip(names, water_fill([sizes[s] for s in names], [1.0 + k % 3 for k in range(len(names))], 3.0), strict=True))
    for s in names:
        mine = [len(words(t)) for k, t in enumerate(texts) if (None if k % 4 == 0 else f"s{k % 3}") == s]
        taken = sum(len(words(r["text"])) for r in got if r["source"] == s)
        # what is left open is smaller than the smallest text that wasn't taken once more
        assert targets[s] - max(mine) < taken <= targets[s] + 1e-6


def test_packing_stage_round_trip(spark):
    from tokenizers import Tokenizer

    texts, ids = mixture()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.encode_special_tokens = True
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in zip(ids, texts, strict=True))
    pieces = sorted(corpus_pipeline.pack(spark, rows(spark, texts, ids), "").collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    got, at = [], 0
    for r in pieces:
        assert (r["sequence_id"] * 2048 + r["offset"], len(r["ids"])) == (at, 4 * r["length"])
        at += r["length"]
        part = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        if r["start"] == 0:
            got.append([str(r["doc_id"]), part])
        else:
            got[-1][1] += part
    assert sorted((i, x) for i, x in got) == want


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    """A folder with labels, and documents of which every fourth has words that go with the label."""
    r = random.Random(8)
    plain = ["".join(r.choice("aeioubdgklmnrst") for _ in range(r.randint(3, 8))) for _ in range(150)]
    texts, labels = [], []
    for i in range(260):
        w = [r.choice(plain) for _ in range(r.randint(20, 90))]
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(["vilex", "gromp", "snark"]))
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    texts[1] = " ".join(r.choice(plain) for _ in range(30_000))
    texts[2], texts[3] = None, ""
    folder = str(tmp_path_factory.mktemp("toxic"))
    spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder, texts


def test_toxicity_stage_drops_toxic_rows_only(spark, toxic):
    folder, texts = toxic
    docs = rows(spark, texts, [*range(258), 5, None])
    left = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    kept = {int(r["row_number"][1:]) for r in left.collect()}
    bad = {i for i in range(260) if i % 4 == 0}
    assert len(kept & bad) <= 0.1 * len(bad) and len(kept - bad) >= 0.98 * (260 - len(bad)) and {1, 2, 3} <= kept


def test_every_stage_takes_an_empty_table(spark, toxic):
    docs = rows(spark, ["a"]).limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, toxic[0]).count() == 0, name


def test_a_worker_gives_memory_back_between_stages():
    """What a stage's function has freed, but the allocator keeps, doesn't stand in the way of the next one's."""
    import subprocess
    import sys

    code = """
import re
from heliobar.llm import common
def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
kept = []  # what a worker keeps for good lies behind what it frees
def work():
    for i in range(3):
        some = [bytes(1000) for _ in range(100_000)]
        kept.append(bytes(1000))
        yield i
base = held()
rows = getattr(common, "trimmed", lambda it: it)(work())
assert list(rows) == [0, 1, 2]
del rows
print(held() - base)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120)
    assert float(out.stdout) < 30, out.stderr


def test_the_driver_doesn_t_learn_the_network(spark, monkeypatch):
    """The driver's memory serves all stages; the sample is learned from in a task, to the same network."""
    texts = [f"{'vile scum ' if i % 3 == 0 else ''}" + " ".join(f"w{(i * k) % 40}" for k in range(1, 30)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    want = toxicity.learn(pa.array(texts), np.array([i % 3 == 0 for i in range(120)], np.float32))

    def here(*args, **kwargs):
        raise AssertionError("the driver learns")

    monkeypatch.setattr(toxicity, "learn", here)
    net = toxicity.fit(docs, labels)
    assert (net.words == want.words).all() and net.prior == want.prior
    assert all(np.allclose(net.p[k], want.p[k], atol=1e-4) for k in want.p)


def test_stages_give_the_driver_s_freed_memory_back(spark, monkeypatch):
    assert common.give_back_driver(spark) in (True, False)
    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back_driver", lambda s: calls.append("back"))
    for name in ("drop_near_duplicates", "redact_secrets"):
        step = next(f for _, f in corpus_pipeline.STAGES if f.__name__ == name)
        got = step(spark, spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA), "")
        assert sorted(r["doc_id"] for r in got.collect()) == [1, 2]
    assert calls == ["back"] * 4


def test_a_jvm_gives_freed_native_memory_back(spark):
    """Blocks that the JVM has freed, each below one that it keeps, would count against the driver for good."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe = field.get(None)
    if not common.give_back_driver(spark):
        pytest.skip("this JVM can't")
    base, blocks = held(), []
    for _ in range(500):
        blocks.append(unsafe.allocateMemory(100_000))
        unsafe.setMemory(blocks[-1], 100_000, 1)
        blocks.append(unsafe.allocateMemory(64))
    full = held()
    for b in blocks[::2]:
        unsafe.freeMemory(b)
    common.give_back_driver(spark)
    left = held()
    for b in blocks[1::2]:
        unsafe.freeMemory(b)
    assert full - base > 35 and left - base < 25
