"""The registered queries on the smallest tables, whole, against brute force and the columns of their contracts."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest

from heliobar.llm import queries
from heliobar.llm.mixing import water_fill

from .test_operators import base_spans, components, words

SOURCE = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SOURCE).collect()]


@pytest.fixture(scope="module")
def documents():
    return [dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SOURCE}/documents.parquet'").fetchall()]


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_op1(spark):
    got = {r["vec_id"]: r for r in rows_of(spark, "op1_rotation")}
    ids, v = zip(*duckdb.sql(f"SELECT vec_id, embedding FROM '{SOURCE}/embeddings.parquet' ORDER BY vec_id").fetchall(), strict=True)
    m = np.array(v, np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    root = components(len(ids), list(zip(*np.nonzero(np.triu(link)), strict=True)))
    assert sum(got[i]["n_links"] for i in ids) >= 0.998 * link.sum() and all(got[i]["n_links"] <= n for i, n in zip(ids, link.sum(axis=1), strict=True))
    assert np.mean([got[i]["component_id"] == ids[root[k]] for k, i in enumerate(ids)]) >= 0.998
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_language")}
    held = [d for d in documents if fold(d["doc_id"], 3) == 1]
    assert {i for i, r in got.items() if r["held_out"]} == {d["doc_id"] for d in held} and len(got) == len(documents)
    assert np.mean([got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held if d["lang"]]) >= 0.9


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    tok.encode_special_tokens = True
    got = rows_of(spark, "op3_packing")
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for d in documents:
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 2048
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(used) == list(range(len(used))) and all(n == 2048 for s, n in used.items() if s < len(used) - 1)


def test_op5(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op5_mixing")}
    size = {d["doc_id"]: len(words(d["text"])) for d in documents}
    per = {}
    for d in documents:
        per[d["source"]] = per.get(d["source"], 0) + size[d["doc_id"]]
    names = sorted((s for s in per if s is not None), key=lambda s: s.encode()) + [None] * (None in per)
    target = dict(zip(names, water_fill([per[s] for s in names], [1.0 + k % 3 for k in range(len(names))], 3.0), strict=True))
    taken = {}
    for d in documents:
        r = got[d["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[d["doc_id"]], per[d["source"]]) and r["target"] == pytest.approx(target[d["source"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
    for s in names:
        left = [size[d["doc_id"]] for d in documents if d["source"] == s and size[d["doc_id"]] and got[d["doc_id"]]["taken"] < 3 * size[d["doc_id"]]]
        assert 0 <= target[s] - taken[s] + 1e-6 and (target[s] - taken[s] < max(left, default=1) or target[s] >= 3 * per[s])


@pytest.mark.parametrize("name", ["op4_topk", "op6_warc", "op7_minhash"])
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SOURCE}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SOURCE).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_op8(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op8_lm")}
    tokens = {d["doc_id"]: [*words(d["text"]), None] for d in documents}
    count = {}
    for i, t in tokens.items():
        if fold(i, 7) != 2:
            for w in t:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(i, 7) == 2, len(t), sum(w in count for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op9(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_toxicity")}
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SOURCE}/labels.parquet'").fetchall())
    assert len(got) == len(documents) and all(r["held_out"] == (fold(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == y for i, y in toxic.items() if fold(i, 5)]) >= 0.95


def test_op10(spark, documents):
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_secrets")}
    names = ["assign", "access", "hex"]
    for d in documents:
        spans = base_spans(d["text"])
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        r = got[d["doc_id"]]
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
