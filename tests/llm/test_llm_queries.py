"""The registered queries on the smallest tables: against their SQL, or against plain Python."""

import math
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from rasterloom.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


def table(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_neighbours(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in table("embeddings") if r["embedding"] is not None and None not in r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for r in QUERIES["op1_neighbours"](spark, DIR).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-9 for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len(set(best) & {f[1] for f in found})
    assert hit >= 9 * len(got)


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in QUERIES["op2_packing"](spark, DIR).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    docs = table("documents")
    assert set(pieces) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = np.array([*whole.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_language(spark):
    docs = {d["doc_id"]: d for d in table("documents")}
    out = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, DIR).collect()}
    assert set(out) == set(docs)
    learned = {d["lang"] for i, d in docs.items() if zlib.crc32(str(i).encode()) % 3 != 1} - {None}
    right = asked = 0
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in docs[i]["text"] or "")
        assert r["lang_pred"] in learned if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
        if r["held_out"] and letters and docs[i]["lang"] is not None and len(docs[i]["text"].split()) >= 5:
            asked, right = asked + 1, right + (r["lang_pred"] == docs[i]["lang"])
    assert right >= 0.9 * asked


def test_scoring(spark):
    docs = table("documents")
    words = {d["doc_id"]: (d["text"] or "").encode().lower().split() for d in docs}
    used = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in used for w in t)
    n, v = sum(counts.values()) + len(used), len(counts) + 1
    out = {r["doc_id"]: r for r in QUERIES["op5_scoring"](spark, DIR).collect()}
    assert set(out) == set(words)
    for i, text in words.items():
        r, c = out[i], [*(counts.get(w, 0) for w in text), len(used)]
        base = sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in c)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(c), sum(k > 0 for k in c), n)
        assert abs(r["base_score"] - base) <= 1e-9 * max(1, abs(base)) and r["score"] < 0
    kept = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)
