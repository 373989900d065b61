from itertools import combinations

import numpy as np
import pytest

from rasterloom.llm.minhash import BINS, near_duplicates, shingle_set, sketch


def brute(docs, size, percent):
    """Classes by comparing all sets of words."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = out[rng.integers(len(out))].split()
            for _ in range(rng.integers(0, 1 + len(words) // 12)):
                words[rng.integers(len(words))] = vocabulary[rng.integers(400)]
        else:
            words = [vocabulary[k] for k in rng.integers(0, 400, rng.integers(1, 120))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_same_classes_as_brute_force(spark, size):
    docs = list(enumerate(texts(size, 250)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=size).collect()}
    assert got == brute(docs, size, 80)


def test_odd_rows(spark):
    long = "x y " * 30000
    docs = [(1, "A b\tc d"), (2, "a B c\nd"), (3, None), (4, "  "), (5, "one"), (6, "ONE"), (7, long), (8, long + "z"), (None, "a b c d"), (9, "a b c"), (1, "A b\tc d")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, id long")
    out = {(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, shingle=2).collect()}
    assert {(1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (None, 3, None, True), (9, 1, 9, True)} < out
    assert (7, 2, 7, True) in out
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_group_whose_head_links_to_none_of_the_others(spark):
    """Documents that meet only through others are found in later rounds."""
    base = [f"b{k}" for k in range(100)]
    docs = [(k, " ".join(base[2 * k :] + [f"n{k}x{j}" for j in range(2 * k)])) for k in range(12)]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=1).collect()}
    assert got == brute(docs, 1, 80)


def test_every_bin_is_filled_and_estimates_hold():
    rng = np.random.default_rng(3)
    all_ = [shingle_set(" ".join(f"t{k}" for k in rng.integers(0, 10**9, n)).encode(), 1) for n in (1, 2, 7, 128, 900)]
    assert (sketch(all_) != np.uint64(2**64 - 1)).all()
    items = rng.integers(1, 2**63, 1000, dtype=np.uint64)
    a, b = np.unique(items[:800]), np.unique(items[200:])
    s = sketch([a, b])
    assert abs((s[0] == s[1]).sum() / BINS - 0.6) < 0.15


def test_small_units_and_blocks_find_the_same(spark, monkeypatch):
    """Heads of many candidates dealt into units of three, buckets into blocks of four."""
    import rasterloom.llm.minhash as m

    monkeypatch.setattr(m, "UNIT", 3)
    monkeypatch.setattr(m, "BLOCK", 4)
    docs = list(enumerate(texts(11, 60)))
    base = " ".join(f"w{k}" for k in range(60))
    docs += [(1000 + k, base + f" tail{k}") for k in range(25)] + [(2000 + k, base.replace("w7 ", f"x{k} ")) for k in range(12)]
    want = brute(docs, 2, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, shingle=2, percent=80).collect()}
    assert got == want
