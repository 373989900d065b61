import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import langid, lm, mixing, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, id int")


LANGS = {"aa": "ba be bi ko ku lama sera tion", "bb": "zwo xik vqu yth grr plo kyx", "cc": "éü ßä öçñ íá óú"}


def sample(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(LANGS)[i % 3]
        out.append((i, " ".join(rng.choice(LANGS[lang].split(), 30)), lang, f"s{i % 4}"))
    return out


def test_languages(spark):
    rows = sample(120) + [(500, None, "aa", "s"), (501, "", None, "s"), (502, "12 !! 34", "bb", "s"), (503, "BA BE Lama " * 40000, None, None), (None, "zwo xik", None, "s")]
    out = {r["id"]: r for r in langid.identify(docs(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert {out[i]["held_out"] for i in range(120)} == {True, False}
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert out[503]["lang_pred"] == "aa" and out[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(docs(spark, rows).limit(0), F.lit(True)).count() == 0


def test_chunks_don_t_change_a_text_s_vector(monkeypatch):
    text = "The quick, brown fox -- jumps  over it. " * 50
    whole = langid.Encoder(64).encode(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    small = langid.Encoder(64, cache=40)
    assert np.array_equal(small.encode(text), whole)


def test_packing_is_a_partition_of_the_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"word{k}" for k in rng.integers(0, 5000, rng.integers(0, 900))), "x", "s") for i in range(150)] + [(900, None, "x", "s"), (901, "", "x", "s"), (902, "alpha beta " * 9000, "x", "s"), (903, "a\x1cb <|endoftext|> İ", "x", "s")]
    out = packing.pack(docs(spark, rows).repartition(5), PATH).collect()
    whole = packing.Ids(PATH).whole
    pieces = {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded / total < 0.005
    assert packing.pack(docs(spark, rows).limit(0), PATH).count() == 0


def test_word_ids_equal_those_of_the_text():
    ids = packing.Ids(PATH)
    for text in ["It's 12½ ² _x_ don't", "ΣΑΣ ﬁ é é", "日本 テスト", "\x85a　b c", "tab\tnew\nline"] + [chr(c) * 2 + "a" + chr(c) for c in range(0x250)]:
        assert np.frombuffer(ids(text), "<u4").tolist() == ids.whole.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_take_texts_whole(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        about = json.load(f)
    assert packing.splits_at_blanks(about)
    about["normalizer"]["normalizers"] = about["normalizer"]["normalizers"][:2]
    (tmp_path / "other.json").write_text(json.dumps(about), encoding="utf-8")
    ids = packing.Ids(str(tmp_path / "other.json"))
    text = "Upper lower ÜBER it's"
    assert np.frombuffer(ids(text), "<u4").tolist() == ids.whole.encode(text, add_special_tokens=False).ids
    assert ids(text) != packing.Ids(PATH)(text)


def test_merges_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rows = [(i, f"word {i} " * (i % 40 + 1), "x", "s") for i in range(300)]
    out = packing.pack(docs(spark, rows).repartition(13), PATH).collect()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    full = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        full += at == 2048 or at & (at - 1) == 0
    assert full >= len(by) - 2 * 13
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in out) and len(total) == 300


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), "x", ["b", "a", None, "ä"][i % 4] if i % 3 else "hot") for i in range(400)] + [(900, None, "x", "only nothing")]
    df = docs(spark, rows)
    out = {r["id"]: r for r in mixing.plan(df).collect()}
    by = {}
    for i, text, _, source in rows:
        r = out[i]
        assert r["size"] == len((text or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(source, []).append(r)
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 0.5
        assert group[0]["target"] <= 2 * group[0]["source_size"] + 1e-9
        done = sorted((r["position"], r["lead"]) for r in group if r["taken"])
        assert done == sorted(done, key=lambda p: p[1]) and all(0 <= p <= 1 for p, _ in done)
    total = sum(r["size"] for r in out.values())
    assert abs(sum(g[0]["target"] for g in by.values()) - 1.5 * total) < 1e-6 * total
    again = {r["id"]: r["taken"] for r in mixing.plan(df.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in out.items()}
    mixed = mixing.mix(df).groupBy("doc_id").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in mixed} == {i: r["taken"] for i, r in out.items() if r["taken"]}
    assert mixing.mix(df).columns == df.columns
    assert mixing.plan(df.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, f"a b c{i}", "s", 7, 8, 9, 10) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size int, __turn int, _t0 int, lead int")
    out = mixing.mix(df).collect()
    assert out and {tuple(r)[3:] for r in out} == {(7, 8, 9, 10)}


def test_schedules_are_inverted(spark):
    """The schedule's integral up to a position gives the share again."""
    shares = [k / 20 for k in range(20)]
    df = spark.createDataFrame([(u, k) for u in shares for k in range(3)], "u double, k int")
    for u, k, t in df.select("u", "k", mixing.position(F.col("u"), F.col("k"))).collect():
        knots = np.array(mixing.SCHEDULES[k])
        grid = np.linspace(0, 1, 20001)
        w = np.interp(grid, knots[:, 0], knots[:, 1])
        total = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert abs(np.interp(t, grid, total / total[-1]) - u) < 1e-6


def test_scores(spark):
    rows = sample(200, 7) + [(900, None, "x", "s"), (901, "unseen 12", "x", "s"), (902, "BA be\x0bko " * 30000, "x", "s"), (None, "ba be", "x", "s"), (5, rows_text := "ba be", "x", "s")]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    out = lm.score(docs(spark, rows), train).collect()
    assert len(out) == len(rows)
    used = [t for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = {}
    for t in used:
        for w in (t or "").encode().lower().split():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(used), len(counts) + 1
    assert {r["train_tokens"] for r in out} == {n}
    want = {}
    for i, t, *_ in rows:
        c = [counts.get(w, 0) for w in (t or "").encode().lower().split()] + [len(used)]
        want.setdefault((i, len(c)), (sum(k > 0 for k in c), float(np.log10((np.array(c) + 0.5) / (n + 0.5 * (v + 1))).sum())))
    for r in out:
        known, base = want[r["id"], r["n_tokens"]]
        assert r["n_known"] == known and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    kept = [r for r in out if r["held_out"] and r["id"] < 200]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)
    assert rows_text and lm.score(docs(spark, rows).limit(0), train).count() == 0


def test_exchange_finds_the_two_kinds_of_words():
    rng = np.random.default_rng(0)
    m = np.zeros((21, 21), dtype=np.int64)
    for a in range(20):
        for b in range(20):
            m[a, b] = rng.integers(20, 40) if a // 10 != b // 10 else 0
    cls = lm.exchange(m, classes=3)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:20])) == 1 and cls[0] != cls[10] and cls[20] == 0


def test_a_models_words_have_probability_one():
    m = np.arange(16).reshape(4, 4)
    cls = lm.exchange(m, classes=3)
    hot = np.eye(3)[cls]
    between = hot.T @ m @ hot
    prior = (between.sum(axis=0) + 1) / (between.sum() + 3)
    p = (between + lm.PRIOR * prior) / (between.sum(axis=1, keepdims=True) + lm.PRIOR)
    assert np.allclose(p.sum(axis=1), 1)


def test_best_classes_have_the_highest_likelihood():
    rng = np.random.default_rng(1)
    size, classes = 30, 5
    m = rng.integers(0, 6, (size, size)) * (rng.random((size, size)) < 0.4)
    cls = np.append(rng.integers(1, classes, size - 1), 0)

    def likelihood(c):
        hot = np.eye(classes)[c]
        n = hot.T @ m @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    hot = np.eye(classes)[cls]
    words = np.arange(size - 1)
    off = m - np.diag(np.diag(m))
    got = lm.best_classes(hot.T @ m @ hot, cls[words], (off.T @ hot)[words], (off @ hot)[words], np.diag(m)[words].astype(float))
    for w in words:
        every = [likelihood(np.where(np.arange(size) == w, c, cls)) for c in range(1, classes)]
        assert every[got[w] - 1] >= max(every) - 1e-6


def test_other_words_have_the_class_of_their_neighbours(spark, monkeypatch):
    """Words that end alike but stand where different frequent words do are told apart."""
    monkeypatch.setattr(lm, "LOOKUP", 700)
    assert len(set(lm.endings([b"x5end", b"y7end", b"end,"]))) == 1
    texts = [" ".join(f"f{i + k}" for k in range(20)) for i in range(0, 600, 20)] * 5 + ["aa xx bb cc yy dd"] * 400
    for i in range(0, 600, 4):
        texts += [" ".join(f"aa x{j}end bb cc y{j}end dd" for j in range(i, i + 4))] * 3
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "aa x5end bb"), (1001, "aa y5end bb")]
    out = {r["id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000, words=512).collect()}
    like, unlike = out[1000], out[1001]
    assert like["n_known"] == unlike["n_known"] == 4
    assert (like["score"] - like["base_score"]) - (unlike["score"] - unlike["base_score"]) > 2


def plain_scores(rows, held_out, core_words):
    """Scores by loops over words: clustering of the core, the best class of every other word, smoothing."""
    fitted = [lm.words_of((t or "").encode()) for i, t in rows if i not in held_out]
    counts = {}
    for words in fitted:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    core = sorted(counts, key=lambda w: (-counts[w], w))[:core_words]
    number = {w: i for i, w in enumerate(core)}
    size = core_words + lm.ENDINGS + 1
    kind = lambda w: number.get(w, core_words + int(lm.endings([w])[0]))
    pairs = np.zeros((size, size))
    for words in fitted:
        types = [size - 1, *map(kind, words), size - 1]
        for a, b in zip(types, types[1:]):
            pairs[a, b] += 1
    first = lm.exchange(pairs)
    hot = np.eye(lm.CLASSES)[first]
    bigrams = hot.T @ pairs @ hot
    cls = {w: int(first[kind(w)]) for w in core}
    guess = {w: int(first[kind(w)]) for w in counts}
    at = {w: [] for w in counts}
    for words in fitted:
        ends = [None, *words, None]
        for i in range(1, len(ends) - 1):
            at[ends[i]].append((ends[i - 1], ends[i + 1]))

    def value(n):
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))

    of = lambda w: 0 if w is None else guess[w]
    for w in counts:
        if w in cls:
            continue
        bare = bigrams.copy()
        moves = []
        for before, after in at[w]:
            bare[of(before), guess[w]] -= before != w
            bare[guess[w], of(after)] -= after != w
            bare[guess[w], guess[w]] -= before == w
            moves.append((before, after))

        def placed(c):
            n = bare.copy()
            for before, after in moves:
                n[of(before), c] += before != w
                n[c, of(after)] += after != w
                n[c, c] += before == w
            return value(n)

        gains = [-np.inf] + [placed(c) for c in range(1, lm.CLASSES)]
        best = int(np.argmax(gains))
        cls[w] = best if gains[best] > gains[guess[w]] + 1e-7 else guess[w]
    tokens, distinct, between = np.zeros(lm.CLASSES), np.zeros(lm.CLASSES), np.zeros((lm.CLASSES, lm.CLASSES))
    for w, n in counts.items():
        tokens[cls[w]] += n
        distinct[cls[w]] += 1
    path = lambda words: [0, *(cls.get(w, int(first[core_words + int(lm.endings([w])[0])])) for w in words), 0]
    for words in fitted:
        c = path(words)
        for a, b in zip(c, c[1:]):
            between[a, b] += 1
    prior = (between.sum(axis=0) + 1) / (between.sum() + lm.CLASSES)
    out = {}
    for i, t in rows:
        words = lm.words_of((t or "").encode())
        c = path(words)
        total = sum(np.log10((between[a, b] + lm.PRIOR * prior[b]) / (between[a].sum() + lm.PRIOR)) for a, b in zip(c, c[1:]))
        total += sum(np.log10((counts.get(w, 0) + 0.5) / (tokens[x] + 0.5 * (distinct[x] + 1))) for w, x in zip(words, c[1:]))
        out[i] = total
    return out


@pytest.mark.parametrize("lookup", [200_000, 40])
def test_scores_equal_a_plain_version(spark, monkeypatch, lookup):
    """Also where most words are beyond the lookup table and meet the documents in a join."""
    monkeypatch.setattr(lm, "LOOKUP", lookup)
    rng = np.random.default_rng(11)
    kinds = [[f"{c}{i}{e}" for i in range(25) for e in ("ing", "é")] for c in "abcd"]
    rows = []
    for i in range(80):
        words = [kinds[(i + k) % 4][min(int(rng.exponential(8)), 49)] for k in range(int(rng.integers(0, 40)))]
        words = [w for w in words for _ in range(1 + (rng.random() < 0.1))]
        rows.append((i, " ".join(words)))
    rows += [(80, None), (81, "never seen"), (82, "a0ing zzz a0ing")]
    held_out = {i for i, _ in rows if i % 5 == 1}
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 != 1, words=30).collect()
    want = plain_scores(rows, held_out, 30)
    assert {r["id"] for r in out if r["held_out"]} == held_out
    for r in out:
        assert abs(r["score"] - want[r["id"]]) < 1e-9 * max(1, abs(want[r["id"]]))


def test_language_against_plain_trigrams(spark):
    """Labels and scores of profiles that are made trigram by trigram."""

    def vector(text):
        kept = "".join(chr(low) if (low := int(langid._letters()[ord(c)])) else " " for c in text or "")
        if not kept.strip():
            return None
        padded = " " + " ".join(kept.split()) + " "
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(padded) - 2):
            one = np.ones(langid.DIMENSIONS)
            for k in range(3):
                one = one * np.roll(langid._letter_vector(ord(padded[i + k]), langid.DIMENSIONS), 2 - k)
            out += one
        return out

    rows = sample(90) + [(900, None, "aa", "s"), (901, "12 -- 3", "bb", "s"), (902, "A.", None, "s"), (903, "kü-zwo, BA3be", "cc", "s"), (904, "", None, None)]
    train = lambda i: i % 3 != 1
    profiles = {}
    for i, text, lang, _ in rows:
        v = vector(text)
        if train(i) and lang is not None and v is not None:
            profiles[lang] = profiles.get(lang, 0) + v / np.linalg.norm(v)
    got = {r["id"]: r for r in langid.identify(docs(spark, rows), F.col("doc_id") % 3 != 1).collect()}
    for i, text, _, _ in rows:
        v = vector(text)
        if v is None:
            want = ("und", 0.0)
        else:
            cosine = {lang: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for lang, p in profiles.items()}
            best = min(cosine, key=lambda lang: (-cosine[lang], lang))
            want = (best, max(0.0, cosine[best]))
        assert got[i]["lang_pred"] == want[0] and got[i]["score"] == pytest.approx(want[1], abs=1e-9) and got[i]["held_out"] == (not train(i))
