import corpus_pipeline
from rasterloom.llm.common import connected_components, cut


def test_stages(spark):
    clean = [(i, f"the house of number {i} stands near the river and has {i * 7} windows of glass in {i + 3} rooms", "en", "s1", 1) for i in range(30)]
    rows = clean + [(100, clean[0][1], "en", "s2", 1), (101, None, None, "s2", 1), (102, "12 34 !!", "en", "s1", 1), (103, clean[3][1].upper(), None, None, 1), (0, clean[0][1], "en", "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), f"test-{name}")
        seen.append(docs)
    assert {r["doc_id"] for r in seen[0].collect()} == {*range(30), 100, 103}
    kept = [r["doc_id"] for r in seen[1].collect()]
    assert sorted(kept) == list(range(30))
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:3])
    assert {r["doc_id"] for r in seen[3].collect()} == {r["doc_id"] for r in seen[2].collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in seen[2].collect())


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 200)]
    out = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert out == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 140)} | {(200, 200), (300, 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_short_texts_of_every_language_stay(spark):
    prose = {
        "en": "the house stands near the river and has many windows of glass in every room",
        "fr": "la maison se trouve au bord de la rivière et ses fenêtres donnent sur le jardin",
        "de": "das haus steht nahe am fluss und hat viele fenster aus glas in jedem zimmer",
        "es": "la casa está cerca del río y tiene muchas ventanas de vidrio en cada cuarto",
    }
    rows = [(100 * k + i, f"{text} {text[i:]} {text[: 40 - i]}", lang) for k, (lang, text) in enumerate(prose.items()) for i in range(20)]
    short = [(1000, "A.", "en"), (1001, "Onhaha sh.", "en"), (1002, "Avec.", "fr"), (1003, "Zwölf", "de"), (1004, "Ñu", "es"), (1005, "Zyx", None)]
    foreign = [(2000, " ".join(chr(0x4E00 + k) * 3 for k in range(200)), None), (2001, "12 !", "en")]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows + short + foreign, "doc_id long, text string, lang string"), "").collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows + short}
    assert all(r["lang"] for r in out)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, `__pred` int, score double, `__size` int, id int, kept boolean"


def test_stages_of_odd_rows(spark):
    """Null ids, long texts, ties, repeated rows, and columns named like those of the stages."""
    prose = "the house stands near the river and has many windows of glass in every room"
    rows = [(i, f"{prose} {i} {i * 3} {prose[i:]}", "en", "s") for i in range(20)]
    rows += [(None, f"{prose} of nobody", "en", None), (None, f"{prose} of nobody", "en", None), (50, (f"{prose} again " * 3000).strip(), None, "s"), (51, "same words in both of these texts", "en", "s"), (52, "same words in both of these texts", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1]), 1, 0.5, 2, 3, True) for r in rows], FIELDS)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = cut(stage(spark, docs, ""), f"odd-{name}")
        assert ", ".join(docs.columns) == "doc_id, text, lang, source, n_chars, __pred, score, __size, id, kept"
        assert {tuple(r)[5:] for r in docs.collect()} == {(1, 0.5, 2, 3, True)}
        ids = [r["doc_id"] for r in docs.collect()]
        if name == "language":
            assert len(ids) == len(rows)
        else:
            assert 52 not in ids and {*range(20), 50, 51, None} <= set(ids)
    pieces = corpus_pipeline.STAGES[3][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in pieces} == set(ids)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
