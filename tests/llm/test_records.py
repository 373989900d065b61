import base64
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, licenses, warc
from rasterloom.llm.templates import FILTERS, TemplateError, compile_template, fold_body, parse


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")


ROWS = [(1, "http://a/x y", "<p>é\r\n\r\nWARC/1.1</p>"), (5, None, "same"), (9, "http://b", "same"), (3, "http://c", None), (2, "http://d", ""), (None, "u", "same"), (9, "http://b", "same"), (7, "z", "x" * 300000), (-4, "n", "neg")]


def test_archive_round_trip(spark, tmp_path):
    out = warc.round_trip(pages(spark, ROWS), str(tmp_path / "a")).collect()
    assert len(out) == len(ROWS)
    for r in out:
        html = next((h or "") for i, _, h in ROWS if i == r["id"]).encode()
        assert r["payload_bytes"] == len(html)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html).digest()).decode()
    kinds = {(r["id"], r["record_type"], r["refers_to"]) for r in out}
    assert kinds == {(1, "response", None), (5, "revisit", 9), (9, "response", None), (None, "revisit", 9), (3, "response", None), (2, "revisit", 3), (7, "response", None), (-4, "response", None)}
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 5
    small = warc.round_trip(pages(spark, ROWS), str(tmp_path / "b"), least_bytes=100).collect()
    assert {r["record_type"] for r in small} == {"response"}
    assert warc.round_trip(pages(spark, ROWS).limit(0), str(tmp_path / "c")).count() == 0


def test_a_payload_of_very_many_records(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"page {i}") for i in range(90)] + [(6, "http://again", "hot")] * 5
    path = str(tmp_path / "hot")
    out = warc.round_trip(pages(spark, rows), path, hot=4).collect()
    assert len(out) == len(rows)
    assert {(r["record_type"], r["refers_to"]) for r in out if r["id"] % 3 == 0} == {("response", None), ("revisit", 87)}
    assert sum(r["record_type"] == "response" for r in out) == 61
    assert spark.read.parquet(f"{path}/payloads").count() == 61
    parts = spark.read.parquet(f"{path}/headers").where("part is not null").groupBy("part").count().collect()
    assert len(parts) > 4 and sum(r["count"] for r in parts) == 35
    # without the tables in the catalogue, records come back from the files alone
    for name in ("headers", "payloads"):
        spark.sql(f"DROP TABLE {warc._table(f'{path}/{name}')}")
    again = warc.fields(warc.records(*warc.read_archive(spark, path))).collect()
    assert sorted(again, key=str) == sorted(out, key=str)


def test_reading_back_shuffles_no_payload(spark, tmp_path):
    path = str(tmp_path / "flat")
    warc.write_archive(pages(spark, [(i, "u", f"page {i}") for i in range(50)]), path)
    plan = warc.records(*warc.read_archive(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_exported_files_are_records(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "a"))
    warc.export(warc.records(*warc.read_archive(spark, str(tmp_path / "a"))), str(tmp_path / "files"))
    found = 0
    for f in (tmp_path / "files").glob("part-*"):
        data, at = f.read_bytes(), 0
        while at < len(data):
            head = data[at : data.index(b"\r\n\r\n", at)]
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            at += len(head) + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            found += 1
    assert found == len(ROWS)


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.write_archive(pages(spark, ROWS), str(tmp_path / "a"))
    spoiled = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.lit("!")))
    spoiled.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="digest"):
        warc.fields(warc.records(*warc.read_archive(spark, str(tmp_path / "b")))).collect()


def render(source, **data):
    return "".join(t for t, _ in compile_template(source)(**data))


def test_templates():
    assert render("{{ a.b }}{{ a['c'] | upper }}{# x #}", a={"b": 1, "c": "x"}) == "1X"
    assert render("{% if n > 2 and not z %}big{% elif n == 2 %}two{% else %}small{% endif %}", n=2) == "two"
    assert render("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter("ab")) == "1a,2b"
    assert render("{% set v = 'q' ~ 3 %}{{ v if true else none }}") == "q3"
    assert render("{{ 'in' if 'a' in xs else 'out' }}{{ nothing }}", xs=["a"]) == "in"
    assert fold_body(parse("a{{ 'b' ~ (1 + 1) }}{% if false %}x{% endif %}{% if 1 == 1 %}c{% endif %}")) == [("text", "ab2c")]
    pieces = list(compile_template("x{% generation %}y{% endgeneration %}")())
    assert pieces == [("x", False), ("y", True)]
    for bad in ("{% if x %}", "{{ a.__class__ }}", "{{ open('f') }}", "{% endfor %}", "{{ 1 | nofilter }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        render("{{ a.b }}", a=3)


def test_given_filters_are_not_folded_away():
    name = next(iter(FILTERS))
    shown = list(compile_template("{{ 'ab' | " + name + " }}", {name: lambda v: "mine"})())
    assert shown == [("mine", False)]
    with pytest.raises(TemplateError):
        compile_template("{{ 1 + 'a' }}")


def test_escapes_are_reversible():
    for text in ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]", "[\\INST]", "<s><s>", "[[INST]]", "[/ROLE]\\", "plain"]:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes </s>\\"), (2, 0, None, None), (3, 5, "assistant", ""), (3, 2, "we[/ROLE]ird", "x\ny"), (None, 0, "user", "lost"), (4, 0, "assistant", "long " * 60000), (4, 1, "assistant", "é𝄞"), (1, 1, "assistant", "yes </s>\\")]


def test_conversations_read_back(spark):
    df = spark.createDataFrame([(*t, "c") for t in TURNS], "conv_id long, turn long, role string, text string, conv string")
    formatted = chat.format_conversations(df)
    assert formatted.where("conv_id = 4").count() > 1
    out = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in TURNS}:
        turns = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        said = "".join(t[2] for t in turns if t[1] == "assistant")
        r = out[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, licenses.TEMPLATES + licenses.TEXTS])
def test_key_words_are_enough(templates):
    rows, unknown, keys = licenses.weigh(templates)
    for i in range(len(templates)):
        rest = sum(w * w for j, _, t, w in rows if j == i and t not in keys)
        assert rest < licenses.THRESHOLD**2
    assert unknown > 0


def test_licences_are_declared_and_inherited(spark):
    files = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/x.py", "code"), ("r/a/b/COPYING.txt", "Intro\nThis work is licensed under the GNU General Public License, version 3.\nend"),
        ("r/a/b/y.py", None), ("r/a/b/c/z.py", ""), ("r/a/h.py", "# Licensed under the Apache License, Version 2.0\ncode"), ("top.py", "licensed or not, version of a public thing"), ("q/only.py", "x"), (None, "m"),
    ]
    df = spark.createDataFrame([(i, t, p, 0) for i, (p, t) in enumerate(files)], "doc_id long, text string, name string, license int")
    out = {r["id"]: (r["license"], r["origin"], r["license_dir"]) for r in licenses.license_scan(df, F.col("name")).collect()}
    assert out == {
        0: ("MIT", "header", None), 1: ("MIT", "inherited", "r"), 2: ("GPL-3.0", "header", None), 3: ("GPL-3.0", "inherited", "r/a/b"), 4: ("GPL-3.0", "inherited", "r/a/b"),
        5: ("Apache-2.0", "header", None), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None),
    }
    assert licenses.license_scan(df.limit(0), F.col("name")).count() == 0


def test_tree_inherits_across_levels(spark, tmp_path):
    from rasterloom.llm.queries import QUERIES

    notice = {20: "MIT", 104: "MPL-2.0", 112: "GPL-3.0"}
    told = {k: f"intro\n{next(t for n, t in licenses.TEMPLATES if n == v)}\nend" for k, v in notice.items()}
    spark.createDataFrame([(i, told.get(i, "words of a text"), "web") for i in (1, 15, 20, 104, 107, 112, 115, 203)] + [(301, "x", "books")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: (r["license"], r["origin"], r["license_dir"]) for r in QUERIES["op10_license_tree"](spark, str(tmp_path)).collect()}
    assert all(out[i][:2] == (v, "header") for i, v in notice.items())
    assert all(out[i] == ("MPL-2.0", "inherited", "web/1") for i in (107, 115))  # hundreds, one level up
    assert all(out[i] == ("MIT", "inherited", "web") for i in (1, 15, 203))  # source, two levels up
    assert out[301] == (None, "none", None)


def test_licence_texts_and_wrapped_headers(spark):
    full = {name: text for name, text in licenses.TEXTS}
    apache = "#!/bin/sh\n" + "\n".join(f"# {line}" for line in full["Apache-2.0"].splitlines()) + "\n#\n\nimport os\n" + "x = y + z\n" * 400
    wrapped = "/* Copyright 2020 Somebody.\n\n   This work is licensed under the GNU\n   General Public License, version 3\n\n*/ int main() { return 0; }"
    rows = [
        (0, "MIT License\n\nCopyright (c) 2020 Foo Inc\n\n" + full["MIT"]), (1, full["BSD-2-Clause"]), (2, "Copyright 2021, The Authors\r\n\r\n" + full["BSD-3-Clause"].replace("\n", "\r\n")), (3, apache),
        (4, wrapped), (5, "/*\n" + full["GPL-3.0"] + "\n*/\nvoid f();"), (6, full["ISC"]), (7, "The authors of the work shall not be liable for the use of the software or of the notice. " * 3), (8, None), (9, ""),
        (10, "of the and to in or a is that it " * 30000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    how = {"templates": licenses.TEMPLATES + licenses.TEXTS, "units": licenses.blocks}
    out = {r["id"]: r["license"] for r in licenses.scan(df, "doc_id", "text", **how).collect()}
    assert out == {0: "MIT", 1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "Apache-2.0", 4: "GPL-3.0", 5: "GPL-3.0", 6: "ISC"}


def test_licence_ties_repeats_and_long_texts(spark):
    a, b = "Released under the MIT License", "Licensed under the BSD 3-Clause License"
    rows = [(1, f"x\n{b}\n{a}"), (2, f"{a}\n{b}"), (2, f"{a}\n{b}"), (3, "word\n" * 200_000 + a), (4, f"{a} {a}"), (None, a)]
    out = {r["id"]: (r["license"], r["line"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert out[1] == ("BSD-3-Clause", 1) and out[2] == ("MIT", 0) and out[3] == ("MIT", 200_000) and out[4] == ("MIT", 0)
    same = (("Zeta", "shared words of a notice"), ("Alpha", "shared words of a notice"))
    tied = licenses.scan(spark.createDataFrame([(1, "shared words of a notice")], "doc_id long, text string"), "doc_id", "text", templates=same).collect()
    assert [r["license"] for r in tied] == ["Alpha"]
    repeated = licenses.license_scan(spark.createDataFrame([(5, a, "p/LICENSE"), (5, a, "p/LICENSE"), (6, "x", "p/x")], "doc_id long, text string, path string"), F.col("path")).collect()
    assert sorted((r["id"], r["license"], r["origin"]) for r in repeated) == [(5, "MIT", "header"), (5, "MIT", "header"), (6, "MIT", "inherited")]


def test_versions_and_siblings_are_told_apart(spark):
    """Notices of several versions: the right licence, or none where there is no template for it."""
    notices = [
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: ISC", None),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 1", None), ("Licensed under the GNU Lesser General Public License, version 2", None),
        ("Licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"), ("Licensed under the BSD 2-Clause License", "BSD-2-Clause"), ("Licensed under the BSD 4-Clause License", None),
        ("Licensed under the BSD 3-Clause License", "BSD-3-Clause"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-SA 3.0", None), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"), ("Licensed under the MIT License.", "MIT"), ("MIT License", "MIT"),
        ("Licensed under the GNU General Public License v3", "GPL-3.0"), ("Licensed under the GNU General Public License v2", None), ("Licensed under the Apache License, Version 1.1", None),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0"), ("A story about a license to fish in the river", None),
    ]
    files = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices)], "doc_id long, text string")
    got = {r["id"]: r["license"] for r in licenses.scan(files, "doc_id", "text").collect()}
    assert {t: got.get(i) for i, (t, _) in enumerate(notices)} == dict(notices)


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, licenses.TEMPLATES + licenses.TEXTS])
def test_what_is_passed_over_could_not_reach_the_threshold(spark, templates):
    """Random parts near the threshold against plain cosines with every template."""
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    bags = [Counter(licenses.terms(t)) for _, t in templates]
    df = Counter(t for b in bags for t in b)
    weight = lambda t: math.log((1 + len(bags)) / (1 + df[t])) + 1
    parts = []
    for _ in range(400):
        words = licenses.terms(rng.choice(templates)[1])
        kept = [w for w in words if rng.random() > rng.choice([0.0, 0.1, 0.3])]
        kept += [f"other{rng.randrange(9)}" for _ in range(rng.randrange(0, 1 + len(words) // 3))]
        rng.shuffle(kept)
        parts.append(" ".join(kept))

    def best(text):
        bag = Counter(licenses.terms(text))
        norm = math.sqrt(sum((k * weight(t)) ** 2 for t, k in bag.items())) or 1
        found = []
        for (name, _), b in zip(templates, bags):
            if all(t in bag for t in b if re.fullmatch(licenses.VERSION, t)):
                dot = sum(bag[t] * k * weight(t) ** 2 for t, k in b.items()) / math.sqrt(sum((k * weight(t)) ** 2 for t, k in b.items())) / norm
                if dot >= licenses.THRESHOLD:
                    found.append((-round(dot, 9), name))
        return min(found)[1] if found else None

    files = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = {r["id"]: r["license"] for r in licenses.scan(files, "doc_id", "text", templates).collect()}
    want = {i: best(t) for i, t in enumerate(parts)}
    assert got == {i: n for i, n in want.items() if n} and 50 < len(got) < 390


@pytest.mark.parametrize("source", ["{% if x < 'a' %}y{% endif %}", "{{ x + 'a' }}", "{% if 'a' in x %}y{% endif %}", "{{ 1 + 'a' }}"])
def test_values_that_do_not_go_together(source):
    with pytest.raises(TemplateError):
        list(compile_template(source)(x=1))
