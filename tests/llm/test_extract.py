from collections import defaultdict

import numpy as np
import pytest

from rasterloom.llm import extract
from rasterloom.llm.extract import ARTICLE, MARKED, OUTSIDE, RUN, blocks, kept_blocks, main_text, repeats, windows

MENU = "<div><span>Home</span> <span>News and views</span></div><div>All the topics of the day</div>"
FOOT = "<div>Copyright 2024 by the example company, all rights reserved</div>"


def page(body, menu=MENU, foot=FOOT):
    return f"<html><head><title>t</title></head><body>{menu}{body}{foot}</body></html>"


def texts(html):
    return [t for r, t in blocks(html) if r == ARTICLE]


def test_blocks_of_odd_markup():
    assert texts("<article><h1>A &amp; B</h1><p><b>one<br><p>two\n  <i>th</i>ree&nbsp;x</p>tail</article>") == ["A & B", "one", "two three x", "tail"]
    assert texts("<article><p>cut &am") == ["cut &am"]
    assert texts("<article><p>5 &lt; 6 &#x41;&#66;<!-- no > <p>no --><script>var a='</p>';</script><style>p{}</style></p></article>") == ["5 < 6 AB"]
    assert texts("<nav><p>menu<article><p>text</p></article>") == ["text"]
    assert texts('<article><div class="ad">no</div><p>yes <span class="ad">no</span>again</p><form>no</form><aside><p>no</p></aside></article>') == ["yes again"]
    assert texts('<article>t<section class="comments"><article><p>reader</p></article></section></article>') == ["t"]
    assert texts('<aside><article>teaser</article></aside><main><header><h1>T</h1></header>x</main>') == ["T", "x"]
    assert texts('<div class="has-sidebar"><article class="post comment-open" title="a > b">x</article></div>') == ["x"]
    assert texts('<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e</table></article>') == ["a", "b", "c", "d", "e"]
    assert blocks("") == [] and blocks("<") == [(OUTSIDE, "<")] and blocks("plain") == [(OUTSIDE, "plain")]
    for name in ("cookie-notice", "left-sidebar", "site-footer", "ad", "ad-300", "comments", "newsletter signup"):
        assert blocks(f'<div class="{name}">x</div>') == [(MARKED, "x")], name
    for name in ("content", "article-header", "no-sidebar", "reading", "additional"):
        assert blocks(f'<div class="{name}">x</div>') == [(OUTSIDE, "x")], name
    assert blocks('<div role="navigation">a</div><p hidden>b</p><p>c') == [(MARKED, "a"), (MARKED, "b"), (OUTSIDE, "c")]


def test_unclosed_quotes_take_linear_time():
    assert blocks('<a "' * 20000) is not None
    assert len(blocks("<div>x" * 20000)) == 20000


def test_windows_rank_by_their_tokens():
    rng = np.random.default_rng(0)
    for length in (1, 2, 3, 5, 8):
        x = rng.integers(0, 3, 200)
        want = [tuple(x[i : i + length].tolist()) for i in range(200)]
        rank = windows(x, length)
        order = {w: k for k, w in enumerate(sorted(set(want)))}
        assert rank.tolist() == [order[w] for w in want]


def plain_repeats(pages):
    """By comparing all windows of all pages."""
    streams = []
    for p in pages:
        s = []
        for b, (_, t) in enumerate(p):
            s += [(b, "".join("0" if c.isascii() and c.isdigit() else c for c in w)) for w in t.split(" ")] + [(b, "")]
        streams.append(s)
    distinct = {tuple(p): k for k, p in enumerate(pages)}
    on = defaultdict(set)
    for p, s in zip(pages, streams):
        for i in range(len(s) - RUN + 1):
            on[tuple(w for _, w in s[i : i + RUN])].add(distinct[tuple(p)])
    out = []
    for p, s in zip(pages, streams):
        cover = [0] * len(s)
        for i in range(len(s) - RUN + 1):
            k = len(on[tuple(w for _, w in s[i : i + RUN])])
            for j in range(i, i + RUN):
                cover[j] = max(cover[j], k if k > 1 else 0)
        row = []
        for b in range(len(p)):
            c = [x for x, (at, w) in zip(cover, s) if at == b and w]
            row.append(max(c) if sum(x > 0 for x in c) >= extract.COVER * len(c) else 0)
        out.append(row)
    return out


def test_repeats_against_all_windows():
    rng = np.random.default_rng(1)
    lines = [" ".join(f"w{k}" for k in rng.integers(0, 30, rng.integers(1, 12))) for _ in range(12)]
    pages = []
    for _ in range(60):
        parts = [(int(rng.integers(3)), lines[i] if rng.random() < 0.7 else " ".join(f"w{k}" for k in rng.integers(0, 30, 9))) for i in rng.integers(0, 12, rng.integers(0, 7))]
        pages.append(parts)
    pages += [pages[3], [], pages[3]]
    assert [r.tolist() for r in repeats(pages)] == plain_repeats(pages)
    assert repeats([]) == [] and [r.tolist() for r in repeats([[], []])] == [[], []]


ROWS = "page_id long, url string, html string, text string, n_chars long"


def extracted(spark, rows):
    out = main_text(spark.createDataFrame([(*r, "other", 5) for r in rows], ROWS))
    assert out.columns == ["id", "url", "text", "n_chars", "n_repeated", "n_marked"]
    return {r["id"]: r for r in out.collect()}


def test_boilerplate_without_marks_is_found_by_repeats(spark):
    bodies = [f"<div>Story {w} tells of {w} and more of {w} in its own words</div><div>It ends with {w}</div>" for w in ("apples", "boats", "clouds", "dunes")]
    rows = [(i, f"http://u@A.example:80/{i}", page(b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://other.example/1", page(bodies[0]))]
    got = extracted(spark, rows)
    for i, w in enumerate(("apples", "boats", "clouds", "dunes")):
        assert got[i]["text"] == f"Story {w} tells of {w} and more of {w} in its own words\nIt ends with {w}"
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["n_repeated"] > 10 and got[i]["n_marked"] == 0
    # a host's only page has nothing to repeat
    assert got[10]["text"].startswith("Home News and views") and got[10]["n_repeated"] == 0


def test_copies_keep_their_text(spark):
    body = "<div>The same story stands here once more, with a dozen words</div>"
    rows = [(1, "http://a.example/1", page(body)), (2, "http://a.example/2", page(body)), (1, "http://a.example/1", page(body))]
    rows += [(3 + i, f"http://a.example/{i}", page(f"<p>Some other text, number {w}, has its own words: {w} {w}</p>")) for i, w in enumerate("pqrs")]
    near = page("<div>" + "A long story that two pages share to the word " * 3 + "</div>")
    rows += [(20, "http://a.example/x", near), (21, "http://a.example/y", near.replace("<body>", "<body><nav>one</nav>"))]
    got = extracted(spark, rows)
    assert got[1]["text"] == got[2]["text"] == "The same story stands here once more, with a dozen words"
    assert got[20]["text"] == got[21]["text"] == ("A long story that two pages share to the word " * 3).strip()


def test_articles_keep_what_repeats(spark):
    quote = "<p>This passage of a good many words is quoted by every page of the host</p>"
    rows = [(i, "http://a.example/", page(f"<article><p>Own text {i}</p>{quote}</article><p>beside it {i}</p>")) for i in range(5)]
    got = extracted(spark, rows)
    assert all(got[i]["text"] == f"Own text {i}\nThis passage of a good many words is quoted by every page of the host" for i in range(5))


def test_odd_rows_and_parts(spark, monkeypatch):
    rows = [(1, None, None), (2, "nonsense", ""), (None, None, "<article>x</article>"), (4, None, "<p>" + "long " * 50000)]
    got = extracted(spark, rows)
    assert [got[i]["text"] for i in (1, 2, None)] == ["", "", "x"]
    assert got[4]["n_chars"] == 5 * 50000 - 1 and got[1]["n_chars"] == 0
    empty = main_text(spark.createDataFrame([], ROWS))
    assert empty.count() == 0
    monkeypatch.setattr(extract, "PART", 1500)
    many = [(i, "http://a.example/", page(f"<div>Body of {i} with words that are {chr(97 + i)} {chr(98 + i)} only</div>")) for i in range(24)]
    got = extracted(spark, many)
    assert all(got[i]["text"].startswith(f"Body of {i} with") for i in range(24))


def test_every_page_of_the_table(spark):
    """Every page's text against a plain reading of the one article that each page marks."""
    import html as h
    import re
    from pathlib import Path

    import pyarrow.parquet as pq

    from rasterloom.llm.queries import QUERIES

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no tables")
    got = {r["page_id"]: r for r in QUERIES["op12_extraction"](spark, "/root/testdata/sf0.001").collect()}
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1] if body else "")
        want = [" ".join(h.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert got[r["page_id"]]["text"] == "\n".join(w for w in want if w)
        assert got[r["page_id"]]["url"] == r["url"]


def test_kept_blocks():
    regions = [(OUTSIDE, "a"), (MARKED, "b"), (OUTSIDE, "c")]
    assert kept_blocks(regions, np.array([0, 0, 3])).tolist() == [True, False, False]
    assert kept_blocks(regions, np.array([5, 0, 2])).tolist() == [False, False, True]
    assert kept_blocks([(MARKED, "b")], np.array([0])).tolist() == [False]
    assert kept_blocks([], np.array([], dtype=np.int64)).tolist() == []


def test_results_do_not_depend_on_the_parts_of_a_host(spark, monkeypatch):
    """Runs on two pages, copies in several parts and quotations, in one part and in many."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "el")]
    lines = [" ".join(rng.choice(words, 10)) for _ in range(90)]
    rows = []
    for i in range(120):
        own = "".join(f"<div>{' '.join(rng.choice(words, 14))}</div>" for _ in range(2))
        body = own + "".join(f"<p>{lines[k]}</p>" for k in (i // 2 % 45, 45 + i * 7 % 45)) if i % 10 else f"<p>{lines[i // 30]}</p><p>{lines[9]}</p>"
        rows.append((i, f"http://a.example/{i}", page(body, menu=MENU if i % 2 else "<div>Only some few pages have this</div>")))
    rows += [(200 + i, f"http://a.example/copy/{i}", rows[i % 3][2]) for i in range(40)]
    want = extracted(spark, rows)
    total = sum(len(h) for *_, h in rows)
    assert total < extract.PART
    for size in (total // 3, total // 40):
        monkeypatch.setattr(extract, "PART", size)
        assert extracted(spark, rows) == want


def test_adverts_that_quote_articles_of_other_parts(spark, monkeypatch):
    """Runs of articles count for the blocks beside them, in whatever part of the host the articles are."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "e", "i", "o", "u", "an", "el")]
    lines = [" ".join(rng.choice(words, 12)) for _ in range(160)]
    rows = []
    for i in range(80):
        advert = " ".join(rng.choice(words, 12)) if i % 3 else lines[(i * 2 + 31) % 160] + " and so on"
        article = f"<article><h1>{lines[i * 2]}</h1><p>{lines[(i * 2 + 3) % 160]}</p></article>" if i % 8 else f"<div>{lines[i * 2]}</div>"
        rows.append((i, f"http://a.example/{i}", page(f'<div class="ad">{advert}</div>{article}<div>{' '.join(rng.choice(words, 11)) if i % 5 else lines[i]}</div>')))
    want = extracted(spark, rows)
    assert len({r["n_repeated"] for r in want.values()}) > 2 and sum(r["n_marked"] for r in want.values()) > 100
    total = sum(len(h) for *_, h in rows)
    for size in (total // 2, total // 30):
        monkeypatch.setattr(extract, "PART", size)
        assert extracted(spark, rows) == want


def test_parts_of_a_host_exchange_less_than_its_pages(spark, monkeypatch):
    """What is shuffled stays below the html where all words of a host differ and it has many parts."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    text = lambda n: " ".join(map("".join, rng.choice(letters, (n, 7))))
    rows = [(i, f"http://a.example/{i}", page(f"<article><p>{text(300)}</p></article>")) for i in range(400)]
    total = sum(len(h) for *_, h in rows)
    monkeypatch.setattr(extract, "PART", total // 12)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = extracted(spark, rows)
    assert len(got) == 400 and all(r["n_chars"] == 300 * 8 - 1 and r["n_repeated"] == 19 for r in got.values())
    assert 0 < written() - before < total


def test_codes_of_rising_integers():
    rng = np.random.default_rng(6)
    for n, top in ((0, 9), (1, 2**64 - 1), (2, 2**64 - 1), (40, 50), (3000, 2**20), (3000, 2**50)):
        values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        data = extract._pack(values)
        assert np.array_equal(extract._unpack(data), values)
        assert len(data) <= 16 + len(values) / 8 * (3 + max(0.0, np.log2(max(1, top) / max(1, len(values)))))


def test_parts_without_shared_runs_or_text(spark, monkeypatch):
    monkeypatch.setattr(extract, "PART", 400)
    words = [f"{a}{b}{c}" for a in "bcdfgklmnp" for b in "aeiou" for c in "rstxyz"]
    rows = [(i, f"http://a.example/{i}", f"<article>{' '.join(words[i * 10 : i * 10 + 10])}</article><i>") for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", "<!-- " + "x" * 300 + " -->") for i in range(9)]
    got = extracted(spark, rows)
    assert len(got) == 39 and all(got[i]["n_chars"] == 39 for i in range(30)) and all(got[100 + i]["text"] == "" for i in range(9))
    assert {(r["n_repeated"], r["n_marked"]) for r in got.values()} == {(0, 0)}
