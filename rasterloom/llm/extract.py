"""Main text of web pages: what repeats across the pages of a host is not an article.

A page becomes a stream of blocks, each with the region of the page that it stands in.  The
streams of a host's pages are put one after another and their suffixes sorted by prefix doubling;
neighbours in that order that share ``RUN`` tokens on different pages are repeated substrings.
Sorting stops at ``RUN`` tokens: the windows of that length that repeat are exactly those inside of longer
repeated substrings, so a deeper order would cover the same positions.

Blocks covered by repeats go and unique runs stay, and the page's own marks are a check on both.  A repeat
inside of a marked article is a copy or a quotation, which belongs to the text; what a page with
such an article has outside of it, and menus, forms, adverts, comments and the like, go even where they
don't repeat on the host.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, grouped

#: Tokens of a repeated substring; the ends of blocks are tokens too.
RUN = 8
#: Characters of html that a task sorts at a time; larger hosts are dealt into parts that exchange their runs.
PART = 4 << 20
PLACE = ("id", "url", "site", "chars", "parts", "grp")
#: A page as it is shuffled: its place, a hash of its blocks, their size in bytes, and themselves, compressed.
PARSED = "id long, url string, site long, chars long, parts long, grp long, content long, size long, page binary"
TEXTS = "id long, url string, text string, n_repeated long, n_marked long"
#: Share of a block's words that repeats must cover.
COVER = 0.5

#: Where a block stands: anywhere, in the article, in furniture, in furniture that no article within ends.
OUTSIDE, ARTICLE, MARKED, SEALED = 0, 1, 2, 3

# Element names of HTML and usual names of page furniture.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select button textarea datalist audio video".split())
FURNITURE = frozenset("nav header footer aside form dialog menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SIBLINGS = frozenset("p li dt dd tr td th thead tbody tfoot option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comment comments discussion disqus replies respond".split())
NAMES = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer header masthead toolbar topbar share sharing social "
    "related recommended newsletter subscribe subscription signup login pagination pager widget disclaimer copyright form search".split()
)
NOT_FIRST = frozenset("has no with without article entry post".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
_WORD_BREAK = re.compile(r"[^a-z0-9]+")


def _region(name: str, attributes: str) -> int:
    """The region that an element opens by its own name, role, class or id, or OUTSIDE if none."""
    if name in FURNITURE:
        return SEALED if name == "aside" else MARKED
    if name in ("html", "body") or not attributes:
        return ARTICLE if name in ("article", "main") else OUTSIDE
    out = OUTSIDE
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            out = max(out, MARKED)
        elif key in ("class", "id"):
            for parts in map(_WORD_BREAK.split, value.split()):
                if parts[0] not in NOT_FIRST and (ends := {parts[0], parts[-1], parts[-1].rstrip("0123456789")}) & NAMES:
                    out = max(out, SEALED if ends & COMMENTS else MARKED)
    if name in ("article", "main"):
        return SEALED if out == SEALED else ARTICLE
    return out


def blocks(html: str) -> list[tuple[int, str]]:
    """The blocks of a page in order, as (region, text); scripts, styles and the like are none.

    References are decoded and white space inside of a block is one space.  An end tag closes
    what was left open inside of its element; one without a start tag is ignored.  A paragraph or an
    item ends where the next begins.
    """
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements, the region inside, whether text there is dropped
    region, dropped, at = OUTSIDE, False, 0

    def flush() -> None:
        text = " ".join(unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append((min(region, MARKED), text))

    def close(depth: int) -> None:
        nonlocal region, dropped
        if any(name not in INLINE for name, *_ in stack[depth:]):
            flush()
        del stack[depth:]
        region, dropped = stack[-1][1:] if stack else (OUTSIDE, False)

    while at < len(html):
        tag = _TAG.search(html, at)
        stop = tag.start() if tag else len(html)
        if stop > at and not dropped:
            pieces.append(html[at:stop])
        if not tag:
            break
        at, name = tag.end(), (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        inline = name in INLINE
        if tag[1] or tag[4]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    close(depth)
                    break
                if inline and stack[depth][0] not in INLINE:
                    break
            continue
        if name in VOID:
            if not inline:
                flush()
            elif not dropped:
                pieces.append(" " if name == "br" else "")
            continue
        attributes = tag[3] or tag[6] or ""
        if not inline:
            # a paragraph ends at any block, an item at its next
            last = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)
            if last >= 0 and (stack[last][0] == "p" or (name in SIBLINGS and stack[last][0] == name)):
                close(last)
            flush()
        if name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.start() if end else len(html)
        opened = _region(name, attributes)
        inside = any(r == ARTICLE for _, r, _ in stack)
        if region == SEALED or opened == OUTSIDE or (name == "header" and region == ARTICLE):
            opened = region
        elif opened == ARTICLE and inside:
            opened = region
        hide = dropped or name in HIDDEN or (inline and opened >= MARKED > region)
        stack.append((name, region if inline else opened, hide))
        region, dropped = stack[-1][1:]
    flush()
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; sorting is faster here than the hash table of ``np.unique``."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """The rank of every suffix among all suffixes by its first ``length`` tokens; equal beginnings, equal rank.

    Ranks by 1, 2, 4, ... tokens each come from two ranks by half as many; the last step joins two that overlap.
    """
    rank, done, n = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1, len(tokens)
    while done < length:
        step = min(done, length - done)
        second = np.full(n, -1, dtype=np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + second + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


def _streams(pages: list[list[tuple[int, str]]]) -> tuple[list[int], list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """The content of each page by number, the different contents, their tokens in one stream, the content at each token, and the words by number.

    Tokens are words by number from 1, digits all alike, and 0 at the end of a block.
    """
    seen: dict[tuple, int] = {}
    content = [seen.setdefault(tuple(p), len(seen)) for p in pages]
    split = pc.split_pattern(pc.replace_substring_regex(pa.array([t for s in seen for _, t in s], pa.string()), "[0-9]", "0"), " ")
    words = split.flatten().dictionary_encode()
    blocks_of = np.array([len(s) for s in seen], dtype=np.int64)
    page = np.repeat(np.arange(len(seen)), blocks_of)
    length = np.diff(split.offsets.to_numpy()).astype(np.int64)
    sizes = np.bincount(page, length, len(seen)).astype(np.int64) + blocks_of + 1
    stream = np.zeros(int(sizes.sum()), dtype=np.int64)
    stream[np.arange(len(words)) + np.repeat(np.arange(len(page)) + page, length)] = words.indices.to_numpy() + 1
    # a token of its own ends every stream, so no repeat reaches into the next page
    stream[np.cumsum(sizes) - 1] = -1 - np.arange(len(seen))
    return content, list(seen), stream, np.repeat(np.arange(len(seen)), sizes), words.dictionary.to_numpy(zero_copy_only=False)


def _hashes(stream: np.ndarray, page: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the ``RUN`` tokens at each position, the same in every part of a host, and whether they lie within their page."""
    code = np.concatenate([np.ones(1, dtype=np.uint64), pd.util.hash_array(words, categorize=False)])
    tokens, out = code[np.maximum(stream, 0)], np.zeros(len(stream), dtype=np.uint64)
    for i in range(min(RUN, len(stream))):
        at = out[: len(stream) - i]
        at ^= tokens[i:]
        at *= np.uint64(0x9E3779B97F4A7C15)
        at ^= at >> np.uint64(29)
    return out, np.arange(len(stream)) + RUN <= np.flatnonzero(stream < 0)[page]


def repeats(pages: list[list[tuple[int, str]]], elsewhere: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """For each page and its blocks: on how many different pages the runs stand that cover it, or 0 if it is not covered.

    Pages are counted once for each content: copies of a whole page are one page.  Where ``pages`` are a part of a host,
    ``elsewhere`` has the hashes, in order, of the runs that other parts have too, and their pages in all parts.
    """
    content, seen, stream, page, words = _streams(pages)
    if len(stream) == len(seen):
        return [np.zeros(len(p), dtype=np.int64) for p in pages]

    rank = windows(stream, RUN)
    meetings = _distinct(rank * len(seen) + page)
    support = np.bincount(meetings // len(seen), minlength=int(rank.max()) + 1)
    support = np.where(support > 1, support, 0)[rank]
    if elsewhere is not None and len(elsewhere[0]):
        run, within = _hashes(stream, page, words)
        at = np.minimum(np.searchsorted(elsewhere[0], run), len(elsewhere[0]) - 1)
        support = np.where(within & (elsewhere[0][at] == run), elsewhere[1][at], support)
    covered = support.copy()
    for i in range(1, RUN):
        covered[i:] = np.maximum(covered[i:], support[:-i])

    # blocks end at their own 0; the page's last token makes a block that is left out
    word = stream > 0
    first = np.r_[0, np.flatnonzero(~word)[:-1] + 1]
    length, hit = (np.add.reduceat(x.astype(np.int64), first) for x in (word, word & (covered > 0)))
    times = np.where(hit >= COVER * length, np.maximum.reduceat(np.where(word, covered, 0), first), 0)
    blocks_of = np.split(times, np.cumsum([len(s) + 1 for s in seen])[:-1])
    return [blocks_of[c][:-1] for c in content]


def kept_blocks(page: list[tuple[int, str]], times: np.ndarray) -> np.ndarray:
    """Which blocks of a page are its main text."""
    region = np.array([r for r, _ in page], dtype=np.int64)
    if (region == ARTICLE).any():
        return region == ARTICLE
    free = region == OUTSIDE
    unique = free & (times == 0)
    if unique.any() or not free.any():
        return unique
    # a copy in part of other pages: furniture stands on at least as many pages as the copied text
    return free & (times == times[free].min())


def _packed(page: list[tuple[int, str]]) -> bytes:
    """A page's blocks as bytes: lines of a region's digit and a text, which has no line ends of its own."""
    return "\n".join(f"{r}{t}" for r, t in page).encode()


def _pages(part: pa.Table) -> list[list[tuple[int, str]]]:
    codec = pa.Codec("zstd")
    pages = zip(part["page"].to_pylist(), part["size"].to_pylist(), strict=True)
    texts = (codec.decompress(p, n, asbytes=True).decode() if n else "" for p, n in pages)
    return [[(int(line[0]), line[1:]) for line in t.split("\n")] if t else [] for t in texts]


def _texts(part: pa.Table, elsewhere: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """The main texts of a host's pages, or of a part of them."""
    pages = _pages(part)
    texts, repeated, marked = [], [], []
    for page, times in zip(pages, repeats(pages, elsewhere), strict=True):
        keep = kept_blocks(page, times)
        texts.append("\n".join(t for (_, t), k in zip(page, keep, strict=True) if k))
        gone = [(t.count(" ") + 1, n) for (_, t), k, n in zip(page, keep.tolist(), times.tolist(), strict=True) if not k]
        repeated.append(sum(w for w, n in gone if n > 0))
        marked.append(sum(w for w, n in gone if n == 0))
    return pa.table([part["id"], part["url"], pa.array(texts, pa.string()), pa.array(repeated, pa.int64()), pa.array(marked, pa.int64())], names=["id", "url", "text", "n_repeated", "n_marked"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, at in grouped(batches, ["grp"]):
        for s, e in zip(at[:-1], at[1:], strict=True):
            yield from _texts(rows.slice(s, e - s).combine_chunks()).to_batches(max_chunksize=1000)


# Parts of a large host tell each other the hashes of their runs.  Most runs stand in one part only or in articles, which keep what
# repeats; so the parts first tell the leading bits of their hashes, and whole hashes only of runs that another part may have too
# and whose number of pages the text of some page or its counts depend on.


def _pack(values: np.ndarray) -> bytes:
    """Different rising integers as Elias-Fano codes: about 2 bits and the logarithm of their mean distance for each."""
    n, base = len(values), int(values[0]) if len(values) else 0
    span = int(values[-1]) - base + 1 if n else 1
    k = max(0, (span // max(n, 1)).bit_length() - 1)
    rest = values - np.uint64(base)
    high = np.zeros(n + (span >> k) + 1, dtype=np.uint8)
    high[(rest >> np.uint64(k)).astype(np.int64) + np.arange(n)] = 1
    low = np.empty((n, k), dtype=np.uint8)
    for i in range(k):
        low[:, i] = (rest >> np.uint64(i)) & np.uint64(1)
    return struct.pack("<QIB", base, n, k) + np.packbits(low).tobytes() + np.packbits(high).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    base, n, k = struct.unpack_from("<QIB", data)
    at, size = struct.calcsize("<QIB"), (n * k + 7) // 8
    low = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * k).reshape(n, k)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=at + size)))[:n] - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(k)
    for i in range(k):
        out |= low[:, i].astype(np.uint64) << np.uint64(i)
    return out + np.uint64(base)


def _asked(contents: list[tuple], stream: np.ndarray) -> np.ndarray:
    """At which positions runs begin whose pages must be counted: those over a block that no article of its page decides on."""
    matter = []
    for blocks_ in contents:
        article = any(r == ARTICLE for r, _ in blocks_)
        matter += [*(not article or r != ARTICLE for r, _ in blocks_), False]
    ends = np.flatnonzero(stream <= 0)
    word = np.repeat(np.array(matter, dtype=bool), np.diff(np.r_[-1, ends]))
    out = word.copy()
    for i in range(1, RUN):
        out[:-i] |= word[i:]
    return out


def _leading(part: pa.Table) -> np.uint64:
    """By how many bits the hashes of a host's runs are cut, so that few of all its runs share what is left."""
    return np.uint64(max(0, 63 - part["chars"][0].as_py().bit_length()))


def _ranges(part: pa.Table) -> int:
    """Into how many ranges the hashes of a host's runs are dealt: one for each four parts."""
    return -(-part["parts"][0].as_py() // 4)


def _tell(part: pa.Table) -> pa.Table:
    """The leading bits of a part's runs, a row for each range of them."""
    _, seen, stream, page, words = _streams(_pages(part))
    run, within = _hashes(stream, page, words)
    drop, ranges = _leading(part), _ranges(part)
    values, asked = _distinct(run[within] >> drop), _distinct(run[within & _asked(seen, stream)] >> drop)
    other = np.ones(len(values), dtype=bool)
    other[np.searchsorted(values, asked)] = False
    bounds = np.array([(i << (64 - int(drop))) // ranges for i in range(1, ranges)], dtype=np.uint64)
    cells = [[_pack(x) for x in np.split(v, np.searchsorted(v, bounds))] for v in (asked, values[other])]
    cols = [pa.array([part[c][0].as_py()] * ranges, pa.int64()) for c in ("site", "grp")]
    return pa.table([cols[0], pa.array(range(ranges), pa.int64()), cols[1], *(pa.array(c, pa.binary()) for c in cells)], names=["site", "bucket", "grp", "asked", "other"])


def _shared(told: pa.Table) -> pa.Table:
    """For each part the leading bits of a range that another part has too and that one of them asks for."""
    asked, other = ([_unpack(b) for b in told[c].to_pylist()] for c in ("asked", "other"))
    values = np.sort(np.concatenate(asked + other))
    wanted = np.intersect1d(_distinct(values[1:][values[1:] == values[:-1]]), _distinct(np.concatenate(asked)), assume_unique=True)
    found = [(g, np.intersect1d(np.concatenate([a, o]), wanted, assume_unique=True)) for g, a, o in zip(told["grp"].to_pylist(), asked, other, strict=True)]
    found = [(g, _pack(x)) for g, x in found if len(x)]
    return pa.table([pa.array([g for g, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["teller", "shared"])


def _runs_of_part(part: pa.Table, others: pa.Table) -> pa.Table:
    """The different runs of a part that others may have and on how many of its contents they stand, without those that another part counts."""
    pages, counted = _pages(part), set(others["counted"].drop_null().to_pylist())
    shared = np.concatenate([_unpack(b) for b in others["shared"].drop_null().to_pylist()] or [np.zeros(0, dtype=np.uint64)])
    content, seen, stream, page, words = _streams(pages)
    home = np.ones(len(seen), dtype=np.int64)
    for c, key in zip(content, part["content"].to_pylist(), strict=True):
        home[c] = key not in counted
    run, within = _hashes(stream, page, words)
    within &= np.isin(run >> _leading(part), shared)
    run, page = run[within], page[within]
    order = np.lexsort((page, run))
    run, page = run[order], page[order]
    once = np.ones(len(run), dtype=bool)
    once[1:] = (run[1:] != run[:-1]) | (page[1:] != page[:-1])
    run, counts = run[once], home[page[once]]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, dtype=np.int64)
    counts = np.add.reduceat(counts, first).astype(np.uint32) if len(run) else counts.astype(np.uint32)
    run = run[first]
    bucket = run % np.uint64(_ranges(part))
    order = np.argsort(bucket, kind="stable")
    run, counts = run[order], counts[order]
    names, starts = np.unique(bucket[order], return_index=True)
    ends = np.r_[starts, len(run)][1:].astype(np.int64)
    site, grp = part["site"][0].as_py(), part["grp"][0].as_py()
    cols = [pa.array([site] * len(names), pa.int64()), pa.array(names.astype(np.int64)), pa.array([grp] * len(names), pa.int64())]
    cols += [pa.array([v[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()) for v in (run, counts)]
    return pa.table(cols, names=["site", "bucket", "grp", "runs", "counts"])


def _meet(told: pa.Table) -> pa.Table:
    """For each part the runs of a range that another part has too, and their contents in all parts."""
    runs = [np.frombuffer(b, dtype=np.uint64) for b in told["runs"].to_pylist()]
    counts = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in told["counts"].to_pylist()]).astype(np.int64)
    sizes, run = [len(r) for r in runs], np.concatenate(runs)
    run, at = np.unique(run, return_inverse=True)
    total = np.zeros(len(run), dtype=np.int64)
    np.add.at(total, at, counts)
    told_by = np.bincount(at, minlength=len(run))
    grp, found, totals = [], [], []
    for g, mine in zip(told["grp"].to_pylist(), np.split(at, np.cumsum(sizes)[:-1]), strict=True):
        mine = mine[(told_by[mine] > 1) & (total[mine] > 1)]
        if len(mine):
            grp.append(g)
            found.append(run[mine].tobytes())
            totals.append(total[mine].astype(np.uint32).tobytes())
    return pa.table([pa.array(grp, pa.int64()), pa.array(found, pa.binary()), pa.array(totals, pa.binary())], names=["teller", "runs", "totals"])


def _texts_of_part(part: pa.Table, met: pa.Table) -> pa.Table:
    run = np.concatenate([np.frombuffer(b, dtype=np.uint64) for b in met["runs"].to_pylist()] or [np.zeros(0, dtype=np.uint64)])
    total = np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in met["totals"].to_pylist()] or [np.zeros(0, dtype=np.uint32)])
    order = np.argsort(run)
    return _texts(part.combine_chunks(), (run[order], total[order].astype(np.int64)))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.select(["site", "content", "grp"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        for s in range(0, batch.num_rows, 200):
            part = batch.slice(s, 200)
            pages = [_packed(blocks(h or "")) for h in part.column("html").to_pylist()]
            content = [int.from_bytes(blake2b(p, digest_size=8).digest(), "little", signed=True) for p in pages]
            cols = [pa.array(content, pa.int64()), pa.array([len(p) for p in pages], pa.int64()), pa.array([codec.compress(p, asbytes=True) for p in pages], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in PLACE), *cols], names=[*PLACE, "content", "size", "page"])


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, blocks joined by line ends.

    Returns ``id, url, text, n_chars, n_repeated, n_marked``, one row per row of ``df``: the text, its code
    points, and how many words went because they repeat on the host and how many only because of the page's marks.

    Pages of a host are compared with each other, those without a host too, all with all however large the host is.  A host of
    more than ``PART`` characters of html is dealt into parts by a hash of the page; the parts exchange the 64-bit hashes of
    their runs, so that a run counts on how many pages of the host it stands, as in a host of one part.  Null html is empty; empty pages and those without an
    article and without a block of their own have empty text.  Pages are read whole.  Rows that are copies, or share
    an id, are pages of their own but count once as a repeat if their content is equal.  An empty table gives an empty result; other columns play no part.
    """
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    pages = pages.withColumn("host", host(F.col("url")))
    size = pages.groupBy("host").agg(F.sum(F.coalesce(F.length("html"), F.lit(0))).alias("n"))
    large = cut(size.where(F.col("n") > PART).select("host", F.col("n").alias("chars"), F.ceil(F.col("n") / PART).alias("parts")), "hosts")
    part = F.pmod(F.xxhash64("id", "url", F.length("html")), F.coalesce("parts", F.lit(1)))
    dealt = pages.join(large, "host", "left").select("id", "url", "html", F.xxhash64("host").alias("site"), "chars", F.coalesce("parts", F.lit(1)).alias("parts"), F.xxhash64("host", part).alias("grp"))
    parsed = dealt.where("parts = 1").mapInArrow(_parse, PARSED)
    parsed = parsed.repartition("grp").sortWithinPartitions("grp")
    out = parsed.mapInArrow(_extract, TEXTS)
    if not large.isEmpty():
        # all uses of the parts are of one shuffle of them, whole rows for that; only keys and hashes move again
        parts = dealt.where("parts > 1").mapInArrow(_parse, PARSED).repartition("grp")
        # a content that several parts hold is counted by one of them
        held = parts.mapInArrow(_contents, "site long, content long, grp long").distinct()
        others = held.withColumn("home", F.min("grp").over(Window.partitionBy("site", "content"))).where("grp <> home")
        told = parts.groupBy("grp").applyInArrow(_tell, "site long, bucket long, grp long, asked binary, other binary")
        shared = told.groupBy("site", "bucket").applyInArrow(_shared, "teller long, shared binary")
        others = others.select(F.col("grp").alias("teller"), F.col("content").alias("counted"), F.lit(None).cast("binary").alias("shared"))
        others = others.unionByName(shared.withColumn("counted", F.lit(None).cast("long")))
        told = parts.groupBy("grp").cogroup(others.groupBy("teller")).applyInArrow(_runs_of_part, "site long, bucket long, grp long, runs binary, counts binary")
        met = told.groupBy("site", "bucket").applyInArrow(_meet, "teller long, runs binary, totals binary")
        out = out.union(parts.groupBy("grp").cogroup(met.groupBy("teller")).applyInArrow(_texts_of_part, TEXTS))
    return out.select("id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated", "n_marked")
