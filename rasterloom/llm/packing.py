"""Packing tokenised documents into sequences of one length.

A document's ids and one closing id are cut into whole sequences and a rest.  The rest goes,
best fit, into one of a fixed number of open windows of the task.  When none fits and all
are open, the fullest is emitted; if it lacks more than ``SLACK`` ids, the rest's first
ids fill it.  What stays open at the end of the tasks is merged: 32 tasks' windows go
through the same packer, then 32 of these, until one group is left; its windows are
closed up, and the last one is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, grouped

LENGTH = 2048
WINDOWS = 64
SLACK = 8
FAN_IN = 32
END_ID = 1
#: Words and parts of words whose ids a worker keeps; beyond, it starts afresh and keeps those
#: until then for as many more.
CACHE = 250_000

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\s\w]|_)+")
_PLAIN = re.compile(r"[\x00-įı-ɏ]*")
#: How the vocabulary file that ``Ids`` knows cuts a text, and its special strings.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPECIAL = {"<|startoftext|>", "<|endoftext|>"}
_ODD = re.compile("[\x1c-\x1f]|<\\|(?:start|end)oftext\\|>")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return out


def splits_at_blanks(about: dict) -> bool:
    """Whether a tokenizer's file has the steps, the pattern and the special strings that ``Ids`` imitates."""
    before, cuts = ((about.get(part) or {}).get(of) or [] for part, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    steps = [x.get("type") for x in (*before, *cuts)]
    patterns = [x["pattern"].get("Regex") for x in (*before, *cuts) if "pattern" in x]
    special = {x["content"] for x in about.get("added_tokens") or []}
    return steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and patterns == [r"\s+", _SPLIT] and special == _SPECIAL and about["model"]["type"] == "BPE"


class Ids:
    """Ids of texts, word by word, equal to the tokenizer's own for the whole text.

    The tokenizer never joins what white space parts, so a word's ids are the same in any
    text; words met before are looked up.  Texts with its special strings, or with the four
    control characters that it and Python split differently, go to it whole.  So do all texts if the
    file is set up in another way than this class knows.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = splits_at_blanks(json.load(f))
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.coded = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return b"".join([self.coded[i] for i in self.whole.encode(text, add_special_tokens=False).ids])

    def _part(self, part: str) -> bytes:
        ids = self.words.get(part) or self.older.get(part)
        if ids is None:
            shown = part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.coded[t.id] for t in self.model.tokenize(shown)])
        self.words[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._whole(word)
        return b"".join(map(self._part, _PARTS.findall(word.lower())))

    def __call__(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids."""
        if not self.by_words or _ODD.search(text):
            return self._whole(text)
        words = text.split()
        new = set(words).difference(self.words)
        if new:
            if len(self.words) + len(new) > CACHE:
                self.older, self.words = self.words, {}
                new = set(words)
            for w in new:
                self.words[w] = self.older.get(w) or self._word(w)
        return b"".join(map(self.words.__getitem__, words))


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


class Packer:
    """Open windows; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, length: int, windows: int, slack: int):
        self.length, self.most, self.slack = length, windows, slack
        self.open: dict[int, list] = {}
        self.free: list[tuple[int, int]] = []
        self.made = self._key = 0
        self.closed: list[tuple[int, list]] = []

    def _close(self, pieces: list) -> None:
        self.closed.append((self.made, pieces))
        self.made += 1

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        size = len(ids) // 4
        while size >= self.length:
            self._close([(doc, start, ids[: 4 * self.length], doc_tokens)])
            start, ids, size = start + self.length, ids[4 * self.length :], size - self.length
        if size:
            self._place(doc, start, ids, doc_tokens)

    def _place(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        size = len(ids) // 4
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, key = self.free.pop(at)
            self.open[key].append((doc, start, ids, doc_tokens))
            room -= size
            if room:
                insort(self.free, (room, key))
            else:
                self._close(self.open.pop(key))
            return
        if len(self.open) >= self.most:
            room, key = self.free.pop(0)
            pieces = self.open.pop(key)
            if room > self.slack:  # smaller than the piece, as it didn't fit
                pieces.append((doc, start, ids[: 4 * room], doc_tokens))
                start, ids, size = start + room, ids[4 * room :], size - room
            self._close(pieces)
            self._place(doc, start, ids, doc_tokens)
            return
        self._key += 1
        self.open[self._key] = [(doc, start, ids, doc_tokens)]
        insort(self.free, (self.length - size, self._key))

    def finish(self) -> None:
        """Close all windows: each is filled from the emptiest, the last cut into powers of two."""
        rest = [p for _, key in self.free for p in self.open[key]]
        self.open, self.free = {}, []
        window, room = [], self.length

        def powers(left: int) -> Iterator[int]:
            while left:
                yield (one := 1 << (left.bit_length() - 1))
                left -= one

        total = sum(len(p[2]) // 4 for p in rest)
        sizes = iter([self.length] * (total // self.length) + list(powers(total % self.length)))
        room = next(sizes, 0)
        for doc, start, ids, doc_tokens in rest:
            while ids:
                part = ids[: 4 * room]
                window.append((doc, start, part, doc_tokens))
                start, ids, room = start + len(part) // 4, ids[4 * room :], room - len(part) // 4
                if not room:
                    self._close(window)
                    window, room = [], next(sizes, 0)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, window long, ids binary"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(_NAMES, columns, strict=True)], names=_NAMES)


def _done(packer: Packer, base: int, rows: list[tuple]) -> None:
    for number, pieces in packer.closed:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), doc_tokens, base + number, offset, None, None, None))
            offset += n
    packer.closed = []


def _left(packer: Packer, task: int, rows: list[tuple]) -> None:
    for window, pieces in enumerate(packer.open.values()):
        for doc, start, ids, doc_tokens in pieces:
            rows.append((doc, start, None, None, doc_tokens, None, None, task, window, ids))


def _pack(path: str, length: int, windows: int, slack: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_for, packer, task = ids_of(path), Packer(length, windows, slack), TaskContext.get().partitionId()
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_for(text.as_py() or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
                if len(packer.closed) >= 2000:
                    _done(packer, task << 32, rows)
                    yield _batch(rows)
                    rows = []
        _done(packer, task << 32, rows)
        _left(packer, task, rows)
        yield _batch(rows)

    return run


def _merge(length: int, windows: int, slack: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, rows = None, None, []
        for table, at in grouped(batches, ["group"]):
            for s, e in zip(at[:-1], at[1:], strict=True):
                part = table.slice(s, e - s).to_pydict()
                group, packer = part["group"][0], Packer(length, windows, slack)
                for doc, start, ids, doc_tokens in zip(part["doc_id"], part["start"], part["ids"], part["doc_tokens"], strict=True):
                    packer.add(doc, start, ids, doc_tokens)
                if last:
                    packer.finish()
                _done(packer, (level << 56) | (group << 32), rows)
                _left(packer, group, rows)
        yield _batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``length`` ids.

    ``tokenizer`` is the path of a vocabulary file that every executor has.  A document
    is its ids and a closing id 1; a null or empty text is that id alone.  Returns a row
    per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Rows that share an id are packed each on its own.  Only the two columns are read; an
    empty table gives no piece.  A task holds ``windows`` open windows at most.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    done = cut(slim.mapInArrow(_pack(tokenizer, length, windows, slack), _SCHEMA), "packed")
    keep = _NAMES[:7]
    parts, level = [done.where("sequence_id is not null").select(*keep)], 1
    tasks = done.agg(F.max("task")).first()[0]
    while tasks is not None:
        left = done.where("sequence_id is null").withColumn("group", F.floor(F.col("task") / FAN_IN).cast("long"))
        last = tasks < FAN_IN
        rows = left.repartition("group").sortWithinPartitions("group", "task", "window", "doc_id", "start")
        done = cut(rows.mapInArrow(_merge(length, windows, slack, level, last), _SCHEMA), "packed")
        parts.append(done.where("sequence_id is not null").select(*keep))
        if last:
            break
        tasks, level = tasks // FAN_IN, level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
