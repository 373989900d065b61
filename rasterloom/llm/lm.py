"""Class-based n-gram scoring in the manner of Brown et al.

Every word has a class.  Exchange clustering on the driver moves one type at a time to the class
that gives the class bigrams the highest likelihood; types are the most frequent words (the
*core*) and, for the others, the last letters of the word.  Then every other training word
takes the class of largest exchange gain for its own neighbours, in Spark; an ending's
class is left to words unseen in training.  A text's probability is the product, over its
words and one end, of P(class | previous class) and P(word | class), both smoothed.

What is gathered: counts of all training words and of the classes beside each (distributed tables
that grow with the corpus) and counts of neighbouring types, sparse and at most ``(WORDS +
ENDINGS + 1)`` squared (21 million), summed over the tasks in Spark.  Only these bounded type counts, counts of class
bigrams and the ``LOOKUP`` most frequent words reach the driver.  Counts and classes of
all other words meet the documents in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut

#: Words that exchange clustering moves one at a time; the first number of what the driver holds.
WORDS = 4096
#: Types that stand in for the other words meanwhile, by the last letters of the word.
ENDINGS = 512
CLASSES = 48
SWEEPS = 5
#: Frequent words whose counts every task holds, at most.
LOOKUP = 200_000
#: Weight of the class prior in transitions.
PRIOR = 10.0
#: Words, distinct pairs of types, and words in a row that a task holds before they are passed on.
HELD = 120_000
PAIRS = 400_000
RUN = 50_000
#: Counts below this have their gains in tables.
SMALL = 17

_TAIL = ".,;:!?&%$#*)\"'|"
_HALF = float(np.log10(0.5))
_ENTRY = np.dtype([("place", "<i4"), ("n", "<i8")])


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words; bytes.split() parts at exactly the six ASCII blanks."""
    return (text or b"").lower().split()


def endings(words: list[bytes]) -> np.ndarray:
    """A number below ``ENDINGS`` for the last three letters of each word, punctuation aside."""
    try:
        whole = pa.array(words, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        whole = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
    bare = pc.utf8_rtrim(whole, characters=_TAIL)
    last = pc.utf8_slice_codeunits(pc.if_else(pc.equal(bare, ""), whole, bare), -3).dictionary_encode()
    numbers = np.array([zlib.crc32(x.encode()) % ENDINGS for x in last.dictionary.to_pylist()], dtype=np.int64)
    return numbers[last.indices.to_numpy()]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Words of many texts in a row, an empty word before, between and after them."""
    run: list[bytes] = [b""]
    for batch in batches:
        for text in batch.column(0):
            run += words_of(text.as_py())
            run.append(b"")
            if len(run) > RUN:
                yield run
                run = [b""]
    if len(run) > 1:
        yield run


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words_of(text.as_py()))
            if len(counts) > HELD:
                yield out(counts)
                counts = Counter()
    yield out(counts)


class Numbers:
    """Numbers of words: the end is 0, core words come next, others are numbered as met.

    ``kind`` holds for each number what ``of_core`` or ``of_ending`` say of the word.
    """

    def __init__(self, core: dict[bytes, int], of_core: np.ndarray, of_ending: np.ndarray):
        self.number: defaultdict[bytes, int] = defaultdict(count(len(core) + 1).__next__, {b"": 0} | {w: i + 1 for w, i in core.items()})
        self.fixed, self.of_ending = len(self.number), of_ending
        self.kind = of_core[: self.fixed].astype(np.int64)

    def __len__(self) -> int:
        return len(self.number)

    def all_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and kinds of words."""
        at = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        new = list(islice(self.number, len(self.kind), None))
        if new:
            self.kind = np.r_[self.kind, self.of_ending[endings(new)]]
        return at, self.kind[at]


def _sums(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts (of ones, if not given)."""
    if n is None:
        return np.unique(code, return_counts=True)
    at, back = np.unique(code, return_inverse=True)
    return at, np.bincount(back, weights=n, minlength=len(at)).astype(np.int64)


def _sparse_rows(code: np.ndarray, n: np.ndarray, span: int) -> tuple[np.ndarray, pa.Array]:
    """Ascending codes ``row * span + place`` as one binary of (place, count) for each row."""
    row = code // span
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    data = np.empty(len(code), dtype=_ENTRY)
    data["place"], data["n"] = code - row * span, n
    ends = (np.r_[at, len(code)] * _ENTRY.itemsize).astype(np.int32)
    return row[at], pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def _pair_counts(core: dict[bytes, int], words: int):
    """Counts of neighbouring types: one sparse row for each type and task."""
    size = words + ENDINGS + 1
    of_core = np.arange(-1, len(core))
    of_core[0] = size - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, codes, held = np.zeros(size * size, dtype=np.int32), [], 0
        numbers = Numbers(core, of_core, words + np.arange(ENDINGS))
        for row in _runs(batches):
            types = numbers.all_of(row)[1].astype(np.int32)
            codes.append(types[:-1] * np.int32(size) + types[1:])
            held += len(row)
            if held > PAIRS:
                code, n = _sums(np.concatenate(codes))
                total[code] += n.astype(np.int32)
                codes, held = [], 0
            if len(numbers) > HELD:
                numbers = Numbers(core, of_core, words + np.arange(ENDINGS))
        if codes:
            code, n = _sums(np.concatenate(codes))
            total[code] += n.astype(np.int32)
        for start in range(0, size * size, 256 * size):
            part = total[start : start + 256 * size]
            code = np.flatnonzero(part)
            rows, entries = _sparse_rows(code, part[code], size)
            yield pa.RecordBatch.from_arrays([pa.array(rows + start // size), entries], names=["row", "entries"])

    return run


def _merged(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of sorted sparse rows of equal key: keys, and for each entry (number of the key, place, count)."""
    held = None
    for whole in batches:
        for start in range(0, whole.num_rows, 2048):
            batch = whole.slice(start, 2048)
            key, entries = batch.column(0), batch.column(1)
            offsets = np.frombuffer(entries.buffers()[1], np.int32)[entries.offset : entries.offset + len(entries) + 1]
            data = np.frombuffer(entries.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(_ENTRY) if offsets[-1] > offsets[0] else np.zeros(0, dtype=_ENTRY)
            new = np.r_[held is None or held[0] != key[0], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)].astype(np.int64)
            if held is not None and new[0]:
                yield pa.array([held[0].as_py()], key.type), np.zeros(len(held[1]), dtype=np.int64), held[1], held[2]
                held = None
            new[0] = 0
            group = np.cumsum(new)
            firsts = key.take(pa.array(np.flatnonzero(np.r_[True, group[1:] != group[:-1]])))
            code = np.repeat(group, np.diff(offsets) // _ENTRY.itemsize) * span + data["place"]
            n = data["n"].astype(np.int64)
            if held is not None:
                code, n = np.r_[held[1], code], np.r_[held[2], n]
            code, n = _sums(code, n)
            group, place = code // span, code % span
            done = np.searchsorted(group, len(firsts) - 1)
            if done:
                yield firsts[:-1], group[:done], place[:done], n[:done]
            held = firsts[-1], place[done:], n[done:]
    if held is not None:
        yield pa.array([held[0].as_py()], held[0].type), np.zeros(len(held[1]), dtype=np.int64), held[1], held[2]


def _add_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, group, place, n in _merged(batches, size):
            rows, entries = _sparse_rows(group * size + place, n, size)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), entries], names=["row", "entries"])

    return run


def exchange(pairs: np.ndarray | tuple[np.ndarray, np.ndarray, np.ndarray], size: int = 0, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each type; the last type, the end of a text, is alone in class 0.

    ``pairs`` is a matrix or, of ``size`` types, its entries: rows (ascending), columns, counts.
    Starts with types dealt by frequency, then moves each type, the most frequent first, to
    the class of largest class-bigram likelihood, until a sweep moves none.
    """
    if isinstance(pairs, np.ndarray):
        a, b = np.nonzero(pairs)
        size, pairs = len(pairs), (a, b, pairs[a, b].astype(np.float64))
    a, right, right_n = pairs
    weight = np.bincount(a, right_n, size) + np.bincount(right, right_n, size)
    self = np.zeros(size)
    self[a[a == right]] = right_n[a == right]
    back = np.argsort(right, kind="stable")
    left, left_n = a[back], right_n[back]
    del back
    to_at = np.searchsorted(a, np.arange(size + 1))
    back_at = np.r_[0, np.cumsum(np.bincount(right, minlength=size))]
    order = np.argsort(-weight[:-1], kind="stable")
    cls = np.ones(size, dtype=np.int64)
    cls[order] = 1 + np.arange(size - 1) % (classes - 1)
    cls[-1] = 0
    out = np.bincount(a * classes + cls[right], right_n, size * classes).reshape(size, classes)
    into = np.bincount(right * classes + cls[a], right_n, size * classes).reshape(size, classes)
    n = np.eye(classes)[cls].T @ out

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    d = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not weight[w]:
                break
            a, s = cls[w], self[w]
            r, q = out[w].copy(), into[w].copy()
            r[a] -= s
            q[a] -= s
            n[a] -= r
            n[:, a] -= q
            n[a, a] -= s
            base = f(n)
            gain = (f(n + r) - base).sum(axis=1) + (f(n + q[:, None]) - base).sum(axis=0)
            own = n[d, d]
            gain += f(own + r + q + s) - f(own + r) - f(own + q) + f(own)
            rows, cols = n.sum(axis=1), n.sum(axis=0)
            gain -= f(rows + r.sum() + s) - f(rows) + f(cols + q.sum() + s) - f(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            n[b] += r
            n[:, b] += q
            n[b, b] += s
            if b != a:
                moved += 1
                cls[w] = b
                at = slice(back_at[w], back_at[w + 1])
                out[left[at], a] -= left_n[at]
                out[left[at], b] += left_n[at]
                at = slice(to_at[w], to_at[w + 1])
                into[right[at], a] -= right_n[at]
                into[right[at], b] += right_n[at]
        if not moved:
            break
    return cls


def _contexts(core: dict[bytes, int], cls: np.ndarray, words: int):
    """Counts of the classes beside each word outside the core, a sparse row a word.

    ``place`` is the class on the left, ``CLASSES`` and the class on the right, or twice
    ``CLASSES`` for the word beside itself, which counts in neither of the others.
    """
    span = 2 * CLASSES + 1
    of_core = np.r_[0, cls[: len(core)]]

    def out(numbers: Numbers, codes: list[np.ndarray]) -> pa.RecordBatch:
        rows, entries = _sparse_rows(*_sums(np.concatenate([np.zeros(0, dtype=np.int64), *codes])), span)
        return pa.RecordBatch.from_arrays([pa.array(numbers.number, pa.binary()).take(pa.array(rows)), entries], names=["word", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, codes, held = Numbers(core, of_core, cls[words:-1]), [], 0
        for row in _runs(batches):
            w, c = numbers.all_of(row)
            at = np.flatnonzero(w >= numbers.fixed)
            left, right = w[at - 1] == w[at], w[at + 1] == w[at]
            codes += [w[at[~left]] * span + c[at[~left] - 1], w[at[~right]] * span + CLASSES + c[at[~right] + 1], w[at[left]] * span + 2 * CLASSES]
            held += 2 * len(at)
            if len(numbers) > HELD or held > 1_000_000:
                yield out(numbers, codes)
                numbers, codes, held = Numbers(core, of_core, cls[words:-1]), [], 0
        yield out(numbers, codes)

    return run


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


class Classes:
    """Class bigrams ``n``, and what small counts more would gain in each of their cells."""

    def __init__(self, n: np.ndarray):
        self.n = n.astype(np.float64)
        self.sides = [(table, *self._small(table)) for table in (self.n.T.copy(), self.n, self.n.sum(axis=1), self.n.sum(axis=0))]

    @staticmethod
    def _small(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = _f(table)
        return base, np.stack([_f(table + m) - base for m in range(SMALL)])

    def best(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """The class of largest exchange gain of each word, the others staying where they are.

        The bigrams hold the words in their classes ``own``; ``left`` and ``right`` count the
        classes beside a word (a row each), ``beside`` the word beside itself.
        """
        k, rows = len(own), np.arange(len(own))
        gain = np.zeros((k, len(self.n)))
        for (table, base, small), mine, other in zip(self.sides, (right, left), (left, right), strict=False):
            # the word's counts are part of the table only in its own class or beside that
            w, d = np.nonzero(mine)
            if not len(w):
                continue
            many = mine[w, d].astype(np.int64)
            more = small[np.minimum(many, SMALL - 1), d]
            far = np.flatnonzero(many >= SMALL)
            more[far] = _f(table[d[far]] + many[far][:, None]) - base[d[far]]
            less = table[d, own[w]] - many
            more[np.arange(len(w)), own[w]] = base[d, own[w]] - _f(less)
            self_ = np.flatnonzero(d == own[w])
            less = table[d[self_]] - other[w[self_]]
            less[np.arange(len(self_)), own[w[self_]]] -= many[self_] + beside[w[self_]]
            more[self_] = _f(less + many[self_][:, None]) - _f(less)
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            gain[w[first]] += np.add.reduceat(more, first, axis=0)
        # the diagonal gains more than its row and column only where a class is on both sides
        both = np.flatnonzero((beside > 0) | ((left > 0) & (right > 0)).any(axis=1))
        l, r, s, at = left[both], right[both], beside[both][:, None], np.arange(len(both))  # noqa: E741
        same = np.repeat(np.diag(self.n)[None], len(both), axis=0)
        same[at, own[both]] -= l[at, own[both]] + r[at, own[both]] + s[:, 0]
        gain[both] += _f(same + l + r + s) - _f(same + l) - _f(same + r) + _f(same)
        for (total, base, small), mine in zip(self.sides[2:], (right, left), strict=True):
            weight = (mine.sum(axis=1) + beside).astype(np.int64)
            more = small[np.minimum(weight, SMALL - 1)]
            far = np.flatnonzero(weight >= SMALL)
            more[far] = _f(total + weight[far][:, None]) - base
            more[rows, own] = base[own] - _f(total[own] - weight)
            gain -= more
        gain[:, 0] = -np.inf
        best = gain.argmax(axis=1)
        return np.where(gain[rows, best] > gain[rows, own] + 1e-9, best, own)


def best_classes(n: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """``Classes.best`` for class bigrams ``n``."""
    return Classes(n).best(own, left, right, beside)


def _assign(n: np.ndarray, of_ending: np.ndarray):
    """Sorted sparse rows of words: the count of each word and the class that its neighbours give it.

    Words met once differ only in their own class and those beside them, so the class of each such
    triple is found once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, met_once = Classes(n), np.full((CLASSES,) * 3, -1, dtype=np.int64)
        for words, group, place, k in _merged(batches, 2 * CLASSES + 1):
            seen = np.zeros((len(words), 2 * CLASSES + 1))
            seen[group, place] = k
            left, right, self = seen[:, :CLASSES], seen[:, CLASSES:-1], seen[:, -1]
            own = of_ending[endings(words.to_pylist())]
            total = (left.sum(axis=1) + self).astype(np.int64)
            out = np.empty(len(words), dtype=np.int64)
            one = np.flatnonzero(total == 1)
            triple = own[one], left[one].argmax(axis=1), right[one].argmax(axis=1)
            new = one[np.unique(np.ravel_multi_index(triple, met_once.shape), return_index=True)[1]]
            new = new[met_once[own[new], left[new].argmax(axis=1), right[new].argmax(axis=1)] < 0]
            for rows in (new, np.flatnonzero(total > 1)):
                out[rows] = classes.best(own[rows], left[rows], right[rows], self[rows])
            met_once[own[new], left[new].argmax(axis=1), right[new].argmax(axis=1)] = out[new]
            out[one] = met_once[triple]
            yield pa.RecordBatch.from_arrays([words, pa.array(total), pa.array(out)], names=["word", "n", "cls"])

    return run


def _code(model: dict):
    """Words of each text as places in the list of frequent words, or -1, -2, ... for its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model["value"].value
        index, of_ending = {w: i for i, w in enumerate(m["words"])}, m["of_ending"]
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                codes, others, ends = [], [], [0]
                for text in batch.column("text"):
                    words = words_of(text.as_py())
                    at = np.fromiter(map(index.get, words, repeat(-1)), dtype=np.int32, count=len(words))
                    rare: defaultdict[bytes, int] = defaultdict(count().__next__)
                    left = np.flatnonzero(at < 0)
                    at[left] = -1 - np.fromiter(map(rare.__getitem__, map(words.__getitem__, left.tolist())), dtype=np.int32, count=len(left))
                    codes.append(at)
                    others += rare
                    ends.append(len(others))
                at = pa.array(ends, pa.int32())
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in codes])].astype(np.int32))
                columns = pa.array(np.concatenate(codes)), pa.array(others, pa.binary()), pa.array(of_ending[endings(others)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(e, x) for e, x in zip((ends, at, at), columns, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(batch))), batch.column("id"), batch.column("held_out"), *lists],
                    names=["row", "id", "held_out", "codes", "words", "guess"],
                )
                row += len(batch)

    return run


def _resolve(model: dict):
    """Classes of each text's words and the sum of the logarithms of their counts."""
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_known", pa.int64()), ("emitted", pa.float64()), ("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model["value"].value
        logs, word_cls = m["logs"], m["word_cls"]
        for batch in batches:
            out: list[tuple] = []
            for id_, held_out, codes, guess, met in zip(*(batch.column(c) for c in ("id", "held_out", "codes", "guess", "met")), strict=True):
                at, c = codes.values.to_numpy(), guess.values.to_numpy().copy()
                log, hit = np.full(len(c), _HALF), np.zeros(len(c), dtype=bool)
                if met.is_valid:
                    k = met.values.field("k").to_numpy()
                    c[k], log[k], hit[k] = met.values.field("cls").to_numpy(), np.log10(met.values.field("n").to_numpy() + 0.5), True
                known, rare = at[at >= 0], -1 - at[at < 0]
                classes = np.empty(len(at), dtype=np.uint8)
                classes[at >= 0], classes[at < 0] = word_cls[known], c[rare]
                out.append((id_.as_py(), held_out.as_py(), len(known) + int(hit[rare].sum()), float(logs[known].sum() + log[rare].sum()), classes.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _steps(classes: bytes) -> np.ndarray:
    c = np.zeros(len(classes) + 2, dtype=np.int64)
    c[1:-1] = np.frombuffer(classes, dtype=np.uint8)
    return c


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    for batch in batches:
        for classes in batch.column(0).to_pylist():
            c = _steps(classes)
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])


def _score(step: np.ndarray, room: np.ndarray, all_room: float, docs: int):
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emitted = batch.column("emitted").to_numpy()
            steps = [_steps(classes) for classes in batch.column("classes").to_pylist()]
            n = np.array([len(c) - 1 for c in steps], dtype=np.int64)
            score = np.array([step[c[:-1], c[1:]].sum() - room[c[1:-1]].sum() for c in steps], dtype=np.float64)
            known = batch.column("n_known").to_numpy() + (docs > 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(n), pa.array(known), pa.array(emitted + np.log10(docs + 0.5) - all_room * n), pa.array(emitted + score)], names=names)

    return run


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Fit on the rows where ``train`` holds and score every whole text.

    The ``words`` most frequent words are clustered by exchange, the others by their neighbours.

    Returns ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  A null text
    is empty: one token, its end.  A null ``train`` counts as true.  Rows that share an id
    are scored each on its own.  Without training rows every word is unknown and the base
    gives each the probability 1.  Words of one count are ranked by their bytes.  Texts are scored whole, however long; an
    empty table gives an empty result.  Other columns play no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), (~F.coalesce(train, F.lit(True))).alias("held_out"))
    fitted = rows.where("not held_out").select("text")
    counted = fitted.mapInArrow(_count_words, "word binary, n long")
    vocab = cut(counted.groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    n_docs = fitted.count()
    # the least count of a looked-up word, from a histogram with 16 steps to a doubling
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    bins = sorted(vocab.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), reverse=True)
    least, taken = None, 0
    for s, k in bins:
        if taken + k > LOOKUP:
            break
        least, taken = s, taken + k
    frequent = [] if least is None else [(bytes(w), n) for w, n in vocab.where(step >= least).collect()]
    frequent.sort(key=lambda x: (-x[1], x[0]))
    core = {w: i for i, (w, _) in enumerate(frequent[:words])}

    size = words + ENDINGS + 1
    sparse = "row long, entries binary"
    sums = fitted.mapInArrow(_pair_counts(core, words), sparse).repartition("row").sortWithinPartitions("row").mapInArrow(_add_rows(size), sparse)
    met = sorted((row, np.frombuffer(e, _ENTRY)) for row, e in sums.toLocalIterator())
    a = np.repeat(np.array([row for row, _ in met], dtype=np.int32), [len(e) for _, e in met])
    b = np.concatenate([np.zeros(0, dtype=np.int32), *(e["place"] for _, e in met)])
    n = np.concatenate([np.zeros(0), *(e["n"] for _, e in met)])
    del met
    cls = exchange((a, b, n), size)
    between = np.bincount(cls[a] * CLASSES + cls[b], n, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    del a, b, n
    of_ending = cls[words:-1]
    beside = fitted.mapInArrow(_contexts(core, cls, words), "word binary, entries binary").repartition("word").sortWithinPartitions("word")
    others = cut(beside.mapInArrow(_assign(between, of_ending), "word binary, n long, cls long"), "classes")
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, n, k in others.groupBy("cls").agg(F.sum("n"), F.count("*")).collect():
        tokens[c] += n
        distinct[c] += k
    for i, (_, n) in enumerate(frequent[:words]):
        tokens[cls[i]] += n
        distinct[cls[i]] += 1
    n_tokens = int(tokens.sum()) + n_docs
    n_distinct = int(distinct.sum()) + (n_docs > 0)
    found = {} if least is None else {bytes(w): c for w, c in others.where(step >= least).select("word", "cls").collect()}
    model = {
        "words": [w for w, _ in frequent],
        "word_cls": np.array([cls[i] if i < words else found[w] for i, (w, _) in enumerate(frequent)], dtype=np.uint8),
        "logs": np.log10(np.array([n for _, n in frequent], dtype=np.float64) + 0.5),
        "of_ending": of_ending,
    }
    shared = {"value": spark.sparkContext.broadcast(model)}
    coded = cut(rows.mapInArrow(_code(shared), "row long, id long, held_out boolean, codes array<int>, words array<binary>, guess array<int>"), "coded")
    rare = coded.select("row", F.posexplode("words").alias("k", "word"))
    seen = others if least is None else others.where(step < least)
    # the side that is built is the slim one; sorting both takes more of an executor's memory
    met = rare.join(seen.hint("shuffle_hash"), "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "cls")).alias("met"))
    known = coded.drop("words").join(met, "row", "left").select("id", "held_out", "codes", "guess", "met")
    known = cut(known.mapInArrow(_resolve(shared), "id long, held_out boolean, n_known long, emitted double, classes binary"), "resolved")
    between = np.zeros(CLASSES * CLASSES)
    for at, n in known.where("not held_out").select("classes").mapInArrow(_bigrams, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        between[at] = n
    between = between.reshape(CLASSES, CLASSES)
    prior = (between.sum(axis=0) + 1) / (between.sum() + CLASSES)
    steps = np.log10((between + PRIOR * prior) / (between.sum(axis=1, keepdims=True) + PRIOR))
    fields = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = known.mapInArrow(_score(steps, np.log10(tokens + 0.5 * (distinct + 1)), float(np.log10(n_tokens + 0.5 * (n_distinct + 1))), n_docs), fields)
    return scored.select("id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
