"""Near-duplicate documents by fast similarity sketching, banding and exact checks.

The sketch (Dahlgaard, Knudsen and Thorup, 2017) hashes every shingle into one of ``t``
bins per round.  A value carries its round in the high bits, so an earlier round always
wins.  After ``t`` random rounds, round ``t + i`` sends every shingle to bin ``i``: every
coordinate of a non-empty set is filled.  Most documents need one or two rounds.

Steps, all of them Spark jobs:

1. sketch whole texts, group equal sets: the rest works on one document a set;
2. explode band keys; the smallest document of a bucket is its head, and every other
   member is a candidate pair with it;
3. drop pairs whose sketches can't reach the threshold (over six standard deviations
   below), confirm the others on the full sets of their texts;
4. components of the confirmed links;
5. what is left are pairs of one bucket in different components, neither of which is the
   head.  The bucket's largest component and its other documents are dealt into blocks; a
   unit of work compares two blocks, tests each likely pair on full sets in the first
   bucket that the pair shares, and emits what ties components together, not pairs.  No pair
   of a bucket is skipped, and pairs within one component are not listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import connected_components, cut, grouped, roots

BINS = 128
ROWS = 4
#: Candidates of a head in one unit of work; each unit has a copy of the head's text.
UNIT = 256
#: Rows of a bucket that one unit of work compares with as many others.
BLOCK = 1024
#: Bytes of text that are sketched at once.
CHUNK = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    With fewer words than ``size`` the whole sequence is one shingle; a null text or one
    without words has none.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, size)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = mix(out * _ODD + h[j : n - width + 1 + j])
    return np.unique(out)


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` values for each set; equal values at a place count for similarity."""
    out = np.full((len(sets), bins), _FULL, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if len(sets) else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * bins):
        h = mix(items ^ mix(np.array([i + 1], dtype=np.uint64) * _ODD))
        value = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        place = ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, owner * bins + place, value)
        short = (out == _FULL).any(axis=1) & (sizes > 0)
        if not short.any():
            break
        keep = short[owner]
        items, owner = items[keep], owner[keep]
    return out


def _describe(size: int, rows: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("marks", pa.binary())])
    bands = BINS // rows

    def block(ids: list, texts: list) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in texts]
        sk = sketch(sets)
        d1 = np.array([np.sum(mix(s ^ _ODD)) for s in sets], dtype=np.uint64)
        d2 = np.array([np.bitwise_xor.reduce(mix(s + _ODD)) if len(s) else 0 for s in sets], dtype=np.uint64)
        key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
        for j in range(rows):
            key = mix(key * _ODD + sk[:, j : bands * rows : rows])
        marks = (mix(sk) & np.uint64(0xFF)).astype(np.uint8)
        keys = pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(key.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), keys, pa.array([m.tobytes() for m in marks], pa.binary())],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held, ts = batch.column(0).to_pylist(), batch.column(1), [], []
            total = 0
            for i, t in zip(ids, texts, strict=True):
                t = t.as_py()
                held.append(i)
                ts.append(t)
                total += len(t or b"")
                if total > CHUNK:
                    yield block(held, ts)
                    held, ts, total = [], [], 0
            if held:
                yield block(held, ts)

    return run


def _alike(marks_a: np.ndarray, marks_b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair may reach the threshold, by its equal marks and its sizes."""
    same = (marks_a == marks_b).sum(axis=-1)
    p = percent / 100
    least = BINS * p - 6.3 * np.sqrt(BINS * p * (1 - p))
    return (same >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def _marks(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _sieve(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = {name: batch.column(name) for name in batch.schema.names}
                ok = _alike(_marks(c["ma"]), _marks(c["mb"]), c["na"].to_numpy(), c["nb"].to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(size: int, percent: int):
    """Rows (a, unit, b, text) sorted by a, unit, b; those of the head have no b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["a", "unit"]):
            a, b, text = table["a"].to_numpy(), table["b"].to_pylist(), table["text"]
            left, right = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                heads = [shingle_set(text[int(i)].as_py(), size) for i in range(s, e) if b[i] is None]
                for i in range(s, e):
                    if b[i] is None:
                        continue
                    one = shingle_set(text[int(i)].as_py(), size)
                    for head in heads:
                        both = len(np.intersect1d(one, head, assume_unique=True))
                        if both and 100 * both >= percent * (len(one) + len(head) - both):
                            left.append(a[i])
                            right.append(b[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _first_common(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """True for pairs (rows of band keys) that share no bucket of an earlier band."""
    return ~(a[:, :band] == b[:, :band]).any(axis=1)


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (sorted by ``left``) reach the threshold on their full sets."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    held = np.zeros(len(codes) + 1, dtype=bool)
    out = np.zeros(len(left), dtype=bool)
    at = np.flatnonzero(np.r_[True, left[1:] != left[:-1]])
    for s, e in zip(at, np.r_[at[1:], len(left)], strict=True):
        own = codes[ends[left[s]] - sizes[left[s]] : ends[left[s]]]
        held[own] = True
        for b in range(s, e, 256):
            part = right[b : min(e, b + 256)]
            where = np.concatenate([codes[ends[r] - sizes[r] : ends[r]] for r in part])
            both = np.add.reduceat(held[where].astype(np.int64), np.r_[0, np.cumsum(sizes[part])[:-1]])
            out[b : b + len(part)] = 100 * both >= percent * (sizes[left[s]] + sizes[part] - both)
        held[own] = False
    return out


def _cross(size: int, percent: int):
    """Links between documents of a bucket that are in different components.

    A unit has the rows of one block (``side`` = i) and of another (j), or of one only.  A
    pair is tested in the first bucket that it shares.  For each set of documents that the
    unit ties together its smallest row comes out with each of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["key", "i", "j"]):
            ids, comp, n, key = (table[c].to_numpy() for c in ("id", "comp", "n", "key"))
            side, i, j = (table[c].to_numpy() for c in ("side", "i", "j"))
            marks = _marks(table["marks"])
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            out_a, out_b = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                one, two = s + np.flatnonzero(side[s:e] == i[s]), s + np.flatnonzero(side[s:e] == j[s])
                left, right = [], []
                for k in one:
                    other = two[comp[two] != comp[k]]
                    if i[s] == j[s]:
                        other = other[other > k]
                    if not len(other):
                        continue
                    other = other[_alike(marks[other], marks[k], n[other], n[k], percent)]
                    band = int(np.argmax(bands[k] == key[s]))
                    other = other[_first_common(np.broadcast_to(bands[k], (len(other), bands.shape[1])), bands[other], band)]
                    left.append(np.full(len(other), k))
                    right.append(other)
                if not left or not sum(map(len, left)):
                    continue
                a, b = np.concatenate(left), np.concatenate(right)
                used, back = np.unique(np.r_[a, b], return_inverse=True)
                a, b = back[: len(a)], back[len(a) :]
                good = _linked([shingle_set(table["text"][int(r)].as_py(), size) for r in used], a, b, percent)
                top = roots(a[good], b[good], len(used))
                tied = np.flatnonzero(top != np.arange(len(used)))
                out_a.append(ids[used[top[tied]]])
                out_b.append(ids[used[tied]])
            a = np.concatenate(out_a) if out_a else np.empty(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose word-shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns ``id, n_shingles, component_id, kept`` for every row: the set's size, the
    smallest id reachable by links, and whether that is the row's own.  A null or wordless
    text has no shingles and links with nothing; so does a row with a null id, whose
    ``component_id`` is null.  Rows that share an id are one node with the links of all.
    Copies (equal sets) are one node from the first step on.  Texts are read whole; an empty table gives
    an empty result.  Columns other than the two named play no part.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    seen = cut(src.mapInArrow(_describe(shingle, ROWS), "id long, n long, d1 long, d2 long, bands array<long>, marks binary"), "sketches")
    group = seen.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "bands", "marks")).alias("r"))
    one = cut(group.select("d1", "d2", "n", "r.*"), "sets")
    entries = one.select("id", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = cut(entries.join(buckets, "key"), "members")
    small = one.select("id", "n", "marks")
    # ids grow with the documents, so they are not broadcast; hashing them spares the sort of the texts
    texts = cut(src.join(members.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "texts")

    def with_texts(pairs: DataFrame) -> DataFrame:
        """Confirmed pairs."""
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / UNIT).alias("units"))
        pairs = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("units")).alias("unit"))
        ask = pairs.select("a", "unit", "b", F.col("b").alias("id")).union(
            pairs.select("a", "unit").distinct().select("a", "unit", F.lit(None).cast("long"), F.col("a").alias("id"))
        )
        rows = ask.join(texts, "id").select("a", "unit", "b", "text")
        return rows.repartition("a", "unit").sortWithinPartitions("a", "unit", "b").mapInArrow(_confirm(shingle, percent), "a long, b long")

    pairs = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    seen_a, seen_b = (small.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("marks").alias(f"m{x}")) for x in "ab")
    likely = pairs.join(seen_a, "a").join(seen_b, "b").select("a", "b", "na", "nb", "ma", "mb")
    links = cut(with_texts(cut(likely.mapInArrow(_sieve(percent), "a long, b long"), "pairs")), "links")
    labels = connected_components(links, "components")

    # what is left: pairs of a bucket in different components, neither of which is the head
    rest = members.where("size > 2").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    per = rest.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.max_by(F.struct("comp", "k"), F.struct("k", "comp")).alias("most"), F.count("*").alias("kinds"))
    split = per.where("kinds > 1").select(
        "key", F.col("most.comp").alias("main"), F.ceil(F.col("most.k") / BLOCK).cast("int").alias("pm"), F.ceil((F.col("all") - F.col("most.k")) / BLOCK).cast("int").alias("po")
    )
    main = F.col("comp") == F.col("main")
    rest = rest.where("id <> head").join(split, "key")
    rest = rest.withColumn("side", F.when(main, -1 - F.pmod(F.xxhash64("id"), F.col("pm"))).otherwise(F.pmod(F.xxhash64("id"), F.col("po"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("po") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    units = F.when(main, F.transform(others, lambda o: pair(F.col("side"), o))).otherwise(
        F.concat(F.transform(F.sequence(F.lit(1), F.col("pm")), lambda p: pair(-p, F.col("side"))), F.transform(others, lambda o: pair(F.least("side", o), F.greatest("side", o))))
    )
    rows = rest.select("key", "id", "comp", "side", F.explode(units).alias("u")).select("key", "u.i", "u.j", "side", "id", "comp")
    rows = rows.join(one.select("id", "n", "marks", "bands"), "id").join(texts, "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    more = cut(rows.mapInArrow(_cross(shingle, percent), "a long, b long"), "links")
    if not more.isEmpty():
        labels = connected_components(links.union(more), "components")

    sets = one.select("d1", "d2", "n", F.col("id").alias("rep"))
    out = seen.select("id", "n", "d1", "d2").join(sets, ["d1", "d2", "n"], "left")
    out = out.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    root = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    out = out.select("id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.select("*", F.coalesce(F.col("id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))
