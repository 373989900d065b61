"""Language identification with hyperdimensional profiles.

Every code point has a random vector of +1 and -1, made from its number alone.  The vector of
an n-gram is the product of its letters' vectors, each rotated by its place; a text's
vector is the sum over its n-grams, a language's prototype the sum of its texts' unit
vectors.  The answer is the prototype of largest cosine.

Texts are lower-cased; runs of anything but letters become one blank, also at both ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import cut

DIMENSIONS = 1024
GRAM = 3
#: Labelled documents of a language that its prototype is fitted on, at most (in expectation).
TRAIN_ROWS = 4000
#: n-gram vectors that a task keeps; beyond, it starts afresh.  Results don't depend on it.
CACHE = 50_000
#: Code points that are encoded at once.
CHUNK = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower case, or 0 for what isn't a letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@functools.lru_cache(maxsize=4096)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.where(np.random.default_rng([code, dimensions]).integers(0, 2, dimensions) > 0, 1, -1).astype(np.int8)


class Encoder:
    """Texts to bundled n-gram vectors; keeps the vectors of the n-grams it has met."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, cache: int = CACHE):
        self.dimensions, self.gram, self.cache = dimensions, gram, cache
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), dtype=np.int8)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the table with the vectors of n-grams."""
        at = np.fromiter(map(self.rows.get, codes.tolist(), repeat(-1)), dtype=np.int64, count=len(codes))
        missing = codes[at < 0].tolist()
        if not missing:
            return at
        if len(self.rows) + len(missing) > self.cache:
            self.rows, missing = {}, codes.tolist()
        while len(self.rows) + len(missing) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        for c in missing:
            v = np.ones(self.dimensions, dtype=np.int8)
            for i in range(self.gram):
                letter = (c >> (21 * (self.gram - 1 - i))) & 0x1FFFFF
                v = v * np.roll(_letter_vector(letter, self.dimensions), self.gram - 1 - i)
            self.table[len(self.rows)] = v
            self.rows[c] = len(self.rows)  # the value is taken before the key is in
        return np.fromiter(map(self.rows.__getitem__, codes.tolist()), dtype=np.int64, count=len(codes))

    def encode(self, text: str | None) -> np.ndarray | None:
        """The text's vector; None for a null text or one without letters."""
        if not text:
            return None
        fold, out, tail, any_letter = _letters(), np.zeros(self.dimensions), np.array([32], dtype=np.int64), False
        for s in range(0, len(text), CHUNK):
            raw = fold[np.frombuffer(text[s : s + CHUNK].encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.int64)
            any_letter |= bool(raw.any())
            raw[raw == 0] = 32
            raw = np.concatenate([tail, raw] + ([[32]] if s + CHUNK >= len(text) else []))
            keep = np.ones(len(raw), dtype=bool)
            keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
            raw = raw[keep]
            n = len(raw) - self.gram + 1
            if n > 0:
                code = np.zeros(n, dtype=np.int64)
                for i in range(self.gram):
                    code = (code << 21) | raw[i : i + n]
                codes, counts = np.unique(code, return_counts=True)
                for b in range(0, len(codes), 8192):
                    rows = self._places(codes[b : b + 8192])
                    out += counts[b : b + 8192].astype(np.float32) @ self.table[rows].astype(np.float32)
            tail = raw[-(self.gram - 1) :]
        return out if any_letter else None


def _sums(dimensions: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(dimensions, gram), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                v = encoder.encode(text)
                if v is not None and (norm := np.sqrt(v @ v)) > 0:
                    total[lang] = total.get(lang, 0) + v / norm
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    return run


def fit(labelled: DataFrame, text_col: str, lang_col: str, key: Column, train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Prototypes by language, from rows with a language.

    ``train_rows`` bounds the sample of each language: its rows enter with probability
    ``train_rows`` / count, decided by a hash of ``key``.  What reaches the driver is one
    vector per task and language.
    """
    rows = labelled.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), key.alias("key"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # one row a language: Spark broadcasts it by its size
    sample = rows.join(cut(counts, "languages"), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) < F.lit(float(train_rows)) / F.col("n"))
    parts = sample.select("lang", "text").mapInArrow(_sums(dimensions, gram), "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, vector in summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).collect():
        v = np.array([x for _, x in vector])
        out[lang] = v / max(np.sqrt(v @ v), 1e-300)
    return out


def _predict(prototypes: dict[str, np.ndarray], dimensions: int, gram: int, column: int, names: list[str]):
    langs = sorted(prototypes)
    table = np.array([prototypes[x] for x in langs]).reshape(len(langs), dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(dimensions, gram)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(column):
                v = encoder.encode(text.as_py())
                if v is None or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                cosine = table @ v / max(np.sqrt(v @ v), 1e-300)
                best = int(np.argmax(cosine))
                pred.append(langs[best])
                score.append(float(min(1.0, max(0.0, cosine[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """``docs`` with the language of every whole text and its cosine, cut to 0..1.

    Only the text is read.  A null text, one without letters, or an empty model gives
    ``und`` and 0; ties go to the first language by code point.  ``pred_col`` and
    ``score_col`` must be names that ``docs`` does not have.
    """
    if {pred_col.lower(), score_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the input has a column named {pred_col} or {score_col}")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(_predict(prototypes, dimensions, gram, docs.columns.index(text_col), schema.names), schema)


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **model) -> DataFrame:
    """Fit on the rows where ``train`` holds and predict every row.

    Returns the columns ``id, lang_pred, score`` and ``held_out`` (not ``train``).  A null
    ``train`` counts as true for ``held_out`` but the row is not learned from, nor is one without a
    language.  A null text or one without letters is ``und`` with score 0, and so is every text
    if nothing was learned; texts of any length are read whole.  Ties go to the first language by
    code point.  Repeated rows and rows that share an id are each predicted; an empty table gives
    an empty one.  Other columns play no part.
    """
    prototypes = fit(docs.where(train), text_col, lang_col, F.col(f"`{id_col}`"), **model)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), (~F.coalesce(train, F.lit(True))).alias("held_out"))
    keys = {k: v for k, v in model.items() if k in ("dimensions", "gram")}
    return predict(slim, prototypes, **keys).drop("text")
