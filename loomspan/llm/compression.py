"""Quality scores by compression.

Two zstandard dictionaries are built, one from text labelled good, one from text
labelled bad. A text goes through both in blocks, each block by itself, so that all
of it is measured against the dictionaries and not only its beginning. The difference
of the two compressed sizes, per byte of text, becomes a probability by isotonic
calibration on labelled rows that neither dictionary has seen. Text that repeats
itself compresses well with either one and so has a small difference, as bad text has.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, stored, table

BLOCK, LEVEL = 1024, 3


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def calibration(x: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (differences, probabilities) of the rising curve that fits ``good`` best: neighbours by ``x``
    are pooled until shares rise. Shares are drawn in by half a row; beyond the rows the curve goes on to 0 at -1 and 1 at 1."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for value, hit in zip(x[order].tolist(), good[order].tolist()):
        pools.append([value, float(hit), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    at = np.array([p[0] / p[2] for p in pools])
    share = np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools]))
    inside = (at > -1) & (at < 1)
    return np.concatenate([[-1.0], at[inside], [1.0]]), np.concatenate([[0.0], share[inside], [1.0]])


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    @cached_property
    def _compressors(self):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else None for d in (self.good, self.bad))

    def difference(self, text: bytes) -> float:
        """How many bytes the bad dictionary needs more than the good one, per byte of text; 0 for an empty text."""
        good, bad = self._compressors
        if not good or not bad:
            return 0.0
        return sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks(text)) / max(len(text), 1)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return np.interp(differences, *self.knots)


def _scored(model: CompressionClassifier):
    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch, 1):
                raw = data.tobytes()
                found = np.array([model.difference(raw[a:b]) for a, b in zip(off[:-1], off[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array(model.scores(found))], ["key", "difference", "score"])

    return run


def _blocks(batches):
    for batch in batches:
        for part, data, off in pieces(batch, 1):
            raw, names, found = data.tobytes(), part.column(0).to_pylist(), []
            for name, a, b in zip(names, off[:-1], off[1:]):
                found += [(name, x) for x in blocks(raw[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["quality", "block"])


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    most_labelled: int = 20_000, most_blocks: int = 8192, size: int = 32_768,
) -> CompressionClassifier:
    """Learn from at most ``most_labelled`` labelled rows of ``labels``, the first by a hash of their id.

    Of a document's several labels the smallest counts, null labels don't, and equal texts
    count once. A hash of the text deals the rows to two folds: the dictionaries, of ``size``
    bytes each, are built from ``most_blocks`` blocks of either label of the one (the first by a
    hash), the curve is fitted on the other. If a label is missing, every score is the smoothed
    share of good labels.
    """
    sample = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "quality").orderBy(F.xxhash64(id_col), id_col).limit(most_labelled)
    sample = sample.groupBy(id_col).agg(F.min("quality").cast("int").alias("quality"))
    rows = docs.select(id_col, F.col(text_col).alias("text")).where("length(text) > 0").join(F.broadcast(sample), id_col)  # most_labelled rows of two numbers
    rows = stored(rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.min("quality").alias("quality")), "labelled")
    first = F.xxhash64("digest") % 2 == 0
    parts = rows.where(first).select("quality", "text").mapInArrow(_blocks, "quality int, block binary")
    order = (F.xxhash64("block"), "block")
    good, bad = ([bytes(r[0]) for r in parts.where(F.col("quality") == q).orderBy(*order).limit(most_blocks).select("block").collect()] for q in (1, 0))
    model = CompressionClassifier(dictionary(good, size) if good else b"", dictionary(bad, size) if bad else b"")
    seen = rows.where(~first).select("quality", "text").mapInArrow(_scored(model), "key int, difference double, score double").toPandas()  # most_labelled rows of two numbers
    x, y = seen.difference.to_numpy(float), seen.key.to_numpy() == 1
    share = (y.sum() + 1) / (len(y) + 2)
    model.knots = calibration(x, y) if len(x) and good and bad else (np.zeros(1), np.full(1, share))
    return model


def score(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, difference and score, from 0 to 1. Null texts count as
    empty: their difference is 0. Equal texts get equal rows, also where ids repeat or are null; other
    columns are ignored; an empty table gives none. Tasks get the two dictionaries."""
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(_scored(model), f"key {kind}, difference double, score double")
    return out.withColumnRenamed("key", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op11_compression_quality(spark, sf_dir):
    """A score for every whole text of ``documents``, learned from labelled rows that aren't held out. Null and empty texts get
    the score of difference 0; a row without an id is scored, but neither held out nor learned from (held_out is null)."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
