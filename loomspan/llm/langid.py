"""Language identification by rank-order n-gram profiles.

A language's profile ranks its most frequent letter n-grams; a document's own
ranking is compared to each profile by the out-of-place distance. N-grams are
counted over whole texts with arrays: letters become numbers, and an n-gram is a
number made of up to three of them.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, table

EDGE = 1  # stands for what is not a letter, at the border of a word
BITS = 21


@cache
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of each row as numbers, words framed by EDGE, and row offsets."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(off[:-1], off[1:])]
    size = np.array([len(t) + 2 for t in texts], np.int64)
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[:-1] |= is_letter[1:]
    keep[1:] |= is_letter[:-1]
    # of two borders side by side, as after a word and before the next, one is enough
    out = np.where(is_letter, codes + 2, EDGE).astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size)])]
    return out[keep], cut


def grams(codes: np.ndarray, base: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(number, position) of the 1-, 2- and 3-grams in which only the ends are borders."""
    edge = codes == EDGE
    one = np.flatnonzero(~edge)
    two = np.flatnonzero(~(edge[:-1] & edge[1:]))
    three = np.flatnonzero(~edge[1:-1])
    return [
        (codes[one], one),
        (codes[two] * base + codes[two + 1], two),
        ((codes[three] * base + codes[three + 1]) * base + codes[three + 2], three),
    ]


def _dense(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur and, for each place, which of them; number 0 is none."""
    present = np.flatnonzero(np.bincount(codes, minlength=2))
    lookup = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    lookup[present] = np.arange(1, len(present) + 1)
    return np.concatenate([[0], present]), lookup[codes]


def _absolute(numbers: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """N-gram numbers over a piece's own alphabet as numbers over all symbols."""
    base, out = len(alphabet), np.zeros(len(numbers), np.int64)
    for shift in range(3):
        out |= alphabet[numbers % base] << (BITS * shift)
        numbers = numbers // base
    return out


def _count(batches):
    for batch in batches:
        for part, data, off in pieces(batch, 1, 2_000_000):
            codes, cut = symbols(data, off)
            if not len(codes):
                continue
            alphabet, codes = _dense(codes)
            edge = np.searchsorted(alphabet, EDGE)
            names = part.column(0).to_pylist()
            row_lang, langs = np.unique(names, return_inverse=True)[1], sorted(set(names))
            where = np.repeat(row_lang, np.diff(cut))
            codes = np.where(codes == edge, EDGE, np.where(codes == EDGE, edge, codes))  # EDGE keeps its number
            alphabet = alphabet.copy()
            alphabet[[EDGE, edge]] = alphabet[[edge, EDGE]]
            for numbers, at in grams(codes, len(alphabet)):
                for i, lang in enumerate(langs):
                    mine = numbers[where[at] == i]
                    if len(alphabet) ** 3 <= 1 << 23:
                        count = np.bincount(mine)
                        found = np.flatnonzero(count)
                        count = count[found]
                    else:
                        found, count = np.unique(mine, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(_absolute(found, alphabet)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = 400) -> DataFrame:
    """Rows (lang, gram, rank): each language's ``size`` most frequent n-grams over all texts, ranks
    from 0, ties by n-gram. Rows without a language are left out; null texts count nothing."""
    counts = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_col).mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), "gram"]
    # first within shares of a language, so that no task ranks all n-grams of one
    part = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(*order))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    return counts.withColumn("r", part).where(F.col("r") <= size).withColumn("rank", rank - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Ranks of the profiles' n-grams as one table: a row per n-gram, a column per language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.langs, self.size = sorted({r[0] for r in rows}), size
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), size, np.int32)
        if rows:
            at = np.searchsorted(self.grams, [r[1] for r in rows])
            self.rank[at, [self.langs.index(r[0]) for r in rows]] = [r[2] for r in rows]

    def best(self, ranked: np.ndarray) -> tuple[str, float]:
        """The nearest language for a document's n-grams by rank, and by how much it is nearer
        than the next one, from 0 to 1. N-grams outside a profile are ``size`` places off."""
        at = np.minimum(np.searchsorted(self.grams, ranked), len(self.grams) - 1)
        ranks = self.rank[np.where(self.grams[at] == ranked, at, len(self.grams))]
        place = np.arange(len(ranked))[:, None]
        distance = np.where(ranks < self.size, np.abs(ranks - place), self.size).sum(axis=0)
        order = np.argsort(distance, kind="stable")
        first = distance[order[0]]
        other = distance[order[1]] if len(order) > 1 else len(ranked) * self.size
        return self.langs[order[0]], float((other - first) / other) if other else 0.0


def _predict(known: Profiles):
    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch, 1, 2_000_000):
                langs, scores = ["und"] * (len(off) - 1), [0.0] * (len(off) - 1)
                codes, cut = symbols(data, off)
                if len(codes) and known.langs:
                    alphabet, dense = _dense(codes)
                    edge = np.searchsorted(alphabet, EDGE)
                    dense = np.where(dense == edge, EDGE, np.where(dense == EDGE, edge, dense))
                    alphabet = alphabet.copy()
                    alphabet[[EDGE, edge]] = alphabet[[edge, EDGE]]
                    kinds = [(n.astype(np.int32 if len(alphabet) < 1200 else np.int64), np.searchsorted(at, cut)) for n, at in grams(dense, len(alphabet))]
                    for i in np.flatnonzero(cut[1:] > cut[:-1]):
                        own = np.concatenate([n[e[i] : e[i + 1]] for n, e in kinds])
                        own.sort()
                        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                        count = np.diff(np.append(first, len(own)))
                        numbers = own[first]
                        if len(count) > known.size:  # keep all that tie with the last place
                            least = np.partition(count, len(count) - known.size)[len(count) - known.size]
                            numbers, count = numbers[count >= least], count[count >= least]
                        wide = _absolute(numbers.astype(np.int64), alphabet)
                        langs[i], scores[i] = known.best(wide[np.lexsort((wide, -count))][: known.size])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """One row per row of ``docs``: its id, lang_pred and score.

    A text's ``size`` most frequent n-grams, ties by n-gram, are its ranking. Null texts, texts
    without a letter, and all texts if nothing was learned, are ``und`` with score 0. The profiles
    go to the driver and to each task: languages times ``size`` rows. Equal texts get equal rows;
    other columns are ignored; an empty table gives none.
    """
    rows = [tuple(r) for r in known.select("lang", "gram", "rank").collect()]
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_predict(Profiles(rows, size)), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op9_language_id(spark, sf_dir):
    """A prediction for every whole text of ``documents``, from profiles of those that aren't held out. Null texts and texts
    without a letter are ``und``; a row without an id is predicted, but neither held out nor learned from (held_out is null)."""
    docs = table(spark, sf_dir, "documents")
    known = profiles(docs.where(~held_out()))
    return identify(docs, known).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
