"""Quality statistics of documents, and a decision list learned from labels.

Sequential covering: rules that reject are grown one at a time on two thirds of
the labelled rows, condition by condition by FOIL gain, pruned on the other third,
and kept while they are precise. The list becomes one Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import pieces, stored, table
from loomspan.llm._words import PLAIN, SPACE, Prefix, U, mix, windows, words

STATS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOL, UPPER, DIGIT, MARK = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?"))
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

#: What conditions are put on. All are defined for a text without words.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the keys that an earlier index has too, and of all that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return np.flatnonzero(later), np.flatnonzero(any_)


def _statistics(batches):
    for batch in batches:
        for part, data, off in pieces(batch, 1):
            n = len(off) - 1

            def per_row(mask):
                return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

            start, end, row = words(data, off)
            lead, prefix = LEAD[data], Prefix(PLAIN[data])
            inside = ~SPACE[data]
            own = mix(np.arange(n, dtype=U))
            grams, at = windows(prefix.hashes(start, end), row, 3)
            often = at[_repeated(grams ^ own[row[at]])[1]]
            marked = np.zeros(len(row) + 2, bool)
            for j in range(3):
                marked[often + j] = True
            breaks = np.flatnonzero(data == 10)
            owner = np.concatenate([np.searchsorted(off[1:], breaks, side="right"), np.arange(n)])
            begin = np.concatenate([breaks + 1, off[:-1]])
            order = np.argsort(begin * 2 + (np.arange(len(begin)) >= len(breaks)), kind="stable")  # by text, an empty last line before the next row
            begin, owner = begin[order], owner[order]
            owner_next = np.append(owner[1:], -1)
            stop = np.where(owner_next == owner, np.append(begin[1:], 0) - 1, off[1:][owner])
            filled = np.concatenate([[0], np.cumsum(inside)])
            has_word = filled[stop] > filled[begin]
            begin, stop, owner = begin[has_word], stop[has_word], owner[has_word]
            twice = _repeated(prefix.hashes(begin, stop) ^ own[owner])[0]
            columns = (
                per_row(lead), np.bincount(row, minlength=n), per_row(lead & inside), per_row(SYMBOL[data]), per_row(UPPER[data]),
                per_row(DIGIT[data]), per_row(MARK[data]), np.bincount(owner, minlength=n), np.bincount(owner[twice], minlength=n),
                np.bincount(row[marked[: len(row)]], minlength=n),
            )
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in columns)], ["id", *STATS])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and STATS, counted over the whole text (null: empty).

    Words are runs outside ``[\\x20\\x09-\\x0D]``; n_lines counts lines with a word;
    n_dup_lines those of them equal to an earlier line; n_repeat_words the words in
    3-word windows that the text has twice or more. Other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(_statistics, f"id {kind}, " + ", ".join(f"{x} long" for x in STATS)).withColumnRenamed("id", id_col)


@dataclass
class Rule:
    #: (feature, "<=" or ">", threshold)
    conditions: list[tuple[str, str, float]]
    hits: int = 0
    misses: int = 0

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, sign, cut in self.conditions:
            value = x[:, names.index(name)]
            out &= value <= cut if sign == "<=" else value > cut
        return out

    def sql(self) -> str:
        return " AND ".join(f"{FEATURES[n]} {s} {c!r}D" for n, s, c in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; a document goes by the first that holds, and stays if none does."""

    rules: list[Rule] = field(default_factory=list)

    def sql(self) -> str:
        whens = " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(self.rules, 1))
        return f"CASE {whens} ELSE 0 END" if whens else "0"

    def verdict(self) -> Column:
        """The number of the rule that rejects, 0 for none."""
        return F.expr(self.sql()).cast("int")


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str], cuts: int) -> tuple[float, tuple]:
    p0, n0 = y.sum(), len(y) - y.sum()
    before = np.log2(p0 / (p0 + n0))
    best = (0.0, ())
    for j, name in enumerate(names):
        order = np.argsort(x[:, j], kind="stable")
        value, good = x[order, j], np.cumsum(y[order])
        ends = np.flatnonzero(value[1:] > value[:-1])
        if not len(ends):
            continue
        ends = ends[np.unique(np.linspace(0, len(ends) - 1, cuts).astype(int))]
        for sign in ("<=", ">"):
            p = good[ends] if sign == "<=" else p0 - good[ends]
            total = ends + 1 if sign == "<=" else len(y) - ends - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - before), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), (name, sign, float((value[ends[i]] + value[ends[i] + 1]) / 2)))
    return best


def learn(x: np.ndarray, y: np.ndarray, names: list[str], *, least_precision: float = 0.9, most_conditions: int = 4, most_rules: int = 16, cuts: int = 64) -> DecisionList:
    """A decision list for rows ``x`` (n x features) to be rejected where ``y`` is true; rows i with i % 3 == 2 prune."""
    found = DecisionList()
    prune = np.arange(len(y)) % 3 == 2
    open_ = np.ones(len(y), bool)
    while len(found.rules) < most_rules and (open_ & y).sum() >= 3:
        live, rule = open_ & ~prune, Rule([])
        while len(rule.conditions) < most_conditions and 0 < y[live].sum() < live.sum():
            gain, condition = _best_condition(x[live], y[live], names, cuts)
            if gain <= 0:
                break
            rule.conditions.append(condition)
            live &= Rule([condition]).covers(x, names)
        best, test = (-2.0, 0), open_ & prune
        for n in range(1, len(rule.conditions) + 1):
            covered = test & Rule(rule.conditions[:n]).covers(x, names)
            p, total = (covered & y).sum(), covered.sum()
            worth = (2 * p - total) / total if total else -1.0
            if worth > best[0] + 1e-9:
                best = (worth, n)
        rule.conditions = rule.conditions[: best[1]]
        covered = open_ & rule.covers(x, names)
        rule.hits, rule.misses = int((covered & y).sum()), int((covered & ~y).sum())
        if not rule.conditions or (rule.hits + 1) / (rule.hits + rule.misses + 2) < least_precision:
            break
        found.rules.append(rule)
        open_ &= ~covered
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _sample(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    rows = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).select(id_col, "quality").orderBy(F.xxhash64(id_col), id_col).limit(most)
    return rows.groupBy(id_col).agg(F.min("quality").alias("quality"))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", most_labelled: int = 20_000, **options) -> DecisionList:
    """Learn from at most ``most_labelled`` labelled documents (the first by a hash of
    their id) that pass the base rules; label 0 means reject. Of a document's several
    labels the smallest counts; null labels don't. No labels give an empty list."""
    sample = _sample(labels, id_col, most_labelled)
    names = list(FEATURES)
    rows = (
        stats.where(~base_failed()).join(F.broadcast(sample), id_col)  # most_labelled rows of two numbers
        .selectExpr(id_col, "quality", *(f"{FEATURES[n]} AS {n}" for n in names)).toPandas()
    )
    rows = rows.iloc[np.argsort(mix(rows[id_col].to_numpy(np.int64).view(U)), kind="stable")]
    return learn(rows[names].to_numpy(float), rows["quality"].to_numpy() == 0, names, **options)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: its id, STATS, base_failed, rule (the number of the
    learned rule that rejects, 0 for none) and kept. Null, empty and word-less texts fail
    the base rules; repeated rows get equal verdicts; an empty table gives none."""
    stats = stored(statistics(docs, id_col, text_col), "statistics")
    rules = fit(stats, labels, id_col, **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 20_000, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged. Each row is judged by its own
    text, also where its id repeats or is null. Only labelled documents are read to learn the rules."""
    some = docs.select(id_col, text_col).join(F.broadcast(_sample(labels, id_col, most_labelled)), id_col, "left_semi")  # most_labelled ids
    rules = fit(statistics(some, id_col, text_col), labels, id_col, most_labelled, **options)
    # rows are told apart by id and text, as equal texts have one verdict; texts alone go to Python
    keyed = docs.select(F.struct("*").alias("doc"), F.concat_ws(":", F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).alias("key"))
    kept = statistics(keyed.select("key", F.col("doc")[text_col].alias("text")), "key", "text").where(~base_failed() & (rules.verdict() == 0)).select("key")
    return keyed.join(kept.hint("shuffle_hash"), "key", "left_semi").select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op7_quality_rules(spark, sf_dir):
    """Counts and verdict for every row of ``documents``, rules learned from ``labels``. Null, empty and word-less texts fail
    the base rules; repeated rows get equal rows; rows without an id are judged but teach nothing."""
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
