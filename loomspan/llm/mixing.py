"""Mixing of sources to temperature weights within a token budget.

The weights are token shares to the power of an exponent, made to sum to one. The
exponent is bisected until the weights' entropy reaches a target and no source is
repeated more often than allowed. Each source is then dealt into blocks by a hash;
every epoch of a source takes its blocks in a permutation of its own until the
source's share of the budget is full. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.llm._base import stored, table

WORD = r"[^\x20\x09-\x0D]+"


def dice(*parts: Column | str) -> Column:
    """60 pseudo-random bits of some values, the same in every engine that has MD5."""
    text = F.concat_ws(":", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


@dataclass(frozen=True)
class Mix:
    #: entropy of the weights, as a share of the largest possible, that is to be reached
    target_entropy: float = 0.97
    #: times that any source's tokens may be used at most
    most_repeats: float = 4.0
    #: tokens to realise; None: as many as there are
    budget: int | None = None
    #: blocks that each source is dealt into; None: about the root of the largest source's rows
    blocks: int | None = None
    seed: int = 17


def source_tokens(docs: DataFrame, source_col: str = "source", tokens: str | Column = "tokens") -> DataFrame:
    """Rows (source, tokens, docs) of the sources; null is a source like others."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))


def fit_exponent(sources: DataFrame, mix: Mix, levels: int = 10) -> float:
    """The largest exponent from 0 to 1 with the target entropy or more, raised where needed
    until no source repeats too often. Each of ``levels`` jobs tells 15 inner exponents apart,
    four bisections at once. 1 if the natural shares have that entropy already."""
    some = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    total, n, least = some.agg(F.sum("t"), F.count("t"), F.min("t")).first()
    if not n or n == 1:
        return 1.0
    budget = mix.budget or total

    def ask(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy and greatest repetition for each."""
        p, out = F.col("t") / total, []
        for a in exponents:
            w = F.pow(p, F.lit(a))
            out += [F.sum(w), F.sum(w * F.ln(p))]
        row = some.agg(*out).first()
        return [(math.log(z) - a * s / z, (least / total) ** a / z * budget / least) for a, z, s in zip(exponents, row[::2], row[1::2])]

    def largest(good) -> float:
        """The end of the exponents from 0 for which ``good`` holds; it does for none after it."""
        low, high = 0.0, 1.0
        for _ in range(levels):
            inner = [low + (high - low) * i / 16 for i in range(1, 16)]
            n_good = sum(1 for x in ask(inner) if good(x))
            low, high = [low, *inner, high][n_good : n_good + 2]
        return (low + high) / 2

    natural = ask([1.0])[0]
    wanted = mix.target_entropy * math.log(n)
    exponent = 1.0 if natural[0] >= wanted else largest(lambda x: x[0] >= wanted)
    if ask([exponent])[0][1] > mix.most_repeats:
        exponent = max(exponent, 1.0 if natural[1] > mix.most_repeats else largest(lambda x: x[1] > mix.most_repeats))
    return exponent


def weighted(sources: DataFrame, exponent: float, mix: Mix) -> DataFrame:
    """``sources`` with weight, target (whole tokens of the budget, repeats allowed at most) and full (whole epochs)."""
    totals = sources.agg(F.sum("tokens").cast("double").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).alias("z"))
    out = sources.join(F.broadcast(totals), how="cross")  # one row
    budget = F.lit(mix.budget) if mix.budget is not None else F.col("all_tokens")
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.col("z")).otherwise(0.0)
    out = out.withColumn("weight", weight).withColumn("target", F.least(F.floor(weight * budget + F.lit(1e-6)), F.floor(F.col("tokens") * F.lit(mix.most_repeats))))
    return out.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens"))).otherwise(F.lit(0))).drop("all_tokens", "z")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """One row per draw of a document: its id, source, tokens, epoch (from 0) and position, a
    number from 0 to 1 by which the draws of all sources, sorted, interleave at their weights.

    A document's tokens are its words, one at least, so that each can be drawn. A source's
    draws hold as many tokens as its weight's share of the budget, less than one document
    short; sources repeat in whole epochs before the last one. Rows that repeat a document
    are drawn on their own. A null id, text or source is a value like others; rows without an id
    are dealt by their texts. An empty table gives no draws. Other columns are ignored.
    """
    return _dealt(docs, id_col, text_col, source_col, mix).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "tokens", "epoch", "position")


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, mix: Mix, row: str | None = None) -> DataFrame:
    """The draws, each with ``row``, which tells rows of ``docs`` apart."""
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.col(row) if row else F.lit(0)).cast("long").alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.md5(F.concat(F.lit("~"), F.coalesce(text_col, F.lit(""))).cast("binary"))).alias("name"),
        F.greatest(F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long").alias("tokens"),
    )
    rows = stored(rows.withColumn("dice", dice(F.lit(mix.seed), "name")), "draw-rows")
    sources = stored(source_tokens(rows), "sources")
    plan = weighted(sources, fit_exponent(sources, mix), mix)
    n_blocks = mix.blocks or min(65536, max(16, math.ceil(math.sqrt(sources.agg(F.max("docs")).first()[0] or 1))))
    rows = rows.withColumn("block", F.col("dice") % n_blocks)
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    plan = plan.where("target > 0").select(F.col("source").alias("s"), F.col("tokens").alias("source_tokens"), "target", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))).alias("epoch"))
    schedule = blocks.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")  # by size: a table of blocks and one of sources
    order = W.partitionBy("source", "epoch").orderBy(dice(F.lit(mix.seed), "source", "epoch", "block"), "block").rowsBetween(W.unboundedPreceding, -1)
    schedule = (
        schedule.withColumn("before", F.coalesce(F.sum("block_tokens").over(order), F.lit(0)) + F.col("epoch") * F.col("source_tokens"))
        .where("before < target").withColumn("whole", F.col("before") + F.col("block_tokens") <= F.col("target"))
    )
    keys = schedule.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "before", "target", "whole")
    dealt = rows.join(keys, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    dealt = dealt.withColumn("order", dice(F.lit(mix.seed), "name", "epoch"))
    whole = dealt.where("whole").withColumn("upto", F.lit(0).cast("long"))
    # one block of a source is cut; its rows are in order by themselves
    inside = W.partitionBy("source", "epoch").orderBy("order", "id", "tokens", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = dealt.where("NOT whole").withColumn("upto", F.sum("tokens").over(inside)).where("before + upto <= target")
    fraction = (F.col("before") + F.col("order") / F.lit(float(1 << 60))) / F.col("target")
    return whole.unionByName(cut).select("id", "row", "source", "tokens", F.col("epoch").cast("long").alias("epoch"), F.least(fraction, F.lit(1.0)).alias("position"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """The documents as drawn, a row per draw, all columns unchanged. Rows are told apart by their
    place in a written copy of ``docs``, so ids may repeat or be null."""
    keyed = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    deal = _dealt(keyed.select("doc.*", F.col("row").alias(_ROW)), id_col, text_col, source_col, mix, _ROW)
    times = deal.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("times"))
    out = keyed.join(times.hint("shuffle_hash"), "row").select("doc", F.explode(F.sequence(F.lit(1), "times")))
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


_ROW = "__row of the written copy"


def op5_source_mixing(spark, sf_dir):
    """A row per draw from the whole of ``documents``. Null ids, texts and sources are values like others, empty texts count
    one token, repeated rows are drawn on their own; an empty table gives no rows."""
    return drawn(table(spark, sf_dir, "documents")).select("doc_id", "source", "tokens", "epoch", F.round("position", 9).alias("position"))


_DICE = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"

ORACLE = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, name, source, greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1) AS tokens, {_DICE.format("'17:' || name")} AS dice FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5('~' || coalesce(text, ''))) AS name FROM documents)
), src AS (SELECT source, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM r GROUP BY source),
tot AS (SELECT sum(tokens)::DOUBLE AS t, count(*) AS n, min(tokens)::DOUBLE AS least FROM src),
nat AS (SELECT -sum(tokens / t * ln(tokens / t)) AS h FROM src, tot),
bis(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT i, low, high, (low + high) / 2 AS mid,
      (SELECT ln(sum(pow(tokens / t, (low + high) / 2))) - (low + high) / 2 * sum(pow(tokens / t, (low + high) / 2) * ln(tokens / t)) / sum(pow(tokens / t, (low + high) / 2)) FROM src, tot)
        >= 0.97 * (SELECT ln(n) FROM tot) AS ok
    FROM bis WHERE i < 40)
), ex AS (SELECT CASE WHEN (SELECT h FROM nat) >= 0.97 * ln(n) OR n = 1 THEN 1.0::DOUBLE ELSE (SELECT (low + high) / 2 FROM bis WHERE i = 40) END AS a FROM tot),
w AS (
  SELECT source, tokens, least(floor(pow(tokens::DOUBLE, a) / (SELECT sum(pow(tokens::DOUBLE, a)) FROM src) * t + 1e-6), tokens * 4)::BIGINT AS target FROM src, ex, tot
), nb AS (SELECT greatest(16, ceil(sqrt(max(docs))))::BIGINT AS k FROM src),
e AS (SELECT source, tokens, target, unnest(range(0, target // tokens + 1)) AS epoch FROM w WHERE target > 0),
d AS (SELECT *, dice % k AS block FROM r, nb),
b AS (SELECT source, block, sum(tokens)::BIGINT AS bt FROM d GROUP BY ALL),
sched AS (
  SELECT b.source, block, epoch, target, bt, epoch * tokens + coalesce(sum(bt) OVER (
    PARTITION BY b.source, epoch ORDER BY {_DICE.format("'17:' || coalesce(b.source, '~') || ':' || epoch || ':' || block")}, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source
), deal AS (
  SELECT doc_id, d.source, tokens, epoch, before, target, before + bt <= target AS whole, {_DICE.format("'17:' || name || ':' || epoch")} AS ord
  FROM d JOIN sched s ON d.source IS NOT DISTINCT FROM s.source AND d.block = s.block WHERE before < target
), cut AS (
  SELECT *, sum(tokens) OVER (PARTITION BY source, epoch, whole ORDER BY ord, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM deal
)
SELECT doc_id, source, tokens, epoch, round(least((before + ord / 1152921504606846976.0::DOUBLE) / target, 1.0), 9) AS position FROM cut WHERE whole OR before + upto <= target
"""
