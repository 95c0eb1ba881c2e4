"""Interval algebra on closed 1-based intervals (columns seqid, start, stop).

Joins use nested bins: an interval is dealt to the few bins that it touches on the level
of its length, and to those of the higher levels that the other side has intervals on. A
pair meets on the higher of its two levels, in the bin of its later start alone. Ordered sweeps work in tiles: inside a
tile by a window, between tiles over one row per tile, so that one long sequence
with most of the rows is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.sources.scratch import kept

BIN, TILE = 2_000, 100_000
#: bins that an interval fills at most on its level, which is also how many bins one of the next level holds; levels
FAN, LEVELS = 16, 5
#: rows that are compared with another one together
BLOCK = 256
#: rows of an island that are settled in one place
ISLE = 128
#: a bin's number leaves room for its level and whose levels meet there
PLACES = 16


def _keys(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def normalize_interval(df: DataFrame, start: str = "start", stop: str = "stop", strand: str = "strand") -> DataFrame:
    """Start <= stop; where they were the other way round the strand is '-', else '+' if it is unknown."""
    known = F.col(strand) if strand in df.columns else F.lit(None).cast("string")
    return df.withColumns({strand: F.when(F.col(start) > F.col(stop), "-").otherwise(F.coalesce(known, F.lit("+"))), start: F.least(start, stop), stop: F.greatest(start, stop)})


def flip_strand(df: DataFrame, length: Column | str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Coordinates counted from the other end of a sequence of ``length``."""
    n = F.col(length) if isinstance(length, str) else length
    return df.withColumns({start: n - F.col(stop) + 1, stop: n - F.col(start) + 1})


def pad(df: DataFrame, before: int, after: int | None = None) -> DataFrame:
    """Intervals widened on both sides, not below position 1."""
    return df.withColumns({"start": F.greatest(F.col("start") - before, F.lit(1)), "stop": F.col("stop") + (before if after is None else after)})


def _level(size: int) -> Column:
    """The lowest level on which an interval fills ``FAN`` bins at most (the last level has what is left)."""
    length = F.col("stop") - F.col("start")
    return sum(((length > FAN * size * FAN**k).cast("int") for k in range(LEVELS - 1)), F.lit(0))


def _wide(size: int, level: Column) -> Column:
    """The size of the bins of a level."""
    return F.element_at(F.array(*(F.lit(size * FAN**k).cast("long") for k in range(LEVELS))), level + 1)


def _dealt(df: DataFrame, other: DataFrame, size: int, right: bool) -> DataFrame:
    """``df`` with a row per bin: __at is the bin and, in its last ``PLACES`` values, the level and whose levels meet there:
    0 equal ones, 1 a left interval and the bins above a shorter right one, 2 a right interval and the bins above a shorter
    left one."""
    levels = other.agg(F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1), _level(size))), F.lit(0)).alias("__levels"))
    df = df.withColumn("__own", _level(size)).join(F.broadcast(levels), how="cross")  # one row
    own, there, none = F.col("__own"), F.col("__levels"), F.array().cast("array<bigint>")
    mine, above = (2, 1) if right else (1, 2)
    df = df.withColumn("__wide", _wide(size, own))
    for c, end in (("__from", "start"), ("__to", "stop")):
        df = df.withColumn(c, F.floor(F.col(end) / F.col("__wide")) * PLACES + 3 * own)
    step = F.lit(PLACES).cast("long")
    home = F.sequence("__from", "__to", step)
    lower = F.when(there % F.call_function("shiftleft", F.lit(1), own) > 0, F.sequence(F.col("__from") + mine, F.col("__to") + mine, step)).otherwise(none)
    upper = []
    for k in range(1, LEVELS):  # one bin or two; nulls go in the join
        first, last = (F.floor(F.col(c) / (size * FAN**k)) * PLACES + (3 * k + above) for c in ("start", "stop"))
        seen = (own < k) & (there.bitwiseAND(1 << k) > 0)
        upper += [F.when(seen, first), F.when(seen & (first < last), last)]
    places = F.when((own == 0) & (there == 1), home).otherwise(F.concat(home, lower, F.when(there > 1, F.array(*upper)).otherwise(none)))
    return df.withColumn("__at", F.explode(places)).drop("__own", "__levels", "__wide", "__from", "__to")


def overlap_join(left: DataFrame, right: DataFrame, on: str | list[str] = "seqid", how: str = "inner", bin_size: int = BIN, suffix: str = "_r") -> DataFrame:
    """Pairs of overlapping intervals of the same key; the right side's columns get ``suffix``.
    With ``how='left'``, left rows without a partner have nulls there.

    An interval is ``FAN`` + 1 rows at most on its own level, and for each higher level of the other side one or two
    more. ``bin_size`` is that of the lowest level. A bin with most of one side's rows is split by adaptive execution."""
    keys = _keys(on)
    own = left.where("start <= stop")
    r = right.where("start <= stop")
    l, r = _dealt(own, r, bin_size, False), _dealt(r, own, bin_size, True).toDF(*(c + suffix for c in [*right.columns, "__at"]))
    both = l.join(r, [F.col(k) == F.col(k + suffix) for k in [*keys, "__at"]])
    s, t = F.col("start" + suffix), F.col("stop" + suffix)
    level = F.floor(F.pmod(F.col("__at"), F.lit(PLACES)) / 3).cast("int")
    both = both.where((F.col("start") <= t) & (s <= F.col("stop")) & (F.floor(F.col("__at") / PLACES) == F.floor(F.greatest("start", s) / _wide(bin_size, level))))
    both = both.drop("__at", "__at" + suffix)
    if how == "inner":
        return both
    return both.unionByName(overlap_anti(left, right, on, bin_size), allowMissingColumns=True)


def _touched(left: DataFrame, right: DataFrame, keys: list[str], size: int) -> DataFrame:
    spans = left.select(*keys, "start", "stop").distinct()
    return overlap_join(spans, right.select(*keys, "start", "stop").distinct(), keys, bin_size=size).select(*keys, "start", "stop").distinct()


def overlap_semi(left: DataFrame, right: DataFrame, on: str | list[str] = "seqid", bin_size: int = BIN) -> DataFrame:
    """Left rows that touch a right interval, each as often as it is there."""
    keys = _keys(on)
    return left.join(_touched(left, right, keys, bin_size), [*keys, "start", "stop"], "left_semi").select(left.columns)


def overlap_anti(left: DataFrame, right: DataFrame, on: str | list[str] = "seqid", bin_size: int = BIN) -> DataFrame:
    """Left rows that touch no right interval."""
    keys = _keys(on)
    return left.join(_touched(left, right, keys, bin_size), [*keys, "start", "stop"], "left_anti").select(left.columns)


def overlap_report(left: DataFrame, right: DataFrame, id_col: str, name_col: str, on: str = "seqid", bin_size: int = BIN) -> DataFrame:
    """Left ids with each partner's name, NO_MATCH where there is none, and single_match where there is one."""
    l = left.select(on, "start", "stop", F.col(id_col).alias("id"))
    r = right.select(on, "start", "stop", F.col(name_col).alias("name"))
    pairs = overlap_join(l, r, on, "left", bin_size)
    n = pairs.groupBy("id").agg(F.count("name_r").alias("n_matches"))
    return pairs.select("id", F.coalesce(F.col("name_r").cast("string"), F.lit("NO_MATCH")).alias("match")).join(n, "id").withColumn("single_match", F.col("n_matches") == 1)


def _blocked(df: DataFrame, keys: list[str], row: list[str], name: str) -> DataFrame:
    """Rows of the same keys as blocks of ``BLOCK`` neighbours: their columns ``row`` by the first of these, least start and greatest start and stop."""
    w = W.partitionBy(*keys).orderBy("start")
    df = df.withColumn("__block", F.floor((F.row_number().over(w) - 1) / BLOCK)).groupBy(*keys, "__block")
    return df.agg(F.min("start").alias("__from"), F.max("start").alias("__to"), F.max("stop").alias("__end"), F.array_sort(F.collect_list(F.struct(*row))).alias(name))


def self_overlaps(genes: DataFrame, id_col: str = "id", on: str = "seqid", bin_size: int = BIN) -> DataFrame:
    """Unordered pairs of overlapping rows once, with the range they share and whether their strands agree.

    The row of a pair that starts later (of equal starts, that with the greater id) is looked for in the bin of its start,
    on the levels that rows have; the other one is in all bins that it touches on its own level, so a pair meets once. Both
    come as blocks of ``BLOCK`` neighbours, later rows by strand: a pair of blocks is one row of the join, and pairs are written out
    behind it, those of one block of later rows after each other, in the order of their ids. So the join grows with the pairs
    of blocks, and what a file holds of a block's rows repeats itself."""
    g = genes.select(on, "start", "stop", "strand", F.col(id_col).alias("id")).where("start <= stop").withColumn("__level", _level(bin_size))
    keys, bin_of = [on, "__level", "__bin"], lambda c: F.floor(F.col(c) / _wide(bin_size, F.col("__level")))
    levels = g.agg(F.collect_set("__level").alias("__levels"))
    r = g.drop("__level").join(F.broadcast(levels), how="cross").withColumn("__level", F.explode("__levels")).withColumn("__bin", bin_of("start"))  # one row
    r = _blocked(r.withColumns({f"{c}_r": F.col(c) for c in ("id", "start", "stop")}), [*keys, "strand"], ["id_r", "start_r", "stop_r"], "__later")
    r = r.select(*(F.col(k).alias(f"{k}_r") for k in keys), F.col("strand").alias("strand_r"), "__from", "__to", "__later")
    l = _blocked(g.withColumn("__bin", F.explode(F.sequence(bin_of("start"), bin_of("stop")))), keys, ["start", "stop", "strand", "id"], "__rows")
    l = l.select(*keys, F.col("__from").alias("__first"), "__end", "__rows")
    p = l.join(r, [F.col(k) == F.col(f"{k}_r") for k in keys] + [F.col("__from") <= F.col("__end"), F.col("__to") >= F.col("__first")])
    p = p.select(on, "strand_r", "__from", "__to", "__later", F.inline("__rows")).where("__from <= stop AND __to >= start")
    p = p.select(on, "id", "start", "stop", strand_relation().alias("strands"), F.inline("__later"))
    p = p.where("start_r <= stop AND start_r >= start AND (start_r > start OR id_r > id) AND id_r <> id")
    return p.select(on, F.least("id", "id_r").alias("left_id"), F.greatest("id", "id_r").alias("right_id"), F.col("start_r").alias("start"), F.least("stop", "stop_r").alias("stop"), "strands")


def strand_relation(left: str = "strand", right: str = "strand_r") -> Column:
    return F.when(F.col(left) == F.col(right), "same").otherwise("opp")


def offset_pairs(df: DataFrame, offset: int, on: str = "seqid") -> DataFrame:
    """Top-strand rows with the bottom-strand rows ``offset`` further on."""
    top = df.where("strand = '+'")
    bottom = df.where("strand = '-'").select(F.col(on).alias("__on"), (F.col("start") - offset).alias("__at"), *(F.col(c).alias(c + "_r") for c in df.columns if c != on))
    return top.join(bottom, (F.col(on) == F.col("__on")) & (F.col("start") == F.col("__at"))).drop("__on", "__at")


def project_to_blocks(features: DataFrame, blocks: DataFrame, on: str = "seqid", bin_size: int = BIN) -> DataFrame:
    """Features that begin inside a block (columns block, seqid, start, stop), in 1-based block coordinates cut at its end."""
    p = overlap_join(features, blocks, on, bin_size=bin_size, suffix="_b").where("start >= start_b")
    return p.select("block_b", *(c for c in features.columns if c not in ("start", "stop")), (F.col("start") - F.col("start_b") + 1).alias("start"), (F.least("stop", "stop_b") - F.col("start_b") + 1).alias("stop")).withColumnRenamed("block_b", "block")


def touched_blocks(df: DataFrame, genome: DataFrame, every: int, number: str, on: str = "seqid", start: str = "start", stop: str = "stop") -> DataFrame:
    """Keys and numbers of the blocks of ``every`` positions (k spans k * every + 1 to (k + 1) * every) that intervals touch, each
    once, with the length of their sequence: for a map of regular blocks, which grows with the intervals so and not with the genome."""
    first, last = (F.floor((F.col(c) - 1) / every) for c in (start, stop))
    return df.where(F.col(start) <= F.col(stop)).select(on, F.explode(F.sequence(first, last)).alias(number)).distinct().join(genome.select(on, "length"), on)


def earlier(df: DataFrame, keys: list[str], order: list[Column | str], value: Column, kind: str, tile: Column, inclusive: bool = False) -> DataFrame:
    """``df`` with __before: sum or maximum of ``value`` over the rows of the same keys that come earlier."""
    agg = {"sum": F.sum, "max": F.max}[kind]
    df = df.withColumn("__tile", tile).withColumn("__value", value)
    inner = W.partitionBy(*keys, "__tile").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    outer = W.partitionBy(*keys).orderBy("__tile").rowsBetween(W.unboundedPreceding, -1)
    tiles = df.groupBy(*keys, "__tile").agg(agg("__value").alias("__sum")).withColumn("__base", agg("__sum").over(outer)).drop("__sum")
    out = df.withColumn("__inner", agg("__value").over(inner)).join(tiles, [*keys, "__tile"])
    both = F.greatest("__inner", "__base") if kind == "max" else F.coalesce("__inner", F.lit(0)) + F.coalesce("__base", F.lit(0))
    return out.withColumn("__before", both).drop("__tile", "__value", "__inner", "__base")


def beside(df: DataFrame, keys: list[str], order: list[str], value: Column, tile: Column, ahead: bool = False) -> DataFrame:
    """``df`` with __beside: the last ``value`` that isn't null in the rows of the same keys that come earlier or, with
    ``ahead``, the first in those that come later. ``tile`` grows with the first column of ``order``."""
    df = df.withColumn("__tile", tile).withColumn("__value", value)
    sort = [F.col(c).desc() if ahead else F.col(c).asc() for c in [*order, "__tile"]]
    inner = W.partitionBy(*keys, "__tile").orderBy(*sort[:-1]).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(sort[-1]).rowsBetween(W.unboundedPreceding, -1)
    pick = F.min_by if ahead else F.max_by
    edge = pick(F.col("__value"), F.when(F.col("__value").isNotNull(), F.struct(*order)))
    tiles = df.groupBy(*keys, "__tile").agg(edge.alias("__edge")).withColumn("__base", F.last("__edge", ignorenulls=True).over(outer)).drop("__edge")
    out = df.withColumn("__inner", F.last("__value", ignorenulls=True).over(inner)).join(tiles, [*keys, "__tile"])
    return out.withColumn("__beside", F.coalesce("__inner", "__base")).drop("__tile", "__value", "__inner", "__base")


def tile_of(df: DataFrame, column: str, size: int = TILE, letters: int = 12) -> Column:
    """A tile that grows with a column: ``size`` numbers each for numbers, the first ``letters`` for texts."""
    return F.substring(column, 1, letters) if dict(df.dtypes)[column] == "string" else F.floor(F.col(column) / size)


def merge_intervals(df: DataFrame, on: str | list[str] = "seqid", gap: int = 0, tile: int = TILE, total: str | None = None) -> DataFrame:
    """Islands of intervals with at most ``gap`` between start and the end so far (1 joins neighbours),
    as keys, start, stop, n, the number of intervals in each, and the sum of a column ``total``. ``gap`` is 0 or more and less than ``tile``."""
    keys, sums = _keys(on), ["n", *([total] if total else [])]
    spans = df.where("start <= stop").groupBy(*keys, "start", "stop").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums[1:]))
    bits = spans.withColumn("t", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor(F.col("stop") / tile))))
    bits = bits.select(
        *keys, "t", F.greatest("start", F.col("t") * tile).alias("s"), F.least("stop", F.col("t") * tile + tile - 1).alias("e"),
        (F.col("stop") >= (F.col("t") + 1) * tile).alias("right"), (F.col("start") < F.col("t") * tile).alias("left"), *(F.when(F.floor(F.col("start") / tile) == F.col("t"), F.col(c)).otherwise(0).alias(c) for c in sums),
    )
    # an island is read off its last row by windows of one order, so that a task holds one sort of its rows and no groups of them
    w = W.partitionBy(*keys, "t").orderBy("s", "e")
    upto, reach = w.rowsBetween(W.unboundedPreceding, 0), F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    bits = bits.withColumn("new", reach.isNull() | (F.col("s") > reach + gap)).withColumns({"k": F.sum(F.col("new").cast("int")).over(upto), "sofar": F.sum("n").over(upto), "ahead": F.lead("new").over(w)})
    if total:  # sums of their own: differences of running ones would round
        bits = bits.withColumn(total, F.sum(total).over(W.partitionBy(*keys, "t", "k")))
    since = lambda c: F.last(F.when(F.col("new"), c), ignorenulls=True).over(upto)
    isles = bits.select(
        *keys, "t", "k", "ahead", since(F.col("s")).alias("start"), F.max("e").over(upto).alias("stop"), (F.col("sofar") - since(F.col("sofar") - F.col("n"))).alias("n"), *sums[1:],
        F.max("right").over(upto).alias("right"), F.max("left").over(upto).alias("left"),
    ).where("coalesce(ahead, true)")
    edge = isles.where("k = 1 OR ahead IS NULL")  # two of a tile at most
    w = W.partitionBy(*keys).orderBy("t", "k")
    ties = (F.lag("right").over(w) & F.col("left")) | (F.col("start") <= F.lag("stop").over(w) + gap)
    ties = F.coalesce(ties & (F.col("k") == 1) & F.lag(F.col("ahead").isNull()).over(w), F.lit(False))
    edge = edge.withColumn("new", F.when(ties, 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.groupBy(*keys, "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *(F.sum(c).alias(c) for c in sums)).drop("g")
    return isles.where("k <> 1 AND ahead IS NOT NULL").select(*keys, "start", "stop", *sums).unionByName(edge)


def greedy_disjoint(df: DataFrame, on: str | list[str], order: list[Column], chain: str | None = None, tile: int = TILE) -> DataFrame:
    """Rows that stay when they are taken one by one by ``order``, each unless it overlaps one of the same keys that
    stays; with ``chain``, a row that doesn't stay ends the later ones of its chain. Rows of equal rank are in any order,
    rows without a key are left out.

    Islands of up to ``ISLE`` rows that lie inside a tile are settled where one shuffle puts them, row by row; larger ones,
    those across the ends of tiles and all rows of chains go through rounds. Writes intermediate tables."""
    if chain:
        return _greedy_rounds(df, on, order, chain)
    keys = _keys(on)
    rows = df.where("start <= stop").dropna(subset=keys)
    bits = rows.withColumn("__tile", F.explode(F.sequence(*(F.floor(F.col(c) / tile) for c in ("start", "stop")))))
    w = W.partitionBy(*keys, "__tile").orderBy("start", "stop")
    upto, reach = w.rowsBetween(W.unboundedPreceding, 0), F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    bits = bits.withColumn("__new", reach.isNull() | (F.col("start") > reach)).withColumn("__at", F.row_number().over(w))
    since = F.last(F.when(F.col("__new"), F.col("__at")), ignorenulls=True).over(upto)
    bits = bits.withColumns({"__isle": since, "__end": F.coalesce(F.lead("__new").over(w), F.lit(True))})
    home, out = F.floor(F.col("start") / tile) == F.col("__tile"), F.floor(F.col("stop") / tile) > F.col("__tile")
    row = F.struct(F.struct(*order).alias("rank"), "start", "stop", home.alias("home"), F.struct(*df.columns).alias("row"))
    # an island comes in pieces of ISLE rows, so that none is gathered; it is settled if the first one is all of it
    isles = bits.groupBy(*keys, "__tile", "__isle", F.floor((F.col("__at") - F.col("__isle")) / ISLE).alias("__piece"))
    isles = isles.agg(F.collect_list(row).alias("__rows"), F.bool_or(out | ~home).alias("__open"), F.bool_or("__end").alias("__whole"))
    isles = isles.withColumn("__done", (F.col("__piece") == 0) & F.col("__whole") & ~F.col("__open"))
    isles = isles.select("__done", F.inline(F.when(F.col("__done"), _one_by_one(F.col("__rows"))).otherwise(F.filter("__rows", lambda r: r["home"])))).select("__done", "row.*")
    isles = kept(isles, "isles")
    done, rest = isles.where("__done").drop("__done"), isles.where("NOT __done").drop("__done")
    return done if rest.isEmpty() else done.unionByName(_greedy_rounds(rest, on, order))


def _one_by_one(rows: Column) -> Column:
    """Of an array of rows with rank, start and stop, those that stay when they are taken by rank."""
    by_rank = F.array_sort(rows, lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))
    free = lambda stay, r: ~F.exists(stay, lambda k: (k["start"] <= r["stop"]) & (r["start"] <= k["stop"]))
    stay = F.aggregate(by_rank, F.slice(rows, 1, 0), lambda stay, r: F.when(free(stay, r), F.concat(stay, F.array(r))).otherwise(stay))
    return F.when(F.size(rows) == 1, rows).otherwise(stay)


def _greedy_rounds(df: DataFrame, on: str | list[str], order: list[Column], chain: str | None = None) -> DataFrame:
    """``greedy_disjoint`` in rounds, each for all rows at once: a row is taken when it is the first of all undecided ones that
    it may overlap, and undecided rows that overlap a taken one go. What may overlap is seen in bins of about the rows' own
    lengths: a bin holds the smallest rank of its rows, so that no pairs are formed and no island is gathered. As many
    rounds as the longest chain of ever better rows that overlap; few, if the order isn't that of position."""
    keys = _keys(on)
    rows = df.where("start <= stop").withColumn("__row", F.monotonically_increasing_id())
    rows = kept(rows.withColumns({"__rank": F.struct(*order, "__row"), "__level": F.when(F.col("start") == F.col("stop"), 0).otherwise(F.length(F.bin(F.col("stop") - F.col("start"))))}), "greedy")
    levels = sorted(r[0] for r in rows.select("__level").distinct().collect())  # 64 numbers at most
    open_ = rows.select(*keys, "start", "stop", "__row", "__rank", "__level", *([F.col(chain).alias("__chain")] if chain else []))
    taken = []
    while True:
        at = open_.withColumn("__m", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= F.col("__level"))))
        at = kept(_power_bins(at).withColumn("__own", F.col("__m") == F.col("__level")), "greedy")
        if at.isEmpty():
            break
        place = [*keys, "__m", "__bin"]
        # rows meet on the higher of their levels: those at home there see all, the others those at home
        firsts = at.groupBy(*place).agg(F.min("__rank").alias("__all"), F.min(F.when(F.col("__own"), F.col("__rank"))).alias("__home"))
        ahead = at.join(firsts, place).groupBy("__row").agg(F.min(F.when(F.col("__own"), F.col("__all")).otherwise(F.col("__home"))).alias("__first"))
        best = open_.join(ahead, "__row").where(F.col("__first").isNull() | (F.col("__rank") <= F.col("__first")))
        if chain:  # the rows of a chain before it are taken too
            wait = open_.join(best.select("__row"), "__row", "left_anti").groupBy("__chain").agg(F.min("__rank").alias("__wait"))
            best = best.join(wait, "__chain", "left").where(F.col("__wait").isNull() | (F.col("__rank") < F.col("__wait")))
        best = kept(best.select("__row"), "greedy")
        taken.append(best)
        new = at.join(best, "__row").select(*(F.col(k).alias(f"{k}__t") for k in keys), F.col("__m").alias("__mt"), F.col("__bin").alias("__bint"), F.col("start").alias("__from"), F.col("stop").alias("__to"), F.col("__own").alias("__ownt"))
        hit = at.join(new, [F.col(k) == F.col(f"{k}__t") for k in keys] + [F.col("__m") == F.col("__mt"), F.col("__bin") == F.col("__bint")])
        gone = hit.where("(__own OR __ownt) AND start <= __to AND __from <= stop").select("__row").distinct()
        left = open_.join(gone, "__row", "left_anti")
        if chain:
            out = open_.join(gone, "__row").join(best, "__row", "left_anti").groupBy("__chain").agg(F.min("__rank").alias("__stopped"))
            left = left.join(out, "__chain", "left").where(F.col("__stopped").isNull() | (F.col("__rank") < F.col("__stopped"))).drop("__stopped")
        open_ = kept(left, "greedy")
    if not taken:
        return rows.select(df.columns)
    return rows.join(reduce(DataFrame.union, taken), "__row", "left_semi").select(df.columns)


def _power_bins(df: DataFrame) -> DataFrame:
    """A row for each bin of 2 ** __m positions that an interval touches, two at most where its length is no greater."""
    wide = F.pow(F.lit(2), F.col("__m")).cast("long")
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / wide), F.floor(F.col("stop") / wide))))


def collapse_runs(df: DataFrame, value: str = "value", on: str | list[str] = "seqid", tile: int = TILE) -> DataFrame:
    """Runs of consecutive integers as start and stop, with how many rows each holds."""
    return merge_intervals(df.withColumns({"start": F.col(value), "stop": F.col(value)}), on, 1, tile)


def _ends(df: DataFrame, on: str, **weights: Column) -> DataFrame:
    """A step up at the start of each interval and one down behind its stop, in the columns of ``weights``."""
    up, down = (F.struct(at.cast("long").alias("pos"), *((sign * w).cast("long").alias(n) for n, w in weights.items())) for at, sign in ((F.col("start"), 1), (F.col("stop") + 1, -1)))
    return df.where("start <= stop").select(on, F.inline(F.array(up, down)))


def _runs(steps: DataFrame, on: str, values: list[str], tile: int) -> DataFrame:
    """Stretches between positions at which a sum of ``values`` over the steps (on, pos) so far changes: key, start, stop,
    sums. One sweep: a window over the positions of a tile, ``tile`` rows at most, and one over the tiles of a key.
    Behind the last step stop is null. Steps without a key or position are left out."""
    steps = steps.groupBy(on, "pos").agg(*(F.sum(v).alias(v) for v in values)).where(" OR ".join(f"{v} <> 0" for v in values)).withColumn("__tile", F.floor(F.col("pos") / tile))
    w_in, w_out = W.partitionBy(on, "__tile").orderBy("pos"), W.partitionBy(on).orderBy("__tile")
    tiles = steps.groupBy(on, "__tile").agg(F.min("pos").alias("__first"), *(F.sum(v).alias(v) for v in values))
    tiles = tiles.select(on, "__tile", F.lead("__first").over(w_out).alias("__next"), *(F.sum(v).over(w_out.rowsBetween(W.unboundedPreceding, -1)).alias(f"__{v}") for v in values))
    runs = steps.select(on, "__tile", "pos", F.lead("pos").over(w_in).alias("__ahead"), *(F.sum(v).over(w_in.rowsBetween(W.unboundedPreceding, 0)).alias(v) for v in values))
    sums = ((F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values)
    return runs.join(tiles, [on, "__tile"]).select(on, F.col("pos").alias("start"), (F.coalesce("__ahead", "__next") - 1).alias("stop"), *sums)


def complement(df: DataFrame, genome: DataFrame, on: str = "seqid", tile: int = TILE) -> DataFrame:
    """What intervals leave free of each sequence of ``genome`` (seqid, length, a row per sequence), sequences without
    intervals whole."""
    one, none = F.lit(1), F.lit(0)
    whole = genome.select(on, F.lit(1).alias("start"), F.col("length").alias("stop"))
    steps = _ends(df, on, taken=one, inside=none).unionByName(_ends(whole, on, taken=none, inside=one))
    return _runs(steps, on, ["taken", "inside"], tile).where("taken = 0 AND inside > 0").select(on, "start", "stop")


def intergenic(genes: DataFrame, genome: DataFrame, on: str = "seqid", tile: int = TILE) -> DataFrame:
    """Regions between a gene and all before it, and from the last one to the end; the region before the first gene is left out."""
    first = genes.groupBy(on).agg(F.min("start").alias("__first"))
    return complement(genes, genome, on, tile).join(first, on).where("start > __first").drop("__first")


def depth(reads: DataFrame, on: str = "seqid", weight: str | None = None, tile: int = TILE) -> DataFrame:
    """Runs of equal depth above 0: key, start, stop, depth."""
    steps = _ends(reads, on, depth=F.col(weight) if weight else F.lit(1))
    return _runs(steps, on, ["depth"], tile).where("depth > 0").select(on, "start", "stop", "depth")


def bases_by_type(features: DataFrame, by: str = "type", genome: DataFrame | None = None, on: str = "seqid") -> DataFrame:
    """Distinct positions of each type, and their share of the genome in percent if it is given."""
    out = merge_intervals(features, [on, by], 1).groupBy(by).agg(F.sum(F.col("stop") - F.col("start") + 1).alias("bases"))
    if genome is None:
        return out
    total = genome.agg(F.sum("length").alias("__total"))
    return out.join(F.broadcast(total), how="cross").select(by, "bases", (100.0 * F.col("bases") / F.col("__total")).alias("percent"))


def feature_bits(one: DataFrame, two: DataFrame, genome: DataFrame, on: str = "seqid", by: str | None = None, tile: int = TILE) -> DataFrame:
    """Percent of the genome in each set and in both, cover = both / one, enrich = (both / two) / (one / genome);
    a row per value of ``by`` (the key, say), or one for all. Both sets are counted in one sweep."""
    yes, no = F.lit(1), F.lit(0)
    runs = _runs(_ends(one, on, one=yes, two=no).unionByName(_ends(two, on, one=no, two=yes)), on, ["one", "two"], tile).where("one > 0 OR two > 0")
    size = F.col("stop") - F.col("start") + 1
    parts = runs.select(on, *(F.when(seen, size).alias(c) for c, seen in (("one", F.col("one") > 0), ("two", F.col("two") > 0), ("both", (F.col("one") > 0) & (F.col("two") > 0)))))
    parts = parts.unionByName(genome.select(on, F.col("length").alias("len")), True)
    out = (parts.groupBy(by) if by else parts.groupBy()).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("one", "two", "both", "len")))
    pc = lambda c: F.try_divide(F.lit(100.0) * F.col(c), F.col("len"))
    cover = F.try_divide(F.col("both").cast("double"), F.col("one"))
    enrich = F.try_divide(F.try_divide(F.col("both").cast("double"), F.col("two")), F.try_divide(F.col("one").cast("double"), F.col("len")))
    return out.select(*([by] if by else []), pc("one").alias("one_pc"), pc("two").alias("two_pc"), pc("both").alias("both_pc"), (100 * cover).alias("cover_pc"), enrich.alias("enrich"))


def map_domains_to_genome(hits: DataFrame, cds: DataFrame) -> DataFrame:
    """Protein hits (gene, domain, ali_from, ali_to) as one genome interval per CDS exon that they cover
    (cds: gene, seqid, start, stop, strand); residue i is coding bases 3i-2 to 3i."""
    w = W.partitionBy("gene").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")), "seqid", "stop", "strand")
    size = F.col("stop") - F.col("start") + 1
    parts = cds.withColumn("c_to", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("c_from", F.col("c_to") - size + 1)
    h = hits.select("gene", "domain", (3 * F.col("ali_from") - 2).alias("h_from"), (3 * F.col("ali_to")).alias("h_to"))
    p = parts.join(h, "gene").where("h_from <= c_to AND c_from <= h_to")
    p = p.withColumns({"a": F.greatest("h_from", "c_from") - F.col("c_from"), "b": F.least("h_to", "c_to") - F.col("c_from")})
    plus = F.col("strand") != "-"
    return p.select("gene", "domain", "seqid", F.when(plus, F.col("start") + F.col("a")).otherwise(F.col("stop") - F.col("b")).alias("start"), F.when(plus, F.col("start") + F.col("b")).otherwise(F.col("stop") - F.col("a")).alias("stop"), "strand")
