"""One-sweep operators against sets of positions, over tiles of a few bases."""

import random

import pytest

from loomspan.operators import intervals

SPANS = "seqid string, start long, stop long"


def _random(seed, least, n=60):
    r = random.Random(seed)
    # a third of the rows on one sequence; some begin before it, run past its end, or are the wrong way round
    rows = [(r.choice("aaabc"), s, s + r.choice([-2, 0, 1, 5, 40])) for s in (r.randrange(least, 130) for _ in range(n))]
    return [*rows, rows[0], (None, 5, 9), ("a", None, 9), ("a", 3, None), ("not in the genome", 4, 8)]


def _bases(rows):
    return {(k, p) for k, s, e in rows if None not in (k, s, e) for p in range(s, e + 1)}


def _expand(frame):
    found = [(k, p) for k, s, e in frame.select("seqid", "start", "stop").collect() for p in range(s, e + 1)]
    assert len(found) == len(set(found))  # stretches don't overlap
    return set(found)


@pytest.mark.parametrize("tile", [7, 1000])
def test_complement_of_random_intervals(spark, tile):
    rows, genome = _random(tile, -9), {"a": 100, "b": 120, "c": 1, "d": 30, "e": 0}
    lengths = spark.createDataFrame([*genome.items(), ("f", None)], "seqid string, length long")
    free = intervals.complement(spark.createDataFrame(rows, SPANS), lengths, tile=tile)
    taken = _bases(rows)
    assert _expand(free) == {(k, p) for k, n in genome.items() for p in range(1, n + 1)} - taken
    ends = sorted((k, s, e) for k, s, e in free.collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(ends, ends[1:]))  # as long as can be
    assert _expand(intervals.complement(spark.createDataFrame([], SPANS), lengths, tile=tile)) == {(k, p) for k, n in genome.items() for p in range(1, n + 1)}


@pytest.mark.parametrize("tile", [7, 1000])
def test_depth_of_random_reads(spark, tile):
    rows = _random(tile + 1, 1)
    runs = intervals.depth(spark.createDataFrame(rows, SPANS), tile=tile)
    deep = {(k, p): d for k, s, e, d in runs.collect() for p in range(s, e + 1)}
    brute = {at: sum(k == at[0] and s is not None and e is not None and s <= at[1] <= e for k, s, e in rows) for at in _bases(rows)}
    assert deep == brute
    assert intervals.depth(spark.createDataFrame([], SPANS), tile=tile).count() == 0


@pytest.mark.parametrize("tile", [7, 1000])
def test_feature_bits_of_random_sets(spark, tile):
    one, two = _random(3, 1), _random(4, 1, 25)
    genome = spark.createDataFrame([("a", 200), ("b", 200), ("c", 100), ("not in the genome", 500)], "seqid string, length long")
    r = intervals.feature_bits(spark.createDataFrame(one, SPANS), spark.createDataFrame(two, SPANS), genome, tile=tile).first()
    a, b = _bases(one), _bases(two)
    assert [r.one_pc, r.two_pc, r.both_pc, r.cover_pc] == pytest.approx([len(a) / 10, len(b) / 10, len(a & b) / 10, 100 * len(a & b) / len(a)])
    assert r.enrich == pytest.approx(len(a & b) / len(b) / (len(a) / 1000))
    each = {r.seqid: r for r in intervals.feature_bits(spark.createDataFrame(one, SPANS), spark.createDataFrame(two, SPANS), genome, by="seqid", tile=tile).collect()}
    assert each["b"].both_pc == pytest.approx(len({p for p in a & b if p[0] == "b"}) / 2)
    none = intervals.feature_bits(spark.createDataFrame([], SPANS), spark.createDataFrame(two, SPANS), genome, tile=tile).first()
    assert (none.one_pc, none.both_pc, none.cover_pc, none.enrich) == (0, 0, None, None)
