"""Pairs of a table with itself in blocks and greedy islands, against plain Python."""

import random

import pytest

from pyspark.sql import functions as F

from loomspan.operators import features, intervals
from tests.test_graphs_spans_rounds import one_by_one, table
from tests.test_operators import got


@pytest.mark.parametrize("names", [False, True])
def test_later_rows_of_a_pair_come_in_blocks(spark, monkeypatch, names):
    """A bin's rows were buffered one by one in the join and met all of the bin in both orders."""
    monkeypatch.setattr(intervals, "BLOCK", 4)
    rng = random.Random(3)
    rows = [("c", 1, 5_000_000, "+", 0), ("c", 900, 2, "+", 1), (None, 5, 9, "+", 2), ("c", None, 9, "+", 3), ("c", 70, 90, "+", None)]
    for i in range(4, 250):
        at = rng.choice([70, rng.randint(1, 3000), rng.randint(1, 200_000)])
        rows.append((rng.choice("cd"), at, at + rng.choice([0, 40, int(10 ** rng.uniform(0, 6))]), rng.choice(["+", "-", None]), i))
    rows += [("c", 70, 80, "-", 9), ("c", 70, 80, "+", 9)]  # rows of one id make no pair
    rows = [(*r[:4], None if r[4] is None else f"g{r[4]}" if names else r[4]) for r in rows]
    good = [r for r in rows if None not in (r[0], r[1], r[4]) and r[1] <= r[2]]
    want = [(a[0], a[4], b[4], max(a[1], b[1]), min(a[2], b[2]), "same" if a[3] and a[3] == b[3] else "opp") for a in good for b in good if a[0] == b[0] and a[4] < b[4] and a[1] <= b[2] and b[1] <= a[2]]
    df = intervals.self_overlaps(table(spark, f"seqid string, start long, stop long, strand string, id {'string' if names else 'long'}", rows), bin_size=100)
    assert got(df, "seqid", "left_id", "right_id", "start", "stop", "strands") == sorted(want)
    assert "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("isle", [3, 128])
def test_islands_inside_a_tile_need_no_rounds(spark, monkeypatch, isle):
    seen, rounds = [], intervals._greedy_rounds
    monkeypatch.setattr(intervals, "_greedy_rounds", lambda df, *a, **k: seen.extend(r[0] for r in df.select("id").collect()) or rounds(df, *a, **k))
    monkeypatch.setattr(intervals, "ISLE", isle)
    rng = random.Random(isle)
    spans = list({(rng.choice("cd"), s, s + int(10 ** rng.uniform(0, 2.3))) for s in (rng.randint(-300, 9000) for _ in range(260))} | {("d", 4990, 6100)})
    rows = [(*r, i) for i, r in enumerate(spans)]
    df = table(spark, "seqid string, start long, stop long, id long", [*rows, ("c", 9, 8, -1), (None, 1, 2, -2)]).withColumn("attrs", F.create_map(F.lit("n"), "id"))
    out = intervals.greedy_disjoint(df, "seqid", [F.col("start") - F.col("stop"), F.col("start"), F.col("stop")], tile=1000)
    assert got(out, "seqid", "start", "stop", "id") == one_by_one(rows, lambda r: (r[1] - r[2], r[1], r[2]))
    assert out.columns == df.columns and out.where("attrs['n'] <> id").isEmpty()
    want = set()  # of islands that are too large or touch two tiles, the rows in tiles where they do
    for key in "cd":
        for t in range(-1, 11):
            isles = []
            for r in sorted((r for r in rows if r[0] == key and r[1] // 1000 <= t <= r[2] // 1000), key=lambda r: r[1:3]):
                if isles and r[1] <= max(x[2] for x in isles[-1]):
                    isles[-1].append(r)
                else:
                    isles.append([r])
            for x in isles:
                if len(x) > isle or any(r[1] // 1000 != r[2] // 1000 for r in x):
                    want |= {r[3] for r in x if r[1] // 1000 == t}
    assert sorted(seen) == sorted(want) and len(seen) < len(rows)


def test_copies_of_small_islands_are_settled_at_once(spark, monkeypatch):
    monkeypatch.setattr(intervals, "_greedy_rounds", None)
    rows = [("g", "c", i * 500 + a, i * 500 + b) for i in range(1, 60) for a, b in ((0, 99), (50, 200), (201, 260), (90, 170))]
    out = features.dedupe_overlaps(table(spark, "gene string, seqid string, start long, stop long", rows))
    assert got(out, "start", "stop", "copy") == [(i * 500 + a, i * 500 + b, 2 * i - 1 + k) for i in range(1, 60) for k, (a, b) in enumerate(((50, 200), (201, 260)))]
