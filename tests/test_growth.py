"""Steps whose work must grow with the input alone: stretches instead of whole sequences, one reading instead of many."""

import bisect
import math
import random

import pytest

from loomspan import catalog
from loomspan.functions import codon_table
from loomspan.operators import features, intervals, popgen, variants, windows
from tests.conftest import SF


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stretches", [variants.READ_ON, (3, 9, None), (None,)])
def test_frameshifts_are_read_on_in_stretches(spark, monkeypatch, stretches):
    """Before, each frameshift translated all of the coding sequence behind it."""
    monkeypatch.setattr(variants, "READ_ON", stretches)
    seqs = {"near": "ATG" + "GCT" * 20 + "TAAG" + "GCT" * 50, "far": "GCA" * 1500 + "TGAC" + "GCA" * 10, "none": "GCC" * 1200, "end": "ATGGC"}
    models = table(spark, "gene string, seqid string, start long, stop long, strand string", [(k, k, 1, len(s), "+") for k, s in seqs.items()])
    cuts = [(k, p, s[p - 1 : p + 1], s[p - 1]) for k, s in seqs.items() for p in (2, 3, 60) if p < len(s) and s[p - 1] != s[p]]
    out = variants.variant_effects(table(spark, "seqid string, pos long, ref string, alt string", cuts), models, table(spark, "seqid string, seq string", list(seqs.items())), 50, 100)
    found = {(r.seqid, r.pos): (r["class"], r.new_aa, r.stop_at) for r in out.collect()}
    code = codon_table()
    for k, p, _, _ in cuts:
        new = seqs[k][:p] + seqs[k][p + 1 :]
        w = found[k, p]
        first = p // 3  # codons before the first one that changes
        pep = "".join(code[new[i : i + 3]] for i in range(first * 3, len(new) - 2, 3))
        pep, at = (pep[: pep.index("*") + 1], first + pep.index("*") + 1) if "*" in pep else (pep, None)
        assert w == ("frameshift", pep, at)
    assert len(found) == len(cuts) >= 8


def test_groups_are_compared_in_one_sweep(spark):
    """Before, each pair had rows of its own, and the distinct values were grouped anew for each running number."""
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), rng.choice([float(rng.randrange(40)), rng.random(), -0.0, math.inf, -math.inf])) for _ in range(3000)] + [("a", None), (None, 1.0)]
    df = table(spark, "k string, v double", rows)
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "none"), ("none", "a"), ("none", "nil"), ("a", "b")]
    out = popgen.compare_groups(df, "v", "k", pairs)
    found = {(r.one, r.two): r for r in out.collect()}
    assert set(found) == set(pairs) - {("none", "nil")}
    for (one, two), r in found.items():
        x, y = ([v for k, v in rows if k == name and v is not None] for name in (one, two))
        assert (r.n_one, r.n_two) == (len(x), len(y))
        every = sorted(x + y)
        rank = {v: (bisect.bisect_left(every, v) + bisect.bisect_right(every, v) + 1) / 2 for v in every}
        assert r.rank_sum == sum(rank[v] for v in x)
        if x and y:
            x, y = sorted(x), sorted(y)
            assert r.ks == pytest.approx(max(abs(bisect.bisect_right(x, v) / len(x) - bisect.bisect_right(y, v) / len(y)) for v in every), abs=1e-12)
        else:
            assert r.ks is None and r.ks_p is None
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2  # the sums in a tile and those over the tiles, of all groups at once


def test_neighbours_are_found_in_one_shuffle(spark):
    rng = random.Random(5)
    rows = []
    for i, p in enumerate(sorted(rng.sample(range(1, 3_000_000), 120))):
        there = rng.random() < 0.6
        rows.append(("c%d" % (i % 2), p, f"g{i}", "OK" if there else "NO_GENES_IN_INTERVAL", rng.choice("xy") if there else None, 2 * p if there else None, 2 * p + 9 if there else None))
    rows.append((None, 5, "n", "NO_GENES_IN_INTERVAL", None, None, None))
    df = table(spark, "chrom string, start long, gene string, status string, target string, t_start long, t_stop long", rows)
    want = []
    for c in ("c0", "c1"):
        own = sorted(r for r in rows if r[0] == c)
        for a, r, b in zip(own, own[1:], own[2:]):
            if r[4] is None and a[4] is not None and a[4] == b[4]:
                want.append((c, r[2], a[4], min(a[6], b[6]) + 1, max(a[5], b[5]) - 1))
    out = features.missing_regions(df)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and len(want) > 5
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is made
    try:
        plan = features.missing_regions(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ReusedExchange") == 1  # the tiles' ends read the rows' shuffle
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("size,step", [(2000, 500), (500, 500), (400_000, 500)])
def test_points_go_to_blocks_of_bins(spark, size, step):
    """Before, each point was shuffled once for every bin that it counts in."""
    rng = random.Random(size)
    rows = [(rng.choice("ab"), rng.choice([-1200, -3, 0, 127_999, 128_000, 128_001, rng.randrange(600_000)]), rng.choice([None, 1.0, 2.5])) for _ in range(400)] + [(None, 7, 1.0)]
    out = windows.sliding_windows(table(spark, "seqid string, start long, v double", rows), value="v", size=size, step=step)
    bins = {}
    for g, p, v in rows:
        i = p // step
        for b in [i] if size == step else range(max(i - size // step, 0), i + 2):
            if g is not None:
                bins.setdefault((g, b), []).append(v)
    want = {k: (sum(x for x in v if x is not None) if any(x is not None for x in v) else None, len(v)) for k, v in bins.items()}
    found = out.collect()
    assert {(r.seqid, r.bin): (r.total, r.n) for r in found} == want
    for g in "ab":
        of = [(t, t / n) for (k, _), (t, n) in want.items() if k == g and t is not None]
        for r in (r for r in found if r.seqid == g):
            assert (r.max_total, r.max_average) == (max(t for t, _ in of), max(a for _, a in of))
    # points are shuffled by block, before their bins are written out
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = next(x for x in reversed(plan.splitlines()) if "Generate explode" in x or "RepartitionByExpression" in x)
    assert "block" in first and "bin#" not in first


@pytest.mark.parametrize("tile,gap", [(7, 0), (7, 3), (50, 1), (1000, 0)])
def test_islands_without_groups_of_rows(spark, tile, gap):
    """Before, a task held two sorts of its rows and two tables of its islands."""
    rng = random.Random(tile + gap)
    rows = [(rng.choice("ab"), p, p + rng.choice([0, 1, 2, 5, 40]), rng.choice([0.1, 1e9, None])) for p in (rng.randrange(-20, 400) for _ in range(90))] + [("a", 9, 3, 1.0)]
    want = []
    for key in "ab":
        for _, s, e, v in sorted((r for r in rows if r[0] == key and r[1] <= r[2]), key=lambda r: r[1:3]):
            if want and want[-1][0] == key and s <= want[-1][2] + gap:
                want[-1][2], want[-1][3] = max(want[-1][2], e), want[-1][3] + [v]
            else:
                want.append([key, s, e, [v]])
    df = table(spark, "seqid string, start long, stop long, v double", rows)
    found = {(r.seqid, r.start, r.stop): (r.n, r.v) for r in intervals.merge_intervals(df, gap=gap, tile=tile, total="v").collect()}
    assert found.keys() == {tuple(w[:3]) for w in want}
    for *place, values in want:
        n, v = found[tuple(place)]
        some = [x for x in values if x is not None]
        assert n == len(values) and (v or 0.0) == pytest.approx(sum(some), abs=1e-6)
    plain = intervals.merge_intervals(df.drop("v"), gap=gap, tile=tile)
    assert sorted(tuple(r) for r in plain.collect()) == sorted((*w[:3], len(w[3])) for w in want)
    inner = plain._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert inner.count("Window") >= 3  # no grouping above the windows of the inner islands


def test_chunks_are_written_by_all_tasks_and_opened_once(spark):
    """Before, a file of events was written by one task, and all chunks were read a second time."""
    out = catalog.queries()["write_chunks"](spark, SF)
    assert len(out.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert {f.split("part-")[1][:5] for f in out.inputFiles()} == {f"{i:05d}" for i in range(spark.sparkContext.defaultParallelism)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
