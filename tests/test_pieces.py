"""Alignment columns are worked out inside pieces of rows: results across the pieces' ends, and plans that group no cells."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomspan import catalog
from loomspan.operators import alignments as A
from tests.conftest import SF


@pytest.fixture(scope="module")
def blocks():
    rng = random.Random(4)
    out = {}
    for block, size in enumerate((1, 255, 256, 257, 700, 1024)):
        rows = {r: "".join(rng.choice("ACGTacgN-") for _ in range(size)) for r in ("x", "y", "z")}
        if size > 300:  # gaps across an end of a piece, and over a whole one
            rows["x"] = rows["x"][:200] + "A" * 320 + rows["x"][520:]
            rows["y"] = rows["y"][:250] + "-" * 270 + rows["y"][520:]
        out[block] = rows
    return out


@pytest.fixture(scope="module")
def aln(spark, blocks):
    return spark.createDataFrame([(b, r, a) for b, rows in blocks.items() for r, a in rows.items()] + [(9, "y", "AC-T"), (8, "x", "")], "block long, row_id string, aln string")


@pytest.mark.parametrize("name", ["aln_column_classes", "column_rates", "rate_scores", "aln_stats_by_row", "scan_indels"])
def test_no_cell_is_grouped(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    keys = {k.split("#")[0].strip() for part in re.findall(r"Aggregate \[([^\]]*)\]", plan) for k in part.split(",")}
    assert "block" in keys and not keys & {"col", "base", "i", "row_id"}, keys


def test_classes_across_pieces(aln, blocks):
    got = {(r["block"], r["col"]): r["class"] for r in A.aln_column_classes(aln, "x").collect()}
    for b, rows in blocks.items():
        for i, (x, y, z) in enumerate(zip(*(rows[r].upper() for r in "xyz")), 1):
            assert got.pop((b, i)) == ("invariant" if x == y == z else "target_unique" if y == z else "mixed")
    assert got == {(9, i): "invariant" for i in range(1, 5)}


def test_rates_across_pieces(aln, blocks):
    got = {(r["block"], r["col"]): r for r in A.column_rates(aln, F.ascii, lambda base, col: -col % 5).collect()}
    assert len(got) == sum(len(rows["x"]) for rows in blocks.values()) + 4
    for b, rows in blocks.items():
        states = max(ord(c) for a in rows.values() for c in a.upper())
        rates = [sum(ord(rows[r][i].upper()) for r in rows) / 2 ** ((i + 1) % 5) / states for i in range(len(rows["x"]))]
        for i, rate in enumerate(rates, 1):
            r = got[b, i]
            assert (r["states"], r["rate"], r["scaled"]) == (states, pytest.approx(rate), pytest.approx(rate / max(rates)))


def test_stats_by_row_across_pieces(aln, blocks):
    one = {(r["block"], o): r for o in "yz" for r in A.aln_stats(aln, "x", o).collect()}
    got = {(r["block"], r["other"]): r for r in A.aln_stats_by_row(aln, "x", ["y", "z"]).collect()}
    assert set(got) == set(one) == {(b, o) for b in blocks for o in "yz"}
    for (b, o), r in got.items():
        pairs = [(s, t) for v, w in combinations(blocks[b].values(), 2) for s, t in zip(v.upper(), w.upper()) if "-" not in (s, t)]
        assert r["average"] == (pytest.approx(sum(s == t for s, t in pairs) / len(pairs)) if pairs else None)
        assert all(r[c] == (one[b, o][c] if one[b, o][c] is None else pytest.approx(one[b, o][c])) for c in ("length", "ungapped", "identity", "k80"))
    whole = {r["block"]: r["average"] for r in A.average_identity(aln).collect()}
    assert set(whole) == {*blocks, 8, 9} and whole[9] is None and whole[8] is None and all(r["average"] == whole[b] for (b, _), r in got.items())


def test_indels_across_pieces(spark, aln, blocks):
    at = spark.createDataFrame([(b, "c", 1000 * b + 1) for b in blocks], "block long, seqid string, start long")
    for least, most in ((1, 0.5), (2, 1.0), (1, 0.0)):
        want = []
        for b, rows in blocks.items():
            x, pos, run = rows["x"].upper() + "-", 0, []
            for i, c in enumerate(x, 1):
                pos += c != "-"
                if c != "-" and sum(rows[r][i - 1 : i] == "-" for r in "yz") >= least:
                    run.append((i, pos, c == "N"))
                    continue
                if 2 <= len(run) <= 400 and sum(r[2] for r in run) <= most * len(run):
                    want.append((b, run[0][0], run[-1][0], "c", 1000 * b + run[0][1], 1000 * b + run[-1][1], len(run)))
                run = []
        assert sorted(map(tuple, A.scan_indels(aln, at, "x", 2, 400, least, most).collect())) == sorted(want) != []


def test_alleles_are_counted_without_copies_of_rows(spark):
    from loomspan.operators import popgen

    rows = [("g", "Synonymous", "c", 1, p, a) for p, a in (("CI", "A"), ("CI", "A"), ("CP", "C"), ("XX", "A"), (None, "C"))]
    rows += [("g", "Non-Synonymous", "c", 2, p, a) for p, a in (("CI", "A"), ("CI", "C"), ("CP", "C"))] + [("g", "Synonymous", "c", 3, p, a) for p, a in (("XX", "A"), ("CI", "C"), ("CP", "G"), ("CP", None))]
    out = popgen.mk_counts(spark.createDataFrame(rows, "gene string, snptype string, chrom string, pos long, pop string, allele string"))
    assert [tuple(r) for r in out.collect()] == [("g", 1, 0, 0, 1, 1)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
