"""Genes in several genomes by maps of their own, and what is read off one shuffle, against plain Python."""

import random

import pytest

from loomspan.operators import comparative, features, intervals, windows
from tests.test_graphs_spans_rounds import est_twin, table
from tests.test_operators import got

GENE = "gene string, seqid string, start long, stop long, strand string"


def test_multiway_orthologs_have_every_gene_and_where_its_partners_lie(spark):
    """Genes without partners were left out, and so were the partners' places, strands, statuses and the flag of all genomes."""
    genes = table(spark, GENE, [("one", "c", 10, 20, "+"), ("two", "c", 110, 190, "-"), ("bare", "c", 300, 310, "+"), ("off", "d", 1, 9, None)])
    row = "genome string, block string, a_seqid string, a_start long, a_stop long, b_seqid string, b_start long, b_stop long, b_strand string"
    blocks = [("x", "1", "c", 1, 100, "k", 1001, 1100, "+"), ("x", "2", "c", 101, 150, "k", 2001, 2050, "-"), ("x", "3", "c", 151, 400, "m", 1, 250, "+"), ("y", "1", "c", 1, 120, "n", 1, 120, "-")]
    x = [("x1", "k", 1015, 1100, "-"), ("x2", "k", 900, 1009, "+"), ("x3", "k", 1990, 2001, "+"), ("x4", "m", 35, 60, "-"), ("x5", "n", 1, 500, "+")]
    y = [("y2", "n", 90, 101, "+"), ("y1", "n", 111, 130, "-"), ("y3", "n", 5, 9, "-"), ("y4", "k", 1, 5000, "-")]
    out = comparative.multiway_orthologs(genes, table(spark, row, blocks), {"x": table(spark, GENE, x), "y": table(spark, GENE, y)}, 100)
    names = ["names", "seqid", "start", "stop", "strands", "single", "status"]
    assert out.columns == ["gene", "seqid", "start", "stop", "strand", *(f"{g}_{c}" for g in "xy" for c in names), "single"]
    lone, none = (None,) * 5 + (False, "NO_GENES_IN_INTERVAL"), (None,) * 5 + (False, "NO_SYNTENIC_ALIGNMENT")
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == {
        "one": ("c", 10, 20, "+", "x1", "k", 1015, 1100, "-", True, None, "y1,y2", "n", 90, 130, "-,+", False, None, False),
        "two": ("c", 110, 190, "-", "x3,x4", "k,m", 35, 2001, "+,-", False, None, "y3", "n", 5, 9, "-", True, None, False),
        "bare": ("c", 300, 310, "+", *lone, *none, True),
        "off": ("d", 1, 9, None, *none, *none, True),
    }
    assert got(comparative.annotation_transfer(genes, table(spark, row, blocks[:3]), table(spark, GENE, x), 100), "gene", "match") == [
        ("bare", "NO_GENES_IN_INTERVAL"), ("off", "NO_SYNTENIC_ALIGNMENT"), ("one", "x1"), ("two", "x3"), ("two", "x4"),
    ]


@pytest.mark.parametrize("tile", [40, 500, 100_000])
def test_est_chains_in_tiles_equal_the_loop(spark, tile):
    """Every exon was shuffled for its distinct rows, twice for its island, for its walk and for its transcript."""
    rng = random.Random(tile)
    rows = []
    for i in range(400):
        hs, qs = rng.randint(-200, 9000), rng.randint(1, 300)
        rows.append((rng.choice("+-"), qs, qs + rng.randint(10, 60), hs, hs + rng.choice([0, 1, rng.randint(5, 60), rng.choice([20, 90, 700])])))
    rows += [("+", 1, 50, 20_000, 20_049), ("+", 51, 90, 20_048, 20_090), ("+", 91, 99, 20_080, 20_095), ("-", 1, 50, 21_500, 21_550), ("-", 51, 60, 21_400, 21_501)]
    rows = list(set(rows))
    cols = "query string, seqid string, strand string, qstart long, qstop long, start long, stop long, qlen int"
    df = table(spark, cols, [("q", "c", *r, 400) for r in rows] + [(None, "c", *rows[0], 400), ("q", "c", "+", 1, 2, None, 9, 400)])
    want = est_twin(sorted(rows, key=lambda r: (r[4], r[1], r[2])), 50)
    out = features.chain_est(df.repartition(3), max_intron=50, min_cov=-1000, tile=tile)
    assert got(out, "strand", "start", "stop", "exons", "qstart", "qstop") == want
    twice = features.chain_est(df.union(df).repartition(3), max_intron=50, min_cov=-1000, distinct=True, tile=tile)
    assert got(twice, "strand", "start", "stop", "exons", "qstart", "qstop") == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = features.chain_est(df, max_intron=50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Scan ExistingRDD") == 1  # all steps read one shuffle of the exons


def test_est_transcripts_keep_lengths_apart_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(q, 7, s, 100 + i, 110 + i, at, at + 10, n) for q in "ab" for s in "+-" for i in range(9) for at in [1000 + 20 * (i if s == "+" else 9 - i)] for n in (100, 200)]
    df = table(spark, "query string, seqid int, strand string, qstart int, qstop int, start int, stop int, qlen int", [r for r in rows if (r[5] // 20) % 2 == r[7] // 100 % 2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = got(features.chain_est(df, 50), "query", "seqid", "strand", "exons", "qlen", "coverage")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert out == sorted((q, 7, s, n, l, c) for q in "ab" for s in "+-" for n, l, c in {"+": [(5, 200, 9), (4, 100, 16)], "-": [(5, 100, 18), (4, 200, 8)]}[s])


def test_bins_of_many_sequences_come_block_by_block(spark):
    """Rows came sequence by sequence, so that a written file had too many different bins for a dictionary."""
    g = table(spark, "seqid string, length long", [(f"s{i:02}", 100 + 37 * i) for i in range(40)])
    v = table(spark, "seqid string, pos long", [(f"s{i % 50:02}", 1 + i * 7 % 500) for i in range(600)])
    out = [tuple(r) for r in windows.snps_per_bin(v, g, 10, 8).collect()]
    assert out == sorted(out, key=lambda r: (r[1] // 8, r[0], r[1]))
    want = {(f"s{i:02}", b): 0 for i in range(40) for b in range((99 + 37 * i) // 10 + 1)}
    for i in range(600):
        at = f"s{i % 50:02}", i * 7 % 500 // 10
        if at in want:
            want[at] += 1
    assert {r[:2]: r[2] for r in out} == want and len(out) == len(want)


def test_pairs_of_a_block_of_later_rows_come_together(spark, monkeypatch):
    """Pairs came by their earlier row, through all blocks of its bin, so that a written file repeated nothing close by."""
    monkeypatch.setattr(intervals, "BLOCK", 4)
    rows = [("c", 1 + 5 * i, 900 + 5 * i, "+", (i * 7) % 20) for i in range(20)]
    out = [tuple(r) for r in intervals.self_overlaps(table(spark, "seqid string, start long, stop long, strand string, id long", rows)).collect()]
    ids = {r[1]: r[4] for r in rows}
    assert sorted(out) == sorted(("c", min(a[4], b[4]), max(a[4], b[4]), b[1], a[2], "same") for a in rows for b in rows if a[1] < b[1])
    places = [((r[3] - 1) // 20, ({r[1], r[2]} - {ids[r[3]]}).pop()) for r in out]  # the later row's block, and the earlier row
    place = {r[4]: i // 4 for i, r in enumerate(rows)}
    blocks = [(place[l], b) for b, l in places]
    runs = [x for i, x in enumerate(blocks) if i == 0 or blocks[i - 1] != x]
    assert len(runs) == len(set(runs)) == 5 * 6 // 2  # each pair of blocks is written out at once
