"""Operators on small tables with answers worked out by hand."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan import functions as X
from loomspan.operators import alignments, features, intervals, ontology, popgen, windows


def spans(spark, rows):
    return spark.createDataFrame([("c", a, b) for a, b in rows], "seqid string, start long, stop long")


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merge_across_tiles(spark):
    df = spans(spark, [(1, 5), (4, 9), (10, 12), (18, 43), (41, 60), (99, 99)])
    assert got(intervals.merge_intervals(df, tile=20), "start", "stop", "n") == [(1, 9, 2), (10, 12, 1), (18, 60, 2), (99, 99, 1)]
    assert got(intervals.merge_intervals(df, gap=1, tile=20), "start", "stop", "n") == [(1, 12, 3), (18, 60, 2), (99, 99, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_interval_properties(spark, seed):
    rng = random.Random(seed)
    rows = [(s, s + rng.randint(0, 70)) for s in (rng.randint(1, 900) for _ in range(60))]
    df, genome = spans(spark, rows), spark.createDataFrame([("c", 1000), ("d", 40)], "seqid string, length long")
    covered = {p for a, b in rows for p in range(a, b + 1) if p <= 1000}
    holes = got(intervals.complement(df, genome, tile=64).where("seqid = 'c'"), "start", "stop")
    assert {p for a, b in holes for p in range(a, b + 1)} == set(range(1, 1001)) - covered
    assert got(intervals.complement(df, genome).where("seqid = 'd'"), "start", "stop") == [(1, 40)]
    deep = {p: d for a, b, d in got(intervals.depth(df, tile=64), "start", "stop", "depth") for p in range(a, b + 1)}
    assert deep == {p: n for p in range(1, 1100) if (n := sum(a <= p <= b for a, b in rows))}
    other = spans(spark, [(s, s + rng.randint(0, 30)) for s in (rng.randint(1, 900) for _ in range(40))])
    pairs = got(intervals.overlap_join(df, other, bin_size=37), "start", "stop", "start_r", "stop_r")
    assert pairs == sorted((a, b, r.start, r.stop) for a, b in rows for r in other.collect() if a <= r.stop and r.start <= b)


def test_sequence_functions(spark):
    row = spark.range(1).select(
        X.revcomp(F.lit("AACGTN")).alias("rc"), X.translate_cds(F.lit("ATGTGACTGTAAG")).alias("p1"), X.translate_cds(F.lit("ATGTGACTGTAAG"), 4).alias("p4"), X.translate_cds(F.lit("CTG"), 12).alias("p12"),
        X.subseq(F.lit("ACCTG"), F.lit(4), F.lit(2)).alias("sub"), X.gff_escape(F.lit("a=b;c%\t")).alias("esc"), X.iupac(F.array(F.lit("G"), F.lit("A"))).alias("iu"),
        X.to_sanger(F.lit("hB")).alias("q"), X.two_digits(F.lit(0.00123)).alias("two"), X.strip_isoform(F.lit("AB_0012T3")).alias("iso"),
    ).first()
    assert tuple(row) == ("NACGTT", "M*L*", "MWL*", "S", "AGG", "a%3Db%3Bc%25%09", "R", "I#", "1.2e-03", "AB_0012")


def test_introns_and_roles(spark):
    e = spark.createDataFrame([("t", "c", "-", 1, 10), ("t", "c", "-", 21, 30), ("t", "c", "-", 41, 50), ("u", "c", "+", 5, 9)], "parent string, seqid string, strand string, start long, stop long")
    assert got(features.introns(e), "parent", "start", "stop", "number") == [("t", 11, 20, 2), ("t", 31, 40, 1)]
    assert got(features.exon_roles(e), "parent", "start", "role") == [("t", 1, "Eterm"), ("t", 21, "Exon"), ("t", 41, "Einit"), ("u", 5, "Esngl")]
    assert got(features.cds_frames(e.where("parent = 't'")), "start", "frame") == [(1, 1), (21, 2), (41, 0)]


def test_dedupe_overlaps_keeps_longest(spark):
    m = spark.createDataFrame([("g", "c", 1, 100), ("g", "c", 50, 200), ("g", "c", 190, 260), ("g", "c", 400, 470)], "gene string, seqid string, start long, stop long")
    assert got(features.dedupe_overlaps(m), "start", "stop", "copy") == [(50, 200, 1), (400, 470, 2)]


def test_sliding_windows(spark):
    p = spark.createDataFrame([("c", 2500, 2.0), ("c", 100, 0.0)], "seqid string, start long, v double")
    assert got(windows.sliding_windows(p, value="v", size=2000, step=1000), "bin", "total") == [(0, 2.0), (1, 2.0), (2, 2.0), (3, 2.0)]
    assert got(windows.sliding_windows(p, value="v", size=2000, step=1000, legacy_zero=True).where("bin = 0"), "total") == [(102.0,)]


def test_feature_bits_ratio(spark):
    genome = spark.createDataFrame([("c", 100_000)], "seqid string, length long")
    r = intervals.feature_bits(spans(spark, [(1, 10_000)]), spans(spark, [(3_576, 23_575)]), genome).first()
    assert r.cover_pc == pytest.approx(64.25) and r.enrich == pytest.approx(6425 / 20000 / 0.1)


def test_fisher(spark):
    p = popgen.fisher_exact(*(pd.Series([x]) for x in (1, 9, 11, 3))).iloc[0]
    assert p.two_sided == pytest.approx(0.002759456, abs=1e-8) and p.left == pytest.approx(0.0013797, abs=1e-6)


def test_slim_and_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "s1"), ("a", "s2"), ("s1", "root"), ("s2", "s1")], "child string, parent string")
    slim = spark.createDataFrame([("s1",), ("s2",)], "term string")
    assert got(ontology.map_to_slim(edges, slim).where("term = 'a'"), "slim") == [("s2",)]  # a slim parent stops all branches
    assert got(ontology.map_to_slim(edges, slim).where("term = 's2'"), "slim") == [("s2",)]
    assert got(ontology.ancestors(edges).where("term = 'a' AND ancestor = 'root'"), "distance") == [(3,)]


def test_hypergeometric_enrichment(spark):
    assoc = spark.createDataFrame([(f"g{i}", "t" if i < 4 else "u") for i in range(10)], "gene string, term string")
    edges = spark.createDataFrame([("t", "root"), ("u", "root")], "child string, parent string")
    r = ontology.go_enrichment(assoc.where("gene IN ('g0','g1','g2')").select("gene"), assoc, edges, p_max=1.0).where("term = 't'").first()
    assert r.p == pytest.approx(math.comb(4, 3) / math.comb(10, 3))


def test_alignment_positions(spark):
    aln = spark.createDataFrame([("b", "x", "A-CG"), ("b", "y", "AT-C")], "block string, row_id string, aln string")
    assert got(alignments.aln_coordinates(aln, "x", "y"), "col", "ref_pos", "other_pos", "other_base") == [(1, 1, 1, "A"), (3, 2, None, None), (4, 3, 3, "C")]
    cds = spark.createDataFrame([("p", "ATGAAACTG")], "id string, seq string")
    assert alignments.codon_alignment(spark.createDataFrame([("p", "M-KL")], "id string, aln string"), cds).first().aln == "ATG---AAACTG"


@pytest.mark.parametrize("ahead", [False, True])
def test_beside_across_tiles(spark, ahead):
    rng = random.Random(3)
    rows = [(k, p, rng.choice([None, p * 10])) for k in "ab" for p in rng.sample(range(1, 400), 60)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    out = {(r.k, r.p): r["__beside"] for r in intervals.beside(df, ["k"], ["p"], F.col("v"), F.floor(F.col("p") / 50), ahead).collect()}
    for k, p, _ in rows:
        side = [(q, v) for j, q, v in rows if j == k and v is not None and (q > p if ahead else q < p)]
        assert out[k, p] == ((min(side) if ahead else max(side))[1] if side else None)


def test_long_chains_of_terms_are_not_cut(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], "child string, parent string")
    assert ontology.ancestors(edges).where("term = 'n0'").count() == 13
    with pytest.raises(RuntimeError, match="over 5 steps"):
        ontology.ancestors(edges, most=5)


def test_enrichment_q(spark):
    assoc = spark.createDataFrame([(f"g{i}", f"t{k}") for k in range(2, 42) for i in range(300) if i * k % 41 < 4 + k % 5], "gene string, term string")
    edges = spark.createDataFrame([(f"t{k}", "root") for k in range(2, 42)], "child string, parent string")
    rows = ontology.go_enrichment(assoc.where("gene LIKE '%3'").select("gene"), assoc, edges, p_max=1.0).collect()
    p = [r.p for r in rows]
    q0 = {x: x * len(p) / (1 + sum(y < x for y in p)) for x in p}
    assert len(set(p)) > 5 and all(r.q == pytest.approx(min(1.0, *(q0[y] for y in p if y >= r.p))) for r in rows)


def test_scan_indels(spark):
    aln = spark.createDataFrame([("b", "x", "AC-GNNTTACG"), ("b", "y", "A---NN--A-G"), ("b", "z", "ACCG----A-G")], "block string, row_id string, aln string")
    blocks = spark.createDataFrame([("b", "chr", 101)], "block string, seqid string, start long")
    run = lambda **k: got(alignments.scan_indels(aln, blocks, "x", 2, 50, **k), "col_start", "col_stop", "start", "stop", "size")
    assert run(least_rows=2) == [(7, 8, 106, 107, 2)]
    assert run(least_rows=1) == [(4, 8, 103, 107, 5)]
    assert run(least_rows=1, most_n=0.3) == []


def test_predictions_and_gene_lists(spark):
    exons = spark.createDataFrame([("c", "exon", 1, 9, "-", "g.t1"), ("c", "CDS", 2, 9, "-", "g.t1"), ("c", "exon", 20, 29, "-", "g.t1"), ("c", "CDS", 20, 25, "-", "g.t1")], "seqid string, type string, start long, stop long, strand string, parent string")
    assert got(features.to_jgi(exons), "start", "type", "grp") == [(1, "exon", "gene_id g transcript_id g.t1 exon_number 3"), (2, "CDS", "gene_id g transcript_id g.t1 exon_number 2"), (20, "CDS", "gene_id g transcript_id g.t1 exon_number 1"), (20, "exon", "gene_id g transcript_id g.t1 exon_number 1")]
