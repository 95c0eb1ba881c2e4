"""Block maps that grow with the intervals and not with the genome, and results that no tie or rounding decides."""

import random
import re

import duckdb
import numpy as np
import pytest

from loomspan import catalog
from loomspan.functions import two_digits
from loomspan.operators import features, popgen, windows
from loomspan.sources import sinks
from tests.conftest import SF

FAR = 10**12  # a part number: its features lie 4 * 10**13 bases from the sequence's start


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """lineitem with two lines of one sequence that are far apart."""
    folder = tmp_path_factory.mktemp("far")
    line = f"SELECT * FROM '{SF}/lineitem.parquet' WHERE l_linenumber = 1 ORDER BY l_orderkey LIMIT 9"
    duckdb.sql(f"COPY (SELECT * REPLACE (7::BIGINT AS l_suppkey, CASE WHEN l_orderkey % 2 = 0 THEN {FAR} ELSE 3 END::BIGINT + row_number() OVER (ORDER BY l_orderkey) * 7 AS l_partkey) FROM ({line})) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name,every,part", [("project_to_blocks", 500, 400), ("values_by_region", 700, 300), ("partition_bins", 1500, 1000)])
def test_blocks_of_a_sparse_genome(spark, far, name, every, part):
    f = duckdb.sql(f"SELECT l_partkey * 40 + l_linenumber + 1 AS start FROM '{far}/lineitem.parquet'").df()["start"]
    at = f // 100 * 100 + 50 if name == "partition_bins" else f
    at = at.drop_duplicates() if name == "partition_bins" else at
    assert catalog.queries()[name](spark, far).count() == int(((at - 1) % every < part).sum())


def test_bins_are_not_shuffled(spark):
    g = table(spark, "seqid string, length long", [("a", 4 * 10**12), ("b", 2500), ("c", 0), ("d", None)])
    v = table(spark, "seqid string, pos long", [("a", 1), ("a", 5001), ("a", 5002), ("b", 2500), ("b", 2501), ("b", 9999), ("b", 0), ("x", 5)])
    out = windows.snps_per_bin(v, g)
    assert len(out.limit(5).collect()) == 5  # 4 * 10**9 bins: they are written out behind the join, as they are asked for
    small = windows.snps_per_bin(v, g.where("seqid = 'b'"))
    assert sorted(tuple(r) for r in small.collect()) == [("b", 0, 0), ("b", 1, 0), ("b", 2, 2)]


def test_bins_in_blocks(spark):
    g = table(spark, "seqid string, length long", [("a", 1000), ("b", 95), ("c", 1)])
    v = table(spark, "seqid string, pos long", [("a", p) for p in (1, 2, 10, 11, 40, 41, 300, 999, 1000, 1001)] + [("b", 95), ("b", 90)])
    for block in (1, 2, 3, 10, 1000):
        out = {(r[0], r[1]): r[2] for r in windows.snps_per_bin(v, g, 10, block).collect()}
        want = {("a", i): 0 for i in range(100)} | {("b", i): 0 for i in range(10)} | {("c", 0): 0}
        want |= {("a", 0): 3, ("a", 1): 1, ("a", 3): 1, ("a", 4): 1, ("a", 29): 1, ("a", 99): 2, ("b", 9): 1, ("b", 8): 1}
        assert out == want


def test_annotation_transfer_of_a_sparse_genome(spark, far):
    for name in ("annotation_transfer", "multiway_orthologs"):
        got = catalog.queries()[name](spark, far)
        assert got.count() >= 0 and "gene" in got.columns


def test_two_digits_in_the_middle_take_the_even_one(spark):
    values = [1.25e8, 6.25e7, 3.75, 0.0625, 1.25, 2.5e-4, 1.35, 1.45, 1e-320, 0.0, 9.95, 9.96, 123456.0]
    df = table(spark, "v double", [(x,) for x in [*values, None]])
    want = ["0e0" if x == 0 else "%.1e" % x for x in values] + [None]  # C's rule; duckdb's printf gives the same
    assert [r[0] for r in df.select(two_digits("v")).collect()] == want


def test_sql_of_islands_does_not_depend_on_the_order_of_equal_spans():
    """A window over equal rows twice may see them in two orders; the SQL merges distinct spans, with their number."""
    for name in ("feature_bits", "feature_bits_by_block", "mirna_candidates"):
        sql = catalog.oracle_sql()[name]
        for part in re.findall(r"\b[mk]0 AS \(SELECT .*? FROM (\(SELECT DISTINCT|\w+)", sql):
            assert part == "(SELECT DISTINCT" or re.search(rf"\b{part} AS \(SELECT [^)]*(\([^)]*\)[^)]*)*GROUP BY ALL\)", sql), (name, part)


def test_lone_promoters_need_no_rounds(spark, monkeypatch):
    seen = []
    rounds = features.greedy_disjoint
    monkeypatch.setattr(features, "greedy_disjoint", lambda df, *a, **k: seen.append(df.count()) or rounds(df, *a, **k))
    rows = [(f"g{i}", "c", "+", i * 10_000, i * 10_000 + 50) for i in range(1, 60)] + [("x", "c", "-", 9_000, 9_200), ("y", "c", "+", 50, 60)]
    genes = table(spark, "gene string, seqid string, strand string, start long, stop long", rows)
    out = features.promoter_windows(genes, table(spark, "seqid string, length long", [("c", 10**6)]), steps=4, size=200, bin_size=50)
    got = {(r["gene"], r["step"]): (r["start"], r["stop"]) for r in out.collect()}
    assert seen == [6]  # x and the first gene have two or more windows each between them, all others touch none
    assert got[("y", 1)] == (1, 49) and ("y", 2) not in got and got[("x", 1)] == (9201, 9400)
    assert sum(g not in ("x", "y", "g1") for g, _ in got) == 58 * 4


def test_rsq_rows_are_joined_site_by_site(spark, tmp_path):
    rows = [("c", p, s, "A", None if p % 3 == 0 else "ACGT"[(p + s) % 4]) for p in range(1, 4001) for s in range(3) if (p + s) % 5] + [("d", 7, None, "C", "-")]
    a = table(spark, "chrom string, pos long, sample int, ref string, allele string", rows)
    sinks.write_rsq(a, str(tmp_path / "rsq"))
    got = [tuple(r) for r in spark.read.text(str(tmp_path / "rsq")).select("chrom", "value").collect()]
    own = {(p, s): x or "N" for c, p, s, _, x in rows if c == "c"}
    want = ["3 4000", " ".join(map(str, range(1, 4001))), " ".join("A" * 4000)] + [" ".join([str(s)] + [own.get((p, s), "N") for p in range(1, 4001)]) for s in range(3)]
    assert [v for c, v in got if c == "c"] == want
    assert [v for c, v in got if c == "d"] == ["1 1", "7", "C", "N"]
    twice = a.where("chrom = 'd'").union(a.where("chrom = 'd'"))
    sinks.write_rsq(twice, str(tmp_path / "twice"))  # equal rows twice: one site of one sample
    assert [r[0] for r in spark.read.text(str(tmp_path / "twice")).select("value").collect()] == ["1 1", "7", "C", "N"]


def test_quartiles_are_exact_and_read_by_no_one_task(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([rng.random() * 9, float(rng.randint(0, 5)), None])) for _ in range(3001)] + [(None, 4.0), (None, 1.0), ("b", None), ("c", -2.5), ("d", 1.0), ("d", float("inf"))]
    df = table(spark, "g string, v double", rows)
    got = {r["g"]: r for r in popgen.summary_stats(df, "v", "g").collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["b"]["n"] == 0 and got["b"]["median"] is None
    assert (got[None]["q1"], got[None]["median"], got["c"]["q3"]) == (1.75, 2.5, -2.5)
    a = np.array([v for g, v in rows if g == "a" and v is not None])
    assert np.allclose([got["a"][c] for c in ("min", "q1", "median", "q3", "max")], np.quantile(a, [0, 0.25, 0.5, 0.75, 1]), rtol=0, atol=1e-12)
    plan = popgen.summary_stats(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan  # its state is all distinct values of a group
