"""Alignment queries (B22, C17, D41-D48, E17, H6, I6) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import translate_cds
from loomspan.operators import alignments as A
from loomspan.plans.reads import rounded
from loomspan.plans.views import query

CELLS = "c AS (SELECT block, row_id, CAST(unnest(range(1, length(aln) + 1)) AS INT) AS col, unnest(string_split(aln, '')) AS base FROM aln)"
SIDE = CELLS + """, s AS (SELECT a.block, a.col, a.base AS r, b.base AS o, sum(CASE WHEN a.base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY a.block ORDER BY a.col) AS rp, sum(CASE WHEN b.base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY a.block ORDER BY a.col) AS op
FROM c a JOIN c b ON a.block = b.block AND a.col = b.col AND a.row_id = '{0}' AND b.row_id = '{1}')"""


def _blocks(v):
    return v.aln.select("block").distinct().select("block", (F.col("block") % 7).alias("seqid"), (F.col("block") * 100 + 1).alias("start"))


@query("aln_coordinates", "WITH " + SIDE.format("r2", "r0") + " SELECT block, col, rp::BIGINT AS ref_pos, r AS ref_base, CASE WHEN o <> '-' THEN op::BIGINT END AS other_pos, CASE WHEN o <> '-' THEN o END AS other_base FROM s WHERE r <> '-'")
def aln_coordinates(v):
    return A.aln_coordinates(v.aln, "r2", "r0")


@query("complete_alignments", "SELECT * FROM aln WHERE block IN (SELECT block FROM aln GROUP BY 1 HAVING min(length(replace(aln, '-', ''))::DOUBLE / length(aln)) >= 0.7)")
def complete_alignments(v):
    return A.complete_alignments(v.aln, 0.7)


@query("aln_column_classes", "WITH " + CELLS + " SELECT block, col, CASE WHEN count(DISTINCT base) = 1 THEN 'invariant' WHEN count(DISTINCT base) FILTER (row_id <> 'r1') = 1 THEN 'target_unique' ELSE 'mixed' END AS class FROM c GROUP BY ALL")
def aln_column_classes(v):
    return A.aln_column_classes(v.aln, "r1")


@query("mutation_counts", "WITH " + CELLS + """, t AS (SELECT x.base AS a, y.base AS b, z.base AS o FROM c x JOIN c y ON x.block = y.block AND x.col = y.col JOIN c z ON x.block = z.block AND x.col = z.col WHERE x.row_id = 'r0' AND y.row_id = 'r1' AND z.row_id = 'r2' AND x.base <> '-' AND y.base <> '-' AND z.base <> '-'),
k AS (SELECT a, b, o, CASE WHEN a = b AND b = o THEN 'IDENTICAL' WHEN b = o THEN 'r0' WHEN a = o THEN 'r1' WHEN a = b THEN 'r2' ELSE 'ALL_DIFFERENT' END AS class FROM t), m AS (SELECT class, CASE class WHEN 'r0' THEN o WHEN 'r1' THEN o WHEN 'r2' THEN a END AS anc, CASE class WHEN 'r0' THEN a WHEN 'r1' THEN b WHEN 'r2' THEN o END AS obs FROM k)
SELECT class, anc, obs, count(*) AS n FROM m WHERE anc IS NOT NULL GROUP BY ALL UNION ALL SELECT class, NULL, NULL, count(*) FROM m GROUP BY class""")
def mutation_counts(v):
    return A.mutation_counts(v.aln, "r0", "r1", "r2")


@query("aln_snps", "WITH " + SIDE.format("r0", "r2") + " SELECT block % 7 AS seqid, block * 100 + rp::BIGINT AS pos, r AS ref_base, o AS other_base FROM s WHERE r <> '-' AND o <> '-' AND r <> o")
def aln_snps(v):
    return A.aln_snps(v.aln, _blocks(v), "r0", "r2")


@query("site_scores", "WITH " + CELLS + """ SELECT a.block, CAST(a.col AS BIGINT) AS ref_pos, round(sum(CASE WHEN b.base = a.base THEN w ELSE 0 END) / sum(w), 9) AS identity, round(sum(CASE WHEN b.base = '-' THEN w ELSE 0 END) / sum(w), 9) AS gap
FROM c a JOIN (SELECT *, CASE row_id WHEN 'r1' THEN 0.7::DOUBLE ELSE 0.3 END AS w FROM c WHERE row_id IN ('r1', 'r2')) b ON a.block = b.block AND a.col = b.col WHERE a.row_id = 'r0' AND a.base <> '-' GROUP BY a.block, a.col""")
def site_scores(v):
    return rounded(A.site_scores(v.aln, "r0", {"r1": 0.7, "r2": 0.3}), "identity", "gap", digits=9)


@query("window_identity", "WITH " + SIDE.format("r2", "r0") + """, g AS (SELECT block, block % 7 AS seqid, CAST(floor((block * 100 + 1 + greatest(rp, 1) - 2) / 10.0) AS BIGINT) AS w, floor(100 * avg(CASE WHEN r = o AND r <> '-' THEN 1.0::DOUBLE ELSE 0 END)) AS pc FROM s GROUP BY ALL) SELECT seqid, w AS "window", max(pc)::BIGINT AS identity FROM g GROUP BY ALL""")
def window_identity(v):
    return A.window_identity(v.aln, _blocks(v), "r2", "r0")


@query("aln_stats", "WITH " + SIDE.format("r0", "r2") + """, g AS (SELECT block, count(*) AS length, count(*) FILTER (r <> '-') AS ungapped, count(*) FILTER (r <> '-' AND o <> '-')::DOUBLE AS n, count(*) FILTER (r = o AND r <> '-')::DOUBLE AS same, count(*) FILTER (r || o IN ('AG', 'GA', 'CT', 'TC'))::DOUBLE AS ts FROM s GROUP BY 1),
h AS (SELECT *, 1 - 2 * ts / n - (n - same - ts) / n AS x, 1 - 2 * (n - same - ts) / n AS y FROM g WHERE n > 0) SELECT g.block, g.length, g.ungapped, round(g.same / nullif(g.n, 0), 9) AS identity, CASE WHEN x > 1e-12 AND y > 1e-12 THEN round(-0.5 * ln(x) - 0.25 * ln(y), 6) + 0.0 END AS k80 FROM g LEFT JOIN h ON g.block = h.block""")
def aln_stats(v):
    s = A.aln_stats(v.aln, "r0", "r2")
    return s.withColumns({"identity": F.round("identity", 9), "k80": F.when(F.col("k80") < 12, F.round("k80", 6))})


RATES = CELLS + """, r AS (SELECT block, col, sum(ascii(base) * pow(2.0, -col % 5)) / any_value(states) AS rate, any_value(states) AS states FROM c JOIN (SELECT block, max(ascii(base)) AS states FROM c GROUP BY block) m USING (block) GROUP BY ALL), s AS (SELECT *, rate / max(rate) OVER (PARTITION BY block) AS scaled FROM r)"""


def _rates(v):
    return A.column_rates(v.aln, F.ascii, lambda base, col: -col % 5)


@query("column_rates", "WITH " + RATES + " SELECT block, col, round(rate, 6) AS rate, round(scaled, 9) AS scaled FROM s")
def column_rates(v):
    return _rates(v).select("block", "col", F.round("rate", 6).alias("rate"), F.round("scaled", 9).alias("scaled"))


@query("rate_scores", "WITH " + RATES + """ SELECT block, round(sum(scaled), 3) AS s0, round(sum(1 - scaled), 3) AS s1, round(sum(scaled - 1.0::DOUBLE / states), 3) AS s2, round(sum((scaled - 1.0::DOUBLE / states) * (states::DOUBLE / (states - 1))), 3) AS s3, round(sum(1 - (scaled - 1.0::DOUBLE / states) * (states::DOUBLE / (states - 1))), 3) AS s4 FROM s GROUP BY block""")
def rate_scores(v):
    """The five scores of each column, summed over the block. Sums in the middle of two thirds digits go up, whatever the order
    of their terms was: what that leaves in the last places is rounded off first."""
    return _rates(v).groupBy("block").agg(*(F.round(F.round(F.sum(A.rate_score(k)), 9), 3).alias(f"s{k}") for k in range(5)))


@query("aln_stats_by_row", "WITH " + SIDE.format("r0", "r2") + ", g AS (SELECT block, count(*) FILTER (r <> '-' AND o <> '-')::DOUBLE AS n, count(*) FILTER (r = o AND r <> '-')::DOUBLE AS same FROM s GROUP BY 1), " + SIDE.format("r0", "r1").removeprefix(CELLS + ", ").replace("s AS (", "s2 AS (", 1) + """, g2 AS (SELECT block, count(*) FILTER (r <> '-' AND o <> '-')::DOUBLE AS n, count(*) FILTER (r = o AND r <> '-')::DOUBLE AS same FROM s2 GROUP BY 1),
u AS (SELECT block, 'r2' AS other, n, same FROM g UNION ALL SELECT block, 'r1', n, same FROM g2), p AS (SELECT block, 100.0::DOUBLE * sum(CASE WHEN a.base = b.base THEN 1 ELSE 0 END) / nullif(count(*), 0) AS average FROM c a JOIN c b USING (block, col) WHERE a.row_id < b.row_id AND a.base <> '-' AND b.base <> '-' GROUP BY block)
SELECT u.block, other, round(same / nullif(n, 0), 9) AS identity, round(average / 100, 9) AS average FROM u LEFT JOIN p ON u.block = p.block""")
def aln_stats_by_row(v):
    return A.aln_stats_by_row(v.aln, "r0", ["r1", "r2"]).select("block", "other", F.round("identity", 9).alias("identity"), F.round("average", 9).alias("average"))


@query("concat_alignments", """WITH b AS (SELECT block, max(length(aln)) AS n FROM aln GROUP BY 1), s AS (SELECT *, 1 + coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM b)
SELECT t.row_id, s.block, CAST(start AS BIGINT) AS start, rpad(coalesce(aln, ''), CAST(n AS INT), '-') AS aln FROM s CROSS JOIN (VALUES ('r0'), ('r1'), ('r9')) t(row_id) LEFT JOIN aln ON aln.block = s.block AND aln.row_id = t.row_id""")
def concat_alignments(v):
    return A.concat_alignments(v.aln, ["r0", "r1", "r9"])


@query("gap_runs", "WITH " + CELLS + """, g AS (SELECT block, col, col - row_number() OVER (PARTITION BY block ORDER BY col) AS isle FROM (SELECT DISTINCT a.block, a.col FROM c a JOIN c b ON a.block = b.block AND a.col = b.col AND a.row_id = 'r0' AND b.row_id <> 'r0' WHERE b.base = '-' AND a.base <> '-') x)
SELECT block, min(col) AS start, max(col) AS stop FROM g GROUP BY block, isle HAVING max(col) - min(col) + 1 BETWEEN 2 AND 50""")
def gap_runs(v):
    return A.gap_runs(v.aln, "r0", 2, 50)


@query("scan_indels", "WITH " + CELLS + """, p AS (SELECT block, col, base, sum(CASE WHEN base <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY block ORDER BY col) AS rp FROM c WHERE row_id = 'r0'),
g AS (SELECT p.block, p.col, p.base, rp, p.col - row_number() OVER (PARTITION BY p.block ORDER BY p.col) AS isle FROM p WHERE base <> '-' AND EXISTS (SELECT 1 FROM c WHERE c.block = p.block AND c.col = p.col AND c.row_id <> 'r0' AND c.base = '-')),
r AS (SELECT block, min(col) AS col_start, max(col) AS col_stop, min(rp)::BIGINT AS a, max(rp)::BIGINT AS b, count(*) AS size, count(*) FILTER (base IN ('C', 'A')) AS n FROM g GROUP BY block, isle)
SELECT block, col_start, col_stop, block % 7 AS seqid, block * 100 + a AS start, block * 100 + b AS stop, size FROM r WHERE size BETWEEN 2 AND 500 AND n <= 0.5 * size""")
def scan_indels(v):
    masked = F.when(F.col("row_id") == "r0", F.translate("aln", "AC", "NN")).otherwise(F.col("aln"))
    return A.scan_indels(v.aln.withColumn("aln", masked), _blocks(v), "r0", 2, 500, least_rows=1)


@query("codon_alignment", r"""SELECT id, regexp_replace(substr(seq, 1, length(seq) // 3 * 3), '(.{6})', '\1---', 'g') AS aln FROM seqs WHERE length(seq) >= 3""")
def codon_alignment(v):
    s = v.seqs.where("length(seq) >= 3")
    return A.codon_alignment(s.select("id", F.regexp_replace(translate_cds("seq"), "(.{2})", "$1-").alias("aln")), s)


@query("ancestral_allele", "WITH " + SIDE.format("r0", "r2") + ", a AS (SELECT block % 7 AS seqid, block * 100 + rp::BIGINT AS pos, min(CASE WHEN o <> '-' THEN o END) AS b FROM s WHERE r <> '-' GROUP BY ALL), p AS (SELECT DISTINCT block % 7 AS seqid, block * 100 + 5 AS pos FROM aln UNION SELECT 99, 1) SELECT p.seqid, p.pos, coalesce(b, '-') AS ancestral FROM p LEFT JOIN a ON p.seqid = a.seqid AND p.pos = a.pos")
def ancestral_allele(v):
    p = v.aln.select((F.col("block") % 7).alias("seqid"), (F.col("block") * 100 + 5).alias("pos")).distinct()
    p = p.union(v.table("region").where("r_regionkey = 0").select(F.lit(99).cast("long"), F.lit(1).cast("long")))
    return A.ancestral_allele(p, v.aln, _blocks(v), "r0", "r2")
