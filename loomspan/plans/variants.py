"""Variant-effect and candidate queries (D49, D55, I8, I9, I13-I15) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import codon_table
from loomspan.operators import reads as R
from loomspan.operators import variants as V
from loomspan.plans.reads import rounded
from loomspan.plans.views import query
from loomspan.sources.scratch import kept

CODE = "map([" + ", ".join(f"'{c}'" for c in codon_table()) + "], [" + ", ".join(f"'{a}'" for a in codon_table().values()) + "])"


def _models(seqs):
    """Coding exons of 30 bases all along each sequence, from 11 on every 50 bases, on '-' for odd ids."""
    s = seqs.where("length(seq) >= 40")
    e = s.select(F.concat(F.lit("G"), F.col("id").cast("string")).alias("gene"), F.col("id").alias("seqid"), F.when(F.col("id") % 2 == 1, "-").otherwise("+").alias("strand"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("seq") - 40) / 50))).alias("k"))
    return e.select("gene", "seqid", "strand", (F.col("k") * 50 + 11).alias("start"), (F.col("k") * 50 + 40).alias("stop")), seqs.select(F.col("id").alias("seqid"), "seq")


#: bases of ref of the five kinds in turn: substitution, insertion, deletion of 13 after an anchor, two bases by two, four by two
WIDE = (1, 1, 14, 2, 4)


def _variants(seqs):
    """A variant every 17 bases from 5 on, of five kinds in turn; those with equal last bases are left out."""
    s = seqs.select(F.col("id").alias("seqid"), "seq", F.explode(F.sequence(F.lit(5).cast("long"), F.greatest(F.length("seq"), F.lit(5)).cast("long"), F.lit(17).cast("long"))).alias("pos")).where("pos <= length(seq)")
    i = ((F.col("pos") - 5) / 17).cast("int") % 5
    wide = F.element_at(F.array(*(F.lit(w) for w in WIDE)), i + 1)
    s = s.select("seqid", "pos", i.alias("i"), F.substr("seq", F.col("pos").cast("int"), wide).alias("ref"))
    turned = F.translate("ref", "ACGT", "CGTA")
    alt = F.when(F.col("i") == 1, F.concat("ref", F.lit("A"))).when(F.col("i") == 2, F.left("ref", F.lit(1))).when(F.col("i") == 4, F.left(turned, F.lit(2))).otherwise(turned)
    return s.withColumn("alt", alt).where("ref <> alt AND (i <> 4 OR right(ref, 1) <> right(alt, 1))").drop("i")


#: coding sequences; then, base by base, which coding base each base of ref is and what takes its place there
CDS = """m0 AS (SELECT id AS seqid, 'G' || id AS gene, id % 2 = 1 AS minus, seq, CASE WHEN length(seq) >= 40 THEN (length(seq) - 40) // 50 + 1 ELSE 0 END AS exons FROM seqs),
m1 AS (SELECT *, array_to_string(list_transform(range(0, exons), lambda k: substr(seq, k * 50 + 11, 30)), '') AS plus FROM m0), m AS (SELECT *, CASE WHEN minus THEN reverse(translate(plus, 'ACGT', 'TGCA')) ELSE plus END AS cds FROM m1)"""
EFFECTS = """v0 AS (SELECT *, (pos - 5) // 17 % 5 AS i FROM (SELECT *, unnest(range(5, length(seq) + 1, 17)) AS pos FROM m) x),
v1 AS (SELECT *, substr(seq, pos, [1, 1, 14, 2, 4][i + 1]) AS ref FROM v0), v2 AS (SELECT *, CASE i WHEN 1 THEN ref || 'A' WHEN 2 THEN ref[1] WHEN 4 THEN translate(ref, 'ACGT', 'CGTA')[1:2] ELSE translate(ref, 'ACGT', 'CGTA') END AS alt FROM v1),
v AS (SELECT * FROM v2 WHERE ref <> alt AND (i <> 4 OR right(ref, 1) <> right(alt, 1))),
b0 AS (SELECT seqid, pos, unnest(range(length(ref))) AS j, exons, minus, ref, alt, i FROM v),
b1 AS (SELECT *, pos + j AS g, least(length(ref), length(alt)) AS same FROM b0 WHERE i <> 2 OR j > 0),
b2 AS (SELECT *, (g - 11) // 50 AS k, g - 10 - (g - 11) // 50 * 50 AS off, CASE WHEN j < same THEN alt[j + 1] ELSE '' END || CASE WHEN j = same - 1 THEN substr(alt, same + 1) ELSE '' END AS put FROM b1),
b3 AS (SELECT *, CASE WHEN minus THEN 30 * exons - (30 * k + off) + 1 ELSE 30 * k + off END AS c FROM b2 WHERE g >= 11 AND off <= 30 AND k < exons),
e AS (SELECT seqid, pos, CAST(min(c) AS BIGINT) AS c1, CAST(max(c) AS BIGINT) AS c2, count(*) AS covered, CASE WHEN minus THEN reverse(translate(string_agg(put, '' ORDER BY g), 'ACGT', 'TGCA')) ELSE string_agg(put, '' ORDER BY g) END AS put FROM b3 GROUP BY seqid, pos, minus),
f0 AS (SELECT v.seqid, v.pos, v.ref, v.alt, v.i, gene, cds, pos + CASE WHEN i = 2 THEN 1 ELSE 0 END <= 50 * exons - 10 AND pos + length(ref) - 1 >= 11 AS within, c1, c2, covered, put, (c1 - 1) // 3 * 3 AS w0, (c2 + 2) // 3 * 3 AS w1 FROM v LEFT JOIN e USING (seqid, pos)),
f1 AS (SELECT *, (length(put) - (c2 - c1 + 1)) % 3 <> 0 AS shift, substr(cds, w0 + 1, w1 - w0) AS old, substr(cds, w0 + 1, c1 - 1 - w0) || put AS head FROM f0),
f2 AS (SELECT *, head || substr(cds, c2 + 1, CASE WHEN shift THEN length(cds) ELSE w1 - c2 END) AS new FROM f1)"""
PEPTIDE = f"array_to_string(list_transform(range(0, length({{0}}) // 3), lambda q: coalesce({CODE}[substr({{0}}, q * 3 + 1, 3)], 'X')), '')".format


@query("variant_effects", f"""WITH {CDS}, {EFFECTS}, f3 AS (SELECT *, {PEPTIDE("old")} AS old_aa, {PEPTIDE("new")} AS na FROM f2),
f4 AS (SELECT *, CASE WHEN shift AND strpos(na, '*') > 0 THEN substr(na, 1, strpos(na, '*')) ELSE na END AS new_aa FROM f3),
f5 AS (SELECT *, strpos(new_aa, '*') AS at_, strpos(new_aa, '*') > 0 AND (strpos(old_aa, '*') = 0 OR strpos(new_aa, '*') < strpos(old_aa, '*')) AS gain FROM f4)
SELECT seqid, CAST(pos AS BIGINT) AS pos, ref, alt, CASE WHEN within THEN gene END AS gene,
  CASE WHEN NOT within THEN 'intergenic' WHEN c1 IS NULL THEN 'intron' WHEN shift THEN 'frameshift' WHEN old_aa = new_aa THEN 'synonymous' WHEN gain THEN 'nonsense' WHEN length(old) = length(new) THEN 'missense' ELSE 'inframe_indel' END AS class,
  c1 AS cds_pos, CASE WHEN within THEN old END AS old, CASE WHEN within AND NOT shift THEN new END AS new, CASE WHEN within THEN old_aa END AS old_aa, CASE WHEN within THEN new_aa END AS new_aa,
  CASE WHEN c1 IS NOT NULL THEN covered < CASE i WHEN 2 THEN length(ref) - 1 ELSE length(ref) END END AS crosses, CAST(CASE WHEN (shift AND at_ > 0) OR gain THEN w0 // 3 + at_ END AS BIGINT) AS stop_at FROM f5""")
def variant_effects(v):
    seqs = kept(v.seqs.repartition("id"), "seqs")  # read three times; a file of documents may be one task
    models, genome = _models(seqs)
    return V.variant_effects(_variants(seqs), models, genome, 200, 1000)


@query("strain_cds", f"WITH {CDS}, s AS (SELECT seqid, gene, array_to_string(list_transform(range(1, length(cds) + 1), lambda i: CASE i % 90 WHEN 2 THEN 'A' WHEN 10 THEN 'C' ELSE substr(cds, i, 1) END), '') AS cds FROM m WHERE exons > 0) SELECT gene, 1 AS sample, cds, array_to_string(list_transform(range(1, length(cds) // 3 + 1), lambda i: coalesce({CODE}[substr(cds, CAST(i * 3 - 2 AS BIGINT), 3)], 'X')), '') AS pep FROM s")
def strain_cds(v):
    cds = V.coding_sequences(*_models(v.seqs), 1000)
    at = F.filter(F.sequence(F.lit(1), F.length("cds")), lambda i: (i % 90).isin(2, 10))
    snps = cds.select("gene", F.lit(1).alias("sample"), F.explode(at).alias("cds_pos")).withColumn("allele", F.when(F.col("cds_pos") % 90 == 2, "A").otherwise("C"))
    return V.strain_cds(cds, snps)


@query("mirna_candidates", """WITH w AS (SELECT DISTINCT seqid, w FROM (SELECT seqid, w, lib, sum(weight) AS n FROM (SELECT *, unnest(range((start - 1) // 1000, (stop - 1) // 1000 + 1)) AS w FROM reads) x GROUP BY ALL) y WHERE n > 3),
r AS (SELECT r.seqid, r.start, r.stop, count(*) AS c FROM reads r JOIN w ON r.seqid = w.seqid AND r.start <= (w + 1) * 1000 AND w * 1000 + 1 <= r.stop GROUP BY ALL), m0 AS (SELECT seqid, start, stop, c, CASE WHEN start > max(stop) OVER (PARTITION BY seqid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS k FROM r),
m1 AS (SELECT *, sum(k) OVER (PARTITION BY seqid ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m0), t AS (SELECT m1.seqid, min(start) AS a, max(stop) AS b, CAST(sum(c) AS BIGINT) AS n, any_value(length) AS length FROM m1 JOIN genome ON m1.seqid = genome.seqid GROUP BY m1.seqid, g)
SELECT seqid, a AS t_start, b AS t_stop, n, 'left' AS side, greatest(a - 160, 1) AS start, least(b + 20, length) AS stop FROM t UNION ALL SELECT seqid, a, b, n, 'right', greatest(a - 20, 1), least(b + 160, length) FROM t""")
def mirna_candidates(v):
    return V.mirna_candidates(R.window_counts(v.reads), v.reads, v.genome, 3, bin_size=1000)


@query("tir_windows", """WITH g AS (SELECT id, seq, substr(seq, 1, 35) AS head, reverse(translate(substr(seq, length(seq) - 34), 'ACGT', 'TGCA')) AS tail FROM seqs WHERE length(seq) >= 70)
SELECT id, head, tail, CAST(list_max(list_filter(range(0, 36), lambda k: substr(head, 1, k) = substr(tail, 1, k))) AS INT) AS tir, CAST(list_max(list_filter(range(0, 9), lambda k: k = 0 OR substr(seq, 10 - k + 1, k) = substr(seq, 11, k))) AS INT) AS tsd FROM g""")
def tir_windows(v):
    return V.tir_windows(v.seqs.select("id", "seq", F.substr("seq", F.lit(1), F.lit(10)).alias("left"), F.substr("seq", F.lit(11), F.lit(10)).alias("right")))


@query("polya_est_sites", "SELECT event_id AS est, CASE WHEN event_id % 3 = 0 THEN '5prime' ELSE '3prime' END AS side, seqid, CASE WHEN (event_id % 3 = 0) = (strand <> '-') THEN start ELSE stop END AS pos, strand FROM reads WHERE event_id % 3 < 2")
def polya_est_sites(v):
    t = v.reads.select(F.col("event_id").alias("est"), F.lit(100).alias("length"), F.when(F.col("event_id") % 3 == 0, 9).otherwise(1).alias("clip_start"), F.when(F.col("event_id") % 3 == 1, 90).otherwise(100).alias("clip_stop"))
    return V.polya_est_sites(t, v.reads.select(F.col("event_id").alias("est"), "seqid", "start", "stop", "strand"))


@query("gene_summary", """WITH o AS (SELECT seqid, coalesce(sum(length) OVER (ORDER BY seqid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM genome), g AS (SELECT parent AS gene, seqid, strand, min(start) AS start, max(stop) AS stop, CAST(sum(stop - start + 1) AS BIGINT) AS spliced, count(*) AS exons FROM features WHERE type = 'CDS' GROUP BY ALL)
SELECT gene, g.seqid, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS strand, start, stop, spliced, exons, CAST(o + start AS BIGINT) AS genome_start FROM g JOIN o ON g.seqid = o.seqid""")
def gene_summary(v):
    return V.gene_summary(v.features.where("type = 'CDS'").withColumnRenamed("parent", "gene"), v.genome)


@query("branch_means", """WITH t AS (SELECT o_orderkey % 10 AS a, o_orderkey % 7 AS b, o_orderkey % 3 = 0 AS other FROM orders),
u AS (SELECT unnest(CASE WHEN other THEN ['x', 'y', 'z', 'y|z'] ELSE ['x', 'y', 'x|y', 'z'] END) AS branch, unnest(CASE WHEN other THEN ['x|y|z', 'y|z', 'y|z', 'x|y|z'] ELSE ['x|y', 'x|y', 'x|y|z', 'x|y|z'] END) AS parent, unnest(CASE WHEN other THEN [a, b, 2.0, 0.25] ELSE [a, b, 0.5, 2.0] END)::DOUBLE AS length FROM t)
SELECT branch, parent, round(avg(length), 6) AS mean, count(*) AS n FROM u GROUP BY ALL""")
def branch_means(v):
    a, b = F.col("o_orderkey") % 10, F.col("o_orderkey") % 7
    o = v.table("orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.format_string("(x:%d,(z:2,y:%d)1:0.25);", a, b)).otherwise(F.format_string("((x:%d,y:%d)0.9:0.5,z:2);", a, b)).alias("newick"))
    return rounded(V.branch_means(o), "mean")
