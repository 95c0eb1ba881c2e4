"""Interval queries (C and the sweeps of D and E) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import intervals as I
from loomspan.plans.views import query

SMALL = 200  # bins near four times the views' usual interval
PAIRS = "FROM features l JOIN reads r ON l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop"
MERGED = """
m0 AS (SELECT seqid, start, stop, CASE WHEN start > max(stop) OVER (PARTITION BY seqid ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS n FROM {t}),
m1 AS (SELECT *, sum(n) OVER (PARTITION BY seqid ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m0),
{name} AS (SELECT seqid, min(start) AS start, max(stop) AS stop, count(*) AS n FROM m1 GROUP BY seqid, g)"""


@query("overlap_join", f"SELECT l.seqid, l.start, l.stop, l.parent, r.event_id, r.start AS start_r, r.stop AS stop_r {PAIRS}")
def overlap_join(v):
    return I.overlap_join(v.features.select("seqid", "start", "stop", "parent"), v.reads.select("seqid", "start", "stop", "event_id"), bin_size=SMALL).select("seqid", "start", "stop", "parent", F.col("event_id_r").alias("event_id"), "start_r", "stop_r")


@query("overlap_semi", "SELECT * FROM reads r WHERE EXISTS (SELECT 1 FROM features l WHERE l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop)")
def overlap_semi(v):
    return I.overlap_semi(v.reads, v.features, bin_size=SMALL)


@query("overlap_anti", "SELECT * FROM reads r WHERE NOT EXISTS (SELECT 1 FROM features l WHERE l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop)")
def overlap_anti(v):
    return I.overlap_anti(v.reads, v.features, bin_size=SMALL)


@query("overlap_report", """
WITH p AS (SELECT r.event_id AS id, l.parent FROM reads r LEFT JOIN features l ON l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop)
SELECT id, coalesce(parent, 'NO_MATCH') AS match, count(parent) OVER (PARTITION BY id) AS n_matches, count(parent) OVER (PARTITION BY id) = 1 AS single_match FROM p""")
def overlap_report(v):
    return I.overlap_report(v.reads, v.features, "event_id", "parent", bin_size=SMALL)


@query("self_overlaps", """
WITH g AS (SELECT seqid % 50 AS seqid, start, stop + 900 AS stop, strand, event_id AS id FROM reads)
SELECT l.seqid, l.id AS left_id, r.id AS right_id, greatest(l.start, r.start) AS start, least(l.stop, r.stop) AS stop, CASE WHEN l.strand = r.strand THEN 'same' ELSE 'opp' END AS strands
FROM g l JOIN g r ON l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop AND l.id < r.id""")
def self_overlaps(v):
    return I.self_overlaps(v.reads.withColumns({"seqid": F.col("seqid") % 50, "stop": F.col("stop") + 900}), "event_id")


@query("strand_relation", f"SELECT l.parent, CASE WHEN l.strand = r.strand THEN 'same' ELSE 'opp' END AS strands, count(*) AS n, CAST(sum(r.weight) AS BIGINT) AS reads {PAIRS} GROUP BY ALL")
def strand_relation(v):
    p = I.overlap_join(v.features.select("seqid", "start", "stop", "strand", "parent"), v.reads.select("seqid", "start", "stop", "strand", "weight"), bin_size=SMALL)
    return p.groupBy("parent", I.strand_relation().alias("strands")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight_r").alias("reads"))


@query("padded_overlap", "SELECT r.event_id, count(*) AS n FROM reads r JOIN features l ON l.seqid = r.seqid AND greatest(r.start - 1, 1) <= l.stop AND l.start <= r.stop + 100 GROUP BY ALL")
def padded_overlap(v):
    return I.overlap_join(I.pad(v.reads, 1, 100), v.features.select("seqid", "start", "stop"), bin_size=4 * SMALL).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("project_to_blocks", """
WITH b AS (SELECT seqid, CAST(x AS BIGINT) AS block, CAST(x * 500 + 1 AS BIGINT) AS start, CAST(x * 500 + 400 AS BIGINT) AS stop, length FROM genome, unnest(range(0, length // 500)) t(x))
SELECT b.block, l.seqid, l.parent, l.start - b.start + 1 AS start, least(l.stop, b.stop) - b.start + 1 AS stop
FROM features l JOIN b ON l.seqid = b.seqid AND l.start <= b.stop AND b.start <= l.stop AND l.start >= b.start""")
def project_to_blocks(v):
    blocks = I.touched_blocks(v.features, v.genome, 500, "block", stop="start").where("block BETWEEN 0 AND floor(length / 500) - 1")
    blocks = blocks.select("seqid", "block", (F.col("block") * 500 + 1).alias("start"), (F.col("block") * 500 + 400).alias("stop"))
    return I.project_to_blocks(v.features.select("seqid", "parent", "start", "stop"), blocks, bin_size=500)


@query("offset_pairs", """
SELECT a.parent, b.parent AS partner FROM features a JOIN features b ON a.seqid = b.seqid AND a.strand = '+' AND b.strand = '-' AND b.start = a.start + 3""")
def offset_pairs(v):
    return I.offset_pairs(v.features, 3).select("parent", F.col("parent_r").alias("partner"))


@query("normalize_interval", "SELECT seqid, least(start, stop - 20) AS start, greatest(start, stop - 20) AS stop, CASE WHEN start > stop - 20 THEN '-' ELSE strand END AS strand FROM features")
def normalize_interval(v):
    return I.normalize_interval(v.features.select("seqid", "start", (F.col("stop") - 20).alias("stop"), "strand"))


@query("flip_strand", "SELECT f.seqid, length - stop + 1 AS start, length - start + 1 AS stop FROM features f JOIN genome g ON f.seqid = g.seqid")
def flip_strand(v):
    return I.flip_strand(v.features.join(v.genome, "seqid"), "length").select("seqid", "start", "stop")


@query("merge_intervals", "WITH " + MERGED.format(t="features", gap=0, name="m") + " SELECT * FROM m")
def merge_intervals(v):
    return I.merge_intervals(v.features)


@query("collapse_runs", """
WITH d AS (SELECT DISTINCT seqid, start FROM features), k AS (SELECT *, start - row_number() OVER (PARTITION BY seqid ORDER BY start) AS g FROM d),
c AS (SELECT seqid, g, min(start) AS start, max(start) AS stop FROM k GROUP BY seqid, g)
SELECT c.seqid, c.start, c.stop, count(*) AS n FROM c JOIN features f ON f.seqid = c.seqid AND f.start BETWEEN c.start AND c.stop GROUP BY ALL""")
def collapse_runs(v):
    return I.collapse_runs(v.features.select("seqid", F.col("start").alias("value")))


COMPLEMENT = "WITH " + MERGED.format(t="features", gap=1, name="m") + """,
a AS (SELECT seqid, start, stop FROM m UNION ALL SELECT seqid, length + 1, length + 1 FROM genome),
h AS (SELECT seqid, coalesce(lag(stop) OVER (PARTITION BY seqid ORDER BY start), 0) + 1 AS start, start - 1 AS stop FROM a)
SELECT h.seqid, h.start, h.stop FROM h {more} WHERE h.start <= h.stop"""


@query("complement", COMPLEMENT.format(more=""))
def complement(v):
    return I.complement(v.features, v.genome)


@query("intergenic", COMPLEMENT.format(more="JOIN (SELECT seqid, min(start) AS first FROM features GROUP BY seqid) x ON x.seqid = h.seqid AND h.start > x.first"))
def intergenic(v):
    return I.intergenic(v.features, v.genome)


DEPTH = """
WITH s AS (SELECT seqid, start AS pos, weight AS d FROM reads UNION ALL SELECT seqid, stop + 1, -weight FROM reads),
t AS (SELECT seqid, pos, sum(d) AS d FROM s GROUP BY ALL HAVING sum(d) <> 0),
w AS (SELECT seqid, pos AS start, lead(pos) OVER (PARTITION BY seqid ORDER BY pos) - 1 AS stop, CAST(sum(d) OVER (PARTITION BY seqid ORDER BY pos) AS BIGINT) AS depth FROM t)"""


@query("depth", DEPTH + " SELECT * FROM w WHERE depth > 0")
def depth(v):
    return I.depth(v.reads, weight="weight")


@query("bases_by_type", """
WITH m0 AS (SELECT seqid, type, start, stop, CASE WHEN start > max(stop) OVER (PARTITION BY seqid, type ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM features),
m1 AS (SELECT *, sum(n) OVER (PARTITION BY seqid, type ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS g FROM m0),
m AS (SELECT type, min(start) AS start, max(stop) AS stop FROM m1 GROUP BY seqid, type, g)
SELECT type, CAST(sum(stop - start + 1) AS BIGINT) AS bases, round(100.0 * sum(stop - start + 1) / (SELECT sum(length) FROM genome), 6) AS percent FROM m GROUP BY type""")
def bases_by_type(v):
    return I.bases_by_type(v.features, "type", v.genome).withColumn("percent", F.round("percent", 6))


#: of distinct spans: equal ones may come in one order in the first window and in another one in the second
SPANS = "(SELECT DISTINCT seqid, start, stop FROM {0}) {0}"
BITS = "WITH " + MERGED.format(t=SPANS.format("features"), gap=1, name="a") + "," + MERGED.format(t=SPANS.format("reads"), gap=1, name="b").replace("m0", "k0").replace("m1", "k1") + """,
x AS (SELECT a.seqid, least(a.stop, b.stop) - greatest(a.start, b.start) + 1 AS n FROM a JOIN b ON a.seqid = b.seqid AND a.start <= b.stop AND b.start <= a.stop),
u AS (SELECT seqid, stop - start + 1 AS one, 0 AS two, 0 AS both_, 0 AS len FROM a UNION ALL SELECT seqid, 0, stop - start + 1, 0, 0 FROM b UNION ALL SELECT seqid, 0, 0, n, 0 FROM x UNION ALL SELECT seqid, 0, 0, 0, length FROM genome),
s AS (SELECT {by} sum(one)::DOUBLE AS one, sum(two)::DOUBLE AS two, sum(both_)::DOUBLE AS both_, sum(len)::DOUBLE AS len FROM u {group})
SELECT {by} round(100 * one / nullif(len, 0), 6) AS one_pc, round(100 * two / nullif(len, 0), 6) AS two_pc, round(100 * both_ / nullif(len, 0), 6) AS both_pc,
  round(100 * (both_ / nullif(one, 0)), 6) AS cover_pc, round((both_ / nullif(two, 0)) / nullif(one / nullif(len, 0), 0), 6) AS enrich FROM s"""


@query("feature_bits", BITS.format(by="", group=""))
def feature_bits(v):
    out = I.feature_bits(v.features, v.reads, v.genome)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("feature_bits_by_block", BITS.format(by="seqid,", group="GROUP BY seqid"))
def feature_bits_by_block(v):
    out = I.feature_bits(v.features, v.reads, v.genome, by="seqid")
    return out.select("seqid", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("map_domains_to_genome", """
WITH c AS (SELECT DISTINCT parent AS gene, seqid, start, stop, strand FROM features WHERE type = 'CDS'),
o AS (SELECT *, sum(stop - start + 1) OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END, seqid, stop, strand ROWS UNBOUNDED PRECEDING) AS ct FROM c),
p AS (SELECT *, ct - (stop - start + 1) + 1 AS cf FROM o),
q AS (SELECT gene, seqid, strand, start, stop, greatest(10, cf) - cf AS a, least(42, ct) - cf AS b FROM p WHERE 10 <= ct AND cf <= 42)
SELECT gene, 'd1' AS domain, seqid, CASE WHEN strand <> '-' THEN start + a ELSE stop - b END AS start, CASE WHEN strand <> '-' THEN start + b ELSE stop - a END AS stop, strand FROM q""")
def map_domains_to_genome(v):
    cds = v.features.where("type = 'CDS'").select(F.col("parent").alias("gene"), "seqid", "start", "stop", "strand").distinct()
    hits = cds.select("gene").distinct().select("gene", F.lit("d1").alias("domain"), F.lit(4).cast("long").alias("ali_from"), F.lit(14).cast("long").alias("ali_to"))
    return I.map_domains_to_genome(hits, cds)
