"""Read-counting queries (B, C19-C24, D1-D9, D50, D51) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import reads as R
from loomspan.operators.intervals import self_overlaps
from loomspan.plans.views import query

SMALL = 200
ON = "l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop"
LONG = "CAST({} AS BIGINT)"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("mapped_totals", "SELECT lib, CAST(sum(weight) AS BIGINT) AS total FROM reads GROUP BY lib")
def mapped_totals(v):
    return R.mapped_totals(v.reads)


CELLS = ", ".join(f"CAST(sum(CASE WHEN base{e} = '{b}' THEN weight ELSE 0 END) AS BIGINT) AS base{e}_{b}" for e in "53" for b in "ACGT")


@query("feature_read_profile", f"SELECT l.parent, r.stop - r.start + 1 AS length, CASE WHEN l.strand = r.strand THEN 'same' ELSE 'opp' END AS strands, CAST(sum(weight) AS BIGINT) AS reads, {CELLS} FROM features l JOIN reads r ON {ON} WHERE r.stop - r.start + 1 BETWEEN 17 AND 30 GROUP BY ALL")
def feature_read_profile(v):
    return R.feature_read_profile(v.features, v.reads, bin_size=SMALL)


COUNTS = f"""n AS (SELECT l.parent, r.lib, sum(CASE WHEN l.strand = r.strand THEN weight ELSE 0 END) AS same, sum(CASE WHEN l.strand <> r.strand THEN weight ELSE 0 END) AS opp, sum(weight) AS total FROM features l JOIN reads r ON {ON} GROUP BY ALL),
m AS (SELECT lib, sum(weight) / 1e6 AS mapped FROM reads GROUP BY lib)"""


@query("feature_counts", f"""WITH {COUNTS} SELECT parent, n.lib, CAST(same AS BIGINT) AS same, CAST(opp AS BIGINT) AS opp, CAST(total AS BIGINT) AS total,
  round(same / mapped, 6) AS same_pm, round(opp / mapped, 6) AS opp_pm, round(total / mapped, 6) AS total_pm FROM n JOIN m ON n.lib = m.lib""")
def feature_counts(v):
    return rounded(R.feature_counts(v.features, v.reads, bin_size=SMALL), "same_pm", "opp_pm", "total_pm")


@query("pivot_libraries", f"""WITH {COUNTS} SELECT parent, {', '.join(f"CAST(coalesce(sum(total) FILTER (lib = 'L{i}'), 0) AS BIGINT) AS L{i}" for i in range(3))} FROM n GROUP BY parent""")
def pivot_libraries(v):
    return R.pivot_libraries(R.feature_counts(v.features, v.reads, bin_size=SMALL), "parent", ["L0", "L1", "L2"])


def _matrix(end, by, where="1 = 1"):
    cells = ", ".join(f"CAST(sum(CASE WHEN {end} = '{b}' THEN weight ELSE 0 END) AS BIGINT) AS \"{b}\"" for b in "ACGT")
    rates = ", ".join(f"round(100.0 * sum(CASE WHEN {end} = '{b}' THEN weight ELSE 0 END) / sum(weight), 6) AS \"{b}_pc\"" for b in "ACGT")
    return f"SELECT {by} stop - start + 1 AS length, {cells}, {rates} FROM reads r WHERE {where} GROUP BY ALL"


PCS = [f"{b}_pc" for b in "ACGT"]


@query("size_base_matrix", _matrix("base5", ""))
def size_base_matrix(v):
    return rounded(R.size_base_matrix(v.reads), *PCS)


@query("size_base_matrix_3prime", _matrix("base3", ""))
def size_base_matrix_3prime(v):
    return rounded(R.size_base_matrix(v.reads, "base3"), *PCS)


@query("size_base_matrix_by_strand", _matrix("base5", "strand,"))
def size_base_matrix_by_strand(v):
    return rounded(R.size_base_matrix(v.reads, by=["strand"]), *PCS)


@query("size_base_matrix_masked", _matrix("base5", "", f"NOT EXISTS (SELECT 1 FROM features l WHERE {ON})"))
def size_base_matrix_masked(v):
    return rounded(R.size_base_matrix(v.reads, mask=v.features, bin_size=SMALL), *PCS)


@query("size_by_feature", f"""WITH p AS (SELECT DISTINCT r.event_id, r.seqid, r.stop - r.start + 1 AS length, r.weight, coalesce(l.type, 'nofeature') AS type FROM reads r LEFT JOIN features l ON {ON})
SELECT seqid, length, type, CAST(sum(weight) AS BIGINT) AS reads FROM p GROUP BY ALL""")
def size_by_feature(v):
    return R.size_by_feature(v.reads, v.features, bin_size=SMALL)


@query("overlap_classes", f"""WITH p AS (SELECT l.type, sum(CASE WHEN l.strand = r.strand THEN weight ELSE 0 END) AS same, sum(CASE WHEN l.strand <> r.strand THEN weight ELSE 0 END) AS opp FROM features l JOIN reads r ON {ON} GROUP BY 1)
SELECT type, CAST(same AS BIGINT) AS same, CAST(opp AS BIGINT) AS opp, round(100.0 * same / sum(same + opp) OVER (), 6) AS same_pc, round(100.0 * opp / sum(same + opp) OVER (), 6) AS opp_pc FROM p""")
def overlap_classes(v):
    return rounded(R.overlap_classes(v.reads, v.features, bin_size=SMALL), "same_pc", "opp_pc")


@query("window_counts", 'SELECT seqid, w AS "window", lib, CAST(sum(weight) AS BIGINT) AS reads FROM (SELECT *, unnest(range((start - 1) // 1000, (stop - 1) // 1000 + 1)) AS w FROM reads) x GROUP BY ALL')
def window_counts(v):
    return R.window_counts(v.reads)


@query("sirna_evidence", f"""WITH n AS (SELECT l.parent AS gene, l.seqid, l.start, l.stop, r.lib, sum(CASE WHEN r.strand = '+' THEN weight ELSE 0 END) AS fwd, sum(CASE WHEN r.strand = '-' THEN weight ELSE 0 END) AS rev, sum(weight) AS a FROM features l JOIN reads r ON {ON} WHERE l.type = 'gene' GROUP BY ALL),
m AS (SELECT lib, sum(weight) / 1e6 AS mapped FROM reads GROUP BY lib)
SELECT gene, seqid, start, stop, n.lib, CAST(fwd AS BIGINT) AS fwd, CAST(rev AS BIGINT) AS rev, CAST(a AS BIGINT) AS all_reads, round(a / ((stop - start + 1) / 1000.0) / mapped, 4) AS rpkm, CASE WHEN a > 10 THEN 'YES' ELSE 'NO' END AS status FROM n JOIN m ON n.lib = m.lib""")
def sirna_evidence(v):
    return rounded(R.sirna_evidence(v.features.where("type = 'gene'"), v.reads, bin_size=SMALL), "rpkm", digits=4)


@query("overhang_offsets", """WITH f AS (SELECT seqid, start, stop, strand FROM features WHERE stop - start + 1 BETWEEN 21 AND 28)
SELECT b.start - a.start AS "offset", count(*) AS n FROM f a JOIN f b ON a.seqid = b.seqid AND a.strand = '+' AND b.strand = '-' AND a.start <= b.stop AND b.start <= a.stop GROUP BY 1""")
def overhang_offsets(v):
    return R.overhang_offsets(v.features, bin_size=SMALL)


@query("pair_list", "SELECT 'u' || user_id || '/1' AS mate1, 'u' || user_id || '/2' AS mate2, 300 AS size FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 3 = 1) > 0 AND count(*) FILTER (event_id % 3 = 2) > 0")
def pair_list(v):
    return R.pair_list(v.table("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("id")), 300)


@query("rename_mates", "SELECT event_id, 'e' || event_id || CASE WHEN event_id % 2 = 0 THEN '/1' ELSE '/2' END AS id FROM events")
def rename_mates(v):
    return R.rename_mates(v.table("events").select("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".f").otherwise(".r")).alias("id")))


@query("pair_mates", """WITH a AS (SELECT id, seq FROM seqs WHERE id % 3 <> 0), b AS (SELECT id, reverse(seq) AS seq FROM seqs WHERE id % 2 = 0), p AS (SELECT coalesce(a.id, b.id) AS id, a.seq AS s1, b.seq AS s2 FROM a FULL JOIN b ON a.id = b.id)
SELECT id, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'paired' ELSE 'unpaired' END AS status, 1 AS file, s1 AS seq FROM p WHERE s1 IS NOT NULL UNION ALL SELECT id, CASE WHEN s1 IS NOT NULL AND s2 IS NOT NULL THEN 'paired' ELSE 'unpaired' END, 2, s2 FROM p WHERE s2 IS NOT NULL""")
def pair_mates(v):
    return R.pair_mates(v.seqs.where("id % 3 <> 0"), v.seqs.where("id % 2 = 0").select("id", F.reverse("seq").alias("seq")))


@query("reads_in_regions", f"SELECT event_id, lib, seqid, start, stop FROM reads WHERE event_id // 4 IN (SELECT r.event_id // 4 FROM reads r JOIN features l ON {ON} WHERE l.type = 'CDS')")
def reads_in_regions(v):
    r = v.reads.withColumn("name", F.floor(F.col("event_id") / 4))
    return R.reads_in_regions(r, v.features.where("type = 'CDS'"), bin_size=SMALL).select("event_id", "lib", "seqid", "start", "stop")


@query("low_coverage", f"SELECT l.parent, CAST(coalesce(sum(weight), 0) AS BIGINT) AS reads FROM features l LEFT JOIN reads r ON {ON} GROUP BY 1 HAVING coalesce(sum(weight), 0) <= 2")
def low_coverage(v):
    return R.low_coverage(v.features, v.reads, 2, bin_size=SMALL)


@query("annotate_counts", """WITH g AS (SELECT DISTINCT seqid, start, stop, parent AS id FROM features WHERE type = 'gene'), p AS (SELECT l.id AS a, r.id AS b FROM g l JOIN g r ON l.seqid = r.seqid AND l.start <= r.stop AND r.start <= l.stop AND l.id < r.id),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), s AS (SELECT a, string_agg(b, ',' ORDER BY b) AS o FROM u GROUP BY a), c AS (SELECT parent, count(*) AS n FROM features GROUP BY 1)
SELECT c.parent, c.n, s.o AS overlapping FROM c LEFT JOIN s ON c.parent = s.a""")
def annotate_counts(v):
    g = v.features.where("type = 'gene'").select("seqid", "start", "stop", F.lit("+").alias("strand"), F.col("parent").alias("id")).distinct()
    return R.annotate_counts(v.features.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), self_overlaps(g, bin_size=SMALL))


@query("merge_counts", """WITH c AS (SELECT seqid AS feature, lib, stop - start + 1 AS length, weight AS n FROM reads), t AS (SELECT feature FROM c GROUP BY 1 ORDER BY sum(n) DESC, feature LIMIT 10)
SELECT feature, lib, length, CAST(sum(n) AS BIGINT) AS n FROM c WHERE feature IN (SELECT feature FROM t) GROUP BY ALL""")
def merge_counts(v):
    c = v.reads.select(F.col("seqid").alias("feature"), "lib", (F.col("stop") - F.col("start") + 1).alias("length"), F.col("weight").alias("n"))
    return R.merge_counts([c.where(F.col("lib") == x) for x in ("L0", "L1", "L2")], 10)


SIGN = "CASE WHEN log2(({b} + 1.0) / ({a} + 1.0)) >= 1.0 THEN '+' WHEN log2(({b} + 1.0) / ({a} + 1.0)) <= -1.0 THEN '-' ELSE '0' END"


@query("expression_patterns", f"""WITH w AS (SELECT seqid, CAST(coalesce(sum(weight) FILTER (lib = 'L0'), 0) AS BIGINT) AS L0, CAST(coalesce(sum(weight) FILTER (lib = 'L1'), 0) AS BIGINT) AS L1, CAST(coalesce(sum(weight) FILTER (lib = 'L2'), 0) AS BIGINT) AS L2 FROM reads GROUP BY 1)
SELECT *, {SIGN.format(a='L0', b='L1')} || {SIGN.format(a='L1', b='L2')} AS pattern FROM w WHERE greatest(L0, L1, L2) >= 5""")
def expression_patterns(v):
    libs = ["L0", "L1", "L2"]
    return R.expression_patterns(v.reads.groupBy("seqid").pivot("lib", libs).agg(F.sum("weight")).fillna(0, libs), libs)


@query("mapability_gc", """WITH c AS (SELECT id AS seqid, seq, CAST(i AS BIGINT) - 1 AS p, substr(seq, CAST(i AS BIGINT), 1) = 'A' AS u, substr(seq, CAST(i AS BIGINT), 20) AS r FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs) x)
SELECT seqid, p // 100 AS "window", round(avg(CASE WHEN u THEN 1.0 ELSE 0 END), 9) AS unique_share, round(avg(CASE WHEN u THEN (length(r) - length(translate(r, 'GC', '')))::DOUBLE / length(r) END), 9) AS gc FROM c GROUP BY ALL""")
def mapability_gc(v):
    s = v.seqs.withColumnRenamed("id", "seqid")
    return rounded(R.mapability(s.select("seqid", F.translate("seq", "A", "!").alias("calls")), genome=s, read=20, chunk=300), "unique_share", "gc", digits=9)


@query("mapability", """WITH c AS (SELECT id AS seqid, CAST(i AS BIGINT) - 1 AS p, substr(seq, CAST(i AS BIGINT), 1) AS c FROM (SELECT id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs) x) SELECT seqid, p // 100 AS "window", round(avg(CASE WHEN c = 'A' THEN 1.0 ELSE 0 END), 9) AS unique_share FROM c GROUP BY ALL""")
def mapability(v):
    return rounded(R.mapability(v.seqs.select(F.col("id").alias("seqid"), F.translate("seq", "A", "!").alias("calls"))), "unique_share", digits=9)
