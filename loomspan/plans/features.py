"""Gene-model and window queries (B, D13, D20-D27, E, F) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import features as G
from loomspan.operators import windows as N
from loomspan.operators.intervals import touched_blocks
from loomspan.plans.reads import rounded
from loomspan.plans.views import query

DIR = "CASE WHEN strand = '-' THEN -1 ELSE 1 END"
TIE = ["seqid", "score", "type"]


@query("of_type", "SELECT seqid, start, stop, type, parent FROM features WHERE type IN ('CDS', 'exon')")
def of_type(v):
    return G.of_type(v.features, "CDS", "exon").select("seqid", "start", "stop", "type", "parent")


@query("sort_features", "SELECT seqid, start, stop FROM features ORDER BY seqid, start, stop")
def sort_features(v):
    return G.sort_features(v.features).select("seqid", "start", "stop")


@query("introns", f"""
WITH e AS (SELECT DISTINCT seqid % 10 AS seqid, strand, 'g' || CAST(substr(parent, 2) AS BIGINT) // 20 AS parent, start, stop FROM features),
r AS (SELECT *, max(stop) OVER (PARTITION BY parent, seqid, strand ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT parent, seqid, strand, reach + 1 AS start, start - 1 AS stop FROM r WHERE reach + 1 <= start - 1)
SELECT *, row_number() OVER (PARTITION BY parent, seqid, strand ORDER BY start * {DIR}) AS number FROM i""")
def introns(v):
    return G.introns(_genes(v))


def _genes(v):
    return v.features.select((F.col("seqid") % 10).alias("seqid"), "strand", F.concat(F.lit("g"), F.floor(F.substr("parent", F.lit(2)).cast("long") / 20).cast("string")).alias("parent"), "start", "stop").distinct()


@query("exon_roles", f"""
WITH e AS (SELECT parent, min(seqid) AS seqid, strand, start, max(stop) AS stop FROM features WHERE type <> 'gene' GROUP BY parent, strand, start), k AS (SELECT *, count(*) OVER (PARTITION BY parent) AS n, row_number() OVER (PARTITION BY parent ORDER BY start * {DIR}, stop * {DIR}) AS k FROM e)
SELECT parent, seqid, strand, start, stop, CASE WHEN n = 1 THEN 'Esngl' WHEN k = 1 THEN 'Einit' WHEN k = n THEN 'Eterm' ELSE 'Exon' END AS role FROM k WHERE parent IN (SELECT parent FROM features WHERE type = 'gene')""")
def exon_roles(v):
    e = v.features.where("type <> 'gene'").groupBy("parent", "strand", "start").agg(F.min("seqid").alias("seqid"), F.max("stop").alias("stop"))
    return G.exon_roles(e, v.features.where("type = 'gene'").select("parent")).select("parent", "seqid", "strand", "start", "stop", "role")


@query("cds_frames", f"""
SELECT seqid, start, stop, strand, parent, score, CAST((3 - coalesce(sum(stop - start + 1) OVER (PARTITION BY parent ORDER BY start * {DIR}, stop * {DIR}, seqid, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS INT) AS frame FROM (SELECT DISTINCT seqid, start, stop, strand, parent, score FROM features WHERE type = 'CDS') c""")
def cds_frames(v):
    cds = v.features.where("type = 'CDS'").select("seqid", "start", "stop", "strand", "parent", "score").distinct()
    return G.cds_frames(cds, tie=["seqid", "score"])


@query("to_gtf_training", """
WITH c AS (SELECT parent, min(seqid) AS seqid, '+' AS strand, start, max(stop) AS stop FROM features WHERE type = 'CDS' GROUP BY parent, start), e AS (SELECT parent, seqid, strand, min(start) AS a, max(stop) AS b FROM c GROUP BY ALL)
SELECT seqid, 'CDS' AS type, start, stop, strand, parent, CAST((3 - coalesce(sum(stop - start + 1) OVER (PARTITION BY parent ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS INT) AS frame FROM c
UNION ALL SELECT seqid, 'start_codon', a, a + 2, strand, parent, 0 FROM e UNION ALL SELECT seqid, 'stop_codon', b - 2, b, strand, parent, 0 FROM e""")
def to_gtf_training(v):
    c = v.features.where("type = 'CDS'").groupBy("parent", "start").agg(F.min("seqid").alias("seqid"), F.max("stop").alias("stop")).withColumn("strand", F.lit("+"))
    return G.to_gtf_training(c)


@query("gene_models", """
WITH r AS (SELECT 'G' || CAST(substr(parent, 2) AS BIGINT) // 10 AS gene, parent AS transcript, seqid, strand, type, start, stop FROM features WHERE type IN ('exon', 'CDS')),
c AS (SELECT transcript, seqid, strand, min(start) AS cf, max(stop) AS ct FROM r WHERE type = 'CDS' GROUP BY ALL), e AS (SELECT r.*, cf, ct FROM r JOIN c USING (transcript, seqid, strand) WHERE type = 'exon')
SELECT gene, NULL AS transcript, seqid, strand, 'gene' AS type, min(start) AS start, max(stop) AS stop FROM r GROUP BY gene, seqid, strand
UNION ALL SELECT gene, transcript, seqid, strand, 'mRNA', min(start), max(stop) FROM r GROUP BY gene, transcript, seqid, strand UNION ALL SELECT * FROM r
UNION ALL SELECT gene, transcript, seqid, strand, CASE WHEN strand <> '-' THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END, start, least(stop, cf - 1) FROM e WHERE start < cf
UNION ALL SELECT gene, transcript, seqid, strand, CASE WHEN strand <> '-' THEN 'three_prime_UTR' ELSE 'five_prime_UTR' END, greatest(start, ct + 1), stop FROM e WHERE stop > ct""")
def gene_models(v):
    gene = F.concat(F.lit("G"), F.floor(F.substr("parent", F.lit(2)).cast("long") / 10).cast("string"))
    return G.gene_models(v.features.select(gene.alias("gene"), F.col("parent").alias("transcript"), "seqid", "strand", "type", "start", "stop"))


#: every transcript with CDS has a start codon that is split over an intron and a stop codon beyond its last CDS
@query("gene_models_codons", """
WITH r AS (SELECT 'G' || CAST(substr(parent, 2) AS BIGINT) // 10 AS gene, parent AS transcript, seqid, strand, type, start, stop FROM features WHERE type IN ('exon', 'CDS')),
c AS (SELECT gene, transcript, seqid, strand, min(start) AS cf, max(stop) AS ct FROM r WHERE type = 'CDS' GROUP BY ALL),
k AS (SELECT *, CASE WHEN strand <> '-' THEN cf + 4 ELSE cf - 3 END AS lo, CASE WHEN strand <> '-' THEN ct + 3 ELSE ct - 4 END AS hi FROM c),
p AS (SELECT gene, transcript, seqid, strand, unnest(range(greatest(start, lo), least(stop, hi) + 1)) AS x FROM (SELECT r.*, lo, hi FROM r JOIN k USING (gene, transcript, seqid, strand) WHERE type = 'CDS'
  UNION ALL SELECT gene, transcript, seqid, strand, 'k', CASE WHEN strand <> '-' THEN cf + 4 ELSE cf - 3 END, CASE WHEN strand <> '-' THEN cf + 4 ELSE cf - 1 END, lo, hi FROM k
  UNION ALL SELECT gene, transcript, seqid, strand, 'k', CASE WHEN strand <> '-' THEN cf + 9 ELSE ct - 4 END, CASE WHEN strand <> '-' THEN cf + 10 ELSE ct - 4 END, lo, hi FROM k
  UNION ALL SELECT gene, transcript, seqid, strand, 'k', CASE WHEN strand <> '-' THEN ct + 1 ELSE ct - 9 END, CASE WHEN strand <> '-' THEN ct + 3 ELSE ct - 8 END, lo, hi FROM k) y),
d AS (SELECT DISTINCT * FROM p), i AS (SELECT *, x - row_number() OVER (PARTITION BY gene, transcript, seqid, strand ORDER BY x) AS isle FROM d), e AS (SELECT r.*, lo, hi FROM r JOIN k USING (gene, transcript, seqid, strand) WHERE type = 'exon')
SELECT gene, transcript, seqid, strand, 'CDS' AS type, min(x) AS start, max(x) AS stop FROM i GROUP BY gene, transcript, seqid, strand, isle
UNION ALL SELECT gene, transcript, seqid, strand, CASE WHEN strand <> '-' THEN 'five_prime_UTR' ELSE 'three_prime_UTR' END, start, least(stop, lo - 1) FROM e WHERE start < lo
UNION ALL SELECT gene, transcript, seqid, strand, CASE WHEN strand <> '-' THEN 'three_prime_UTR' ELSE 'five_prime_UTR' END, greatest(start, hi + 1), stop FROM e WHERE stop > hi""")
def gene_models_codons(v):
    gene = F.concat(F.lit("G"), F.floor(F.substr("parent", F.lit(2)).cast("long") / 10).cast("string"))
    r = v.features.where("type IN ('exon', 'CDS')").select(gene.alias("gene"), F.col("parent").alias("transcript"), "seqid", "strand", "type", "start", "stop")
    k = r.where("type = 'CDS'").groupBy("gene", "transcript", "seqid", "strand").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    plus, a, b = F.col("strand") != "-", F.col("a"), F.col("b")
    part = lambda kind, one, two, three, four: F.struct(F.lit(kind).alias("type"), F.when(plus, one).otherwise(three).alias("start"), F.when(plus, two).otherwise(four).alias("stop"))
    codons = F.array(
        F.when(plus, part("start_codon", a + 4, a + 4, a, a)).otherwise(part("stop_codon", a, a, a - 3, a - 1)),
        F.struct(F.lit("start_codon").alias("type"), F.when(plus, a + 9).otherwise(b - 4).alias("start"), F.when(plus, a + 10).otherwise(b - 4).alias("stop")),
        F.when(plus, part("stop_codon", b + 1, b + 3, b, b)).otherwise(part("start_codon", b, b, b - 9, b - 8)),
    )
    k = k.select("gene", "transcript", "seqid", "strand", F.inline(codons))
    return G.gene_models(r.unionByName(k)).where("type = 'CDS' OR type LIKE '%UTR'")


@query("fill_down", "SELECT event_id, seqid, max(CASE WHEN event_id % 7 = 0 THEN event_id END) OVER (PARTITION BY seqid ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_id FROM reads")
def fill_down(v):
    r = v.reads.select("event_id", "seqid", F.when(F.col("event_id") % 7 == 0, F.col("event_id")).alias("last_id"))
    return G.fill_down(r, "last_id", ["event_id"], ["seqid"])


@query("chain_hits", """
WITH r AS (SELECT type AS query, seqid, strand, start, stop, score, max(stop) OVER (PARTITION BY type, seqid, strand ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM features),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY query, seqid, strand ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS chain FROM r)
SELECT query, seqid, strand, CAST(chain AS BIGINT) AS chain, min(start) AS start, max(stop) AS stop, count(*) AS n, round(sum(score), 2) AS score, greatest(min(start) - 1500, 1) AS from_, max(stop) + 1500 AS to_ FROM n GROUP BY ALL""")
def chain_hits(v):
    h = v.features.select(F.col("type").alias("query"), "seqid", "strand", "start", "stop", "score")
    return rounded(G.chain_hits(h, 100), "score", digits=2)


#: exons one after the other along the strand, with the state that the reference's loop carries: transcript, last query start, last ends
@query("chain_est", """
WITH RECURSIVE h AS (SELECT DISTINCT type AS query, seqid, strand, start, stop, start % 400 // 2 * 2 AS qstart, start % 400 // 2 * 2 + stop - start AS qstop, 400 AS qlen FROM features),
o AS (SELECT *, row_number() OVER (PARTITION BY query, seqid, strand ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END, stop, qstart) AS r FROM h),
w(query, seqid, strand, r, chain, lq, ls, le, skip, qstart, qstop, qlen) AS (
  SELECT query, seqid, strand, r, 1::BIGINT, qstart, start, stop, FALSE, qstart, qstop, qlen FROM o WHERE r = 1
  UNION ALL SELECT query, seqid, strand, r, CASE WHEN skip OR NOT new THEN chain ELSE chain + 1 END, CASE WHEN skip THEN lq ELSE qstart END, CASE WHEN skip THEN ls ELSE hs END, CASE WHEN skip THEN le ELSE he END, skip, qstart, qstop, qlen FROM (
    SELECT x.*, NOT back AND gap < 0 AS skip, back OR gap > 60 AS new FROM (
      SELECT o.query, o.seqid, o.strand, o.r, w.chain, w.lq, w.ls, w.le, o.qstart, o.qstop, o.qlen, o.qstart < w.lq AS back,
        CASE WHEN o.qstart >= w.lq AND o.strand <> '-' AND o.start - w.le BETWEEN -3 AND -1 THEN w.le + 1 ELSE o.start END AS hs,
        CASE WHEN o.qstart >= w.lq AND o.strand = '-' AND w.ls - o.stop BETWEEN -2 AND -1 THEN w.ls - 1 ELSE o.stop END AS he,
        CASE WHEN o.strand <> '-' THEN CASE WHEN o.start - w.le BETWEEN -3 AND -1 THEN 1 ELSE o.start - w.le END ELSE CASE WHEN w.ls - o.stop BETWEEN -2 AND -1 THEN 1 ELSE w.ls - o.stop END END AS gap
      FROM w JOIN o ON o.query = w.query AND o.seqid = w.seqid AND o.strand = w.strand AND o.r = w.r + 1) x) y),
c AS (SELECT query, seqid, strand, chain, qlen, min(ls) AS start, max(le) AS stop, count(*) AS exons, min(qstart) AS qstart, max(qstop) AS qstop FROM w WHERE NOT skip GROUP BY ALL)
SELECT query, seqid, strand, start, stop, exons, qstart, qstop, CAST(qlen AS BIGINT) AS qlen, CAST(100 * (qstop - qstart) // qlen AS BIGINT) AS coverage FROM c WHERE 100 * (qstop - qstart) // qlen >= 5""")
def chain_est(v):
    at = F.floor(F.col("start") % 400 / 2) * 2
    h = v.features.select(F.col("type").alias("query"), "seqid", "strand", "start", "stop", at.alias("qstart"), (at + F.col("stop") - F.col("start")).alias("qstop"), F.lit(400).alias("qlen"))
    return G.chain_est(h, 60, min_cov=5, distinct=True)


@query("dedupe_overlaps", """WITH RECURSIVE m AS (SELECT type AS gene, seqid, start, stop, row_number() OVER (PARTITION BY type, seqid ORDER BY start - stop, start, stop) AS r FROM features WHERE stop - start + 1 >= 20),
s(gene, seqid, r, kept) AS (SELECT gene, seqid, 1::BIGINT, [{'a': start, 'b': stop}] FROM m WHERE r = 1
  UNION ALL SELECT s.gene, s.seqid, m.r, CASE WHEN len(list_filter(kept, lambda k: m.start <= k.b AND k.a <= m.stop)) = 0 THEN list_append(kept, {'a': m.start, 'b': m.stop}) ELSE kept END FROM s JOIN m ON m.gene = s.gene AND m.seqid = s.seqid AND m.r = s.r + 1),
z AS (SELECT gene, seqid, unnest(arg_max(kept, r)) AS k FROM s GROUP BY gene, seqid)
SELECT gene, seqid, k.a AS start, k.b AS stop, row_number() OVER (PARTITION BY gene, seqid ORDER BY k.a, k.b) AS copy FROM z""")
def dedupe_overlaps(v):
    return G.dedupe_overlaps(v.features.select(F.col("type").alias("gene"), "seqid", "start", "stop"), 20)


@query("missing_regions", """
WITH t AS (SELECT seqid AS chrom, start, parent || ':' || stop AS gene, CASE WHEN start % 3 = 0 THEN 'NO_GENES_IN_INTERVAL' ELSE 'OK' END AS status, CASE WHEN start % 3 <> 0 THEN 'T' || seqid % 3 END AS target, CASE WHEN start % 3 <> 0 THEN start * 2 END AS t_start, CASE WHEN start % 3 <> 0 THEN stop * 2 END AS t_stop FROM (SELECT DISTINCT seqid, start, stop, parent FROM features) f),
w AS (SELECT *, lag(target) OVER p AS pt, lead(target) OVER p AS nt, lag(t_stop) OVER p AS pe, lead(t_stop) OVER p AS ne, lag(t_start) OVER p AS ps, lead(t_start) OVER p AS ns FROM t WINDOW p AS (PARTITION BY chrom ORDER BY start, gene))
SELECT chrom, gene, pt AS target, least(pe, ne) + 1 AS from_, greatest(ps, ns) - 1 AS to_ FROM w WHERE status = 'NO_GENES_IN_INTERVAL' AND pt = nt""")
def missing_regions(v):
    some = F.col("start") % 3 != 0
    t = v.features.select("seqid", "start", "stop", "parent").distinct().select(
        F.col("seqid").alias("chrom"), "start", F.concat_ws(":", "parent", F.col("stop").cast("string")).alias("gene"), F.when(~some, "NO_GENES_IN_INTERVAL").otherwise("OK").alias("status"),
        F.when(some, F.concat(F.lit("T"), (F.col("seqid") % 3).cast("string"))).alias("target"), F.when(some, F.col("start") * 2).alias("t_start"), F.when(some, F.col("stop") * 2).alias("t_stop"),
    )
    return G.missing_regions(t)


STATS = "max(len) AS max, min(len) AS min, round(avg(len), 6) AS mean, quantile_cont(len, 0.5) AS median, CAST(sum(len) AS BIGINT) AS total, count(*) AS n"


@query("length_stats", f"SELECT type, {STATS} FROM (SELECT type, stop - start + 1 AS len FROM features) x GROUP BY type")
def length_stats(v):
    return rounded(G.length_stats(v.features), "mean")


@query("length_stats_by_transcript", f"SELECT type, {STATS} FROM (SELECT type, parent, CAST(sum(stop - start + 1) AS BIGINT) AS len FROM features GROUP BY ALL) x GROUP BY type")
def length_stats_by_transcript(v):
    return rounded(G.length_stats(v.features, unit="parent"), "mean")


@query("number_within", "SELECT query, hit, line_no, bits, row_number() OVER (PARTITION BY query, hit ORDER BY qstart, line_no, bits) AS number, query || ':' || hit || printf('_D%02d', row_number() OVER (PARTITION BY query, hit ORDER BY qstart, line_no, bits)) AS label FROM hits")
def number_within(v):
    return G.number_within(v.hits, ["query", "hit"], ["qstart", "line_no", "bits"]).select("query", "hit", "line_no", "bits", "number", "label")


@query("unique_ids", "SELECT parent, start, stop, seqid, score, parent || '.cds' || row_number() OVER (PARTITION BY parent ORDER BY start, stop, seqid, score) AS id FROM features")
def unique_ids(v):
    return G.unique_ids(v.features, "parent", ["start", "stop", "seqid", "score"]).select("parent", "start", "stop", "seqid", "score", "id")


@query("explode_parents", "SELECT seqid, start, 0 AS place, parent FROM features UNION ALL SELECT seqid, start, 1, type FROM features")
def explode_parents(v):
    return G.explode_parents(v.features.select("seqid", "start", F.concat_ws(",", "parent", "type").alias("parents")))


@query("route", "SELECT seqid, start, parent, CASE type WHEN 'CDS' THEN 'proteins' ELSE 'transcripts' END AS output, CASE type WHEN 'CDS' THEN 'coding' ELSE 'match' END AS type FROM features WHERE type IN ('CDS', 'exon')")
def route(v):
    return G.route(v.features.withColumn("source", F.col("type")), {"CDS": ("proteins", "coding"), "exon": ("transcripts", "match")}).select("seqid", "start", "parent", "output", "type")


@query("hits_to_features", "SELECT hit AS seqid, 'blast' AS source, 'match' AS type, least(qstart, qstart + 60 - aln_len * 2) AS start, greatest(qstart, qstart + 60 - aln_len * 2) AS stop, bits AS score, CASE WHEN aln_len > 30 THEN '-' ELSE '+' END AS strand, query || ' ' || CAST(line_no AS VARCHAR) || ' ' || CAST(line_no + 9 AS VARCHAR) AS target FROM hits")
def hits_to_features(v):
    h = v.hits.select("query", "hit", F.col("qstart").alias("sstart"), (F.col("qstart") + 60 - F.col("aln_len") * 2).alias("sstop"), F.col("line_no").alias("qstart"), (F.col("line_no") + 9).alias("qstop"), "bits")
    return G.hits_to_features(h).withColumn("target", F.col("attrs")["Target"]).drop("attrs")


@query("scaffolds", "SELECT seqid, 'assembly' AS source, 'scaffold' AS type, 1 AS start, length AS stop FROM genome")
def scaffolds(v):
    return G.scaffolds(v.genome)


@query("karyotype", "SELECT seqid, length, (row_number() OVER (ORDER BY length DESC, seqid) - 1) % 360 AS colour FROM genome WHERE length >= 2000")
def karyotype(v):
    return G.karyotype(v.genome, 2000)


@query("to_gff2", f"""WITH e AS (SELECT DISTINCT seqid, start, stop, strand, parent FROM features WHERE type = 'exon'), k AS (SELECT parent, min(start) AS start, seqid, strand FROM e GROUP BY parent, seqid, strand), u AS (SELECT parent, min(seqid) AS seqid, start, strand FROM k GROUP BY parent, start, strand)
SELECT seqid, 'exon' AS type, start, start + 9 AS stop, strand, 'GenePrediction ' || CASE WHEN parent LIKE '%1' THEN upper(parent) ELSE parent END || ' ; exonNumber ' || row_number() OVER (PARTITION BY parent ORDER BY start * {DIR}, (start + 9) * {DIR}, strand) AS grp FROM u""")
def to_gff2(v):
    e = v.features.where("type = 'exon'").groupBy("parent", "seqid", "strand").agg(F.min("start").alias("start")).groupBy("parent", "start", "strand").agg(F.min("seqid").alias("seqid"))
    e = e.withColumns({"stop": F.col("start") + 9, "type": F.lit("exon")})
    names = e.where("parent LIKE '%1'").select("parent", F.upper("parent").alias("name")).distinct()
    return G.to_gff2(e, names)


@query("gene_order_map", """WITH g AS (SELECT parent AS gene, seqid, min(start) AS start FROM features GROUP BY ALL), t AS (SELECT gene, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM (SELECT replace(gene, 'P', 'g') AS gene, term FROM assoc) a GROUP BY gene)
SELECT g.*, row_number() OVER (PARTITION BY seqid ORDER BY start, g.gene) AS place, terms FROM g LEFT JOIN t ON g.gene = t.gene""")
def gene_order_map(v):
    return G.gene_order_map(v.features.select(F.col("parent").alias("gene"), "seqid", "start"), v.assoc.select(F.replace("gene", F.lit("P"), F.lit("g")).alias("gene"), "term"))


#: windows one after the other by gene, each unless it touches one that is there; a gene ends with the first that does
@query("promoter_windows", """
WITH RECURSIVE g AS (SELECT seqid || ':' || min(parent) || strand || start AS gene, seqid, strand, start, max(stop) AS stop FROM features WHERE type = 'gene' GROUP BY seqid, strand, start), k AS (SELECT gene, g.seqid, strand, step, g.start AS gs, CASE WHEN strand <> '-' THEN g.start - step * 100 ELSE g.stop + (step - 1) * 100 + 1 END AS a, length FROM g JOIN genome ON genome.seqid = g.seqid, range(1, 5) t(step)),
w AS (SELECT gene, seqid, strand, CAST(step AS INT) AS step, gs, greatest(a, 1) AS start, least(a + 99, length) AS stop FROM k WHERE greatest(a, 1) <= least(a + 99, length)),
f AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.seqid = w.seqid AND g.start <= w.stop AND w.start <= g.stop)), r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY step) AS u FROM f),
q AS (SELECT *, row_number() OVER (PARTITION BY seqid ORDER BY gs, gene, step) AS n FROM r WHERE u = step),
s(seqid, n, ended, kept) AS (SELECT seqid, 1::BIGINT, ''::VARCHAR, [{'gene': gene, 'strand': strand, 'step': step, 'a': start, 'b': stop}] FROM q WHERE n = 1
  UNION ALL SELECT q.seqid, q.n, CASE WHEN ok THEN ended ELSE q.gene END, CASE WHEN ok THEN list_append(kept, {'gene': q.gene, 'strand': q.strand, 'step': q.step, 'a': q.start, 'b': q.stop}) ELSE kept END
  FROM (SELECT q.*, s.ended, s.kept, s.ended <> q.gene AND len(list_filter(s.kept, lambda x: x.a <= q.stop AND q.start <= x.b)) = 0 AS ok FROM s JOIN q ON q.seqid = s.seqid AND q.n = s.n + 1) q),
z AS (SELECT seqid, unnest(arg_max(kept, n)) AS x FROM s GROUP BY seqid)
SELECT x.gene AS gene, seqid, x.strand AS strand, x.step AS step, x.a AS start, x.b AS stop FROM z""")
def promoter_windows(v):
    g = v.features.where("type = 'gene'").groupBy("seqid", "strand", "start").agg(F.max("stop").alias("stop"), F.min("parent").alias("p"))
    g = g.withColumn("gene", F.concat(F.col("seqid").cast("string"), F.lit(":"), "p", "strand", F.col("start").cast("string"))).drop("p")
    return G.promoter_windows(g, v.genome, size=100, bin_size=200)


@query("polya_windows", """WITH s AS (SELECT event_id AS id, r.seqid, start AS pos, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS d, strand, length FROM reads r JOIN genome g ON r.seqid = g.seqid), k AS (SELECT id, seqid, kind, strand, pos + d * off AS mid, length FROM s, (VALUES ('positive', 0), ('upstream', -200), ('downstream', 150)) t(kind, off))
SELECT id, kind, seqid, mid - 50 AS start, mid + 49 AS stop, strand FROM k WHERE mid - 50 >= 1 AND mid + 49 <= length""")
def polya_windows(v):
    return G.polya_windows(v.reads.select(F.col("event_id").alias("id"), "seqid", F.col("start").alias("pos"), "strand"), v.genome)


def _sliding(size, step, value, where="TRUE"):
    bins = f"unnest([start // {step}])" if size == step else f"unnest(range(greatest(start // {step} - {size // step}, 0), start // {step} + 2))"
    return f"""WITH b AS (SELECT seqid, {value} AS v, {bins} AS bin FROM features WHERE {where}), g AS (SELECT seqid, bin, round(sum(v), 8) AS total, count(*) AS n, round(sum(v) / count(*), 8) AS average FROM b GROUP BY ALL)
SELECT *, max(total) OVER (PARTITION BY seqid) AS max_total, max(average) OVER (PARTITION BY seqid) AS max_average FROM g"""


SLIDE = ("total", "average", "max_total", "max_average")


@query("sliding_windows", _sliding(2000, 500, "score"))
def sliding_windows(v):
    return rounded(N.sliding_windows(v.features, value="score", size=2000, step=500), *SLIDE, digits=8)


@query("sliding_windows_where", _sliding(1000, 1000, "score", "score > 20000"))
def sliding_windows_where(v):
    return rounded(N.sliding_windows(v.features, value="score", size=1000, step=1000, where=F.col("score") > 20000), *SLIDE, digits=8)


@query("binned_method", "SELECT seqid, start // 1000 AS bin, round(avg(score), 6) AS average FROM features GROUP BY ALL")
def binned_method(v):
    return rounded(N.binned(v.features, 1000, "average"), "average")


@query("normalize_bins", """WITH a AS (SELECT seqid, start // 1000 AS bin, count(*)::DOUBLE AS total FROM features GROUP BY ALL), b AS (SELECT seqid, start // 1000 AS bin, count(*)::DOUBLE AS d FROM reads GROUP BY ALL)
SELECT a.seqid, a.bin, total, coalesce(round(total / d, 9), 0) AS normalized FROM a LEFT JOIN b ON a.seqid = b.seqid AND a.bin = b.bin""")
def normalize_bins(v):
    track = lambda df: df.groupBy("seqid", F.floor(F.col("start") / 1000).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("total"))
    return rounded(N.normalize_bins(track(v.features), track(v.reads)), "normalized", digits=9)


@query("partition_bins", """WITH t AS (SELECT seqid, start // 100 AS bin, count(*) AS n FROM features GROUP BY ALL), b AS (SELECT seqid, x * 1500 + 1 AS start, x * 1500 + 1000 AS stop, CASE x % 3 WHEN 0 THEN 'HOT' WHEN 1 THEN 'COLD' ELSE 'NEUTRAL' END AS class FROM genome, unnest(range(0, length // 1500 + 1)) u(x))
SELECT t.seqid, t.bin, n, class FROM t JOIN b ON t.seqid = b.seqid AND t.bin * 100 + 50 BETWEEN b.start AND b.stop""")
def partition_bins(v):
    t = v.features.groupBy("seqid", F.floor(F.col("start") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    x = touched_blocks(t.withColumn("mid", F.col("bin") * 100 + 50), v.genome, 1500, "x", start="mid", stop="mid").where("x BETWEEN 0 AND floor(length / 1500)")
    b = x.select("seqid", (F.col("x") * 1500 + 1).alias("start"), (F.col("x") * 1500 + 1000).alias("stop"), F.when(F.col("x") % 3 == 0, "HOT").when(F.col("x") % 3 == 1, "COLD").otherwise("NEUTRAL").alias("class"))
    return N.partition_bins(t, b, 100)


@query("arms_center", """WITH t AS (SELECT seqid, start // 100 AS bin, count(*) AS n FROM features GROUP BY ALL) SELECT t.seqid, bin, n, CASE WHEN bin * 100 / length::DOUBLE < 0.15 OR bin * 100 / length::DOUBLE > 0.85 THEN 'arm' ELSE 'center' END AS region FROM t JOIN genome g ON t.seqid = g.seqid""")
def arms_center(v):
    return N.arms_center(v.features.groupBy("seqid", F.floor(F.col("start") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("n")), v.genome, 100)


@query("snps_per_bin", """WITH s AS (SELECT seqid, unnest(range(0, (length - 1) // 1000 + 1)) AS bin FROM genome), n AS (SELECT seqid, (start - 1) // 1000 AS bin, count(*) AS n FROM features GROUP BY ALL) SELECT s.seqid, s.bin, coalesce(n, 0) AS n FROM s LEFT JOIN n ON s.seqid = n.seqid AND s.bin = n.bin""")
def snps_per_bin(v):
    return N.snps_per_bin(v.features.select("seqid", F.col("start").alias("pos")), v.genome)


@query("snps_per_contig", "SELECT g.seqid, count(f.start) AS n, round(1000.0 * count(f.start) / length, 9) AS per_kb FROM genome g LEFT JOIN features f ON g.seqid = f.seqid GROUP BY g.seqid, length")
def snps_per_contig(v):
    return rounded(N.snps_per_contig(v.features.select("seqid", F.col("start").alias("pos")), v.genome), "per_kb", digits=9)


@query("bin_mean", """WITH k AS (SELECT seqid, start, stop, score, unnest(range((start - 1) // 100, (stop - 1) // 100 + 1)) AS bin FROM features), n AS (SELECT *, least(stop, (bin + 1) * 100) - greatest(start, bin * 100 + 1) + 1 AS n FROM k) SELECT seqid, bin, round(sum(n * score) / sum(n), 8) AS mean FROM n GROUP BY ALL""")
def bin_mean(v):
    return rounded(N.bin_mean(v.features.select("seqid", "start", "stop", F.col("score").alias("value")), 100), "mean", digits=8)


@query("window_density", 'SELECT seqid, start, stop, weight AS count, weight::DOUBLE / abs(stop - start) AS density FROM reads')
def window_density(v):
    return N.window_density(v.reads.select("seqid", "start", "stop", F.col("weight").alias("count")))


@query("snp_distances", "SELECT chrom, pos, coalesce(pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos), -1) AS distance FROM (SELECT DISTINCT chrom, pos FROM alleles) a")
def snp_distances(v):
    return N.snp_distances(v.alleles.select("chrom", "pos").distinct())


@query("isolated_snps", """WITH v AS (SELECT DISTINCT seqid, start AS pos, round(start % 100 / 100.0, 2)::DOUBLE AS af FROM features), c AS (SELECT * FROM v WHERE af BETWEEN 0.4 AND 0.6), n AS (SELECT *, count(*) OVER (PARTITION BY seqid ORDER BY pos RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS near FROM c),
i AS (SELECT n.seqid, pos, af, row_number() OVER (PARTITION BY n.seqid ORDER BY md5('7:' || n.seqid || ':' || pos), pos) AS r FROM n JOIN genome g ON n.seqid = g.seqid WHERE near = 1 AND pos > 20 AND pos <= length - 20) SELECT seqid, pos, af FROM i WHERE r <= 12""")
def isolated_snps(v):
    s = v.features.select("seqid", F.col("start").alias("pos"), F.round(F.col("start") % 100 / 100, 2).alias("af")).distinct()
    return N.isolated_snps(s, v.genome, flank=20)
