"""Family, hit and set queries (B4, C9-C15, C25, D28-D35, E18, F, G, J5) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import comparative as C
from loomspan.operators.intervals import touched_blocks
from loomspan.plans.reads import rounded
from loomspan.plans.views import query

SP = [f"S{i}" for i in range(7)]
EACH = lambda what: ", ".join(what.format(s=s) for s in SP)


@query("filter_hits", "SELECT query, hit, line_no, bits FROM hits WHERE evalue <= 0.04 AND pid >= 92 AND aln_len >= 10 AND query <> hit")
def filter_hits(v):
    return C.filter_hits(v.hits, 0.04, 92, 10).select("query", "hit", "line_no", "bits")


def _domains(v):
    return v.hits.select(F.split("query", "_")[0].alias("species"), F.col("query").alias("gene"), F.concat(F.lit("PF"), (F.col("qstart") % 50).cast("string")).alias("domain"), "evalue")


DOM = "WITH d AS (SELECT split_part(query, '_', 1) AS species, query AS gene, 'PF' || CAST(qstart % 50 AS VARCHAR) AS domain, evalue FROM hits)"


@query("domain_matrix", DOM + f" SELECT domain, {EACH(chr(99) + 'ount(*) FILTER (species = ' + chr(39) + '{s}' + chr(39) + ') AS {s}')}, count(*) AS total FROM d WHERE evalue <= 0.05 GROUP BY domain")
def domain_matrix(v):
    return C.domain_matrix(_domains(v), SP, cutoff=0.05)


@query("domain_matrix_percent", DOM + f""", g AS (SELECT species, count(DISTINCT gene) AS genes FROM d GROUP BY 1), n AS (SELECT d.species, domain, 100.0 * count(DISTINCT gene) / max(genes) AS p FROM d JOIN g ON d.species = g.species WHERE evalue <= 0.05 GROUP BY ALL)
SELECT domain, {EACH("round(coalesce(max(p) FILTER (species = '{s}'), 0), 6) AS {s}")} FROM n GROUP BY domain""")
def domain_matrix_percent(v):
    return rounded(C.domain_matrix(_domains(v), SP, True, 0.05), *SP)


@query("family_counts", f"""WITH g AS (SELECT DISTINCT * FROM orthogroups), d AS (SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR) AS gene, 'PF' || CAST(l_partkey % 9 AS VARCHAR) AS domain FROM lineitem), n AS (SELECT group_id, domain, count(*) AS n FROM g JOIN d ON g.gene = d.gene GROUP BY ALL),
t AS (SELECT group_id, string_agg(domain || ':' || n, ',' ORDER BY n DESC, domain) AS domains FROM n GROUP BY 1), c AS (SELECT group_id, {EACH("count(*) FILTER (species = '{s}') AS {s}")} FROM g GROUP BY 1)
SELECT c.*, domains FROM c LEFT JOIN t ON c.group_id = t.group_id""")
def family_counts(v):
    d = v.table("lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("gene"), F.concat(F.lit("PF"), (F.col("l_partkey") % 9).cast("string")).alias("domain"))
    return C.family_counts(v.orthogroups, SP, d)


@query("family_patterns", "SELECT pattern, count(*) AS families FROM (SELECT group_id, string_agg(DISTINCT species, '-' ORDER BY species) AS pattern FROM orthogroups GROUP BY 1) p GROUP BY 1")
def family_patterns(v):
    return C.family_patterns(v.orthogroups)


@query("single_copy", "SELECT group_id FROM (SELECT group_id, species, count(DISTINCT gene) AS n FROM orthogroups GROUP BY ALL) x GROUP BY 1 HAVING count(*) = 3 AND max(n) = 1")
def single_copy(v):
    return C.single_copy(v.orthogroups, 3)


@query("flexible_orthologs", "SELECT group_id, count(*) AS species, max(n) AS most, CAST(sum(n) AS BIGINT) AS genes FROM (SELECT group_id, species, count(DISTINCT gene) AS n FROM orthogroups GROUP BY ALL) x GROUP BY 1 HAVING count(*) >= 5 AND max(n) <= 2")
def flexible_orthologs(v):
    return C.flexible_orthologs(v.orthogroups, 7, 2, 2)


@query("decode_clusters", "SELECT l_orderkey AS cluster, count(DISTINCT p_partkey) AS genes, count(DISTINCT p_brand) AS taxa FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def decode_clusters(v):
    p = v.table("part")
    return C.decode_clusters(v.table("lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_partkey").alias("member")), p.select(F.col("p_partkey").alias("member"), F.col("p_partkey").alias("gene")), p.select(F.col("p_partkey").alias("gene"), F.col("p_brand").alias("taxon")).distinct())


@query("phylo_profile", f"SELECT query, {EACH(chr(99) + 'ount(DISTINCT hit) FILTER (split_part(hit, ' + chr(39) + '_' + chr(39) + ', 1) = ' + chr(39) + '{s}' + chr(39) + ') AS {s}')} FROM hits WHERE evalue <= 0.05 AND query <> hit GROUP BY 1")
def phylo_profile(v):
    return C.phylo_profile(v.hits, SP, 0.05)


@query("species_genes", "SELECT split_part(g, '_', 1) AS species, count(*) AS genes, min(g) AS first, max(g) AS last FROM (SELECT query AS g FROM hits UNION SELECT hit FROM hits) x GROUP BY 1")
def species_genes(v):
    return C.species_genes(v.hits)


@query("best_hit", "WITH r AS (SELECT query, hit, bits, line_no, row_number() OVER (PARTITION BY query ORDER BY line_no, bits DESC, hit) AS n FROM hits WHERE pid >= 95 AND aln_len >= 10) SELECT query, hit, bits, line_no FROM r WHERE n = 1")
def best_hit(v):
    return C.best_hit(v.hits.withColumn("neg", -F.col("bits")), ["line_no", "neg", "hit"], 95, 10).select("query", "hit", "bits", "line_no")


#: the alignment spans and lengths that the view lacks
SPANS = "SELECT *, CAST(qstart + aln_len * 2 AS DOUBLE) AS qend, 1 AS tstart, CAST(1 + aln_len * 2 AS DOUBLE) AS tend, 60 + CAST(split_part(query, '_', 2) AS BIGINT) % 41 AS ql, 60 + CAST(split_part(hit, '_', 2) AS BIGINT) % 41 AS hl FROM hits"


@query("best_hit_by_coverage", f"""WITH s AS ({SPANS}), r AS (SELECT query, hit, bits, line_no, row_number() OVER (PARTITION BY query ORDER BY line_no, bits DESC, hit) AS n FROM s
WHERE pid >= 95 AND abs(hl - ql) * 100.0 / ql <= 15 AND (tend - tstart) * 100.0 / hl >= 60 AND (qend - qstart) * 100.0 / ql >= 60) SELECT query, hit, bits, line_no FROM r WHERE n = 1""")
def best_hit_by_coverage(v):
    wide = F.col("aln_len") * 2
    h = v.hits.withColumns({"neg": -F.col("bits"), "qend": F.col("qstart") + wide, "tstart": F.lit(1), "tend": 1 + wide})
    ids = v.hits.select(F.col("query").alias("id")).union(v.hits.select("hit")).distinct()
    lens = ids.withColumn("length", 60 + F.split("id", "_")[1].cast("long") % 41)
    return C.best_hit(h, ["line_no", "neg", "hit"], 95, lens=lens).select("query", "hit", "bits", "line_no")


@query("lookup", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey")
def lookup(v):
    c = v.table("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return C.lookup(v.table("orders"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("domain_go_summary", "SELECT p_brand AS go, count(DISTINCT l_orderkey) AS genes, count(DISTINCT p_partkey) AS domains FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1")
def domain_go_summary(v):
    return C.domain_go_summary(v.table("orders").select(F.col("o_orderkey").alias("gene")), v.table("lineitem").select(F.col("l_orderkey").alias("gene"), F.col("l_partkey").alias("domain")), v.table("part").select(F.col("p_partkey").alias("domain"), F.col("p_brand").alias("go")))


@query("hit_functions", """WITH f AS (SELECT DISTINCT hit, 'F' || CAST(length(hit) AS VARCHAR) AS function FROM hits WHERE hit LIKE '%3'), q AS (SELECT query, max(function) AS any_f FROM hits LEFT JOIN f ON hits.hit = f.hit GROUP BY 1)
SELECT function, count(DISTINCT query) AS queries FROM (SELECT query, function FROM hits JOIN f ON hits.hit = f.hit UNION SELECT query, 'Unknown_function' FROM q WHERE any_f IS NULL) x GROUP BY 1""")
def hit_functions(v):
    return C.hit_functions(v.hits.select("query", "hit"), v.hits.where("hit LIKE '%3'").select("hit", F.concat(F.lit("F"), F.length("hit").cast("string")).alias("function")).distinct())


@query("acc_to_taxid", "SELECT o_orderkey AS acc, c_custkey AS gi, n_regionkey AS taxid FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def acc_to_taxid(v):
    o, c, n = v.table("orders"), v.table("customer"), v.table("nation")
    gi = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("gi"), F.col("n_regionkey").alias("taxid"))
    return C.acc_to_taxid(o.select(F.col("o_orderkey").alias("acc")), o.select(F.col("o_orderkey").alias("acc"), F.col("o_custkey").alias("gi")), gi)


@query("merge_pairwise", """WITH t AS (SELECT gene, species, species || group_id AS ortholog, count(*) OVER (PARTITION BY gene, species) AS n FROM orthogroups)
SELECT a.gene, a.ortholog AS ortholog_1, b.ortholog AS ortholog_2 FROM t a JOIN t b ON a.gene = b.gene WHERE a.species = 'S1' AND b.species = 'S2' AND a.n = 1 AND b.n = 1""")
def merge_pairwise(v):
    t = lambda k: v.orthogroups.where(F.col("species") == k).select("gene", F.concat("species", F.col("group_id").cast("string")).alias("ortholog"))
    return C.merge_pairwise([t("S1"), t("S2")])


@query("phylome_table", f"SELECT 'p' || p_partkey AS gene, {EACH(chr(99) + 'ount(DISTINCT group_id) FILTER (species = ' + chr(39) + '{s}' + chr(39) + ') AS {s}')} FROM part LEFT JOIN orthogroups o ON 'p' || p_partkey = o.gene GROUP BY 1")
def phylome_table(v):
    q = v.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("gene"))
    return C.phylome_table(q, v.orthogroups.select("gene", "species", F.col("group_id").alias("ortholog")), SP)


@query("hits_by_taxon", "WITH r AS (SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY line_no, bits, hit) AS n FROM hits) SELECT CASE WHEN hit LIKE 'S6%' THEN 'unknown' ELSE split_part(hit, '_', 1) END AS taxon, count(*) AS queries FROM r WHERE n = 1 GROUP BY 1")
def hits_by_taxon(v):
    t = v.hits.where("hit NOT LIKE 'S6%'").select("hit", F.split("hit", "_")[0].alias("taxon")).distinct()
    return C.hits_by_taxon(v.hits, t, ["line_no", "bits", "hit"])


@query("classify_orthology", """WITH g AS (SELECT group_id, count(DISTINCT gene) FILTER (species = 'S1') AS own, count(DISTINCT species) AS sp FROM orthogroups GROUP BY 1), k AS (SELECT o.gene, min(CASE WHEN sp = 1 THEN 3 WHEN own = 1 THEN 1 ELSE 2 END) AS r FROM orthogroups o JOIN g ON o.group_id = g.group_id WHERE species = 'S1' GROUP BY 1)
SELECT 'p' || p_partkey AS gene, CASE r WHEN 1 THEN 'ortholog' WHEN 2 THEN 'paralog' WHEN 3 THEN 'only' ELSE 'orphan' END AS class FROM part LEFT JOIN k ON 'p' || p_partkey = k.gene""")
def classify_orthology(v):
    return C.classify_orthology(v.orthogroups, v.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("gene")), "S1")


#: of the other genomes' maps: the blocks that they have, how far on these lie, and those that lie the other way round
MAPS = {"x": ("k % 3 <> 2", 500, "k % 2 = 1"), "y": ("k % 4 <> 3", 200, "k % 5 < 2")}


def _synteny(v, genes, *genomes):
    """The blocks of the maps that genes touch."""
    g = touched_blocks(genes, v.genome, 1000, "k").where("k BETWEEN 0 AND floor(length / 1000)")
    of = lambda name, there, on, back: F.when(F.expr(there), F.struct(F.lit(name).alias("genome"), F.lit(on).alias("on"), F.when(F.expr(back), "-").otherwise("+").alias("b_strand")))
    g = g.select("seqid", "k", F.inline(F.array_compact(F.array(*(of(name, *MAPS[name]) for name in genomes)))))
    at = F.col("k") * 1000
    block = F.concat_ws(":", "seqid", "k")
    return g.select("genome", block.alias("block"), F.col("seqid").alias("a_seqid"), (at + 1).alias("a_start"), (at + 1000).alias("a_stop"), F.col("seqid").alias("b_seqid"), (at + F.col("on") + 1).alias("b_start"), (at + F.col("on") + 1000).alias("b_stop"), "b_strand")


def _genes(v, kind):
    """The genes of a genome: what the features of a type span."""
    f = v.features.where(F.col("type") == kind).groupBy("seqid", "parent").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("strand").alias("strand"))
    return f.select(F.concat_ws(":", "seqid", "parent").alias("gene"), "seqid", "start", "stop", "strand")


SYN = """g0 AS (SELECT type, seqid || ':' || parent AS gene, seqid, min(start) AS start, max(stop) AS stop FROM features GROUP BY type, seqid, parent),
ga AS (SELECT gene, seqid, start, stop FROM g0 WHERE type = 'gene'), gb AS (SELECT gene, seqid, start, stop FROM g0 WHERE type = 'CDS'), s AS (SELECT seqid, k, k * 1000 + 1 AS a1, k * 1000 + 1000 AS a2, k * 1000 + 501 AS b1, k * 1000 + 1500 AS b2, CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END AS st FROM genome, unnest(range(0, length // 1000 + 1)) t(k) WHERE k % 3 <> 2),
p AS (SELECT ga.gene, s.seqid, CASE WHEN st <> '-' THEN b1 + greatest(start, a1) - a1 ELSE b2 - (least(stop, a2) - a1) END AS start, CASE WHEN st <> '-' THEN b1 + least(stop, a2) - a1 ELSE b2 - (greatest(start, a1) - a1) END AS stop FROM ga JOIN s ON ga.seqid = s.seqid AND ga.start <= a2 AND a1 <= ga.stop),
m AS (SELECT p.gene, gb.gene AS match FROM p LEFT JOIN gb ON p.seqid = gb.seqid AND p.start <= gb.stop AND gb.start <= p.stop),
tr AS (SELECT DISTINCT gene, coalesce(match, 'NO_GENES_IN_INTERVAL') AS match FROM m WHERE match IS NOT NULL OR gene NOT IN (SELECT gene FROM m WHERE match IS NOT NULL) UNION ALL SELECT gene, 'NO_SYNTENIC_ALIGNMENT' FROM ga WHERE gene NOT IN (SELECT gene FROM p))"""


@query("annotation_transfer", f"WITH {SYN} SELECT * FROM tr")
def annotation_transfer(v):
    a = _genes(v, "gene")
    return C.annotation_transfer(a, _synteny(v, a, "x"), _genes(v, "CDS"), 500)


#: the same with a third genome, the features of the type exon, that has a map of its own
THIRD = """gs AS (SELECT type, seqid || ':' || parent AS gene, min(strand) AS strand FROM features GROUP BY type, seqid, parent), gc AS (SELECT gene, seqid, start, stop FROM g0 WHERE type = 'exon'),
sy AS (SELECT seqid, k * 1000 + 1 AS a1, k * 1000 + 1000 AS a2, k * 1000 + 201 AS b1, k * 1000 + 1200 AS b2, CASE WHEN k % 5 < 2 THEN '-' ELSE '+' END AS st FROM genome, unnest(range(0, length // 1000 + 1)) t(k) WHERE k % 4 <> 3),
py AS (SELECT ga.gene, sy.seqid, CASE WHEN st <> '-' THEN b1 + greatest(start, a1) - a1 ELSE b2 - (least(stop, a2) - a1) END AS start, CASE WHEN st <> '-' THEN b1 + least(stop, a2) - a1 ELSE b2 - (greatest(start, a1) - a1) END AS stop FROM ga JOIN sy ON ga.seqid = sy.seqid AND ga.start <= a2 AND a1 <= ga.stop),
mx AS (SELECT DISTINCT p.gene, g.gene AS match, g.seqid, g.start, g.stop FROM p JOIN gb g ON p.seqid = g.seqid AND p.start <= g.stop AND g.start <= p.stop),
my AS (SELECT DISTINCT py.gene, g.gene AS match, g.seqid, g.start, g.stop FROM py JOIN gc g ON py.seqid = g.seqid AND py.start <= g.stop AND g.start <= py.stop),
nx AS (SELECT mx.gene, string_agg(match, ',' ORDER BY match) AS names, string_agg(DISTINCT CAST(seqid AS VARCHAR), ',' ORDER BY CAST(seqid AS VARCHAR)) AS seqids, min(start) AS start, max(stop) AS stop, string_agg(strand, ',' ORDER BY match) AS strands, count(*) AS n FROM mx JOIN gs ON gs.type = 'CDS' AND gs.gene = match GROUP BY mx.gene),
ny AS (SELECT my.gene, string_agg(match, ',' ORDER BY match) AS names, string_agg(DISTINCT CAST(seqid AS VARCHAR), ',' ORDER BY CAST(seqid AS VARCHAR)) AS seqids, min(start) AS start, max(stop) AS stop, string_agg(strand, ',' ORDER BY match) AS strands, count(*) AS n FROM my JOIN gs ON gs.type = 'exon' AND gs.gene = match GROUP BY my.gene)"""


@query("multiway_orthologs", f"""WITH {SYN}, {THIRD} SELECT ga.gene, ga.seqid, ga.start, ga.stop, gs.strand,
nx.names AS x_names, nx.seqids AS x_seqid, nx.start AS x_start, nx.stop AS x_stop, nx.strands AS x_strands, coalesce(nx.n, 0) = 1 AS x_single, CASE WHEN nx.n > 0 THEN NULL WHEN ga.gene IN (SELECT gene FROM p) THEN 'NO_GENES_IN_INTERVAL' ELSE 'NO_SYNTENIC_ALIGNMENT' END AS x_status,
ny.names AS y_names, ny.seqids AS y_seqid, ny.start AS y_start, ny.stop AS y_stop, ny.strands AS y_strands, coalesce(ny.n, 0) = 1 AS y_single, CASE WHEN ny.n > 0 THEN NULL WHEN ga.gene IN (SELECT gene FROM py) THEN 'NO_GENES_IN_INTERVAL' ELSE 'NO_SYNTENIC_ALIGNMENT' END AS y_status,
coalesce(nx.n, 0) <= 1 AND coalesce(ny.n, 0) <= 1 AS single
FROM ga JOIN gs ON gs.type = 'gene' AND gs.gene = ga.gene LEFT JOIN nx ON nx.gene = ga.gene LEFT JOIN ny ON ny.gene = ga.gene""")
def multiway_orthologs(v):
    a = _genes(v, "gene")
    return C.multiway_orthologs(a, _synteny(v, a, "x", "y"), {"x": _genes(v, "CDS"), "y": _genes(v, "exon")}, 500)


@query("synteny_links", "SELECT a.group_id AS block, a.species AS genome_a, b.species AS genome_b, a.gene AS seqid_a, b.gene AS seqid_b FROM orthogroups a JOIN orthogroups b ON a.group_id = b.group_id AND a.species < b.species")
def synteny_links(v):
    rows = v.orthogroups.select(F.col("group_id").alias("block"), F.col("species").alias("genome"), F.col("gene").alias("seqid"), F.lit(1).alias("start"), F.lit(2).alias("stop"))
    return C.synteny_links(rows).select("block", "genome_a", "genome_b", "seqid_a", "seqid_b")


@query("intersect_all", "SELECT gene FROM orthogroups WHERE species = 'S0' INTERSECT SELECT gene FROM orthogroups WHERE species = 'S1' INTERSECT SELECT gene FROM orthogroups WHERE species = 'S2'")
def intersect_all(v):
    return C.intersect_all([v.orthogroups.where(F.col("species") == s).select("gene") for s in SP[:3]])


@query("union_all", "SELECT query AS g FROM hits UNION ALL SELECT hit FROM hits")
def union_all(v):
    return C.union_all([v.hits.select(F.col("query").alias("g")), v.hits.select(F.col("hit").alias("g"))])


@query("distinct", "SELECT DISTINCT species, gene FROM orthogroups")
def distinct(v):
    return v.orthogroups.select("species", "gene").distinct()


@query("keep", "SELECT seqid, start, parent FROM features WHERE parent IN (SELECT 'g' || o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def keep(v):
    return C.keep(v.features, v.table("orders").where("o_orderkey % 5 = 0").select(F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("parent")), "parent").select("seqid", "start", "parent")


@query("top_k", "SELECT query, round(sum(bits), 2) AS total FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def top_k(v):
    return C.top_k(v.hits.groupBy("query").agg(F.round(F.sum("bits"), 2).alias("total")), "total", 25, "query")


@query("cap_per", "WITH r AS (SELECT query, hit, bits, line_no, row_number() OVER (PARTITION BY query ORDER BY bits DESC, hit, line_no) AS n FROM hits) SELECT query, hit, bits, line_no FROM r WHERE n <= 2")
def cap_per(v):
    return C.cap_per(v.hits, "query", 2, [F.desc("bits"), "hit", "line_no"]).select("query", "hit", "bits", "line_no")


@query("sample_loci", "SELECT chrom, pos FROM (SELECT DISTINCT chrom, pos FROM alleles) a ORDER BY md5('11:' || chrom || ':' || pos), chrom, pos LIMIT 50")
def sample_loci(v):
    return C.sample_loci(v.alleles.select("chrom", "pos").distinct(), 50, 11, ["chrom", "pos"])


@query("split_pairs", "SELECT query, line_no, bits, species AS sample_1, pid - 95 AS fold, CASE WHEN pid - 95 < 0 THEN 'DOWN' ELSE 'UP' END AS direction FROM (SELECT *, split_part(query, '_', 1) AS species FROM hits) h WHERE evalue < 0.03")
def split_pairs(v):
    h = v.hits.select("query", "line_no", "bits", F.split("query", "_")[0].alias("sample_1"), F.split("hit", "_")[0].alias("sample_2"), (F.col("pid") - 95).alias("fold"), F.when(F.col("evalue") < 0.03, "yes").otherwise("no").alias("significant"))
    return C.split_pairs(h).select("query", "line_no", "bits", "sample_1", "fold", "direction")


@query("sort_by", "SELECT query, bits, line_no FROM hits ORDER BY bits DESC")
def sort_by(v):
    return v.hits.select("query", "bits", "line_no").orderBy(F.col("bits").cast("double").desc())


@query("dedupe_consecutive", "SELECT event_id, lib FROM (SELECT event_id, seqid, lib, lag(lib) OVER (PARTITION BY seqid ORDER BY event_id) AS p FROM reads) r WHERE p IS NULL OR p <> lib")
def dedupe_consecutive(v):
    return C.dedupe_consecutive(v.reads, "lib", ["event_id"], ["seqid"]).select("event_id", "lib")
