"""Queries of small projections (B9, B10, B18, B20-B26, C21, D55) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import features as G
from loomspan.operators import reads as D
from loomspan.operators import records as R
from loomspan.plans.reads import rounded
from loomspan.plans.views import query


@query("select_named", "SELECT p_partkey, p_brand FROM part")
def select_named(v):
    return R.select_named(v.table("part"), ["p_partkey", "p_brand"])


@query("casava_pass", "SELECT event_id FROM events WHERE event_id % 4 <> 0")
def casava_pass(v):
    e = v.table("events").select("event_id", F.concat(F.lit("1:"), F.when(F.col("event_id") % 4 == 0, "Y").otherwise("N"), F.lit(":0:")).alias("desc"))
    return D.casava_pass(e).select("event_id")


@query("mask_uncalled", "SELECT block, row_id, replace(aln, '-', 'N') AS seq FROM aln")
def mask_uncalled(v):
    return D.mask_uncalled(v.aln.withColumnRenamed("aln", "seq")).select("block", "row_id", "seq")


@query("add_variant_id", "SELECT DISTINCT chrom, pos, chrom || '.' || pos AS id FROM alleles")
def add_variant_id(v):
    return G.add_variant_id(v.alleles.select("chrom", "pos").distinct())


@query("attr_to_seq", "SELECT 's' || id AS id, seq FROM seqs WHERE seq <> ''")
def attr_to_seq(v):
    f = v.seqs.select(F.lit("c").alias("seqid"), F.lit(1).alias("start"), F.create_map(F.lit("ID"), F.concat(F.lit("s"), F.col("id").cast("string")), F.lit("translation"), F.col("seq")).alias("attrs"))
    return R.attr_to_seq(f)


@query("soap_to_eland", """SELECT '>r' || event_id AS name, base5 || base3 AS seq, CASE WHEN weight = 1 THEN 'U' ELSE 'R' END || least(event_id % 4, 2) AS code, CASE WHEN event_id % 4 = 0 THEN weight ELSE 0 END AS hits0, CASE WHEN event_id % 4 = 1 THEN weight ELSE 0 END AS hits1, CASE WHEN event_id % 4 >= 2 THEN weight ELSE 0 END AS hits2, seqid, start, CASE WHEN strand = '+' THEN 'F' ELSE 'R' END AS direction FROM reads""")
def soap_to_eland(v):
    r = v.reads.select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("name"), F.concat("base5", "base3").alias("seq"), F.col("weight").alias("hits"), "seqid", "start", "strand", (F.col("event_id") % 4).alias("n_mismatch"))
    return R.soap_to_eland(r)


@query("relocate_track", "SELECT block % 7 AS seqid, block * 100 + 1 AS start, block * 100 + length(aln) AS stop, row_id AS value FROM aln")
def relocate_track(v):
    t = v.aln.select("block", F.lit(1).alias("start"), F.length("aln").alias("stop"), F.col("row_id").alias("value"))
    return R.relocate_track(t, v.aln.select("block").distinct().select("block", (F.col("block") % 7).alias("seqid"), (F.col("block") * 100 + 1).alias("start")))


GENES = "SELECT seqid || ':' || parent AS gene, seqid, min(start) AS start, max(stop) AS stop FROM features GROUP BY seqid, parent"


@query("block_bounds", f"""WITH g AS ({GENES}), b AS (SELECT seqid AS block, min(gene) AS first, max(gene) AS last FROM g GROUP BY 1) SELECT block, x.seqid, least(x.start, y.start) AS start, greatest(x.stop, y.stop) AS stop FROM b JOIN g x ON b.first = x.gene JOIN g y ON b.last = y.gene WHERE x.seqid = y.seqid""")
def block_bounds(v):
    g = v.features.groupBy("seqid", "parent").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select(F.concat_ws(":", F.col("seqid").cast("string"), "parent").alias("gene"), "seqid", "start", "stop")
    return R.block_bounds(g.groupBy(F.col("seqid").alias("block")).agg(F.min("gene").alias("first"), F.max("gene").alias("last")), g)


@query("peaks_to_features", "SELECT seqid, 'peaks' AS source, 'peak' AS type, start, stop, score::DOUBLE AS score, NULL::VARCHAR AS strand, 'peak.' || seqid || '.' || start AS id FROM features")
def peaks_to_features(v):
    return R.peaks_to_features(v.features).withColumn("id", F.col("attrs")["ID"]).drop("attrs")


@query("repeats_to_features", "SELECT seqid, 'repeats' AS source, 'repeat' AS type, start, stop, score::DOUBLE AS score, strand, parent || ':' || type AS id FROM (SELECT seqid, start, stop, score, strand, parent, type FROM features) f")
def repeats_to_features(v):
    return R.repeats_to_features(v.features.select("seqid", "start", "stop", "score", "strand", F.col("parent").alias("family"), F.col("type").alias("class"))).withColumn("id", F.col("attrs")["ID"]).drop("attrs")


@query("snps_to_features", """SELECT chrom AS seqid, 'snps' AS source, 'SNP' AS type, pos AS start, pos AS stop, count(*)::DOUBLE AS score, '+' AS strand, chrom || '.' || pos || '.' || map(['A','C','G','T','AG','CT','CG','AT','GT','AC'], ['A','C','G','T','R','Y','S','W','K','M'])[array_to_string(list_sort(list_distinct(list(allele))), '')] AS id FROM alleles WHERE allele IS NOT NULL GROUP BY chrom, pos""")
def snps_to_features(v):
    return R.snps_to_features(v.alleles).withColumn("id", F.col("attrs")["ID"]).drop("attrs")


@query("repeat_summary", "SELECT type AS class, seqid AS family, count(*) AS copies, CAST(sum(stop - start + 1) AS BIGINT) AS bases, round(avg(score), 8) AS score FROM features GROUP BY type, seqid")
def repeat_summary(v):
    return rounded(R.repeat_summary(v.features.select(F.col("type").alias("class"), F.col("seqid").alias("family"), "start", "stop", "score")), "score", digits=8)


@query("domain_summary", "SELECT query AS gene, 'D' || CAST(qstart % 20 AS VARCHAR) AS domain, min(qstart) AS first, max(qstart + 9) AS last, count(*) AS copies, max(bits) AS score FROM hits GROUP BY ALL")
def domain_summary(v):
    h = v.hits.select(F.col("query").alias("gene"), F.concat(F.lit("D"), (F.col("qstart") % 20).cast("string")).alias("domain"), F.col("qstart").alias("ali_from"), (F.col("qstart") + 9).alias("ali_to"), F.col("bits").alias("score"))
    return R.domain_summary(h)
