"""Population-genetics and statistics queries (D21-D25, D52-D54, I) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import popgen as P
from loomspan.operators.intervals import touched_blocks
from loomspan.plans.reads import rounded
from loomspan.plans.views import query


def _stats(locus, cols):
    d = """CASE WHEN s >= 5 AND var > 0 THEN round((k - s / a1) / sqrt(var), 6) END"""
    per = "NULL::DOUBLE" if locus == "gene" else "round(k * 0.001, 9)"
    return f"""
WITH n AS (SELECT {cols}, chrom AS c, pos, allele, count(*) AS n FROM alleles WHERE allele IS NOT NULL GROUP BY ALL),
t AS (SELECT * EXCLUDE (allele, n), sum(n) AS called, count(*) AS kinds, sum(n * (n - 1)) AS same FROM n GROUP BY ALL HAVING sum(n) > 1),
g AS (SELECT * EXCLUDE (c, pos, called, kinds, same), sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END)::DOUBLE AS s, sum(1 - same::DOUBLE / (called * (called - 1))) AS k, max(called)::DOUBLE AS n FROM t GROUP BY ALL),
h AS (SELECT *, list_sum(list_transform(range(1, n::BIGINT), lambda i: 1.0::DOUBLE / i)) AS a1, list_sum(list_transform(range(1, n::BIGINT), lambda i: 1.0::DOUBLE / (i * i))) AS a2 FROM g),
v AS (SELECT *, ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1 * s + (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) * s * (s - 1) AS var FROM h)
SELECT {locus}, pop, s::BIGINT AS segregating, round(k, 6) AS pi, round(s / a1, 6) AS theta, {per} AS pi_per_base, {d} AS tajima_d FROM v"""


def _round(df):
    return df.withColumns({"pi": F.round("pi", 6), "theta": F.round("theta", 6), "pi_per_base": F.round("pi_per_base", 9), "tajima_d": F.round("tajima_d", 6)})


@query("popgen_stats", _stats('chrom, "window"', '(pos - 1) // 1000 AS "window", chrom, pop'))
def popgen_stats(v):
    return _round(P.popgen_stats(v.alleles))


@query("popgen_stats_by_gene", _stats("gene", "gene, pop"))
def popgen_stats_by_gene(v):
    return _round(P.popgen_stats(v.alleles, by_gene=True))


MK = """WITH s AS (SELECT gene, snptype, chrom, pos, count(DISTINCT allele) AS kinds, count(DISTINCT allele) FILTER (pop = 'CI') AS ci, count(DISTINCT allele) FILTER (pop = 'CP') AS cp FROM alleles WHERE allele IS NOT NULL GROUP BY ALL),
f AS (SELECT gene, snptype = 'Synonymous' AS syn, kinds <= 2 AS two, ci <= 1 AND cp <= 1 AS fixed FROM s)
SELECT gene, count(*) FILTER (two AND fixed AND syn) AS fixed_syn, count(*) FILTER (two AND fixed AND NOT syn) AS fixed_non, count(*) FILTER (two AND NOT fixed AND syn) AS poly_syn, count(*) FILTER (two AND NOT fixed AND NOT syn) AS poly_non, count(*) FILTER (NOT two) AS ambiguous FROM f GROUP BY gene"""


@query("mk_counts", MK)
def mk_counts(v):
    return P.mk_counts(v.alleles)


LFACT = "lgamma(({})::DOUBLE + 1)"
TABLE_P = "exp({} + {} + {} + {} - {}".format(*(LFACT.format(x) for x in ("r", "n - r", "k", "n - k", "n"))) + " - {} - {} - {} - {})".format(*(LFACT.format(x) for x in ("i", "r - i", "k - i", "n - r - k + i")))


@query("mk_test", f"""WITH c AS ({MK}), m AS (SELECT *, fixed_non + fixed_syn AS r, fixed_non + poly_non AS k, fixed_non + fixed_syn + poly_non + poly_syn AS n FROM c),
x AS (SELECT *, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS i FROM m), p AS (SELECT *, {TABLE_P} AS p FROM x), h AS (SELECT gene, p AS here FROM p WHERE i = fixed_non)
SELECT gene, fixed_syn, fixed_non, poly_syn, poly_non, ambiguous, round(least(1, sum(p) FILTER (i <= fixed_non)), 8) AS "left", round(least(1, sum(p) FILTER (i >= fixed_non)), 8) AS "right", round(least(1, sum(p) FILTER (p <= here * (1 + 1e-7))), 8) AS two_sided FROM p JOIN h USING (gene) GROUP BY ALL""")
def mk_test(v):
    return rounded(P.mk_test(v.alleles), "left", "right", "two_sided", digits=8)


@query("snp_classes", """WITH s AS (SELECT chrom, pos, count(DISTINCT allele) AS kinds, count(DISTINCT allele) FILTER (pop = 'CI') AS ci, count(DISTINCT allele) FILTER (pop = 'CP') AS cp FROM alleles WHERE allele IS NOT NULL GROUP BY ALL)
SELECT chrom, pos, CASE WHEN ci > 1 AND cp > 1 THEN 'both' WHEN ci > 1 THEN 'CI' WHEN cp > 1 THEN 'CP' WHEN kinds > 1 THEN 'divergence' ELSE 'none' END AS class FROM s""")
def snp_classes(v):
    return P.snp_classes(v.alleles)


@query("allele_freqs", "SELECT chrom, pos, pop, string_agg(allele || ':' || n, ',' ORDER BY allele) AS freqs FROM (SELECT chrom, pos, pop, allele, count(*) AS n FROM alleles WHERE allele IS NOT NULL GROUP BY ALL) x GROUP BY ALL")
def allele_freqs(v):
    return P.allele_freqs(v.alleles)


@query("snp_alignment", """WITH s AS (SELECT chrom, pos FROM alleles GROUP BY ALL HAVING avg(CASE WHEN allele IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.9 AND count(DISTINCT allele) > 1)
SELECT sample, a.chrom, a.pos // 10000 AS chunk, string_agg(coalesce(allele, '-'), '' ORDER BY a.pos) AS seq FROM alleles a JOIN s ON a.chrom = s.chrom AND a.pos = s.pos GROUP BY ALL""")
def snp_alignment(v):
    return P.snp_alignment(v.alleles, size=10_000)


@query("index_of_association", """WITH a AS (SELECT * FROM alleles WHERE pop = 'CI'), n AS (SELECT count(DISTINCT sample) AS n FROM a),
l AS (SELECT chrom, pos FROM a GROUP BY chrom, pos HAVING count(allele) = (SELECT n FROM n) AND count(DISTINCT allele) > 1 ORDER BY md5('3:' || chrom || ':' || pos), chrom, pos LIMIT 50), g AS (SELECT a.chrom, a.pos, sample, allele FROM a JOIN l ON a.chrom = l.chrom AND a.pos = l.pos),
d AS (SELECT x.sample, y.sample AS s2, sum(CASE WHEN x.allele <> y.allele THEN 1 ELSE 0 END) AS d FROM g x JOIN g y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < y.sample GROUP BY ALL),
h AS (SELECT chrom, pos, 1 - sum(pow(k::DOUBLE / (SELECT n FROM n), 2)) AS h FROM (SELECT chrom, pos, allele, count(*) AS k FROM g GROUP BY ALL) z GROUP BY ALL)
SELECT (SELECT count(*) FROM h) AS loci, round((SELECT var_samp(d) FROM d), 6) AS vo, round((SELECT sum(h * (1 - h)) FROM h), 6) AS ve, round((SELECT var_samp(d) FROM d) / (SELECT sum(h * (1 - h)) FROM h) - 1, 6) AS ia""")
def index_of_association(v):
    return rounded(P.index_of_association(v.alleles, "CI"), "vo", "ve", "ia")


GT = "(SELECT a.chrom, a.pos, a.sample, a.ref, a.allele AS x, b.allele AS y FROM alleles a JOIN alleles b ON a.chrom = b.chrom AND a.pos = b.pos AND b.sample = (a.sample + 1) % 12 WHERE a.allele IS NOT NULL AND b.allele IS NOT NULL)"


def _genotypes(v):
    b = v.alleles.select("chrom", "pos", F.pmod(F.col("sample") + 11, F.lit(12)).alias("sample"), F.col("allele").alias("y"))
    return v.alleles.join(b, ["chrom", "pos", "sample"]).where("allele IS NOT NULL AND y IS NOT NULL").withColumn("gt", F.array("allele", "y"))


@query("zygosity_bins", f"SELECT chrom, sample, (pos - 1) // 10000 AS bin, count(*) FILTER (x = y) AS hom, count(*) FILTER (x <> y) AS het FROM {GT} g WHERE x <> y OR x <> ref GROUP BY ALL")
def zygosity_bins(v):
    return P.zygosity_bins(_genotypes(v))


@query("singleton_counts", """SELECT sample, count(*) FILTER (n = 2) AS "D", count(*) FILTER (n = 1) AS "S" FROM (SELECT * FROM alleles WHERE pop = 'CI') a JOIN (SELECT chrom, pos, allele, count(*) AS n FROM alleles WHERE allele IS NOT NULL AND pop = 'CI' GROUP BY ALL HAVING count(*) <= 2) k ON a.chrom = k.chrom AND a.pos = k.pos AND a.allele = k.allele GROUP BY sample""")
def singleton_counts(v):
    return P.singleton_counts(v.alleles.where("pop = 'CI'"))


@query("ref_counts", "SELECT sample, count(*) FILTER (allele = ref) AS ref, count(*) FILTER (allele <> ref) AS nonref, count(*) FILTER (allele IS NULL) AS missing FROM alleles GROUP BY sample")
def ref_counts(v):
    return P.ref_counts(v.alleles)


@query("pairwise_alleles", """WITH f AS (SELECT chrom, pos FROM alleles WHERE pop = 'CI' GROUP BY ALL HAVING count(allele) = count(*)), a AS (SELECT a.* FROM (SELECT * FROM alleles WHERE pop = 'CI') a JOIN f ON a.chrom = f.chrom AND a.pos = f.pos)
SELECT x.sample AS sample_a, y.sample AS sample_b, count(*) FILTER (x.allele = y.allele) AS shared, 2 * count(*) FILTER (x.allele <> y.allele) AS different FROM a x JOIN a y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < y.sample GROUP BY ALL""")
def pairwise_alleles(v):
    return P.pairwise_alleles(v.alleles.where("pop = 'CI'"))


#: genotypes of two alleles, as the loop over sites and pairs of strains counts them
@query("pairwise_genotypes", f"""WITH g0 AS (SELECT * FROM {GT} z WHERE sample < 5), f AS (SELECT chrom, pos FROM g0 GROUP BY ALL HAVING count(*) = 5), g AS (SELECT chrom, pos, sample, list_distinct([x, y]) AS s FROM g0 JOIN f USING (chrom, pos))
SELECT a.sample AS sample_a, b.sample AS sample_b, CAST(sum(len(list_intersect(a.s, b.s))) AS BIGINT) AS shared, CAST(sum(len(a.s) + len(b.s) - 2 * len(list_intersect(a.s, b.s))) AS BIGINT) AS different
FROM g a JOIN g b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample < b.sample GROUP BY ALL""")
def pairwise_genotypes(v):
    return P.pairwise_alleles(_with_gaps(v), 1000)


@query("reference_alleles", f"""WITH g0 AS (SELECT * FROM {GT} z WHERE sample < 5), f AS (SELECT chrom, pos FROM g0 GROUP BY ALL HAVING count(*) = 5)
SELECT sample, CAST(count(*) FILTER (x <> y) AS BIGINT) AS het, CAST(count(*) FILTER (f.pos IS NOT NULL AND (x = ref OR y = ref)) AS BIGINT) AS shared_ref, CAST(count(*) FILTER (f.pos IS NOT NULL AND x <> ref AND y <> ref) AS BIGINT) AS diff_ref FROM g0 LEFT JOIN f USING (chrom, pos) GROUP BY sample""")
def reference_alleles(v):
    return P.reference_alleles(_with_gaps(v))


def _with_gaps(v):
    """Genotypes of two alleles of five samples, null where either is missing."""
    b = v.alleles.select("chrom", "pos", F.pmod(F.col("sample") + 11, F.lit(12)).alias("sample"), F.col("allele").alias("y"))
    g = v.alleles.join(b, ["chrom", "pos", "sample"]).where("sample < 5")
    return g.select("chrom", "pos", "sample", "ref", F.when(F.col("allele").isNotNull() & F.col("y").isNotNull(), F.array("allele", "y")).alias("gt"))


@query("indel_matrix", "SELECT sample, chrom, pos // 10000 AS chunk, string_agg(CASE WHEN allele <> ref THEN '1' ELSE '0' END, '' ORDER BY pos) AS states FROM alleles GROUP BY ALL")
def indel_matrix(v):
    return P.indel_matrix(v.alleles.where("allele <> ref").select("chrom", "pos", "sample", F.lit(True).alias("present")).unionByName(v.alleles.where("sample = 0").select("chrom", "pos", "sample", (F.coalesce(F.col("allele") != F.col("ref"), F.lit(False))).alias("present"))), 10_000)


@query("pn_ps", """WITH c AS (SELECT gene, count(*) FILTER (snptype <> 'Synonymous') AS a, count(*) FILTER (snptype = 'Synonymous') AS b FROM (SELECT DISTINCT gene, chrom, pos, snptype FROM alleles) s GROUP BY 1) SELECT gene, a AS pn, b AS ps, round(a::DOUBLE / nullif(b, 0), 6) AS ratio FROM c""")
def pn_ps(v):
    c = v.alleles.select("gene", "chrom", "pos", "snptype").distinct().groupBy("gene").pivot("snptype", ["Non-Synonymous", "Synonymous"]).count()
    return rounded(P.pn_ps(c, ["Non-Synonymous"], ["Synonymous"]).select("gene", "pn", "ps", "ratio"), "ratio")


@query("allele_dosage", "SELECT chrom, pos, sample, CASE WHEN allele IS NULL THEN NULL WHEN allele = ref THEN 0.5::DOUBLE ELSE 1.0 END AS dosage FROM alleles")
def allele_dosage(v):
    g = v.alleles.withColumn("gt", F.when(F.col("allele").isNull(), "./.").when(F.col("allele") == F.col("ref"), "0/1").otherwise("1/1"))
    return P.allele_dosage(g).select("chrom", "pos", "sample", "dosage")


@query("structure_codes", f"SELECT chrom, pos, sample, CASE WHEN x <> y THEN 0 WHEN x = ref THEN 0 ELSE 1 END AS code1, CASE WHEN x <> y THEN 2 WHEN x = ref THEN 0 ELSE 1 END AS code2 FROM {GT} g")
def structure_codes(v):
    code = lambda c: (F.col(c) != F.col("ref")).cast("int")
    g = _genotypes(v).withColumn("gt", F.when(F.col("allele") == F.col("y"), F.array(code("allele"))).otherwise(F.array(F.lit(0), F.lit(1))))
    return P.structure_codes(g).select("chrom", "pos", "sample", "code1", "code2")


@query("consensus_codes", "SELECT chrom, pos, pop, map(['A','C','G','T','AG','CT','CG','AT','GT','AC'], ['A','C','G','T','R','Y','S','W','K','M'])[array_to_string(list_sort(list_distinct(list(allele) FILTER (allele IS NOT NULL))), '')] AS code FROM alleles GROUP BY ALL")
def consensus_codes(v):
    return P.consensus_codes(v.alleles)


@query("values_by_region", "SELECT f.seqid, f.start AS pos, score AS value, CASE (r.x % 2) WHEN 0 THEN 'HOT' ELSE 'COLD' END AS class FROM features f JOIN (SELECT seqid, x, x * 700 + 1 AS a, x * 700 + 300 AS b FROM genome, unnest(range(0, length // 700 + 1)) t(x)) r ON f.seqid = r.seqid AND f.start BETWEEN a AND b")
def values_by_region(v):
    x = touched_blocks(v.features, v.genome, 700, "x", stop="start").where("x BETWEEN 0 AND floor(length / 700)")
    r = x.select("seqid", (F.col("x") * 700 + 1).alias("start"), (F.col("x") * 700 + 300).alias("stop"), F.when(F.col("x") % 2 == 0, "HOT").otherwise("COLD").alias("class"))
    return P.values_by_region(v.features.select("seqid", F.col("start").alias("pos"), F.col("score").alias("value")), r)


@query("ks_two_sample", """WITH d AS (SELECT score::DOUBLE AS v, type FROM features WHERE type IN ('CDS', 'exon')), k AS (SELECT v, count(*) FILTER (type = 'CDS') AS a, count(*) FILTER (type = 'exon') AS b FROM d GROUP BY 1), n AS (SELECT sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM k),
c AS (SELECT *, sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb FROM k, n)
SELECT round(max(abs(ca / na - cb / nb)), 9) AS ks, round(sum((ca + cb - (a + b - 1) / 2.0) * a)::DOUBLE, 1) AS rank_sum, max(na)::BIGINT AS n_one, max(nb)::BIGINT AS n_two,
  round((SELECT avg(v) FROM d WHERE type = 'CDS'), 3) AS mean_one, round((SELECT avg(v) FROM d WHERE type = 'exon'), 3) AS mean_two, round((SELECT var_samp(v) FROM d WHERE type = 'CDS') / (SELECT var_samp(v) FROM d WHERE type = 'exon'), 6) AS f_ratio FROM c""")
def ks_two_sample(v):
    out = P.ks_two_sample(v.features, "score", "type", "CDS", "exon")
    return out.select(F.round("ks", 9).alias("ks"), F.round("rank_sum", 1).alias("rank_sum"), "n_one", "n_two", F.round("mean_one", 3).alias("mean_one"), F.round("mean_two", 3).alias("mean_two"), F.round("f_ratio", 6).alias("f_ratio"))


#: the series and integrals of the three p: Kolmogorov's, the error function's, and the beta density by Simpson's rule
@query("compare_groups", """WITH k(one, two) AS (VALUES ('CDS', 'exon'), ('exon', 'gene'), ('gene', 'CDS')), d AS (SELECT k.*, score::DOUBLE AS v, type = one AS first FROM features JOIN k ON type IN (one, two)),
g AS (SELECT one, two, v, count(*) FILTER (first) AS a, count(*) FILTER (NOT first) AS b FROM d GROUP BY ALL), n AS (SELECT one, two, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, sum(pow(a + b, 3) - (a + b)) AS ties FROM g GROUP BY ALL),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g JOIN n USING (one, two) WINDOW w AS (PARTITION BY one, two ORDER BY v)),
s AS (SELECT one, two, max(abs(ca / na - cb / nb)) AS ks, sum((ca + cb - (a + b - 1) / 2.0) * a)::DOUBLE AS w, any_value(na) AS na, any_value(nb) AS nb, any_value(ties) AS ties FROM c GROUP BY ALL),
m AS (SELECT one, two, var_samp(v) FILTER (first) / var_samp(v) FILTER (NOT first) AS f FROM d GROUP BY ALL),
t AS (SELECT *, sqrt(na * nb / (na + nb)) * ks AS lam, w - na * (na + 1) / 2 - na * nb / 2 AS off, na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1))) AS var, (na - 1) / 2 AS p, (nb - 1) / 2 AS q FROM s JOIN m USING (one, two)),
u AS (SELECT *, abs(CASE WHEN off = 0 THEN 0 ELSE abs(off) - 0.5 END) / sqrt(2 * var) AS z, p * f / (p * f + q) AS x, greatest(0, p / (p + q) - 14 * sqrt(p * q / ((p + q) * (p + q) * (p + q + 1)))) AS x0 FROM t),
y AS (SELECT *, (x - x0) / 4000 AS h, lgamma(p + q) - lgamma(p) - lgamma(q) AS lb FROM u),
i AS (SELECT *, list_sum(list_transform(range(0, 4001), lambda k: CASE WHEN x0 + k * h <= 0 THEN 0 ELSE CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(lb + (p - 1) * ln(x0 + k * h) + (q - 1) * ln(1 - x0 - k * h)) END)) * h / 3 AS low FROM y)
SELECT one, two, round(ks, 9) AS ks, round(CASE WHEN lam < 1 THEN 1 - sqrt(2 * pi()) / lam * list_sum(list_transform(range(1, 40), lambda k: exp(-pow(2 * k - 1, 2) * pi() * pi() / (8 * lam * lam)))) ELSE 2 * list_sum(list_transform(range(1, 40), lambda k: pow(-1, k - 1) * exp(-2 * k * k * lam * lam))) END, 8) AS ks_p,
  round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda k: pow(-1, k) * exp((2 * k + 1) * ln(greatest(z, 1e-12)) - lgamma(k + 1)) / (2 * k + 1))), 8) AS rank_p, round(least(1, 2 * least(low, 1 - low)), 8) AS f_p FROM i""")
def compare_groups(v):
    out = P.compare_groups(v.features, "score", "type", [("CDS", "exon"), ("exon", "gene"), ("gene", "CDS")])
    return out.select("one", "two", F.round("ks", 9).alias("ks"), *(F.round(c, 8).alias(c) for c in ("ks_p", "rank_p", "f_p")))


@query("summary_stats", "SELECT type, count(score) AS n, min(score::DOUBLE) AS min, round(quantile_cont(score::DOUBLE, 0.25), 4) AS q1, round(quantile_cont(score::DOUBLE, 0.5), 4) AS median, round(quantile_cont(score::DOUBLE, 0.75), 4) AS q3, max(score::DOUBLE) AS max FROM features GROUP BY type")
def summary_stats(v):
    return rounded(P.summary_stats(v.features, "score", "type"), "q1", "median", "q3", digits=4)
