"""Population genetics on long allele tables (chrom, pos, gene, snptype, pop, sample, ref, allele)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import iupac
from loomspan.functions.statistics import two_sample_p
from loomspan.operators.intervals import earlier
from loomspan.sources.scratch import kept


def _lfact(n):
    return np.array([math.lgamma(x + 1.0) for x in n])


def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    """Left, right and two-sided p of 2x2 tables."""
    out = []
    for w, x, y, z in zip(a, b, c, d):
        r, k, n = w + x, w + y, w + x + y + z
        i = np.arange(max(0, r + k - n), min(r, k) + 1)
        const = math.lgamma(r + 1) + math.lgamma(n - r + 1) + math.lgamma(k + 1) + math.lgamma(n - k + 1) - math.lgamma(n + 1)
        p = np.exp(const - _lfact(i) - _lfact(r - i) - _lfact(k - i) - _lfact(n - r - k + i))
        here = p[int(w) - int(i[0])]
        out.append((min(1.0, float(p[i <= w].sum())), min(1.0, float(p[i >= w].sum())), min(1.0, float(p[p <= here * (1 + 1e-7)].sum()))))
    return pd.DataFrame(out, columns=["left", "right", "two_sided"])


def site_counts(alleles: DataFrame, by: list[str]) -> DataFrame:
    """Called alleles of each site: number, distinct ones, and sum of n (n - 1) over the alleles."""
    n = alleles.where("allele IS NOT NULL").groupBy(*by, "allele").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.sum("n").alias("called"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))


def popgen_stats(alleles: DataFrame, window: int = 1000, by_pop: bool = True, by_gene: bool = False, least_sites: int = 5) -> DataFrame:
    """Segregating sites, pi, Watterson's theta and Tajima's D per window (or gene), per base for windows; D only
    from ``least_sites`` segregating sites on. The sample size of a locus is the largest of its sites."""
    pop = ["pop"] if by_pop else []
    locus = ["gene"] if by_gene else ["chrom", "window"]
    a = alleles if by_gene else alleles.withColumn("window", F.floor((F.col("pos") - 1) / window))
    s = site_counts(a, [*locus, *pop, *(["chrom"] if by_gene else []), "pos"]).where("called > 1")
    pi = F.lit(1.0) - F.col("same") / (F.col("called") * (F.col("called") - 1))
    g = s.groupBy(*locus, *pop).agg(F.sum((F.col("kinds") > 1).cast("int")).alias("s"), F.sum(pi).alias("k"), F.max("called").alias("n"))
    up = F.sequence(F.lit(1), (F.col("n") - 1).cast("int"))
    a1 = F.aggregate(up, F.lit(0.0), lambda t, i: t + F.lit(1.0) / i)
    a2 = F.aggregate(up, F.lit(0.0), lambda t, i: t + F.lit(1.0) / (i * i))
    g = g.withColumns({"a1": a1, "a2": a2})
    n, S = F.col("n").cast("double"), F.col("s").cast("double")
    c1 = (n + 1) / (3 * (n - 1)) - 1 / F.col("a1")
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (F.col("a1") * n) + F.col("a2") / (F.col("a1") * F.col("a1"))
    var = c1 / F.col("a1") * S + c2 / (F.col("a1") * F.col("a1") + F.col("a2")) * S * (S - 1)
    d = F.when((F.col("s") >= least_sites) & (var > 0), (F.col("k") - S / F.col("a1")) / F.sqrt(var))
    per = F.lit(None).cast("double") if by_gene else F.lit(1.0 / window)
    return g.select(*locus, *pop, F.col("s").alias("segregating"), F.col("k").alias("pi"), (S / F.col("a1")).alias("theta"), (F.col("k") * per).alias("pi_per_base"), d.alias("tajima_d"))


def mk_counts(alleles: DataFrame) -> DataFrame:
    """McDonald-Kreitman counts per gene: fixed (one allele within each population) and polymorphic sites of both
    classes; sites of more than two alleles go to ``ambiguous``."""
    site = ["gene", "snptype", "chrom", "pos"]
    # each allele of a site once, with the populations that have it: rows are not multiplied by the counts that are taken of them
    own = alleles.where("allele IS NOT NULL").groupBy(*site, "allele").agg(*(F.max(F.when(F.col("pop") == p, 1).otherwise(0)).alias(p) for p in ("CI", "CP")))
    s = own.groupBy(*site).agg(F.count(F.lit(1)).alias("kinds"), *(F.sum(p).alias(p) for p in ("CI", "CP")))
    two, fixed, syn = F.col("kinds") <= 2, (F.col("CI") <= 1) & (F.col("CP") <= 1), F.col("snptype") == "Synonymous"
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return s.groupBy("gene").agg(n(two & fixed & syn)("fixed_syn"), n(two & fixed & ~syn)("fixed_non"), n(two & ~fixed & syn)("poly_syn"), n(two & ~fixed & ~syn)("poly_non"), n(~two)("ambiguous"))


def mk_test(alleles: DataFrame) -> DataFrame:
    """``mk_counts`` with Fisher's exact test of the four counts."""
    fisher = F.pandas_udf(fisher_exact, "left double, right double, two_sided double")
    return mk_counts(alleles).withColumn("p", fisher("fixed_non", "fixed_syn", "poly_non", "poly_syn")).select("gene", "fixed_syn", "fixed_non", "poly_syn", "poly_non", "ambiguous", "p.*")


def snp_classes(alleles: DataFrame) -> DataFrame:
    """Sites by where they vary: both, one population alone, between the populations (divergence), or none."""
    s = alleles.where("allele IS NOT NULL").groupBy("chrom", "pos").agg(F.countDistinct("allele").alias("kinds"), *(F.countDistinct(F.when(F.col("pop") == p, F.col("allele"))).alias(p) for p in ("CI", "CP")))
    kind = F.when((F.col("CI") > 1) & (F.col("CP") > 1), "both").when(F.col("CI") > 1, "CI").when(F.col("CP") > 1, "CP").when(F.col("kinds") > 1, "divergence").otherwise("none")
    return s.select("chrom", "pos", kind.alias("class"))


def allele_freqs(alleles: DataFrame) -> DataFrame:
    """Counts of the alleles of each site and population as ``A:3,C:1``."""
    n = alleles.where("allele IS NOT NULL").groupBy("chrom", "pos", "pop", "allele").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("chrom", "pos", "pop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("allele", "n"))), lambda x: F.concat(x["allele"], F.lit(":"), x["n"].cast("string"))), ",").alias("freqs"))


def snp_alignment(alleles: DataFrame, least_called: float = 0.9, invariant: bool = False, size: int = 100_000) -> DataFrame:
    """The alleles of each sample in order of the sites, '-' where not called; sites called in fewer than
    ``least_called`` of the samples, and without ``invariant`` those that don't vary, are left out. A sample's row is
    its pieces by chrom and chunk, one for each ``size`` positions; it is never one value."""
    s = alleles.groupBy("chrom", "pos").agg(F.avg(F.col("allele").isNotNull().cast("double")).alias("called"), F.countDistinct("allele").alias("kinds"))
    s = s.where((F.col("called") >= least_called) & ((F.col("kinds") > 1) | F.lit(invariant)))
    rows = alleles.join(s.select("chrom", "pos"), ["chrom", "pos"]).select("sample", "chrom", F.floor(F.col("pos") / size).alias("chunk"), "pos", F.coalesce("allele", F.lit("-")).alias("a"))
    return rows.groupBy("sample", "chrom", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x["a"]), "").alias("seq"))


def index_of_association(alleles: DataFrame, pop: str, n_loci: int = 50, seed: int = 3) -> DataFrame:
    """I_A = V_O / V_E - 1 of one population over ``n_loci`` sites by a seeded hash at which all samples are called:
    V_O is the variance of the pairwise numbers of differing loci, V_E the sum over loci of h (1 - h)."""
    a = alleles.where(F.col("pop") == pop)
    n = F.broadcast(a.agg(F.countDistinct("sample").alias("n")))  # one row
    loci = a.groupBy("chrom", "pos").agg(F.count("allele").alias("c"), F.countDistinct("allele").alias("kinds")).join(n, how="cross").where("c = n AND kinds > 1")
    loci = loci.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("chrom").cast("string"), F.col("pos").cast("string")).cast("binary")), "chrom", "pos").limit(n_loci)
    g = a.join(F.broadcast(loci.select("chrom", "pos")), ["chrom", "pos"]).select("chrom", "pos", "sample", "allele")  # n_loci rows
    b = g.select("chrom", "pos", F.col("sample").alias("s2"), F.col("allele").alias("a2"))
    pairs = g.join(b, ["chrom", "pos"]).where("sample < s2")
    vo = pairs.groupBy("sample", "s2").agg(F.sum((F.col("allele") != F.col("a2")).cast("int")).alias("d")).agg(F.var_samp("d").alias("vo"))
    h = g.groupBy("chrom", "pos", "allele").agg(F.count(F.lit(1)).alias("k")).join(n, how="cross").groupBy("chrom", "pos").agg((F.lit(1.0) - F.sum(F.pow(F.col("k") / F.col("n"), F.lit(2.0)))).alias("h"))
    ve = h.agg(F.sum(F.col("h") * (1 - F.col("h"))).alias("ve"), F.count(F.lit(1)).alias("loci"))
    return vo.join(F.broadcast(ve), how="cross").select("loci", "vo", "ve", (F.col("vo") / F.col("ve") - 1).alias("ia"))


def zygosity_bins(alleles: DataFrame, size: int = 10_000) -> DataFrame:
    """Homozygous (not the reference) and heterozygous calls per chromosome, sample and bin (alleles: array column ``gt``)."""
    k = F.size(F.array_distinct("gt"))
    z = alleles.where(F.col("gt").isNotNull()).withColumn("zyg", F.when(k > 1, "het").when(F.col("gt")[0] != F.col("ref"), "hom")).where("zyg IS NOT NULL")
    return z.groupBy("chrom", "sample", F.floor((F.col("pos") - 1) / size).alias("bin")).pivot("zyg", ["hom", "het"]).count().fillna(0, ["hom", "het"])


def singleton_counts(alleles: DataFrame) -> DataFrame:
    """Per sample, sites at which its allele is seen once (S) or twice (D)."""
    n = alleles.where("allele IS NOT NULL").groupBy("chrom", "pos", "allele").agg(F.count(F.lit(1)).alias("n")).where("n <= 2")
    r = alleles.join(n, ["chrom", "pos", "allele"]).withColumn("kind", F.when(F.col("n") == 1, "S").otherwise("D"))
    return r.groupBy("sample").pivot("kind", ["D", "S"]).count().fillna(0, ["D", "S"])


def ref_counts(alleles: DataFrame) -> DataFrame:
    same = F.col("allele") == F.col("ref")
    return alleles.groupBy("sample").agg(F.sum(F.when(same, 1).otherwise(0)).alias("ref"), F.sum(F.when(~same, 1).otherwise(0)).alias("nonref"), F.sum(F.when(same.isNull(), 1).otherwise(0)).alias("missing"))


def _alleles_of(alleles: DataFrame) -> DataFrame:
    """chrom, pos, sample and ``gt``, the array of its alleles: that of a column gt, or the one allele. '.' and nulls are missing."""
    gt = F.col("gt") if "gt" in alleles.columns else F.array("allele")
    missing = gt.isNull() | (F.size(gt) == 0) | F.exists(F.coalesce(gt, F.array().cast("array<string>")), lambda x: x.isNull() | (x == "."))
    return alleles.select("chrom", "pos", "sample", *(["ref"] if "ref" in alleles.columns else []), F.array_distinct(gt).alias("gt"), missing.alias("missing"))


def reference_alleles(alleles: DataFrame) -> DataFrame:
    """Per sample (alleles: chrom, pos, sample, ref and gt, an array, or allele): sites at which it is heterozygous, and
    over the sites at which no sample is missing those at which it has the reference allele, and those at which it hasn't."""
    a = _alleles_of(alleles)
    full = a.groupBy("chrom", "pos").agg(F.max("missing").alias("some")).where("NOT some")
    a = a.join(full, ["chrom", "pos"], "left")
    whole, has = F.col("some").isNotNull(), F.array_contains("gt", F.col("ref"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return a.groupBy("sample").agg(count(F.size("gt") == 2).alias("het"), count(whole & has).alias("shared_ref"), count(whole & ~has).alias("diff_ref"))


def pairwise_alleles(alleles: DataFrame, size: int = 16_384) -> DataFrame:
    """Shared and different alleles of each pair of samples over the sites at which none is missing (alleles: chrom, pos,
    sample and gt, an array, or allele): an allele of both is shared, one of either alone different.

    The alleles of the sites of ``size`` positions are numbered, and a sample's are the bits of a few words; pairs compare
    these by the number of bits that are set in both or in one, so that a row is a pair and a chunk, not a pair and a site."""
    a = _alleles_of(alleles).withColumn("chunk", F.floor(F.col("pos") / size))
    sites = a.groupBy("chrom", "chunk", "pos").agg(F.max("missing").alias("some"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gt")))).alias("kinds")).where("NOT some")
    w = W.partitionBy("chrom", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)  # size positions at most
    sites = sites.withColumn("first", F.coalesce(F.sum(F.size("kinds")).over(w), F.lit(0)))
    bits = a.join(sites.select("chrom", "pos", "kinds", "first"), ["chrom", "pos"])
    bits = bits.select("chrom", "chunk", "sample", F.explode(F.transform("gt", lambda x: F.col("first") + F.array_position("kinds", x) - 1)).alias("bit"))
    words = bits.groupBy("chrom", "chunk", "sample", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    maps = words.groupBy("chrom", "chunk", "sample").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))
    maps = maps.join(words.groupBy("chrom", "chunk").agg(F.max("word").alias("last")), ["chrom", "chunk"])
    rows = maps.select("chrom", "chunk", "sample", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("bits", k), F.lit(0).cast("long"))).alias("bits"))
    p = rows.join(rows.select("chrom", "chunk", F.col("sample").alias("sample_b"), F.col("bits").alias("bits_b")), ["chrom", "chunk"]).where("sample < sample_b")
    count = lambda f: F.aggregate(F.zip_with("bits", "bits_b", lambda x, y: F.bit_count(f(x, y))), F.lit(0).cast("long"), lambda t, n: t + n)
    p = p.select("sample", "sample_b", count(lambda x, y: x.bitwiseAND(y)).alias("shared"), count(lambda x, y: x.bitwiseXOR(y)).alias("different"))
    return p.groupBy(F.col("sample").alias("sample_a"), "sample_b").agg(F.sum("shared").alias("shared"), F.sum("different").alias("different"))


def indel_matrix(calls: DataFrame, size: int = 100_000) -> DataFrame:
    """A 0/1 string per sample, chrom and chunk of ``size`` positions over all sites in order (chrom, pos, sample,
    present), 0 where it has no row. Each chunk's sites are one sorted array, which the samples' own positions are looked up in."""
    at = calls.withColumn("chunk", F.floor(F.col("pos") / size))
    sites = at.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_set("pos")).alias("sites"))  # size positions at most
    own = at.where("present").groupBy("chrom", "chunk", "sample").agg(F.collect_set("pos").alias("own"))
    # the matrix itself, a row for each sample and chunk
    full = sites.join(calls.select("sample").distinct(), how="cross").join(own, ["chrom", "chunk", "sample"], "left")
    mine = F.map_from_entries(F.transform(F.coalesce("own", F.array().cast("array<bigint>")), lambda p: F.struct(p, F.lit("1"))))
    states = F.array_join(F.transform("sites", lambda p: F.coalesce(F.try_element_at("mine", p), F.lit("0"))), "")
    return full.withColumn("mine", mine).select("sample", "chrom", "chunk", states.alias("states"))


def pn_ps(counts: DataFrame, non: list[str], syn: list[str]) -> DataFrame:
    """Pn, Ps and their ratio, null (Undef) where Ps is 0, from columns of effect counts."""
    total = lambda cols: sum((F.coalesce(F.col(c), F.lit(0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0)))
    return counts.withColumns({"pn": total(non), "ps": total(syn)}).withColumn("ratio", F.try_divide(F.col("pn").cast("double"), F.col("ps")))


def allele_dosage(genotypes: DataFrame) -> DataFrame:
    """Half the sum of the allele numbers of genotypes like 0/1, null where one is missing."""
    parts = F.transform(F.split("gt", r"[/|]"), lambda x: x.try_cast("int"))
    return genotypes.withColumn("dosage", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2)


def structure_codes(genotypes: DataFrame) -> DataFrame:
    """Two codes per genotype (array ``gt`` of allele numbers): het gives (0, 2), hom (g, g), missing (-9, -9)."""
    g = F.col("gt")
    missing, het = g.isNull() | (F.size(g) == 0), F.size(F.array_distinct(g)) > 1
    return genotypes.withColumns({"code1": F.when(missing, -9).when(het, 0).otherwise(g[0]), "code2": F.when(missing, -9).when(het, 2).otherwise(g[0])})


def consensus_codes(alleles: DataFrame) -> DataFrame:
    """IUPAC code of each site and population over its samples; null where none is called."""
    return alleles.groupBy("chrom", "pos", "pop").agg(iupac(F.collect_set("allele")).alias("code"))


def values_by_region(points: DataFrame, regions: DataFrame, pad: int = 0) -> DataFrame:
    """Point values (seqid, pos, value) with the class of the regions that they lie in."""
    from loomspan.operators.intervals import overlap_join

    p = points.withColumns({"start": F.greatest(F.col("pos") - pad, F.lit(1)), "stop": F.col("pos") + pad})
    return overlap_join(p, regions.select("seqid", "start", "stop", "class")).select("seqid", "pos", "value", F.col("class_r").alias("class"))


def _value_tiles(counts: DataFrame, value: str) -> DataFrame:
    """Distinct values with __tile, which grows with the value; tiles hold about as many rows each. Runs a job over ``counts``."""
    bounds = sorted({x for x in counts.approxQuantile(value, [i / 256 for i in range(1, 256)], 0.001) if abs(x) < math.inf}) or [0.0]  # 255 numbers
    return Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol=value, outputCol="__tile", handleInvalid="keep").transform(counts)


def compare_groups(df: DataFrame, value: str, group: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Two-sample comparisons of a value, a row per pair of groups (one, two): KS statistic, sizes, means, variances and
    their ratio, the rank sum of the first group (ties share their mean rank), and the p of three two-sided tests: Kolmogorov's
    limit, the rank sum's normal limit with correction for ties and continuity, and the F of the variances. All pairs in
    one sweep over the distinct values in tiles, each value a row with its number in every group. Writes an intermediate table."""
    pairs, names = list(dict.fromkeys(pairs)), list(dict.fromkeys(x for p in pairs for x in p))
    d = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(group).alias("g")).where(F.col("g").isin(names))
    n = [f"n{i}" for i in range(len(names))]
    c = _value_tiles(kept(d.groupBy("v").agg(*(F.count(F.when(F.col("g") == x, 1)).alias(k) for x, k in zip(names, n))), "values"), "v")
    inner, outer = W.partitionBy("__tile").orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.orderBy("__tile").rowsBetween(W.unboundedPreceding, -1)
    base = c.groupBy("__tile").agg(*(F.sum(k).alias(k) for k in n)).select("__tile", *(F.coalesce(F.sum(k).over(outer), F.lit(0)).alias(f"b_{k}") for k in n))  # 257 rows at most
    c = c.select("__tile", *n, *(F.sum(k).over(inner).alias(f"c_{k}") for k in n)).join(F.broadcast(base), "__tile")
    c = c.join(F.broadcast(d.agg(*(F.count(F.when(F.col("g") == x, 1)).alias(f"all_{k}") for x, k in zip(names, n)))), how="cross")  # one row
    found = []
    for one, two in pairs:
        i, j = n[names.index(one)], n[names.index(two)]
        (ca, cb), t = (F.col(f"c_{k}") + F.col(f"b_{k}") for k in (i, j)), (F.col(i) + F.col(j)).cast("double")
        part = lambda of, k: F.try_divide(of.cast("double"), F.col(f"all_{k}"))
        found.append(F.struct(
            F.lit(one).alias("one"), F.lit(two).alias("two"), F.max(F.abs(part(ca, i) - part(cb, j))).alias("ks"),
            F.sum((ca + cb - (F.col(i) + F.col(j) - 1) / 2) * F.col(i)).alias("rank_sum"), F.sum(t * t * t - t).alias("ties"),
        ))
    out = c.agg(F.array(*found).alias("found")).select(F.inline("found"))  # a row per pair
    m = d.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))  # a row per group
    for side in ("one", "two"):
        out = out.join(F.broadcast(m.select(F.col("g").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("n", "mean", "var")))), side, "left").fillna(0, [f"n_{side}"])
    out = out.where("n_one + n_two > 0").withColumn("f_ratio", F.try_divide("var_one", "var_two"))
    tests = F.pandas_udf(two_sample_p, "ks_p double, rank_p double, f_p double")
    out = out.withColumn("p", tests("ks", "rank_sum", "ties", "f_ratio", "n_one", "n_two"))
    return out.select("one", "two", "ks", "rank_sum", "n_one", "n_two", "mean_one", "mean_two", "var_one", "var_two", "f_ratio", "p.*")


def ks_two_sample(df: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    """``compare_groups`` of one pair, a single row."""
    return compare_groups(df, value, group, [(one, two)]).drop("one", "two")


def summary_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Number, least, quartiles (exact, between two values by distance) and greatest of a value per group. The quartiles are read off
    the running numbers of the distinct values, in tiles, so that no task holds a group. Writes an intermediate table."""
    v = F.col(value).cast("double")
    out = df.groupBy(F.struct(group).alias("__of")).agg(F.count(value).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))  # a struct joins where the group is null
    d = df.where(v.isNotNull()).select(F.struct(group).alias("__of"), v.alias("v"))
    c = _value_tiles(kept(d.groupBy("__of", "v").agg(F.count(F.lit(1)).alias("c")), "values"), "v").withColumnRenamed("__tile", "at")
    c = earlier(c, ["__of"], ["v"], F.col("c"), "sum", F.col("at"), inclusive=True)
    c = c.join(out.select("__of", "n"), "__of")
    at = lambda i: F.max(F.when((F.col("__before") > i) & (F.col("__before") - F.col("c") <= i), F.col("v")))
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    place = {q: (F.col("n") - 1) * F.lit(p) for q, p in shares.items()}
    ends = c.groupBy("__of").agg(*(at(f(place[q])).alias(f"{q}_{e}") for q in shares for e, f in (("lo", F.floor), ("hi", F.ceil))))
    full = out.join(ends, "__of", "left")
    mid = lambda q: F.when(F.floor(place[q]) == F.ceil(place[q]), F.col(f"{q}_lo")).otherwise((F.ceil(place[q]) - place[q]) * F.col(f"{q}_lo") + (place[q] - F.floor(place[q])) * F.col(f"{q}_hi"))
    return full.select(F.col(f"__of.{group}").alias(group), "n", "min", *(mid(q).alias(q) for q in shares), "max")