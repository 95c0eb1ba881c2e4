"""Families, ortholog groups, similarity hits and liftover between genomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import scaled_evalue, two_digits
from loomspan.operators.intervals import BIN, beside, overlap_join, tile_of
from loomspan.sources.scratch import kept


def filter_hits(df: DataFrame, evalue: float = 1e-3, pid: float = 0.0, minlen: int = 0, self_hits: bool = False) -> DataFrame:
    out = df.where((F.col("evalue") <= evalue) & (F.col("pid") >= pid) & (F.col("aln_len") >= minlen))
    return out if self_hits else out.where("query <> hit")


def domain_matrix(hits: DataFrame, species: list[str], percent: bool = False, cutoff: float = 1e-4) -> DataFrame:
    """Copies of each domain per species with totals; with ``percent``, the share of a species' genes that have it
    (hits: species, gene, domain, evalue)."""
    h = hits.where(F.col("evalue") <= cutoff)
    if not percent:
        out = h.groupBy("domain").pivot("species", species).count().fillna(0, species)
        return out.withColumn("total", reduce(lambda a, b: a + b, (F.col(s) for s in species)))
    n = h.groupBy("species", "domain").agg(F.countDistinct("gene").alias("n"))
    all_ = hits.groupBy("species").agg(F.countDistinct("gene").alias("genes"))
    return n.join(all_, "species").groupBy("domain").pivot("species", species).agg(F.first(100.0 * F.col("n") / F.col("genes"))).fillna(0.0, species)


def family_counts(groups: DataFrame, species: list[str], hits: DataFrame | None = None) -> DataFrame:
    """Members of each family per species, one per gene, with the domains of its genes (gene, domain) and how many have each."""
    g = groups.select("group_id", "species", "gene").distinct()
    out = g.groupBy("group_id").pivot("species", species).count().fillna(0, species)
    if hits is None:
        return out
    d = g.join(hits.select("gene", "domain").distinct(), "gene").groupBy("group_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    tally = d.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "domain"))), lambda x: F.concat(x["domain"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("domains"))
    return out.join(tally, "group_id", "left")


def family_patterns(groups: DataFrame) -> DataFrame:
    """Families per set of species, as the sorted names joined by '-'."""
    p = groups.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("species")), "-").alias("pattern"))
    return p.groupBy("pattern").agg(F.count(F.lit(1)).alias("families"))


def single_copy(groups: DataFrame, n_species: int) -> DataFrame:
    """Families in which each of ``n_species`` species has exactly one gene."""
    n = groups.groupBy("group_id", "species").agg(F.countDistinct("gene").alias("n"))
    return n.groupBy("group_id").agg(F.count(F.lit(1)).alias("species"), F.max("n").alias("most")).where((F.col("species") == n_species) & (F.col("most") == 1)).select("group_id")


def flexible_orthologs(groups: DataFrame, n_species: int, missing: int = 2, maxsp: int = 10) -> DataFrame:
    """Families that lack ``missing`` species at most and have ``maxsp`` genes of any species at most."""
    n = groups.groupBy("group_id", "species").agg(F.countDistinct("gene").alias("n"))
    g = n.groupBy("group_id").agg(F.count(F.lit(1)).alias("species"), F.max("n").alias("most"), F.sum("n").alias("genes"))
    return g.where((F.col("species") >= n_species - missing) & (F.col("most") <= maxsp))


def decode_clusters(clusters: DataFrame, index: DataFrame, taxa: DataFrame) -> DataFrame:
    """Clusters (cluster, member) of numbers by an index (member, gene) and taxa (gene, taxon), of two genes or more."""
    m = clusters.join(index, "member").join(taxa, "gene")
    return m.groupBy("cluster").agg(F.countDistinct("gene").alias("genes"), F.countDistinct("taxon").alias("taxa")).where("genes >= 2")


def phylo_profile(hits: DataFrame, species: list[str], evalue: float = 1e-3) -> DataFrame:
    """Distinct hit genes of each query per target species (names species_gene)."""
    h = hits.where(F.col("evalue") <= evalue).select("query", "hit", F.split("hit", "_", 2)[0].alias("species")).where("query <> hit")
    return h.groupBy("query").pivot("species", species).agg(F.countDistinct("hit")).fillna(0, species)


def hit_scores(hits: DataFrame, score: str = "evalue", dbsize: float = 1e6) -> DataFrame:
    """Hits with the chosen score: evalue, bits, bits_per_residue (of the query's aligned span) or scaled_evalue
    (dbsize * qlen / 2 ** bits, two digits); rank numbers a query's hits, the best first, ties by hit."""
    kinds = {
        "evalue": lambda: F.col("evalue"), "bits": lambda: F.col("bits"), "bits_per_residue": lambda: F.try_divide("bits", F.abs(F.col("qstop") - F.col("qstart"))),
        "scaled_evalue": lambda: two_digits(scaled_evalue("bits", "qlen", dbsize)),
    }
    s = hits.withColumn("score", kinds[score]().cast("double"))
    best = F.desc("score") if score in ("bits", "bits_per_residue") else F.asc("score")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(best, "hit")))


def species_genes(hits: DataFrame) -> DataFrame:
    """Number and digest of the genes that hit pairs name, per species."""
    g = hits.select(F.col("query").alias("g")).union(hits.select("hit")).distinct()
    return g.groupBy(F.split("g", "_", 2)[0].alias("species")).agg(F.count(F.lit(1)).alias("genes"), F.min("g").alias("first"), F.max("g").alias("last"))


def best_hit(hits: DataFrame, order: list[str], pid: float = 60.0, minlen: int = 0, lens: DataFrame | None = None, cov: float = 60.0, dlen: float = 15.0) -> DataFrame:
    """The first hit of each query by ``order`` that passes. With ``lens`` (id, length), the alignment (qstart, qend, tstart,
    tend) must also span ``cov`` percent of the query and of the hit, and their lengths differ by ``dlen`` percent of
    the query's at most; spans are end less start, and hits without a length of either side don't pass."""
    h = hits.where((F.col("pid") >= pid) & (F.col("aln_len") >= minlen))
    if lens is not None:
        for side, name in (("query", "__qlen"), ("hit", "__hlen")):
            h = h.join(lens.select(F.col("id").alias(side), F.col("length").cast("double").alias(name)), side)
        h = h.where((100 * F.abs(F.col("__hlen") - F.col("__qlen")) <= dlen * F.col("__qlen")) & (100 * (F.col("tend") - F.col("tstart")) >= cov * F.col("__hlen")) & (100 * (F.col("qend") - F.col("qstart")) >= cov * F.col("__qlen")))
    return h.groupBy("query").agg(F.min_by(F.struct(*(c for c in hits.columns if c != "query")), F.struct(*order)).alias("h")).select("query", "h.*")


def lookup(df: DataFrame, names: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Equi join with a lookup table; Spark broadcasts it where its size allows."""
    return df.join(names, on, how)


def domain_go_summary(genes: DataFrame, hits: DataFrame, domain_go: DataFrame) -> DataFrame:
    """Genes per GO term through their domains, with how many domains lead there."""
    p = genes.join(hits, "gene").join(domain_go, "domain")
    return p.groupBy("go").agg(F.countDistinct("gene").alias("genes"), F.countDistinct("domain").alias("domains"))


def hit_functions(hits: DataFrame, functions: DataFrame) -> DataFrame:
    """Queries per function; a query with no function at all counts as Unknown_function."""
    f = hits.join(functions, "hit", "left").groupBy("query").agg(F.array_compact(F.collect_set("function")).alias("f"))
    f = f.select("query", F.explode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.array(F.lit("Unknown_function")))).alias("function"))
    return f.groupBy("function").agg(F.count(F.lit(1)).alias("queries"))


def acc_to_taxid(acc: DataFrame, acc2gi: DataFrame, gi2tax: DataFrame) -> DataFrame:
    return acc.join(acc2gi, "acc").join(gi2tax, "gi").select("acc", "gi", "taxid")


def merge_pairwise(dfs: list[DataFrame], single: bool = True, key: str = "gene") -> DataFrame:
    """Tables (key, ortholog_i) joined on genes that all have; ``single`` leaves out genes that any has more than once."""
    out = None
    for i, df in enumerate(dfs, 1):
        d = df
        if single:
            d = d.join(d.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(key), key, "left_semi")
        d = d.select(key, F.col("ortholog").alias(f"ortholog_{i}"))
        out = d if out is None else out.join(d, key)
    return out


def phylome_table(queries: DataFrame, rows: DataFrame, species: list[str]) -> DataFrame:
    """Co-orthologs of each query gene per species, 0 where there are none."""
    n = queries.join(rows, "gene", "left").groupBy("gene").pivot("species", species).agg(F.countDistinct("ortholog"))
    return n.fillna(0, species)


def hits_by_taxon(hits: DataFrame, taxonomy: DataFrame, order: list[str]) -> DataFrame:
    """Queries per taxon of their first hit."""
    first = hits.groupBy("query").agg(F.min_by("hit", F.struct(*order)).alias("hit"))
    return first.join(taxonomy, "hit", "left").groupBy(F.coalesce("taxon", F.lit("unknown")).alias("taxon")).agg(F.count(F.lit(1)).alias("queries"))


def classify_orthology(groups: DataFrame, genes: DataFrame, focal: str) -> DataFrame:
    """Genes of the focal species as ortholog (one of it, with others), paralog (several, with others), only (no
    others) or orphan (in no group)."""
    g = groups.groupBy("group_id").agg(F.countDistinct(F.when(F.col("species") == focal, F.col("gene"))).alias("own"), F.countDistinct("species").alias("species"))
    kinds = groups.where(F.col("species") == focal).select("group_id", "gene").distinct().join(g, "group_id")
    kinds = kinds.withColumn("rank", F.when(F.col("species") == 1, 3).when(F.col("own") == 1, 1).otherwise(2)).groupBy("gene").agg(F.min("rank").alias("rank"))
    out = genes.join(kinds, "gene", "left")
    return out.select("gene", F.when(F.col("rank") == 1, "ortholog").when(F.col("rank") == 2, "paralog").when(F.col("rank") == 3, "only").otherwise("orphan").alias("class"))


def _carried(genes: DataFrame, blocks: DataFrame, bin_size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """The intervals that a synteny map gives for genes, as gene, seqid, start, stop and columns ``more`` of the blocks."""
    m = blocks.select(F.col("a_seqid").alias("seqid"), F.col("a_start").alias("start"), F.col("a_stop").alias("stop"), "b_seqid", "b_start", "b_stop", "b_strand", *more)
    p = overlap_join(genes.select("gene", "seqid", "start", "stop"), m, bin_size=bin_size)
    low, high = F.greatest("start", "start_r") - F.col("start_r"), F.least("stop", "stop_r") - F.col("start_r")
    plus = F.col("b_strand_r") != "-"
    ends = F.when(plus, F.col("b_start_r") + low).otherwise(F.col("b_stop_r") - high), F.when(plus, F.col("b_start_r") + high).otherwise(F.col("b_stop_r") - low)
    p = p.select("gene", *(F.col(f"{c}_r").alias(c) for c in more), F.col("b_seqid_r").alias("seqid"), ends[0].alias("start"), ends[1].alias("stop"))
    return p.withColumns({"start": F.greatest("start", F.lit(1))}).where("start <= stop")


def annotation_transfer(genes_a: DataFrame, blocks: DataFrame, genes_b: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Genes of one genome with those of another in the interval that a synteny map gives (blocks: block, a_seqid,
    a_start, a_stop, b_seqid, b_start, b_stop, b_strand), and a status where there are none. Positions inside a
    block are carried over by their offset, from the other end on '-'. Writes intermediate tables: what is read
    several times is computed once."""
    a = kept(genes_a.select("gene", F.col("seqid"), "start", "stop"), "genes")
    p = kept(_carried(a, blocks, bin_size), "carried")
    b = kept(genes_b.select("seqid", "start", "stop", F.col("gene").alias("other")), "genes")
    found = kept(overlap_join(p, b, bin_size=bin_size).select("gene", F.col("other_r").alias("match")).distinct(), "found")
    lit = lambda df, text: df.select("gene").distinct().select("gene", F.lit(text).alias("match"))
    none = lit(p.select("gene").distinct().join(found, "gene", "left_anti"), "NO_GENES_IN_INTERVAL")
    return found.unionByName(none).unionByName(lit(a.join(p, "gene", "left_anti"), "NO_SYNTENIC_ALIGNMENT"))


def multiway_orthologs(genes: DataFrame, blocks: DataFrame, genomes: dict[str, DataFrame], bin_size: int = BIN) -> DataFrame:
    """One row per gene (gene, seqid, start, stop, strand; names are unique) with, for each other genome g, the genes that
    lie in its intervals by the map: g_names and g_strands joined in the order of names, g_seqid (joined, if there are
    several), g_start and g_stop from the least start to the greatest stop, g_single, and g_status where there are none.
    ``single`` is false where any genome has more than one. ``blocks`` are those of ``annotation_transfer`` with a column
    ``genome``, whose genome the b side is. Writes intermediate tables."""
    a = kept(genes.select("gene", "seqid", "start", "stop", "strand"), "genes")
    p = kept(_carried(a, blocks, bin_size, ("genome",)), "carried")
    own = F.struct("seqid", "start", "stop", "strand")
    b = reduce(DataFrame.unionByName, (df.select(F.lit(g).alias("genome"), "seqid", "start", "stop", F.col("gene").alias("other"), "strand") for g, df in genomes.items()))
    found = overlap_join(p, kept(b, "genes"), ["genome", "seqid"], bin_size=bin_size)
    found = found.select("gene", "genome", F.struct(F.col("other_r").alias("gene"), *(F.col(f"{c}_r").alias(c) for c in ("seqid", "start", "stop", "strand"))).alias("match"))
    rows = found.unionByName(p.select("gene", "genome"), allowMissingColumns=True).unionByName(a.select("gene", own.alias("own")), allowMissingColumns=True)
    of = lambda g, c: F.when(F.col("genome") == g, c)
    sets = [F.array_sort(F.collect_set(of(g, F.col("match")))).alias(f"{g}_set") for g in genomes]
    seen = [F.max(of(g, F.lit(True))).alias(f"{g}_seen") for g in genomes]
    rows = rows.groupBy("gene").agg(F.max("own").alias("own"), *sets, *seen)
    out = []
    for g in genomes:
        every, n = (lambda c, g=g: F.transform(f"{g}_set", lambda x: x[c])), F.size(f"{g}_set")
        joined = lambda x, n=n: F.when(n > 0, F.array_join(x, ","))
        out += [
            joined(every("gene")).alias(f"{g}_names"), joined(F.array_sort(F.array_distinct(every("seqid")))).alias(f"{g}_seqid"), F.array_min(every("start")).alias(f"{g}_start"), F.array_max(every("stop")).alias(f"{g}_stop"),
            joined(every("strand")).alias(f"{g}_strands"), (n == 1).alias(f"{g}_single"), F.when(n > 0, None).when(F.col(f"{g}_seen"), "NO_GENES_IN_INTERVAL").otherwise("NO_SYNTENIC_ALIGNMENT").alias(f"{g}_status"),
        ]
    return rows.select("gene", "own.*", *out, (F.greatest(F.lit(0), *(F.size(f"{g}_set") for g in genomes)) <= 1).alias("single"))


def synteny_links(rows: DataFrame) -> DataFrame:
    """Pairs of intervals of different genomes in the same block (block, genome, seqid, start, stop)."""
    a, b = (rows.select("block", *(F.col(c).alias(f"{c}_{s}") for c in ("genome", "seqid", "start", "stop"))) for s in "ab")
    return a.join(b, "block").where("genome_a < genome_b")


def intersect_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, dfs)


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def keep(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids, on, "left_semi")


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def cap_per(df: DataFrame, key: str, k: int, order: list) -> DataFrame:
    """At most ``k`` rows of each key, the first by ``order``."""
    from pyspark.sql import Window as W

    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def sample_loci(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows by a seeded hash of their key: the same ones every time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary")), *key).limit(n)


def split_pairs(df: DataFrame) -> DataFrame:
    """Significant rows (sample_1, sample_2, fold) with direction DOWN where fold < 0, sorted by fold within each pair and direction."""
    out = df.where("significant = 'yes'").withColumn("direction", F.when(F.col("fold") < 0, "DOWN").otherwise("UP"))
    return out.repartition("sample_1", "sample_2", "direction").sortWithinPartitions("sample_1", "sample_2", "direction", F.desc("fold"))


def dedupe_consecutive(df: DataFrame, by: str, order: list[str], part: list[str]) -> DataFrame:
    """Rows whose ``by`` differs from that of the row before; name the file in ``part``. A long file is done in
    tiles of the first column of ``order``."""
    above = beside(df, part, order, F.struct(F.col(by).alias("v")), tile_of(df, order[0]))
    return above.where(F.col("__beside").isNull() | (F.col("__beside.v") != F.col(by))).select(df.columns)
