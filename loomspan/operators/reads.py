"""Operators on aligned and raw reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.intervals import BIN, overlap_anti, overlap_join, overlap_semi, strand_relation
from loomspan.operators.sequences import chunked


def mapped_totals(reads: DataFrame, lib: str = "lib", weight: str = "weight") -> DataFrame:
    return reads.groupBy(lib).agg(F.sum(weight).alias("total"))


def feature_read_profile(features: DataFrame, reads: DataFrame, name: str = "parent", lo: int = 17, hi: int = 30, bin_size: int = BIN) -> DataFrame:
    """Weighted reads of each feature by read length and strand relation, in all and by their 5' and 3' base.
    Reads (seqid, start, stop, strand, weight, base5, base3) of lo to hi bases with a called base at both ends count."""
    r = reads.withColumn("length", F.col("stop") - F.col("start") + 1).where(F.col("length").between(lo, hi) & F.col("base5").isin(*"ACGT") & F.col("base3").isin(*"ACGT"))
    p = overlap_join(features.select("seqid", "start", "stop", "strand", name), r, bin_size=bin_size)
    cells = [F.sum(F.when(F.col(f"{end}_r") == b, F.col("weight_r")).otherwise(0)).alias(f"{end}_{b}") for end in ("base5", "base3") for b in "ACGT"]
    return p.groupBy(name, F.col("length_r").alias("length"), strand_relation().alias("strands")).agg(F.sum("weight_r").alias("reads"), *cells)


def feature_counts(features: DataFrame, reads: DataFrame, name: str = "parent", bin_size: int = BIN) -> DataFrame:
    """Reads of each feature and library on the same, the opposite and either strand, also per million
    mapped reads of the library; rows only where there are any."""
    p = overlap_join(features.select("seqid", "start", "stop", "strand", name), reads.select("seqid", "start", "stop", "strand", "weight", "lib"), bin_size=bin_size)
    w = lambda rel: F.sum(F.when(strand_relation() == rel, F.col("weight_r")).otherwise(0))
    n = p.groupBy(name, F.col("lib_r").alias("lib")).agg(w("same").alias("same"), w("opp").alias("opp"), F.sum("weight_r").alias("total"))
    rate = lambda c: F.col(c) / (F.col("mapped") / F.lit(1e6))
    out = n.join(mapped_totals(reads).withColumnRenamed("total", "mapped"), "lib").where("total > 0")
    return out.select(name, "lib", "same", "opp", "total", *(rate(c).alias(f"{c}_pm") for c in ("same", "opp", "total")))


def pivot_libraries(counts: DataFrame, name: str, libs: list[str], value: str = "total") -> DataFrame:
    """A column per library, 0 where a feature has no reads."""
    return counts.groupBy(name).pivot("lib", libs).agg(F.sum(value)).fillna(0, libs)


def size_base_matrix(reads: DataFrame, end: str = "base5", by: list[str] | None = None, mask: DataFrame | None = None, bin_size: int = BIN) -> DataFrame:
    """Weighted read counts by length and end base, with percent of the row; reads that touch ``mask`` are left out."""
    r = overlap_anti(reads, mask, bin_size=bin_size) if mask is not None else reads
    r = r.withColumn("length", F.col("stop") - F.col("start") + 1).where(F.col(end).isin(*"ACGT"))
    n = r.groupBy(*(by or []), "length").pivot(end, list("ACGT")).agg(F.sum("weight")).fillna(0, list("ACGT"))
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return n.select(*(by or []), "length", *"ACGT", *((100.0 * F.col(b) / total).alias(f"{b}_pc") for b in "ACGT"))


def size_by_feature(reads: DataFrame, features: DataFrame, group: str = "type", bin_size: int = BIN) -> DataFrame:
    """Weighted reads by sequence, length and feature group; reads that touch none are ``nofeature``, and a read counts once per group."""
    r = reads.withColumn("length", F.col("stop") - F.col("start") + 1)
    p = overlap_join(r, features.select("seqid", "start", "stop", group), bin_size=bin_size).select("event_id", "seqid", "length", "weight", F.col(f"{group}_r").alias(group)).distinct()
    none = overlap_anti(r, features, bin_size=bin_size).select("event_id", "seqid", "length", "weight", F.lit("nofeature").alias(group))
    return p.unionByName(none).groupBy("seqid", "length", group).agg(F.sum("weight").alias("reads"))


def overlap_classes(reads: DataFrame, features: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Weighted reads per type of the features that they touch, same and opposite strand, with percent of all pairs."""
    p = overlap_join(reads.select("seqid", "start", "stop", "strand", "weight"), features.select("seqid", "start", "stop", "strand", "type"), bin_size=bin_size)
    n = p.groupBy(F.col("type_r").alias("type")).agg(*(F.sum(F.when(strand_relation() == k, F.col("weight")).otherwise(0)).alias(k) for k in ("same", "opp")))
    total = n.agg(F.sum(F.col("same") + F.col("opp")).alias("__t"))
    return n.join(F.broadcast(total), how="cross").select("type", "same", "opp", (100.0 * F.col("same") / F.col("__t")).alias("same_pc"), (100.0 * F.col("opp") / F.col("__t")).alias("opp_pc"))


def window_counts(reads: DataFrame, size: int = 1000) -> DataFrame:
    """Weighted reads per window of the genome that they touch and library; window k spans k * size + 1 to (k + 1) * size."""
    bins = F.explode(F.sequence(F.floor((F.col("start") - 1) / size), F.floor((F.col("stop") - 1) / size)))
    return reads.select("seqid", "lib", "weight", bins.alias("window")).groupBy("seqid", "window", "lib").agg(F.sum("weight").alias("reads"))


def sirna_evidence(genes: DataFrame, reads: DataFrame, min_reads: int = 10, bin_size: int = BIN) -> DataFrame:
    """Forward, reverse and all reads of each gene and library, RPKM, and YES where there are more than ``min_reads``."""
    p = overlap_join(genes.select("seqid", "start", "stop", F.col("parent").alias("gene")), reads.select("seqid", "start", "stop", "strand", "weight", "lib"), bin_size=bin_size)
    n = p.groupBy("gene", "seqid", "start", "stop", F.col("lib_r").alias("lib")).agg(
        *(F.sum(F.when(F.col("strand_r") == s, F.col("weight_r")).otherwise(0)).alias(c) for s, c in (("+", "fwd"), ("-", "rev"))), F.sum("weight_r").alias("all_reads")
    )
    n = n.join(mapped_totals(reads), "lib")
    kb, millions = (F.col("stop") - F.col("start") + 1) / F.lit(1000.0), F.col("total") / F.lit(1e6)
    return n.select("gene", "seqid", "start", "stop", "lib", "fwd", "rev", "all_reads", (F.col("all_reads") / kb / millions).alias("rpkm"), F.when(F.col("all_reads") > min_reads, "YES").otherwise("NO").alias("status"))


def overhang_offsets(reads: DataFrame, lo: int = 21, hi: int = 28, bin_size: int = BIN) -> DataFrame:
    """How often a bottom-strand read begins how far from an overlapping top-strand read."""
    r = reads.where((F.col("stop") - F.col("start") + 1).between(lo, hi)).select("seqid", "start", "stop", "strand")
    p = overlap_join(r.where("strand = '+'"), r.where("strand = '-'"), bin_size=bin_size)
    return p.groupBy((F.col("start_r") - F.col("start")).alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def casava_pass(df: DataFrame, header: str = "desc") -> DataFrame:
    """Reads that the instrument didn't mark as failed (``:Y:`` in the header's second part)."""
    return df.where(~F.coalesce(F.col(header).rlike(r"^\d:Y:"), F.lit(False)))


def mask_uncalled(df: DataFrame) -> DataFrame:
    return df.withColumn("seq", F.translate("seq", ".-", "NN"))


def rename_mates(df: DataFrame, scheme: str = "slash", name: str = "id") -> DataFrame:
    """Mate suffixes .f/.r or 1/2 by scheme: ``slash`` gives /1 and /2, ``letter`` /A and /B."""
    one, two = {"slash": ("/1", "/2"), "letter": ("/A", "/B")}[scheme]
    return df.withColumn(name, F.regexp_replace(F.regexp_replace(F.col(name), r"([./]f|/1|/a)$", one), r"([./]r|/2|/b)$", two))


def pair_list(df: DataFrame, libsize: int, name: str = "id") -> DataFrame:
    """Names of both mates of each pair that is there whole, with the library's size."""
    stem, mate = F.regexp_extract(name, r"^(.*)/([12])$", 1), F.regexp_extract(name, r"^(.*)/([12])$", 2)
    g = df.select(stem.alias("stem"), mate.alias("mate")).where("mate <> ''").groupBy("stem").agg(F.max((F.col("mate") == "1").cast("int")).alias("a"), F.max((F.col("mate") == "2").cast("int")).alias("b"))
    return g.where("a = 1 AND b = 1").select(F.concat("stem", F.lit("/1")).alias("mate1"), F.concat("stem", F.lit("/2")).alias("mate2"), F.lit(libsize).alias("size"))


def pair_mates(one: DataFrame, two: DataFrame, name: str = "id") -> DataFrame:
    """Every read of two files with status paired or unpaired, its file and its sequence."""
    both = one.select(name, F.col("seq").alias("s1")).join(two.select(name, F.col("seq").alias("s2")), name, "full")
    status = F.when(F.col("s1").isNotNull() & F.col("s2").isNotNull(), "paired").otherwise("unpaired")
    rows = F.array(F.struct(F.lit(1).alias("file"), F.col("s1").alias("seq")), F.struct(F.lit(2).alias("file"), F.col("s2").alias("seq")))
    return both.select(name, status.alias("status"), F.inline(rows)).where("seq IS NOT NULL")


def reads_in_regions(reads: DataFrame, regions: DataFrame, name: str = "name", bin_size: int = BIN) -> DataFrame:
    """Reads that touch a region, with the places of all reads of the same name."""
    hit = overlap_semi(reads, regions, bin_size=bin_size).select(name).distinct()
    return reads.join(hit, name, "left_semi")


def low_coverage(features: DataFrame, reads: DataFrame, most: int, name: str = "parent", bin_size: int = BIN) -> DataFrame:
    """Features whose weighted reads are ``most`` at the most, those without any among them."""
    p = overlap_join(features.select("seqid", "start", "stop", name), reads.select("seqid", "start", "stop", "weight"), how="left", bin_size=bin_size)
    return p.groupBy(name).agg(F.coalesce(F.sum("weight_r"), F.lit(0)).alias("reads")).where(F.col("reads") <= most)


def annotate_counts(counts: DataFrame, overlaps: DataFrame, name: str = "parent") -> DataFrame:
    """Counts with the sorted names of the features that overlap each; both sides of a pair name the other."""
    both = overlaps.select(F.col("left_id").alias(name), F.col("right_id").alias("other")).union(overlaps.select("right_id", "left_id"))
    listed = both.groupBy(name).agg(F.array_join(F.array_sort(F.collect_set(F.col("other").cast("string"))), ",").alias("overlapping"))
    return counts.join(listed, name, "left")


def merge_counts(dfs: list[DataFrame], top: int = 1000) -> DataFrame:
    """Counts (feature, library, length, n) of several tables for the ``top`` features by total, ties by name."""
    all_ = dfs[0]
    for df in dfs[1:]:
        all_ = all_.unionByName(df)
    best = all_.groupBy("feature").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "feature").limit(top)
    return all_.join(F.broadcast(best.select("feature")), "feature", "left_semi").groupBy("feature", "lib", "length").agg(F.sum("n").alias("n"))  # top names


def expression_patterns(df: DataFrame, conditions: list[str], cutoff: float = 1.0, least: float = 5.0) -> DataFrame:
    """A sign per neighbouring pair of conditions: + or - where the log2 ratio reaches ``cutoff``, 0 where not; rows whose largest value is below ``least`` are left out."""
    ratio = lambda a, b: F.log2((F.col(b) + 1.0) / (F.col(a) + 1.0))
    sign = lambda r: F.when(r >= cutoff, "+").when(r <= -cutoff, "-").otherwise("0")
    signs = [sign(ratio(a, b)) for a, b in zip(conditions, conditions[1:])]
    return df.where(F.greatest(*conditions) >= least).withColumn("pattern", F.concat(*signs))


def mapability(calls: DataFrame, window: int = 100, genome: DataFrame | None = None, read: int = 35, unique: str = "!", chunk: int = 100_000) -> DataFrame:
    """Share of uniquely mappable starts per window (calls: seqid, calls, a string of one letter per position, ``unique`` is
    unique). With a genome (seqid, seq) also gc, the mean GC share of the reads of ``read`` bases that begin at these starts,
    shorter ones at a sequence's end, null where a window has none. Sequences are cut into chunks that reach ``read`` - 1 bases
    into the next; GC of a read is a difference of prefix sums."""
    chunk = -(-max(chunk, read, window) // window) * window
    c = chunked(calls, "seqid", chunk, 0, "calls").select("seqid", "k", F.col("part").alias("calls"))
    if genome is None:
        c = c.withColumn("seq", F.lit(""))
    else:
        c = c.join(chunked(genome, "seqid", chunk, read - 1).select("seqid", "k", F.col("part").alias("seq")), ["seqid", "k"], "left")
    kind = dict(calls.dtypes)["seqid"]

    def run(batches):
        for batch in batches:
            for seqid, k, text, seq in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hit = np.frombuffer(text.encode("utf-32-le"), np.uint32) == ord(unique)
                strong = np.isin(np.frombuffer((seq or "").encode("utf-32-le"), np.uint32), [ord(x) for x in "GCgc"])
                total = np.concatenate([[0], np.cumsum(strong)])
                begin = np.minimum(np.arange(len(hit)), len(strong))
                end = np.minimum(begin + read, len(strong))
                some = hit & (end > begin)
                gc = np.where(some, (total[end] - total[begin]) / np.maximum(end - begin, 1), 0.0)
                edge = np.arange(0, len(hit), window)
                n, n_gc, sums = (np.add.reduceat(x, edge) for x in (hit.astype(np.int64), some.astype(np.int64), gc))
                share = n / np.diff(np.append(edge, len(hit)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seqid] * len(edge), batch.column(0).type), pa.array(k * (chunk // window) + np.arange(len(edge))), pa.array(share), pa.array(sums / np.maximum(n_gc, 1), mask=n_gc == 0)],
                    ["seqid", "window", "unique_share", "gc"],
                )

    out = c.select("seqid", "k", "calls", "seq").mapInArrow(run, f"seqid {kind}, window long, unique_share double, gc double")
    return out.drop("gc") if genome is None else out


def reads_weight(name: Column | str) -> Column:
    """How many reads a collapsed read stands for, from a name like ``id-count``; 1 without a count."""
    n = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.nullif(F.regexp_extract(n, r"[-_x](\d+)$", 1), F.lit("")).cast("long"), F.lit(1))
