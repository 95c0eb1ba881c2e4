"""Small projections between record formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import iupac


def select_named(df: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns by name; a missing one is an error that names it."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*columns)


def attr_to_seq(df: DataFrame, attribute: str = "translation") -> DataFrame:
    """Sequences that features carry in an attribute, as id and seq."""
    return df.select(F.coalesce(F.try_element_at("attrs", F.lit("ID")), F.concat_ws(":", "seqid", F.col("start").cast("string"))).alias("id"), F.try_element_at("attrs", F.lit(attribute)).alias("seq")).where("seq IS NOT NULL AND seq <> ''")


def soap_to_eland(df: DataFrame) -> DataFrame:
    """Read rows (name, seq, hits, seqid, start, strand, n_mismatch) with the code U0-U2 or R0-R2 and the hits per mismatch class."""
    k = F.least(F.col("n_mismatch"), F.lit(2))
    code = F.concat(F.when(F.col("hits") == 1, "U").otherwise("R"), k.cast("string"))
    classes = [F.when(k == i, F.col("hits")).otherwise(0).alias(f"hits{i}") for i in range(3)]
    return df.select(F.concat(F.lit(">"), "name").alias("name"), "seq", code.alias("code"), *classes, "seqid", "start", F.when(F.col("strand") == "+", "F").otherwise("R").alias("direction"))


def relocate_track(track: DataFrame, blocks: DataFrame) -> DataFrame:
    """Track rows in block coordinates (block, start, stop, value) moved to the genome (blocks: block, seqid, start, 1-based)."""
    b = blocks.select("block", "seqid", F.col("start").alias("__at"))
    return track.join(b, "block").select("seqid", (F.col("__at") + F.col("start") - 1).alias("start"), (F.col("__at") + F.col("stop") - 1).alias("stop"), "value")


def block_bounds(blocks: DataFrame, genes: DataFrame) -> DataFrame:
    """Blocks named by their first and last gene (block, first, last) as intervals (genes: gene, seqid, start, stop);
    blocks whose genes lie on different sequences are left out."""
    a = genes.select(F.col("gene").alias("first"), F.col("seqid").alias("s1"), F.col("start").alias("a1"), F.col("stop").alias("b1"))
    b = genes.select(F.col("gene").alias("last"), F.col("seqid").alias("s2"), F.col("start").alias("a2"), F.col("stop").alias("b2"))
    j = blocks.join(a, "first").join(b, "last").where("s1 = s2")
    return j.select("block", F.col("s1").alias("seqid"), F.least("a1", "a2").alias("start"), F.greatest("b1", "b2").alias("stop"))


def _feature(df: DataFrame, source: str, kind: str, start, stop, score, strand, name) -> DataFrame:
    return df.select(F.col("seqid"), F.lit(source).alias("source"), F.lit(kind).alias("type"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), score.cast("double").alias("score"), strand.alias("strand"), F.create_map(F.lit("ID"), name).alias("attrs"))


def peaks_to_features(df: DataFrame) -> DataFrame:
    return _feature(df, "peaks", "peak", F.col("start"), F.col("stop"), F.col("score"), F.lit(None).cast("string"), F.concat_ws(".", F.lit("peak"), "seqid", F.col("start").cast("string")))


def repeats_to_features(df: DataFrame) -> DataFrame:
    return _feature(df, "repeats", "repeat", F.col("start"), F.col("stop"), F.col("score"), F.col("strand"), F.concat_ws(":", "family", "class"))


def snps_to_features(alleles: DataFrame) -> DataFrame:
    """Sites of a long allele table as one-base features named by position, with the IUPAC code of their alleles."""
    g = alleles.where("allele IS NOT NULL").groupBy(F.col("chrom").alias("seqid"), "pos").agg(F.collect_set("allele").alias("a"), F.count(F.lit(1)).alias("n"))
    f = _feature(g.select("seqid", "pos", "n", "a"), "snps", "SNP", F.col("pos"), F.col("pos"), F.col("n"), F.lit("+"), F.concat_ws(".", F.col("seqid").cast("string"), F.col("pos").cast("string"), iupac(F.col("a"))))
    return f


def repeat_summary(repeats: DataFrame) -> DataFrame:
    """Copies, bases and mean score of each repeat class and family."""
    size = F.col("stop") - F.col("start") + 1
    return repeats.groupBy("class", "family").agg(F.count(F.lit(1)).alias("copies"), F.sum(size).alias("bases"), F.avg("score").alias("score"))


def domain_summary(hits: DataFrame) -> DataFrame:
    """First and last residue, number and best score of each gene's hits to a domain (gene, domain, ali_from, ali_to, score)."""
    return hits.groupBy("gene", "domain").agg(F.min("ali_from").alias("first"), F.max("ali_to").alias("last"), F.count(F.lit(1)).alias("copies"), F.max("score").alias("score"))
