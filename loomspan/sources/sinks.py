"""Writers of genome text formats. All write folders of part files through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import gff_escape


def _dot(c) -> F.Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("."))


def write_gff3(df: DataFrame, path: str, mode: str = "error") -> None:
    pairs = F.transform(F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), gff_escape(e["value"])))
    attrs = F.coalesce(F.nullif(F.array_join(F.array_sort(pairs), ";"), F.lit("")), F.lit("."))
    score = F.coalesce(F.format_string("%s", "score"), F.lit(".")) if "score" in df.columns else F.lit(".")
    score = F.when(F.col("score").isNull(), ".").otherwise(score) if "score" in df.columns else score
    phase = _dot("phase") if "phase" in df.columns else F.lit(".")
    source = _dot("source") if "source" in df.columns else F.lit(".")
    df.sortWithinPartitions("seqid", "start", "stop").select(F.concat_ws("\t", F.col("seqid").cast("string"), source, "type", F.col("start").cast("string"), F.col("stop").cast("string"), score, _dot("strand"), phase, attrs).alias("value")).write.mode(mode).text(path)


def write_fasta(df: DataFrame, path: str, width: int = 60, mode: str = "error") -> None:
    head = F.concat_ws(" ", F.concat(F.lit(">"), F.col("id").cast("string")), *([F.nullif("desc", F.lit(""))] if "desc" in df.columns else []))
    body = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    df.select(F.concat(head, F.lit("\n"), body).alias("value")).write.mode(mode).text(path)


def write_fastq(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(F.concat(F.lit("@"), F.col("id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode(mode).text(path)


def deinterleave(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and second mates of an interleaved read table by index."""
    return tuple(df.where(F.col("index") % 2 == k).withColumn("index", F.floor(F.col("index") / 2)) for k in (0, 1))


def interleave(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.withColumn("mate", F.lit(1)).unionByName(two.withColumn("mate", F.lit(2)))
    return both.orderBy("file", "index", "mate") if "file" in both.columns else both.orderBy("index", "mate")


def write_bedgraph(df: DataFrame, path: str, value: str = "depth", mode: str = "error") -> None:
    rows = df.repartitionByRange("seqid", "start").sortWithinPartitions("seqid", "start")
    rows.select(F.concat_ws("\t", F.col("seqid").cast("string"), (F.col("start") - 1).cast("string"), F.col("stop").cast("string"), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)


def write_wig(df: DataFrame, path: str, step: int, value: str = "mean", mode: str = "error") -> None:
    """Bins (seqid, bin, value) as variableStep blocks of 10,000 bins at most, so that gaps need no rows
    and a long sequence is written by many tasks."""
    d = df.withColumn("block", F.floor(F.col("bin") / 10_000)).repartition("seqid", "block").sortWithinPartitions("seqid", "bin")
    first = F.lag("bin").over(W.partitionBy("seqid", "block").orderBy("bin")).isNull()
    head = F.concat(F.lit("variableStep chrom="), F.col("seqid").cast("string"), F.lit(f" span={step}\n"))
    row = F.concat_ws(" ", (F.col("bin") * step + 1).cast("string"), F.col(value).cast("string"))
    d.select(F.when(first, F.concat(head, row)).otherwise(row).alias("value")).write.mode(mode).text(path)


def load_table(df: DataFrame, name: str, keys: list[str], order: list[str], buckets: int = 64, mode: str = "error") -> None:
    """``df`` as a catalog table in buckets of ``keys``, sorted by ``order`` inside: joins and windows on the keys, and
    reading a key's rows in order, need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*order).format("parquet").saveAsTable(name)


def load_jdbc(df: DataFrame, url: str, name: str, batch: int = 10_000, mode: str = "append", **options) -> None:
    """``df`` into a database table over JDBC, a connection per partition."""
    df.write.mode(mode).format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).save()


def read_jdbc(spark, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_by_key(df: DataFrame, keys: list[str], path: str, format: str = "parquet", mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*keys).format(format).save(path)


def write_chunks(df: DataFrame, n: int, path: str, format: str = "parquet", mode: str = "error") -> None:
    """Files of at most ``n`` records."""
    df.write.mode(mode).option("maxRecordsPerFile", n).format(format).save(path)


def write_matrix(df: DataFrame, path: str, fmt: str, mode: str = "error") -> None:
    """Aligned rows (sample, seq) as ``phylip``, ``nexus`` rows, ``structure`` (a symbol per column) or ``lian`` lines. Rows are
    dealt to files by sample: the header is the first line of the first file, and the files in the order of their names,
    one after the other, are the matrix."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("seq")).alias("m"))
    name = F.col("sample").cast("string")
    apart = lambda by: F.regexp_replace(F.regexp_replace("seq", "(?s)(.)", f"$1{by}"), f"{by}$", "")
    row = {
        "phylip": F.concat(F.rpad(name, 10, " "), "seq"), "nexus": F.concat_ws("\t", name, "seq"),
        "structure": F.concat_ws(" ", name, apart(" ")), "lian": F.concat_ws("\t", name, apart("\t")),
    }[fmt]
    rows = df.select(F.lit(1).alias("k"), name.alias("s"), row.alias("value"))
    head = {"phylip": F.format_string(" %d %d", "n", "m"), "nexus": F.format_string("#NEXUS\nbegin data;\ndimensions ntax=%d nchar=%d;\nmatrix", "n", "m")}.get(fmt)
    if head is not None:
        rows = rows.unionByName(size.select(F.lit(0).alias("k"), F.lit("").alias("s"), head.alias("value")))
    if fmt == "nexus":
        rows = rows.unionByName(size.select(F.lit(2).alias("k"), F.lit("").alias("s"), F.lit(";\nend;").alias("value")))
    rows.repartitionByRange("k", "s").sortWithinPartitions("k", "s").select("value").write.mode(mode).text(path)


def write_rsq(alleles: DataFrame, path: str, mode: str = "error", size: int = 100_000) -> None:
    """Alleles (chrom, pos, sample, ref, allele) as a folder per chromosome: the numbers of samples and sites, the positions, the
    reference alleles, and a row per sample; N where there is none. Sites are in the order of their positions. Texts are made of
    ``size`` positions each and then joined, as the format has a chromosome in one line."""
    base = lambda c: F.when(F.col(c).isNull() | F.col(c).isin("", "-"), "N").otherwise(F.col(c))
    part = F.floor(F.col("pos") / size).alias("part")
    listed = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda x: x[what].cast("string")), " ")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", c))), lambda x: x[c]), " ")
    sites = alleles.groupBy("chrom", "pos").agg(F.min(base("ref")).alias("a"))
    samples = alleles.select("chrom", "sample").distinct()
    # every site of every sample, where there is no allele null
    none = sites.select("chrom", "pos").join(samples, "chrom").select("chrom", "pos", "sample", F.lit(None).cast("string").alias("a"))
    cells = none.unionByName(alleles.select("chrom", "pos", "sample", base("allele").alias("a"))).groupBy("chrom", "pos", "sample").agg(F.coalesce(F.min("a"), F.lit("N")).alias("a"))
    rows = cells.groupBy("chrom", "sample", part).agg(listed("a").alias("text")).groupBy("chrom", "sample").agg(joined("text").alias("text"))
    name = F.col("sample").cast("string")
    lines = rows.select("chrom", F.lit(3).alias("k"), name.alias("s"), F.concat_ws(" ", name, "text").alias("value"))
    head = sites.groupBy("chrom", part).agg(listed("pos").alias("at"), listed("a").alias("ref"), F.count(F.lit(1)).alias("m"))
    head = head.groupBy("chrom").agg(joined("at").alias("at"), joined("ref").alias("ref"), F.sum("m").alias("m")).join(samples.groupBy("chrom").agg(F.count(F.lit(1)).alias("n")), "chrom")
    heads = F.array(F.format_string("%d %d", "n", "m"), F.col("at"), F.col("ref"))
    lines = lines.union(head.select("chrom", F.posexplode(heads).alias("k", "value")).select("chrom", "k", F.lit(""), "value"))
    lines.repartitionByRange("chrom", "k", "s").sortWithinPartitions("chrom", "k", "s").select("chrom", "value").write.mode(mode).partitionBy("chrom").text(path)


def split_records(text: DataFrame, name_pattern: str, path: str, mode: str = "error") -> None:
    """Records (column value) into one folder per name that the pattern's first group gives."""
    text.withColumn("name", F.regexp_extract("value", name_pattern, 1)).where("name <> ''").write.mode(mode).partitionBy("name").text(path)
