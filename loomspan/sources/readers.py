"""Readers of genome text formats. Coordinates come out 1-based and closed, missing values as null.

Compressed files are read as Spark reads them; a gzip file is one partition, so
repartition what is large. Text order matters to a few readers (fill-down, first
hit, four-line records); those number the lines of each file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _known(c: Column, *missing: str) -> Column:
    return F.when(~c.isin("", ".", *missing), c)


def _stretches(batches):
    """(file, block), whether it begins here, rows: stretches of batches that come from one split of a file."""
    key = None
    for batch in batches:
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        codes = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                here = (files.dictionary[int(codes[low])].as_py(), int(blocks[low]))
                yield here, here != key, batch.slice(low, high - low)
                key = here


def _numbered(batches):
    """Lines with their number in their split, and the last ``carried`` at or above each of them there."""
    n, last = 0, None
    for _, first, rows in _stretches(batches):
        n, last = (0, None) if first else (n, last)
        carried = rows.column("carried")
        carried = pc.fill_null_forward(pa.concat_arrays([pa.array([last], carried.type), carried]))[1:]
        inner = pa.array(np.arange(n + 1, n + rows.num_rows + 1))
        yield pa.RecordBatch.from_arrays([rows.column("file"), rows.column("block"), inner, rows.column("value"), carried], ["file", "block", "inner", "value", "carried"])
        n, last = n + rows.num_rows, carried[-1].as_py()


def _split_ends(batches):
    """A row per split: how many lines it has, and its last ``carried``."""
    found = {}
    for here, _, rows in _stretches(batches):
        n, last = found.get(here, (0, None))
        carried = rows.column("carried").drop_null()
        found[here] = (n + rows.num_rows, carried[-1].as_py() if len(carried) else last)
    columns = [[f for f, _ in found], [b for _, b in found], [n for n, _ in found.values()], [c for _, c in found.values()]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["file", "block", "n", "last"])


def lines(spark: SparkSession, path: str, carried: Column | None = None) -> DataFrame:
    """(file, line_no, value, carried) of text files: lines numbered from 1 within each file, and the last ``carried`` (a text
    of a line, or null) at or above each line in its file. Splits are read in order and no line is shuffled; the lines of the
    splits before come from a first look at the files, a row per split."""
    t = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", (F.lit(None) if carried is None else carried).cast("string").alias("carried"))
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ends = t.select("file", "block", "carried").mapInArrow(_split_ends, "file string, block long, n long, last string")
    ends = ends.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"), F.last("last", ignorenulls=True).over(w).alias("above"))
    rows = t.mapInArrow(_numbered, "file string, block long, inner long, value string, carried string")
    return rows.join(F.broadcast(ends), ["file", "block"]).select("file", (F.col("base") + F.col("inner")).alias("line_no"), "value", F.coalesce("carried", "above").alias("carried"))


def _tabbed(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    t = spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    return t.select(F.split("value", "\t").alias("f"))


def _gff(df: DataFrame, attrs: Column) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i))
    return df.select(
        f(0).alias("seqid"), _known(f(1)).alias("source"), f(2).alias("type"), f(3).cast("long").alias("start"), f(4).cast("long").alias("stop"),
        _known(f(5)).cast("double").alias("score"), F.when(f(6).isin("+", "-"), f(6)).alias("strand"), _known(f(7)).cast("int").alias("phase"), attrs.alias("attrs"),
    )


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Features with attributes ``k=v;...`` as a map."""
    pairs = F.filter(F.transform(F.split(F.get("f", F.lit(8)), ";"), lambda x: F.trim(x)), lambda x: x.contains("="))
    attrs = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, F.lit("=")) + 1).alias("v")))))
    return _gff(_tabbed(spark, path), attrs)


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with attributes ``key "value";`` as a map; of repeated keys the first counts."""
    text = F.get("f", F.lit(8))
    keys, values = (F.regexp_extract_all(text, F.lit(r'(\w+)\s+"?([^";]*)"?\s*(?:;|$)'), F.lit(i)) for i in (1, 2))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(0), F.greatest(F.size(keys) - 1, F.lit(0))).alias("i")), lambda x: (x["k"].isNotNull()) & (F.array_position(keys, x["k"]) == x["i"] + 1))
    return _gff(_tabbed(spark, path), F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"]))))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED intervals (0-based, half open in the file) as seqid, start, stop, name, score, strand."""
    f = lambda i: F.get("f", F.lit(i))
    t = spark.read.text(path).where(~F.col("value").rlike(r"^(track|browser|#)|^\s*$")).select(F.split("value", r"\s+").alias("f"))
    return t.select(f(0).alias("seqid"), (f(1).cast("long") + 1).alias("start"), f(2).cast("long").alias("stop"), f(3).alias("name"), _known(f(4)).cast("double").alias("score"), F.when(f(5).isin("+", "-"), f(5)).alias("strand"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Sequence records: id, desc, seq."""
    t = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_replace(F.substring_index("v", "\n", 1), r"\r$", "")
    body = F.when(F.instr("v", "\n") > 0, F.substr("v", F.instr("v", "\n") + 1))
    return t.select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*\s*", "")).alias("desc"), F.coalesce(F.regexp_replace(body, r"\s", ""), F.lit("")).alias("seq"))


def _fastq_records(batches):
    """Reads from pieces between line breaks before ``@``, a piece a row. A quality string that begins with @ makes a piece of
    its own, which is put back; where the two pieces lie in two splits, each goes out as a fragment with the border between."""
    key, n, waiting = None, 0, None
    for batch in batches:
        out = []

        def put(kind, border, head, seq, qual):
            nonlocal n
            out.append((*key[:2], n, kind, border, head, seq, qual))
            n += kind != 2

        for *here, text in zip(*(c.to_pylist() for c in batch.columns)):
            first = here != key
            if first:
                if waiting:
                    put(1, key[1] + key[2], *waiting, None)
                key, n, waiting = here, 0, None
            if first and here[1] == 0:
                if not text:
                    continue
                if not text.startswith("@"):
                    raise ValueError(f"record out of register: {text[:80]}")
                text = text[1:]
            rows = [x.removesuffix("\r") for x in text.split("\n")]
            if len(rows) in (2, 5) and not rows[-1]:  # the file's last line break
                rows.pop()
            if waiting and len(rows) == 1:
                put(0, None, *waiting, "@" + rows[0])
                waiting = None
            elif waiting or len(rows) not in (3, 4) and not (first and len(rows) == 1) or len(rows) > 2 and not rows[2].startswith("+") or len(rows) == 4 and rows[1] and not rows[3]:
                raise ValueError(f"record out of register: {text[:80]}")
            elif len(rows) == 1:
                put(2, here[1], None, None, "@" + rows[0])
            elif len(rows) == 3:
                waiting = rows[:2]
            else:
                put(0, None, rows[0], rows[1], rows[3])
        columns = list(zip(*out)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FASTQ_TYPES)], FASTQ_NAMES)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*key[:2], n, 1, key[1] + key[2], *waiting, None), FASTQ_TYPES)], FASTQ_NAMES)


FASTQ_NAMES = ["file", "block", "inner", "kind", "border", "head", "seq", "qual"]
FASTQ_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]


def read_fastq(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Four-line read records: file, index (from 0), id, desc, seq, qual. A record out of register fails the read.

    Splits of the files are read record by record, so no line is shuffled: only the two halves of a record that a split
    cuts meet. ``numbered`` counts the records of all splits first, which takes a second look at the files; without it
    there is no index."""
    t = spark.read.option("lineSep", "\n@").text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length"), "value")
    r = t.mapInArrow(_fastq_records, "file string, block long, inner long, kind int, border long, head string, seq string, qual string")
    halves = r.where("kind > 0").groupBy("file", "border").agg(*(F.max(c).alias(c) for c in ("block", "inner", "head", "seq", "qual")), F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("kind") == 1, F.col("block"))).alias("own"))
    torn = F.raise_error(F.concat(F.lit("record out of register at byte "), F.col("border").cast("string"), F.lit(" of "), F.col("file"))).cast("string")
    halves = halves.select("file", F.col("own").alias("block"), "inner", F.when((F.col("n") == 2) & F.col("own").isNotNull(), F.col("head")).otherwise(torn).alias("head"), "seq", "qual")
    r = r.where("kind = 0").select("file", "block", "inner", "head", "seq", "qual").unionByName(halves)
    kept = [F.regexp_extract("head", r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace("head", r"^\S*\s*", "")).alias("desc"), "seq", "qual"]
    if not numbered:
        return r.select("file", *kept)
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    base = r.groupBy("file", "block").agg(F.max("inner").alias("last")).withColumn("base", F.coalesce(F.sum(F.col("last") + 1).over(w), F.lit(0))).drop("last")
    return r.join(base, ["file", "block"]).select("file", (F.col("base") + F.col("inner")).alias("index"), *kept)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Genotypes in long form: seqid, pos, id, ref, alt, qual, filter, info (a map), sample, gt. Sample names come
    from each file's #CHROM line."""
    t = spark.read.text(path).withColumn("file", F.input_file_name())
    heads = t.where(F.col("value").startswith("#CHROM")).select("file", F.slice(F.split("value", "\t"), F.lit(10), F.greatest(F.size(F.split("value", "\t")) - 9, F.lit(0))).alias("names"))
    f = lambda i: F.get("f", F.lit(i))
    rows = t.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", F.split("value", "\t").alias("f")).join(heads, "file")
    info = F.map_from_entries(F.array_distinct(F.transform(F.split(f(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.instr(x, F.lit("=")) + 1)).otherwise("1").alias("v")))))
    rows = rows.select(f(0).alias("seqid"), f(1).cast("long").alias("pos"), _known(f(2)).alias("id"), f(3).alias("ref"), _known(f(4)).alias("alt"), _known(f(5)).cast("double").alias("qual"), _known(f(6)).alias("filter"), info.alias("info"), F.arrays_zip("names", F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("g")).alias("calls"))
    return rows.select("*", F.explode_outer("calls").alias("c")).select("seqid", "pos", "id", "ref", "alt", "qual", "filter", "info", F.col("c.names").alias("sample"), F.substring_index("c.g", ":", 1).alias("gt"))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Pileup rows: seqid, pos, ref, alleles, three qualities, reads; kind is indel where the reference is ``*``."""
    f = lambda i: F.get("f", F.lit(i))
    return _tabbed(spark, path).select(f(0).alias("seqid"), f(1).cast("long").alias("pos"), f(2).alias("ref"), f(3).alias("alleles"), f(4).cast("int").alias("consensus_qual"), f(5).cast("int").alias("snp_qual"), f(6).cast("int").alias("map_qual"), f(7).cast("int").alias("reads"), F.when(f(2) == "*", "indel").otherwise("snp").alias("kind"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: name, flag, seqid, start, stop, mapq, cigar, strand, seq, qual, weight (the count in names like
    id-count), mapped. The end comes from the CIGAR's reference bases."""
    f = lambda i: F.get("f", F.lit(i))
    span = F.aggregate(F.transform(F.regexp_extract_all(f(5), F.lit(r"(\d+)[MDN=X]"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    t = _tabbed(spark, path, "@").select(
        f(0).alias("name"), f(1).cast("int").alias("flag"), _known(f(2), "*").alias("seqid"), f(3).cast("long").alias("start"), f(4).cast("int").alias("mapq"), f(5).alias("cigar"),
        (f(3).cast("long") + F.greatest(span, F.lit(1)) - 1).alias("stop"), _known(f(9), "*").alias("seq"), _known(f(10), "*").alias("qual"),
    )
    weight = F.coalesce(F.nullif(F.regexp_extract("name", r"[-_x](\d+)$", 1), F.lit("")).cast("long"), F.lit(1))
    return t.withColumns({"strand": F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+"), "weight": weight, "mapped": F.col("flag").bitwiseAND(4) == 0})


def read_soap(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i))
    return _tabbed(spark, path).select(f(0).alias("name"), f(1).alias("seq"), f(2).alias("qual"), f(3).cast("int").alias("hits"), f(5).cast("int").alias("length"), f(6).alias("strand"), f(7).alias("seqid"), f(8).cast("long").alias("start"), (f(8).cast("long") + f(5).cast("long") - 1).alias("stop"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("mismatches"))


HIT = ("query", "hit", "pid", "aln_len", "mismatches", "gaps", "qstart", "qstop", "sstart", "sstop", "evalue", "bits")


def read_blast_tab(spark: SparkSession, path: str) -> DataFrame:
    """Twelve-column hits with file, line_no and, where ``# Query:`` comments name a length, qlen."""
    length = F.nullif(F.regexp_extract("value", r"^#\s*Query:.*?(\d+)\s*(?:nt|aa|letters)?\)?\s*$", 1), F.lit("")).cast("long")
    t = lines(spark, path, F.when(F.col("value").startswith("#"), length)).withColumn("qlen", F.col("carried").cast("long"))
    t = t.where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("f", F.split("value", "\t"))
    kinds = ["string", "string", "double", "long", "long", "long", "long", "long", "long", "long", "double", "double"]
    return t.select("file", "line_no", "qlen", *(F.get("f", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(zip(HIT, kinds))))


def read_named_fields(spark: SparkSession, path: str, marker: str = "# Fields:") -> DataFrame:
    """Rows of tables that name their columns in a comment, as (file, line_no, fields map)."""
    t = lines(spark, path, F.when(F.col("value").startswith(marker), F.substr("value", F.lit(len(marker) + 1))))
    t = t.withColumn("names", F.transform(F.split("carried", r"\t|,"), lambda x: F.trim(x)))
    t = t.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    values = F.split("value", "\t")
    return t.select("file", "line_no", F.map_from_entries(F.filter(F.transform(F.arrays_zip(F.col("names").alias("k"), values.alias("v")), lambda x: F.struct(x["k"], x["v"])), lambda x: x["k"].isNotNull())).alias("fields"))


def to_m9(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of ``read_named_fields`` as twelve-column hits; ``names`` maps the columns of HIT to the table's."""
    return df.select("file", "line_no", *(F.try_element_at("fields", F.lit(names.get(n, n))).alias(n) for n in HIT))


def read_hmmer(spark: SparkSession, path: str, version: int = 3) -> DataFrame:
    """Domain hits of HMMER 3 tables (23 columns, the last one free text) or of 8-column HMMER 2 tables."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if version == 3:
        f = t.select(F.split("value", r"\s+", 23).alias("f"))
        take = {"domain": (0, "string"), "acc": (1, "string"), "tlen": (2, "long"), "gene": (3, "string"), "qlen": (5, "long"), "evalue": (12, "double"), "score": (13, "double"), "hmm_from": (15, "long"), "hmm_to": (16, "long"), "ali_from": (17, "long"), "ali_to": (18, "long"), "description": (22, "string")}
    else:
        f = t.select(F.split("value", r"\t|\s{2,}|\s").alias("f"))
        take = {"gene": (0, "string"), "domain": (1, "string"), "ali_from": (2, "long"), "ali_to": (3, "long"), "hmm_from": (4, "long"), "hmm_to": (5, "long"), "score": (6, "double"), "evalue": (7, "double")}
    return f.select(*(F.when(F.get("f", F.lit(i)) != "-", F.get("f", F.lit(i))).cast(k).alias(n) for n, (i, k) in take.items()))


def read_interpro(spark: SparkSession, path: str) -> DataFrame:
    f = lambda i: F.nullif(F.nullif(F.get("f", F.lit(i)), F.lit("-")), F.lit(""))
    split = lambda i: F.coalesce(F.split(f(i), r"\|"), F.array().cast("array<string>"))
    return _tabbed(spark, path).select(f(0).alias("protein"), f(2).cast("long").alias("length"), f(3).alias("method"), f(4).alias("dbid"), f(5).alias("hitdesc"), f(6).cast("long").alias("start"), f(7).cast("long").alias("stop"), f(8).cast("double").alias("evalue"), f(11).alias("ipr"), f(12).alias("iprdesc"), split(13).alias("go"), split(14).alias("pathways"))


def read_repeatmasker(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    return t.select(f(0).cast("long").alias("score"), f(1).cast("double").alias("div"), f(4).alias("seqid"), f(5).cast("long").alias("start"), f(6).cast("long").alias("stop"), F.when(f(8) == "C", "-").otherwise("+").alias("strand"), f(9).alias("family"), f(10).alias("class"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Ortholog groups ``id: sp|gene ...`` or ``ORTHOMCLn(g genes,t taxa): gene(sp) ...`` as group_id, species, gene."""
    t = spark.read.text(path).where(F.col("value").contains(":"))
    g = t.select(F.regexp_extract("value", r"^\s*([^:(\s]+)", 1).alias("group_id"), F.explode(F.split(F.trim(F.regexp_extract("value", r"^[^:]*:(.*)$", 1)), r"\s+")).alias("m")).where("m <> ''")
    old = F.col("m").rlike(r"^.*\(.*\)$")
    return g.select("group_id", F.when(old, F.regexp_extract("m", r"\(([^)]*)\)$", 1)).otherwise(F.substring_index("m", "|", 1)).alias("species"), F.when(old, F.regexp_extract("m", r"^(.*)\([^)]*\)$", 1)).otherwise(F.regexp_replace("m", r"^[^|]*\|", "")).alias("gene"))


def read_synteny_map(spark: SparkSession, path: str, genomes: list[str]) -> DataFrame:
    """Blocks in long form, 1-based: block, genome, seqid, start, stop, strand; genomes marked NA in a block are left out."""
    f = lambda i: F.get("f", F.lit(i))
    rows = F.array(*(F.struct(F.lit(g).alias("genome"), f(4 * i + 1).alias("seqid"), (f(4 * i + 2).try_cast("long") + 1).alias("start"), f(4 * i + 3).try_cast("long").alias("stop"), f(4 * i + 4).alias("strand")) for i, g in enumerate(genomes)))
    return _tabbed(spark, path).select(f(0).cast("long").alias("block"), F.inline(rows)).where("seqid <> 'NA'")


#: columns of the two MUMmer tables in tab form, with their types
SHOW_SNPS = {"pos": "long", "ref_base": "string", "query_base": "string", "query_pos": "long", "buff": "long", "dist": "long", "ref_frame": "int", "query_frame": "int", "ref_seqid": "string", "query_seqid": "string"}
SHOW_COORDS = {"start": "long", "stop": "long", "query_start": "long", "query_stop": "long", "length": "long", "query_length": "long", "pid": "double", "ref_seqid": "string", "query_seqid": "string"}


def read_mummer(spark: SparkSession, path: str, names: dict[str, str] | list[str], program: str = "NUCMER") -> DataFrame:
    """Rows below a banner (a line of input files, the program's name, column titles in brackets); ``names`` are the
    columns, with their types or as strings. Every file must have the banner."""
    kinds = names if isinstance(names, dict) else dict.fromkeys(names, "string")
    t = spark.read.text(path).withColumn("file", F.input_file_name())
    flawed = t.groupBy("file").agg(F.max((F.trim("value") == program).cast("int")).alias("named"), F.max(F.trim("value").startswith("[").cast("int")).alias("titled"))
    flawed = flawed.where("named = 0 OR titled = 0").agg(F.first("file").alias("flawed"))  # one row
    row = F.col("value").rlike(r"^\s*-?\d")
    rows = t.where(row).select("value").join(F.broadcast(flawed), how="cross")
    f = F.when(F.col("flawed").isNull(), F.split(F.trim("value"), r"\t|\s*\|\s*|\s+")).otherwise(F.raise_error(F.concat(F.lit("no banner: "), "flawed")))
    return rows.select(f.alias("f")).select(*(F.get("f", F.lit(i)).cast(k).alias(n) for i, (n, k) in enumerate(kinds.items())))


def read_show_snps(spark: SparkSession, path: str) -> DataFrame:
    """Substitutions and indels between two genomes; a base of an indel is null."""
    d = read_mummer(spark, path, SHOW_SNPS)
    return d.withColumns({c: _known(F.col(c)) for c in ("ref_base", "query_base")})


def read_show_coords(spark: SparkSession, path: str) -> DataFrame:
    """Aligned regions with start <= stop on both sides and the strand of the query."""
    d = read_mummer(spark, path, SHOW_COORDS)
    return d.withColumns({"strand": F.when(F.col("query_start") > F.col("query_stop"), "-").otherwise("+"), "query_start": F.least("query_start", "query_stop"), "query_stop": F.greatest("query_start", "query_stop")})


def read_table(spark: SparkSession, path: str, require: list[str] = (), sep: str = "\t") -> DataFrame:
    df = spark.read.csv(path, header=True, sep=sep)
    if missing := [c for c in require if c not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of an ontology: term, name, namespace, subsets; and (child, parent, rel) of is_a and relationships."""
    t = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("[Term]"))
    one = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}: (.*?)\s*$", 1), F.lit(""))
    terms = t.select(one("id").alias("term"), one("name").alias("name"), one("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r"(?m)^subset: (\S+)"), F.lit(1)).alias("subsets"), F.col("value").contains("is_obsolete: true").alias("obsolete"))
    isa = t.select(one("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent"), F.lit("is_a").alias("rel"))
    rel = t.select(one("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^relationship: (\S+ \S+)"), F.lit(1))).alias("r")).select("child", F.split("r", " ")[1].alias("parent"), F.split("r", " ")[0].alias("rel"))
    return terms, isa.unionByName(rel)


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, names) of taxonomy dumps: taxid, parent, rank; and taxid, name (scientific names)."""
    rows = lambda name: spark.read.text(f"{folder}/{name}.dmp").select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    return rows("nodes").select(f(0).cast("long").alias("taxid"), f(1).cast("long").alias("parent"), f(2).alias("rank")), rows("names").where(f(3) == "scientific name").select(f(0).cast("long").alias("taxid"), f(1).alias("name"))


def read_pfam2go(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.text(path).where(~F.col("value").startswith("!"))
    return t.select(F.regexp_extract("value", r"^Pfam:(\S+)", 1).alias("domain"), F.regexp_extract("value", r"(GO:\d+)\s*$", 1).alias("go")).where("domain <> '' AND go <> ''")


def read_map(spark: SparkSession, path: str, names: tuple[str, str] = ("key", "value")) -> DataFrame:
    return _tabbed(spark, path).select(F.get("f", F.lit(0)).alias(names[0]), F.get("f", F.lit(1)).alias(names[1]))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Alignment blocks of FASTA files; a block's name is its folder's."""
    t = spark.read.option("lineSep", "\n>").text(path).withColumn("block", F.element_at(F.split(F.input_file_name(), "/"), -2))
    v = F.regexp_replace("value", "^>", "")
    return t.select("block", F.regexp_extract(v, r"^(\S*)", 1).alias("row_id"), F.regexp_replace(F.substr(v, F.instr(v, F.lit("\n")) + 1), r"\s", "").alias("aln")).where("row_id <> ''")


def read_rnaz(spark: SparkSession, path: str) -> DataFrame:
    """The better strand of each window of RNAz reports that is classed as RNA: seqid, start, stop, strand, p, z (mean z-score).

    A window is a sequence of the report's first alignment row, ``>name start length strand size``; start counts from 0, from
    the other end on the reverse strand. Both reading directions of a window are reports of their own."""
    t = spark.read.option("lineSep", "############################  RNAz").text(path)
    one = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    head = lambda i: F.regexp_extract("value", r"(?m)^>(\S+)\s+(\d+)\s+(\d+)\s+([+-])\s+(\d+)", i)
    at, size, total = (F.nullif(head(i), F.lit("")).cast("long") for i in (2, 3, 5))
    first = F.when(head(4) == "-", total - at - size).otherwise(at) + 1
    r = t.select(
        head(1).alias("seqid"), first.alias("start"), (first + size - 1).alias("stop"), (head(4) == "-").alias("minus"), (one(r"Reading direction:\s*(\w+)") == "reverse").alias("reverse"),
        one(r"SVM RNA-class probability:\s*([\d.eE+-]+)").cast("double").alias("p"), one(r"Mean z-score:\s*([\d.eE+-]+)").cast("double").alias("z"), one(r"Prediction:\s*(\w+)").alias("prediction"),
    ).where("p IS NOT NULL AND start IS NOT NULL")
    best = r.groupBy("seqid", "start", "stop").agg(F.max_by(F.struct("minus", "reverse", "p", "z", "prediction"), F.struct("p", ~F.col("reverse"))).alias("b")).select("seqid", "start", "stop", "b.*")
    return best.where("prediction = 'RNA'").select("seqid", "start", "stop", F.when(F.col("minus") != F.col("reverse"), "-").otherwise("+").alias("strand"), "p", "z")


def read_exonerate(spark: SparkSession, path: str) -> DataFrame:
    """Features between the START and END marks of Exonerate GFF dumps, with the query's and target's lengths where
    ``vulgar`` or length lines give them."""
    t = spark.read.option("lineSep", "# --- START OF GFF DUMP ---").text(path).withColumn("file", F.input_file_name())
    body = F.substring_index("value", "# --- END OF GFF DUMP ---", 1)
    rows = t.where(F.col("value").contains("# --- END OF GFF DUMP ---")).select("file", F.explode(F.split(body, "\n")).alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    f = lambda i: F.get(F.split("line", "\t"), F.lit(i))
    attrs = F.str_to_map(F.regexp_replace(F.coalesce(f(8), F.lit("")), r"\s*;\s*", ";"), F.lit(";"), F.lit(" "))
    return rows.select("file", f(0).alias("seqid"), f(1).alias("source"), f(2).alias("type"), f(3).cast("long").alias("start"), f(4).cast("long").alias("stop"), _known(f(5)).cast("double").alias("score"), F.when(f(6).isin("+", "-"), f(6)).alias("strand"), attrs.alias("attrs")).where("start IS NOT NULL")


def read_exonerate_hits(spark: SparkSession, path: str) -> DataFrame:
    """The ``vulgar`` lines of Exonerate reports: both intervals (1-based, start <= stop) and strands, score, aligned
    lengths (of query and target) in matches, codons and split codons, and the number of gaps, introns and frameshifts."""
    t = spark.read.text(path).where(F.col("value").startswith("vulgar: ")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    f = lambda i: F.get("f", F.lit(i))
    n = F.floor((F.size("f") - 10) / 3)
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("f", (10 + 3 * i).cast("int")).alias("op"), F.get("f", (11 + 3 * i).cast("int")).cast("long").alias("q"), F.get("f", (12 + 3 * i).cast("int")).cast("long").alias("t")))).otherwise(F.array().cast("array<struct<op:string,q:bigint,t:bigint>>"))
    t = t.withColumn("ops", parts)
    total = lambda side: F.aggregate(F.filter("ops", lambda x: x["op"].isin("M", "C", "S")), F.lit(0).cast("long"), lambda a, x: a + x[side])
    count = lambda *ops: F.size(F.filter("ops", lambda x: x["op"].isin(*ops)))
    span = lambda i: [F.least(f(i).cast("long"), f(i + 1).cast("long")) + 1, F.greatest(f(i).cast("long"), f(i + 1).cast("long"))]
    return t.select(
        f(1).alias("query"), span(2)[0].alias("qstart"), span(2)[1].alias("qstop"), f(4).alias("qstrand"), f(5).alias("seqid"), span(6)[0].alias("start"), span(6)[1].alias("stop"), f(8).alias("strand"),
        f(9).cast("long").alias("score"), total("q").alias("query_aligned"), total("t").alias("target_aligned"), count("G").alias("gaps"), count("I").alias("introns"), count("F").alias("frameshifts"),
    )


def read_gene_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of gene-prediction reports: genes and transcripts, whose last field is a bare id, and parts with
    ``transcript_id "t"; gene_id "g";``, as features with attributes. Comments and embedded sequences are skipped."""
    f = lambda i: F.get("f", F.lit(i))
    named = lambda k: F.nullif(F.regexp_extract(f(8), rf'{k} "([^"]*)"', 1), F.lit(""))
    bare = F.when(~F.contains(f(8), F.lit('"')), F.trim(f(8)))
    pairs = F.array(F.struct(F.lit("ID").alias("k"), bare.alias("v")), F.struct(F.lit("gene_id").alias("k"), named("gene_id").alias("v")), F.struct(F.lit("transcript_id").alias("k"), named("transcript_id").alias("v")))
    return _gff(_tabbed(spark, path).where(F.size("f") == 9), F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())))


def flagstat_table(spark: SparkSession, path: str, name: str = r"([^/]+?)\.[^/]*$") -> DataFrame:
    """One row per flagstat file: sample, total, mapped, duplicates, kept; ``name`` finds the sample in a file's path."""
    t = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), name, 1).alias("sample"), F.regexp_extract("value", r"^(\d+)", 1).cast("long").alias("n"), "value")
    at = lambda p: F.max(F.when(F.col("value").rlike(p), F.col("n")))
    g = t.groupBy("sample").agg(at(r"in total").alias("total"), at(r"\+ \d+ mapped|^\d+ mapped").alias("mapped"), at(r"duplicates").alias("duplicates"))
    return g.withColumn("kept", F.col("mapped") - F.col("duplicates"))


def training_summary(spark: SparkSession, bits: str, coverage: str, p: str = r"_([\d.]+)_([\d.]+?)\.[A-Za-z]+$") -> DataFrame:
    """Bits and coverage of training runs by the two parameters in their file names (``..._a_b.txt``), which ``p`` finds in a path."""

    def read(path, name):
        t = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), p, 1).cast("double").alias("a"), F.regexp_extract(F.input_file_name(), p, 2).cast("double").alias("b"), F.regexp_extract("value", r"([\d.eE+-]+)\s*$", 1).try_cast("double").alias("v"))
        return t.groupBy("a", "b").agg(F.max("v").alias(name))

    return read(bits, "bits").join(read(coverage, "coverage"), ["a", "b"]).orderBy("a", "b")
