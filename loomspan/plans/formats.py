"""Queries of readers and sinks (A1-A36, B16, B19, D35): the driver's tables are written in a format and read back; the
SQL gives the rows that were written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import feature_name
from loomspan.operators import comparative as C
from loomspan.operators import features as G
from loomspan.plans.views import Views, query
from loomspan.sources import readers as R
from loomspan.sources import sinks as S
from loomspan.sources.scratch import new_folder


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def tabbed(*fields: str | Column) -> Column:
    return F.concat_ws("\t", *map(text, fields))


def lit(x) -> Column:
    return F.lit(str(x))


def written(v: Views, df: DataFrame, value: Column, head: str | None = None, by: str | None = None, **options) -> str:
    """``value`` of each row as text in a new folder; ``head`` is a first line of its own file, ``by`` a column that
    names a folder for the rows that share it."""
    path = new_folder(v.spark, "text")
    rows = df.select(value.alias("value"), *([by] if by else []))
    w = rows.write.options(**options)
    (w.partitionBy(by) if by else w).text(path)
    if head:
        v.table("region").limit(1).select(F.lit(head).alias("value")).write.mode("append").options(**options).text(path)
    return path


@query("read_gff3", "SELECT seqid::VARCHAR AS seqid, 'src' AS source, type, start, stop, score::DOUBLE AS score, strand, parent AS id, 'a=b' AS note FROM features")
def read_gff3(v):
    d = R.read_gff3(v.spark, written(v, v.features, tabbed("seqid", lit("src"), "type", "start", "stop", "score", "strand", lit("."), F.concat(F.lit("ID="), "parent", F.lit(";Note=a=b"))), "##gff-version 3\n"))
    return d.select("seqid", "source", "type", "start", "stop", "score", "strand", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Note"].alias("note"))


@query("read_gtf", "SELECT seqid::VARCHAR AS seqid, type, start, stop, strand, parent AS gene, 't ' || start AS transcript FROM features")
def read_gtf(v):
    attrs = F.concat(F.lit('gene_id "'), "parent", F.lit('"; transcript_id "t '), text("start"), F.lit('"; gene_id "other";'))
    d = R.read_gtf(v.spark, written(v, v.features, tabbed("seqid", lit("x"), "type", "start", "stop", lit("."), "strand", lit("."), attrs), "# comment"))
    return d.select("seqid", "type", "start", "stop", "strand", F.col("attrs")["gene_id"].alias("gene"), F.col("attrs")["transcript_id"].alias("transcript"))


@query("read_bed", "SELECT seqid::VARCHAR AS seqid, start, stop, 'J' || event_id AS name, weight::DOUBLE AS score, strand FROM reads")
def read_bed(v):
    return R.read_bed(v.spark, written(v, v.reads, tabbed("seqid", F.col("start") - 1, "stop", F.concat(lit("J"), text("event_id")), "weight", "strand"), "track name=junctions"))


@query("read_fasta", """SELECT CAST(id AS VARCHAR) AS id, 'length ' || length(seq) AS "desc", seq FROM seqs WHERE seq IS NOT NULL""")
def write_fasta(v):
    path = new_folder(v.spark, "fasta")
    S.write_fasta(v.seqs.where("seq IS NOT NULL").withColumn("desc", F.concat(F.lit("length "), text(F.length("seq")))), path, width=60)
    return R.read_fasta(v.spark, path)


FASTQ = "SELECT 'r' || event_id AS id, base5 || base3 AS seq, CASE WHEN strand = '+' THEN '@I' ELSE '+#' END AS qual FROM reads"


def _fastq(v):
    return v.reads.select(F.concat(F.lit("r"), text("event_id")).alias("id"), F.concat("base5", "base3").alias("seq"), F.when(F.col("strand") == "+", "@I").otherwise("+#").alias("qual"))


@query("read_fastq", FASTQ)
def read_fastq(v):
    path = new_folder(v.spark, "fastq")
    S.write_fastq(_fastq(v), path)
    return R.read_fastq(v.spark, path).select("id", "seq", "qual")


@query("read_vcf", """SELECT chrom::VARCHAR AS seqid, pos, ref, 'PASS' AS filter, '0.5' AS af, 'S' || sample AS sample, CASE WHEN allele IS NULL THEN './.' WHEN allele = ref THEN '0/0' ELSE '1/1' END AS gt FROM alleles""")
def read_vcf(v):
    gt = F.when(F.col("allele").isNull(), "./.").when(F.col("allele") == F.col("ref"), "0/0").otherwise("1/1")
    calls = F.transform(F.array_sort(F.collect_list(F.struct("sample", F.concat(gt, F.lit(":9")).alias("gt")))), lambda x: x["gt"])
    sites = v.alleles.groupBy("chrom", "pos", "ref").agg(calls.alias("calls"), F.collect_set("sample").alias("names"))
    row = tabbed("chrom", "pos", lit("."), "ref", lit("."), lit("."), lit("PASS"), lit("AF=0.5;DB"), lit("GT:DP"), F.array_join("calls", "\t"))
    head = tabbed(lit("##fileformat=VCFv4.1\n#CHROM"), *map(lit, "POS ID REF ALT QUAL FILTER INFO FORMAT".split()), F.array_join(F.transform(F.array_sort("names"), lambda x: F.concat(F.lit("S"), text(x))), "\t"))
    lines = sites.select("chrom", F.lit(1).alias("k"), row.alias("value")).union(sites.groupBy("chrom").agg(F.min("names").alias("names")).select("chrom", F.lit(0), head))
    path = new_folder(v.spark, "vcf")
    lines.repartition("chrom").sortWithinPartitions("chrom", "k").select("chrom", "value").write.partitionBy("chrom").text(path)  # a file per chromosome
    return R.read_vcf(v.spark, path).select("seqid", "pos", "ref", "filter", F.col("info")["AF"].alias("af"), "sample", "gt")


@query("read_pileup", "SELECT CAST(p_partkey % 5 AS VARCHAR) AS seqid, p_partkey AS pos, CASE WHEN p_size % 9 = 0 THEN '*' ELSE 'A' END AS ref, 'R' AS alleles, p_size AS consensus_qual, p_size + 1 AS snp_qual, 60 AS map_qual, p_size + 2 AS reads, CASE WHEN p_size % 9 = 0 THEN 'indel' ELSE 'snp' END AS kind FROM part")
def read_pileup(v):
    size = F.col("p_size")
    return R.read_pileup(v.spark, written(v, v.table("part"), tabbed(F.col("p_partkey") % 5, "p_partkey", F.when(size % 9 == 0, "*").otherwise("A"), lit("R"), size, size + 1, lit(60), size + 2, lit("."), lit("I"))))


@query("read_sam", """SELECT 'r' || event_id || '-' || weight AS name, CASE WHEN strand = '-' THEN 16 ELSE 0 END AS flag, seqid::VARCHAR AS seqid, start, start + 13 AS stop, 40 AS mapq, '5M2D3M1I4M' AS cigar, strand, base5 AS seq, NULL::VARCHAR AS qual, weight, TRUE AS mapped FROM reads""")
def read_sam(v):
    row = tabbed(F.concat(F.lit("r"), text("event_id"), F.lit("-"), text("weight")), F.when(F.col("strand") == "-", 16).otherwise(0), "seqid", "start", lit(40), lit("5M2D3M1I4M"), lit("*"), lit(0), lit(0), "base5", lit("*"))
    return R.read_sam(v.spark, written(v, v.reads, row, "@HD\tVN:1.0"))


@query("read_soap", "SELECT 'r' || event_id AS name, base5 || base3 AS seq, 'II' AS qual, weight::INT AS hits, 2 AS length, strand, seqid::VARCHAR AS seqid, start, start + 1 AS stop, '1 A->C' AS mismatch FROM reads")
def read_soap(v):
    row = tabbed(F.concat(F.lit("r"), text("event_id")), F.concat("base5", "base3"), lit("II"), "weight", lit("a"), lit(2), "strand", "seqid", "start", lit("1 A->C"))
    d = R.read_soap(v.spark, written(v, v.reads, row))
    return d.withColumn("mismatch", F.col("mismatches")[0]).drop("mismatches")


HIT = "SELECT query, hit, length(query) * 10 AS qlen, round(100 * (1 - l_discount), 0)::DOUBLE AS pid, l_quantity::BIGINT AS aln_len, l_linenumber AS qstart, l_linenumber + 9 AS qstop, l_extendedprice::DOUBLE AS bits FROM (SELECT *, 'q' || l_orderkey AS query, 'h' || l_partkey AS hit FROM lineitem) x"


def _hits(v):
    d = v.table("lineitem").select("*", F.concat(F.lit("q"), text("l_orderkey")).alias("query"), F.concat(F.lit("h"), text("l_partkey")).alias("hit"))
    return d.withColumns({"pid": F.round(100 * (1 - F.col("l_discount")), 0), "aln_len": F.col("l_quantity").cast("long")})


@query("read_blast_tab", HIT)
def read_blast_tab(v):
    row = tabbed("query", "hit", "pid", "aln_len", lit(0), lit(0), "l_linenumber", F.col("l_linenumber") + 9, lit(5), lit(14), lit("1e-5"), "l_extendedprice")
    head = F.concat(F.lit("# BLASTP\n# Query: "), "query", F.lit(" some name ("), text(F.length("query") * 10), F.lit(" letters)\n"))
    d = R.read_blast_tab(v.spark, written(v, _hits(v), F.concat(head, row)))
    return d.select("query", "hit", "qlen", "pid", "aln_len", "qstart", "qstop", "bits")


@query("read_named_fields", "SELECT 'q' || l_orderkey AS query, 'h' || l_partkey AS hit, CAST(l_linenumber AS VARCHAR) AS qstart FROM lineitem")
def read_named_fields(v):
    two = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("# Fields: qid\tsid\tQS\n"), tabbed("query", "hit", "l_linenumber"))).otherwise(F.concat(F.lit("# Fields: QS\tsid\tqid\n"), tabbed("l_linenumber", "hit", "query")))
    return R.to_m9(R.read_named_fields(v.spark, written(v, _hits(v), two)), {"query": "qid", "hit": "sid", "qstart": "QS"}).select("query", "hit", "qstart")


@query("read_hmmer3", "SELECT 'D' || l_suppkey AS domain, NULL::VARCHAR AS acc, 90 AS tlen, 'p' || l_partkey AS gene, 300 AS qlen, 1e-9::DOUBLE AS evalue, l_extendedprice::DOUBLE AS score, 1 AS hmm_from, 9 AS hmm_to, l_linenumber AS ali_from, l_linenumber + 8 AS ali_to, 'a free text' AS description FROM lineitem")
def read_hmmer3(v):
    row = F.concat_ws("   ", F.concat(F.lit("D"), text("l_suppkey")), *map(lit, ["-", 90]), F.concat(F.lit("p"), text("l_partkey")), *map(lit, ["-", 300, "1e-20", 50, 0.1, 1, 2, "1e-8", "1e-9"]), text("l_extendedprice"), *map(lit, [0.1, 1, 9]), text("l_linenumber"), text(F.col("l_linenumber") + 8), *map(lit, [1, 9, 0.95, "a free text"]))
    return R.read_hmmer(v.spark, written(v, v.table("lineitem"), row, "# target name"))


@query("read_hmmer2", "SELECT 'p' || l_partkey AS gene, 'D' || l_suppkey AS domain, l_linenumber AS ali_from, l_linenumber + 8 AS ali_to, 1 AS hmm_from, 9 AS hmm_to, l_extendedprice::DOUBLE AS score, 1e-9::DOUBLE AS evalue FROM lineitem")
def read_hmmer2(v):
    row = tabbed(F.concat(F.lit("p"), text("l_partkey")), F.concat(F.lit("D"), text("l_suppkey")), "l_linenumber", F.col("l_linenumber") + 8, lit(1), lit(9), "l_extendedprice", lit("1e-9"))
    return R.read_hmmer(v.spark, written(v, v.table("lineitem"), row), 2)


@query("read_interpro", """SELECT 'p' || l_partkey AS protein, 300 AS length, 'HMMPfam' AS method, 'PF' || l_suppkey AS dbid, NULL::VARCHAR AS hitdesc, l_linenumber AS start, l_linenumber + 8 AS stop, 0.001::DOUBLE AS evalue, CASE WHEN l_linenumber % 2 = 0 THEN 'IPR' || l_suppkey END AS ipr, 'GO:1;GO:' || l_linenumber AS go, 0 AS pathways FROM lineitem""")
def read_interpro(v):
    row = tabbed(F.concat(F.lit("p"), text("l_partkey")), lit("CRC"), lit(300), lit("HMMPfam"), F.concat(F.lit("PF"), text("l_suppkey")), lit("-"), "l_linenumber", F.col("l_linenumber") + 8, lit("0.001"), lit("T"), lit("01-01-2012"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("IPR"), text("l_suppkey"))).otherwise("-"), lit(""), F.concat(F.lit("GO:1|GO:"), text("l_linenumber")), lit("-"))
    d = R.read_interpro(v.spark, written(v, v.table("lineitem"), row))
    return d.withColumns({"go": F.array_join("go", ";"), "pathways": F.size("pathways")}).drop("iprdesc")


@query("read_repeatmasker", "SELECT l_orderkey AS score, 10.5::DOUBLE AS div, CAST(l_suppkey AS VARCHAR) AS seqid, l_partkey AS start, l_partkey + 20 AS stop, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand, 'R' || l_linenumber AS family, 'LTR/x' AS class FROM lineitem")
def read_repeatmasker(v):
    row = F.concat(F.lit("  "), F.concat_ws("  ", text("l_orderkey"), *map(lit, [10.5, 0.1, 0.2]), text("l_suppkey"), text("l_partkey"), text(F.col("l_partkey") + 20), lit("(90)"), F.when(F.col("l_linestatus") == "F", "C").otherwise("+"), F.concat(F.lit("R"), text("l_linenumber")), *map(lit, ["LTR/x", 1, 21, "(0)", 7])))
    return R.read_repeatmasker(v.spark, written(v, v.table("lineitem"), row, "   SW  perc perc\nscore div. del.\n"))


@query("read_groups", "SELECT CASE WHEN group_id % 2 = 0 THEN 'F' || group_id ELSE 'ORTHOMCL' || group_id END AS group_id, species, gene FROM orthogroups")
def read_groups(v):
    even = F.col("group_id") % 2 == 0
    g = v.orthogroups.groupBy("group_id").agg(F.collect_list(F.when(even, F.concat_ws("|", "species", "gene")).otherwise(F.concat("gene", F.lit("("), "species", F.lit(")")))).alias("m"))  # a group's members
    head = F.when(even, F.concat(F.lit("F"), text("group_id"))).otherwise(F.concat(F.lit("ORTHOMCL"), text("group_id"), F.lit("("), text(F.size("m")), F.lit(" genes,2 taxa)")))
    return R.read_groups(v.spark, written(v, g, F.concat(head, F.lit(": "), F.array_join("m", " "))))


@query("read_synteny_map", "SELECT p_partkey AS block, 'a' AS genome, 'c1' AS seqid, p_partkey * 10 + 1 AS start, p_partkey * 10 + 5 AS stop, '+' AS strand FROM part UNION ALL SELECT p_partkey, 'b', 'd1', p_size + 1, p_size + 7, '-' FROM part WHERE p_size % 3 <> 0")
def read_synteny_map(v):
    k, size = F.col("p_partkey") * 10, F.col("p_size").cast("long")
    other = F.when(size % 3 == 0, tabbed(*[lit("NA")] * 4)).otherwise(tabbed(lit("d1"), size, size + 7, lit("-")))
    return R.read_synteny_map(v.spark, written(v, v.table("part"), tabbed("p_partkey", lit("c1"), k, k + 5, lit("+"), other)), ["a", "b"])


BANNER = "/data/a.fa /data/b.fa\nNUCMER\n\n[P1]\t[SUB]\t[SUB]\t[P2]\t[TAGS]\n"


def _reports(v, row, name: str) -> str:
    """A report with its banner for each brand of the parts."""
    lines = v.table("part").select("p_brand", F.col("p_partkey").alias("n"), row.alias("value"))
    banners = v.table("part").select("p_brand").distinct().select("p_brand", F.lit(-1).alias("n"), F.lit(BANNER).alias("value"))
    path = new_folder(v.spark, name)
    lines.union(banners).repartition("p_brand").sortWithinPartitions("p_brand", "n").select("p_brand", "value").write.partitionBy("p_brand").text(path)
    return f"{path}/*"


@query("read_show_snps", "SELECT p_partkey AS pos, 'A' AS ref_base, CASE WHEN p_size % 4 > 0 THEN 'G' END AS query_base, p_partkey + 3 AS query_pos, p_size AS buff, 5 AS dist, 1 AS ref_frame, -1 AS query_frame, 'r1' AS ref_seqid, 'q' || p_size AS query_seqid FROM part")
def read_show_snps(v):
    row = tabbed("p_partkey", lit("A"), F.when(F.col("p_size") % 4 > 0, "G").otherwise("."), F.col("p_partkey") + 3, "p_size", lit(5), lit(1), lit(-1), lit("r1"), F.concat(F.lit("q"), text("p_size")))
    return R.read_show_snps(v.spark, _reports(v, row, "snps"))


@query("read_show_coords", "SELECT p_partkey AS start, p_partkey + 99 AS stop, p_size AS query_start, p_size + 89 AS query_stop, 100 AS length, 90 AS query_length, 98.5::DOUBLE AS pid, 'r1' AS ref_seqid, 'q1' AS query_seqid, CASE WHEN p_size % 2 = 0 THEN '-' ELSE '+' END AS strand FROM part")
def read_show_coords(v):
    a, b = F.col("p_size"), F.col("p_size") + 89
    back = F.col("p_size") % 2 == 0
    row = F.concat(F.lit("  "), F.concat_ws("  |  ", F.concat_ws("   ", text("p_partkey"), text(F.col("p_partkey") + 99)), F.concat_ws("  ", text(F.when(back, b).otherwise(a)), text(F.when(back, a).otherwise(b))), lit("100   90"), lit("98.5"), lit("r1\tq1")))
    return R.read_show_coords(v.spark, _reports(v, row, "coords"))


@query("read_table", "SELECT CAST(p_partkey AS VARCHAR) AS test_id, p_brand AS name FROM part")
def read_table(v):
    path = new_folder(v.spark, "table")
    v.table("part").select(F.col("p_partkey").alias("test_id"), F.col("p_brand").alias("name"), F.lit("x").alias("other")).write.option("header", "true").option("sep", "\t").csv(path)
    return R.read_table(v.spark, path, ["test_id", "name"]).select("test_id", "name")


@query("read_obo_edges", "SELECT child, parent, CASE WHEN parent LIKE 'M%' THEN 'part_of' ELSE 'is_a' END AS rel FROM edges")
def read_obo_edges(v):
    line = F.when(F.col("parent").startswith("M"), F.concat(F.lit("relationship: part_of "), "parent", F.lit(" ! x"))).otherwise(F.concat(F.lit("is_a: "), "parent"))
    stanza = v.edges.groupBy("child").agg(F.array_join(F.collect_list(line), "\n").alias("up"))  # a term's parents
    return R.read_obo(v.spark, written(v, stanza, F.concat(F.lit("[Term]\nid: "), "child", F.lit("\nname: n "), "child", F.lit("\nnamespace: p\n"), "up", F.lit("\n")), "format-version: 1.2\n"))[1]


@query("read_obo_terms", "SELECT DISTINCT child AS term, 'n ' || child AS name, 'p' AS namespace, 'slim' AS subset, child LIKE 'N%' AS obsolete FROM edges")
def read_obo_terms(v):
    gone = F.when(F.col("child").startswith("N"), "is_obsolete: true\n").otherwise("")
    d = R.read_obo(v.spark, written(v, v.edges.select("child").distinct(), F.concat(F.lit("[Term]\nid: "), "child", F.lit("\nname: n "), "child", F.lit("\nnamespace: p\nsubset: slim\n"), gone)))[0]
    return d.withColumn("subset", F.col("subsets")[0]).drop("subsets")


@query("read_taxdump", "SELECT c_custkey AS taxid, c_nationkey AS parent, 'species' AS rank, c_name AS name FROM customer")
def read_taxdump(v):
    path, c = new_folder(v.spark, "taxdump"), v.table("customer")
    dump = lambda *f: F.concat(F.concat_ws("\t|\t", *map(text, f)), F.lit("\t|"))
    c.select(dump("c_custkey", "c_nationkey", lit("species")).alias("value")).write.text(f"{path}/nodes.dmp")
    kinds = F.explode(F.array(F.lit("scientific name"), F.lit("synonym")))
    c.select("*", kinds.alias("kind")).select(dump("c_custkey", "c_name", lit(""), "kind").alias("value")).write.text(f"{path}/names.dmp")
    nodes, names = R.read_taxdump(v.spark, path)
    return nodes.join(names, "taxid")


@query("read_pfam2go", "SELECT 'PF' || p_partkey AS domain, 'GO:' || p_size AS go FROM part")
def read_pfam2go(v):
    return R.read_pfam2go(v.spark, written(v, v.table("part"), F.concat(F.lit("Pfam:PF"), text("p_partkey"), F.lit(" name > GO:some words ; GO:"), text("p_size")), "!version"))


@query("read_map", "SELECT CAST(p_partkey AS VARCHAR) AS gene, p_brand AS name FROM part")
def read_map(v):
    return R.read_map(v.spark, written(v, v.table("part"), tabbed("p_partkey", "p_brand"), "# key value"), ("gene", "name"))


@query("read_alignments", "SELECT 'k=' || (id % 12) AS block, 's' || id AS row_id, seq || '--' AS aln FROM seqs WHERE seq IS NOT NULL")
def read_alignments(v):
    s = v.seqs.where("seq IS NOT NULL").withColumn("k", F.col("id") % 12)
    return R.read_alignments(v.spark, written(v, s, F.concat(F.lit(">s"), text("id"), F.lit(" words\n"), F.regexp_replace("seq", "(.{50})", "$1\n"), F.lit("--")), by="k"))


@query("read_exonerate", "SELECT CAST(l_suppkey AS VARCHAR) AS seqid, 'exonerate' AS source, 'gene' AS type, l_partkey AS start, l_partkey + 20 AS stop, l_linenumber::DOUBLE AS score, '+' AS strand, 'q' || l_orderkey AS sequence FROM lineitem")
def read_exonerate(v):
    row = tabbed("l_suppkey", lit("exonerate"), lit("gene"), "l_partkey", F.col("l_partkey") + 20, "l_linenumber", lit("+"), lit("."), F.concat(F.lit("gene_id 1 ; sequence q"), text("l_orderkey"), F.lit(" ; orientation +")))
    d = R.read_exonerate(v.spark, written(v, v.table("lineitem"), F.concat(F.lit("# --- START OF GFF DUMP ---\n#\n"), row, F.lit("\n# --- END OF GFF DUMP ---\nother text"))))
    return d.select("seqid", "source", "type", "start", "stop", "score", "strand", F.trim(F.col("attrs")["sequence"]).alias("sequence"))


@query("read_exonerate_hits", """SELECT 'q' || l_orderkey AS query, 1 AS qstart, 30 AS qstop, '.' AS qstrand, CAST(l_suppkey AS VARCHAR) AS seqid, l_partkey + 1 AS start, l_partkey + 150 AS stop, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand, l_linenumber AS score, 29 AS query_aligned, 87 AS target_aligned, 1 AS gaps, 1 AS introns, 0 AS frameshifts FROM lineitem""")
def read_exonerate_hits(v):
    back = F.col("l_linestatus") == "F"
    a, b = F.col("l_partkey"), F.col("l_partkey") + 150
    row = F.concat_ws(" ", lit("vulgar:"), F.concat(F.lit("q"), text("l_orderkey")), lit("0 30 ."), text("l_suppkey"), text(F.when(back, b).otherwise(a)), text(F.when(back, a).otherwise(b)), F.when(back, "-").otherwise("+"), text("l_linenumber"), lit("M 20 60 G 1 0 5 0 2 I 0 59 3 0 2 M 9 27"))
    return R.read_exonerate_hits(v.spark, written(v, v.table("lineitem"), row, "Command line: [x]"))


@query("read_rnaz", "SELECT DISTINCT 'c' || l_suppkey || l_linestatus || 'n' || l_orderkey || '.' || l_linenumber AS seqid, l_partkey + 1 AS start, l_partkey + 120 AS stop, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, 0.9::DOUBLE AS p, -3.5::DOUBLE AS z FROM lineitem WHERE l_linestatus = 'F'")
def read_rnaz(v):
    name = F.concat(F.lit("c"), text("l_suppkey"), "l_linestatus", F.lit("n"), text("l_orderkey"), F.lit("."), text("l_linenumber"))

    def report(direction, p):
        rna = (F.col("l_linestatus") == "F") & (p > 0.5)
        top = F.concat(F.lit("############################  RNAz 2.0  ##############################\n\n Sequences: 4\n Reading direction: "), F.lit(direction), F.lit("\n Mean z-score:  -3.5\n SVM RNA-class probability: "), text(p), F.lit("\n Prediction: "))
        return F.concat(top, F.when(rna, "RNA").otherwise("OTHER"), F.lit("\n\n######\n\n>"), name, F.lit(" "), text("l_partkey"), F.lit(" 120 + 100000\nACGU\n>other 5 10 + 99\nACGA\n"))

    even = F.col("l_linenumber") % 2 == 0
    both = F.concat(report("forward", F.when(even, 0.2).otherwise(0.9)), report("reverse", F.when(even, 0.9).otherwise(0.2)))
    return R.read_rnaz(v.spark, written(v, v.table("lineitem"), both, compression="gzip", maxRecordsPerFile=100_000))  # a gzip file is one split


@query("read_compressed", "SELECT CAST(p_partkey AS VARCHAR) AS gene, p_brand AS name FROM part")
def read_compressed(v):
    folders = [written(v, v.table("part").where(f"p_size % 2 = {k}"), tabbed("p_partkey", "p_brand"), compression=codec) for k, codec in enumerate(("gzip", "bzip2"))]
    one, two = (R.read_map(v.spark, f, ("gene", "name")) for f in folders)
    return one.unionByName(two)


@query("load_hits", "SELECT query, hit, qstart, bits, row_number() OVER (PARTITION BY query ORDER BY bits DESC, hit, qstart) AS place FROM (SELECT 'q' || l_orderkey AS query, 'h' || l_partkey AS hit, l_linenumber AS qstart, l_extendedprice AS bits FROM lineitem) x")
def load_hits(v):
    name = "hits_" + new_folder(v.spark, "t")[-12:]
    S.load_table(_hits(v).select("query", "hit", F.col("l_linenumber").alias("qstart"), F.col("l_extendedprice").alias("bits")), name, ["query"], ["query", "bits"], 16)
    order = G.W.partitionBy("query").orderBy(F.desc("bits"), "hit", "qstart")
    return v.spark.table(name).withColumn("place", F.row_number().over(order))


@query("flagstat_table", "SELECT 'u' || (user_id % 20) AS sample, count(*) AS total, count(*) FILTER (event_id % 3 > 0) AS mapped, count(*) FILTER (event_id % 5 = 1 AND event_id % 3 > 0) AS duplicates, count(*) FILTER (event_id % 3 > 0) - count(*) FILTER (event_id % 5 = 1 AND event_id % 3 > 0) AS kept FROM events GROUP BY 1")
def flagstat_table(v):
    e = v.table("events")
    mapped = F.col("event_id") % 3 > 0
    n = lambda c: F.count(F.when(c, 1)).cast("string")
    g = e.groupBy(F.concat(F.lit("u"), text(F.col("user_id") % 20)).alias("sample")).agg(F.concat(n(F.lit(True)), F.lit(" + 0 in total\n"), n(mapped & (F.col("event_id") % 5 == 1)), F.lit(" + 0 duplicates\n"), n(mapped), F.lit(" + 0 mapped (90.0%)\n3 + 0 paired in sequencing")).alias("value"))
    return R.flagstat_table(v.spark, written(v, g, F.col("value"), by="sample"), r"sample=([^/]+)/")


@query("training_summary", "SELECT (p_size % 4) / 10.0::DOUBLE AS a, (p_size % 3 + 1)::DOUBLE AS b, max(p_partkey)::DOUBLE AS bits, max(p_size)::DOUBLE AS coverage FROM part GROUP BY ALL")
def training_summary(v):
    p = v.table("part").withColumn("run", F.concat_ws("_", lit("x"), text(F.round(F.col("p_size") % 4 / 10, 1)), text(F.col("p_size") % 3 + 1)))
    paths = [written(v, p, F.concat(F.lit("value = "), text(c)), by="run") for c in ("p_partkey", "p_size")]
    return R.training_summary(v.spark, *paths, r"_([\d.]+)_([\d.]+)/")


@query("read_gene_predictions", "SELECT l_suppkey::VARCHAR AS seqid, CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'N' THEN 'mRNA' ELSE 'gene' END AS type, l_partkey AS start, l_partkey + 9 AS stop, CASE WHEN l_returnflag <> 'A' THEN 'pre-g' || l_orderkey END AS id, CASE WHEN l_returnflag <> 'A' THEN 'pre-g' || l_orderkey END AS name, CASE WHEN l_returnflag = 'A' THEN 'g' || l_orderkey END AS gene FROM lineitem")
def read_gene_predictions(v):
    kind = F.when(F.col("l_returnflag") == "A", "CDS").when(F.col("l_returnflag") == "N", "transcript").otherwise("gene")
    gene = F.concat(F.lit("g"), text("l_orderkey"))
    group = F.when(kind == "CDS", F.concat(F.lit('transcript_id "t1"; gene_id "'), gene, F.lit('";'))).otherwise(gene)
    row = tabbed("l_suppkey", lit("AUGUSTUS"), kind, "l_partkey", F.col("l_partkey") + 9, lit("."), lit("+"), lit("."), group)
    extra = F.concat(row, F.lit("\n# protein sequence = [M]\n"), tabbed("l_suppkey", lit("AUGUSTUS"), lit("intron"), lit(1), lit(2), lit("."), lit("+"), lit("."), lit("t1")))
    d = G.prediction_to_features(R.read_gene_predictions(v.spark, written(v, v.table("lineitem"), extra)), "pre")
    a = F.col("attrs")
    return d.select("seqid", "type", "start", "stop", a["ID"].alias("id"), a["Name"].alias("name"), a["gene_id"].alias("gene"))


@query("to_jgi", """WITH f AS (SELECT seqid, type, start, stop, strand, seqid || ':' || parent || '.t1' AS parent, seqid || ':' || parent AS gene FROM features WHERE type IN ('exon', 'CDS')), k AS (SELECT *, 1 + coalesce(sum(CASE WHEN type = 'CDS' THEN 1 ELSE 0 END) OVER (PARTITION BY parent ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END, CASE WHEN strand = '-' THEN -stop ELSE stop END, type DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM f)
SELECT seqid, type, start, stop, strand, 'gene_id ' || gene || ' transcript_id ' || parent || ' exon_number ' || CAST(n AS BIGINT) AS grp FROM k""")
def to_jgi(v):
    return G.to_jgi(v.features.withColumn("parent", F.concat(text("seqid"), F.lit(":"), "parent", F.lit(".t1"))))


SCORES = "SELECT query, hit, bits, row_number() OVER (PARTITION BY query ORDER BY {0}, hit) AS rank, score FROM (SELECT query, hit, bits, {1} AS score FROM (SELECT 'S' || l_orderkey AS query, 'h' || l_partkey || '.' || l_linenumber AS hit, l_extendedprice / 1000 AS bits, l_linenumber AS qstart, l_linenumber + l_quantity AS qstop FROM lineitem) a) b"


def _scored(v, score):
    h = v.table("lineitem").select(F.concat(F.lit("S"), text("l_orderkey")).alias("query"), F.concat(F.lit("h"), text("l_partkey"), F.lit("."), text("l_linenumber")).alias("hit"), (F.col("l_extendedprice") / 1000).alias("bits"), F.col("l_linenumber").alias("qstart"), (F.col("l_linenumber") + F.col("l_quantity")).alias("qstop"), F.lit(500).alias("qlen"), F.col("l_tax").alias("evalue"))
    return C.hit_scores(h, score, 1e6).select("query", "hit", "bits", "rank", "score")


@query("hit_scores", SCORES.format("score DESC", "bits / abs(qstop - qstart)"))
def hit_scores(v):
    return _scored(v, "bits_per_residue")


@query("hit_scores_scaled", SCORES.format("score", "CAST(printf('%.1e', 1e6 * 500 / pow(2, bits)) AS DOUBLE)"))
def hit_scores_scaled(v):
    return _scored(v, "scaled_evalue")


# Sinks


@query("write_gff3", "SELECT seqid::VARCHAR AS seqid, type, start, stop, score::DOUBLE AS score, strand, parent AS id, 'x%3By%3D1%09' AS note FROM features")
def write_gff3(v):
    path = new_folder(v.spark, "gff3")
    S.write_gff3(v.features.withColumn("attrs", F.create_map(F.lit("ID"), "parent", F.lit("Note"), F.lit("x;y=1\t"))), path)
    return R.read_gff3(v.spark, path).select("seqid", "type", "start", "stop", "score", "strand", F.col("attrs")["ID"].alias("id"), F.col("attrs")["Note"].alias("note"))


@query("fastq_mates", "SELECT 'r' || (2 * (event_id // 2)) AS one, 'r' || (2 * (event_id // 2) + 1) AS two FROM reads WHERE event_id % 2 = 1")
def fastq_mates(v):
    """Interleaved reads to two files of mates and back."""
    both = v.reads.withColumn("index", F.col("event_id")).select("index", F.concat(F.lit("r"), text("event_id")).alias("id"), F.concat("base5", "base3").alias("seq"), F.lit("II").alias("qual"))
    one, two = S.deinterleave(both)
    paths = [new_folder(v.spark, "mates") for _ in range(2)]
    for mates, path in zip((one, two), paths):
        S.write_fastq(mates.withColumn("id", F.concat_ws(" ", "id", text("index"))), path)
    one, two = (R.read_fastq(v.spark, p).select("id", F.col("desc").cast("long").alias("index")) for p in paths)
    again = S.interleave(one, two)
    return again.groupBy("index").agg(F.max(F.when(F.col("mate") == 1, F.col("id"))).alias("one"), F.max(F.when(F.col("mate") == 2, F.col("id"))).alias("two")).where("one IS NOT NULL AND two IS NOT NULL").select("one", "two")


@query("write_bedgraph", "SELECT seqid || chr(9) || (start - 1) || chr(9) || stop || chr(9) || weight AS line FROM reads")
def write_bedgraph(v):
    path = new_folder(v.spark, "bedgraph")
    S.write_bedgraph(v.reads.select("seqid", "start", "stop", F.col("weight").alias("depth")), path)
    return v.spark.read.text(path).select(F.col("value").alias("line"))


@query("write_wig", """WITH b AS (SELECT seqid, start // 100 AS bin, count(*) AS n FROM reads GROUP BY ALL) SELECT (bin * 100 + 1) || ' ' || n AS line, count(*) AS rows FROM b GROUP BY 1 UNION ALL SELECT 'variableStep chrom=' || seqid || ' span=100', count(DISTINCT bin // 10000) FROM b GROUP BY seqid""")
def write_wig(v):
    path = new_folder(v.spark, "wig")
    S.write_wig(v.reads.groupBy("seqid", F.floor(F.col("start") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("mean")), path, 100)
    return v.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("rows"))


@query("write_by_key", "SELECT lib, event_id, start FROM reads")
def write_by_key(v):
    path = new_folder(v.spark, "by-key")
    S.write_by_key(v.reads.select("lib", "event_id", "start"), ["lib"], path)
    return v.spark.read.parquet(path).select(text("lib").alias("lib"), "event_id", "start")


@query("write_chunks", "SELECT event_id, TRUE AS small FROM reads")
def write_chunks(v):
    path = new_folder(v.spark, "chunks")
    ids = v.reads.select("event_id").repartition(v.spark.sparkContext.defaultParallelism, "event_id")  # a file of events may be one task
    S.write_chunks(ids, 100, path)
    rows = v.spark.read.schema("event_id bigint").parquet(path).withColumn("file", F.input_file_name())  # opened once each
    return rows.select("event_id", (F.count(F.lit(1)).over(W.partitionBy("file")) <= 100).alias("small"))


def _matrix(v):
    """A row per sample of its alleles at all sites."""
    return v.alleles.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chrom", "pos", F.coalesce("allele", F.lit("N")).alias("b")))), lambda x: x["b"]), "").alias("seq"))


MATRIX = "WITH m AS (SELECT sample, string_agg(coalesce(allele, 'N'), '' ORDER BY chrom, pos) AS seq FROM alleles GROUP BY sample), s AS (SELECT count(*) AS n, max(length(seq)) AS m FROM m) "
SPACED = "array_to_string(string_split(seq, ''), '{}')"


def _matrix_query(fmt: str, sql: str) -> None:
    @query(f"write_{fmt}", MATRIX + sql)
    def run(v):
        path = new_folder(v.spark, fmt)
        S.write_matrix(_matrix(v), path, fmt)
        return v.spark.read.text(path).where("value <> ''").select(F.col("value").alias("line"))


_matrix_query("phylip", "SELECT rpad(CAST(sample AS VARCHAR), 10, ' ') || seq AS line FROM m UNION ALL SELECT ' ' || n || ' ' || m FROM s")
_matrix_query("nexus", "SELECT sample || chr(9) || seq AS line FROM m UNION ALL SELECT unnest(['#NEXUS', 'begin data;', 'dimensions ntax=' || n || ' nchar=' || m || ';', 'matrix', ';', 'end;']) FROM s")
_matrix_query("structure", f"SELECT sample || ' ' || {SPACED.format(' ')} AS line FROM m")
_matrix_query("lian", "SELECT sample || chr(9) || array_to_string(string_split(seq, ''), chr(9)) AS line FROM m")


@query("split_records", "SELECT 'D' || (l_suppkey % 9) AS name, 'NAME D' || (l_suppkey % 9) || ' r' || l_orderkey || '.' || l_linenumber AS value FROM lineitem")
def split_records(v):
    path = new_folder(v.spark, "records")
    value = F.concat(F.lit("NAME D"), text(F.col("l_suppkey") % 9), F.lit(" r"), text("l_orderkey"), F.lit("."), text("l_linenumber"))
    S.split_records(v.table("lineitem").select(value.alias("value")), r"^NAME (\S+)", path)
    return v.spark.read.text(path).select("name", "value")


@query("write_rsq", """WITH s AS (SELECT chrom, pos, min(ref) AS ref FROM alleles GROUP BY ALL)
SELECT chrom, count(DISTINCT sample) || ' ' || count(DISTINCT pos) AS line FROM alleles GROUP BY chrom UNION ALL SELECT chrom, string_agg(pos, ' ' ORDER BY pos) FROM s GROUP BY chrom
UNION ALL SELECT chrom, string_agg(ref, ' ' ORDER BY pos) FROM s GROUP BY chrom UNION ALL SELECT chrom, sample || ' ' || string_agg(coalesce(allele, 'N'), ' ' ORDER BY pos) FROM alleles GROUP BY chrom, sample""")
def write_rsq(v):
    path = new_folder(v.spark, "rsq")
    S.write_rsq(v.alleles, path)
    return v.spark.read.text(path).select(F.col("chrom").cast("long").alias("chrom"), F.col("value").alias("line"))


@query("fastq_records", "SELECT event_id AS index, 'r' || event_id AS id, repeat(base5 || base3, 4) AS seq, CASE WHEN event_id % 3 = 0 THEN '@' ELSE 'I' END || CASE WHEN event_id % 5 = 0 THEN '@+@+@+@' ELSE '+IIII#@' END AS qual FROM reads")
def fastq_records(v):
    """Reads in files whose splits are small, qualities that begin with @ among them; numbers go on over the splits."""
    path = new_folder(v.spark, "fastq-splits")
    qual = F.concat(F.when(F.col("event_id") % 3 == 0, "@").otherwise("I"), F.when(F.col("event_id") % 5 == 0, "@+@+@+@").otherwise("+IIII#@"))
    r = v.reads.select("event_id", F.concat(F.lit("r"), text("event_id")).alias("id"), F.repeat(F.concat("base5", "base3"), F.lit(4)).alias("seq"), qual.alias("qual"))
    S.write_fastq(r.repartitionByRange("event_id").sortWithinPartitions("event_id"), path)
    got = R.read_fastq(v.spark, path)
    # a file's reads are a range of ids: its first id and the place in it give the id again
    own = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    low = got.groupBy("file").agg(F.min(own).alias("low"))
    return got.join(low, "file").select((F.col("low") + F.col("index")).alias("index"), "id", "seq", "qual")


@query("feature_names", "SELECT parent, start, CASE WHEN start % 3 = 0 THEN 'n' || start WHEN start % 3 = 1 THEN parent WHEN start % 5 = 0 THEN 'note' END AS name FROM features")
def feature_names(v):
    """The first of a feature's name, parent and note that there is."""
    at, none = F.col("start") % 3, F.lit(None).cast("string")
    attrs = F.map_filter(F.create_map(F.lit("Note"), F.when(F.col("start") % 5 == 0, "note").otherwise(none), F.lit("Name"), F.when(at == 0, F.concat(F.lit("n"), text("start"))).otherwise(none), F.lit("Parent"), F.when(at == 1, F.col("parent")).otherwise(none)), lambda k, x: x.isNotNull())
    return v.features.select("parent", "start", feature_name(attrs).alias("name"))
