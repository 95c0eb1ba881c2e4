"""Readers and sinks through files."""

import pytest
from pyspark.sql import functions as F

from loomspan.sources import readers, sinks
from loomspan.streaming import run_available, stream


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_gff3(spark, tmp_path):
    path = put(tmp_path, "a.gff", "##gff-version 3\n\nc1\tsrc\tgene\t5\t9\t.\t-\t.\tID=g1;Note=a=b\nc1\t.\tCDS\t6\t8\t1.5\t+\t2\tParent=g1,g2\n")
    r = readers.read_gff3(spark, path).orderBy("start").collect()
    assert (r[0].attrs, r[0].score, r[0].strand, r[0].phase) == ({"ID": "g1", "Note": "a=b"}, None, "-", None)
    assert (r[1].source, r[1].score, r[1].phase) == (None, 1.5, 2)
    sinks.write_gff3(readers.read_gff3(spark, path).withColumn("attrs", F.create_map(F.lit("ID"), F.lit("x;y"))), str(tmp_path / "out"))
    back = readers.read_gff3(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [(x.start, x.attrs) for x in back] == [(5, {"ID": "x%3By"}), (6, {"ID": "x%3By"})]


def test_gtf_bed(spark, tmp_path):
    path = put(tmp_path, "a.gtf", 'c1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g 1"; transcript_id "t1"; gene_id "g2";\n')
    assert readers.read_gtf(spark, path).first().attrs == {"gene_id": "g 1", "transcript_id": "t1"}
    path = put(tmp_path, "a.bed", "track name=x\nc1\t0\t10\tn\t3\t-\n")
    assert tuple(readers.read_bed(spark, path).first()) == ("c1", 1, 10, "n", 3.0, "-")


def test_fasta_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 some words\nACGT\nAC\n>s2\nGG\n\n>s3 x\n")
    r = sorted(map(tuple, readers.read_fasta(spark, path).collect()))
    assert r == [("s1", "some words", "ACGTAC"), ("s2", "", "GG"), ("s3", "x", "")]
    sinks.write_fasta(readers.read_fasta(spark, path), str(tmp_path / "fa"), width=4)
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "fa")).collect())) == r


def test_fastq(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1 1:N\nAC\n+\nIJ\n@r2\nG\n+\n#\n")
    reads = readers.read_fastq(spark, path)
    assert sorted((x["index"], x.id, x.desc, x.seq, x.qual) for x in reads.collect()) == [(0, "r1", "1:N", "AC", "IJ"), (1, "r2", "", "G", "#")]
    one, two = sinks.deinterleave(reads)
    assert [x.id for x in sinks.interleave(one, two).collect()] == ["r1", "r2"]
    with pytest.raises(Exception, match="out of register"):
        readers.read_fastq(spark, put(tmp_path, "b.fq", "r1\nAC\n+\nIJ\n")).collect()


def test_variants_and_alignments(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc\t7\t.\tA\tG\t50\tPASS\tAF=0.5;DB\tGT:DP\t0/1:3\t./.:0\n")
    r = readers.read_vcf(spark, path).orderBy("sample").collect()
    assert [(x.sample, x.gt, x.info, x.id) for x in r] == [("s1", "0/1", {"AF": "0.5", "DB": "1"}, None), ("s2", "./.", {"AF": "0.5", "DB": "1"}, None)]
    path = put(tmp_path, "a.sam", "@HD\nx-12\t16\tc\t5\t60\t2M1D3M\t*\t0\t0\tACGTA\tIIIII\n")
    s = readers.read_sam(spark, path).first()
    assert (s.strand, s.start, s.stop, s.weight, s.mapped) == ("-", 5, 10, 12, True)


def test_hits_groups_ontology(spark, tmp_path):
    hit = "q\th\t99.0\t10\t0\t0\t1\t10\t5\t14\t1e-5\t50\n"
    path = put(tmp_path, "a.m8", f"# Query: q (120 aa)\n{hit}{hit}")
    assert [(x.line_no, x.qlen, x.evalue) for x in readers.read_blast_tab(spark, path).orderBy("line_no").collect()] == [(2, 120, 1e-5), (3, 120, 1e-5)]
    path = put(tmp_path, "a.groups", "F1: sp1|g1 sp2|g2\nORTHOMCL3(2 genes,2 taxa): a(x) b(y)\n")
    assert sorted(map(tuple, readers.read_groups(spark, path).collect())) == [("F1", "sp1", "g1"), ("F1", "sp2", "g2"), ("ORTHOMCL3", "x", "a"), ("ORTHOMCL3", "y", "b")]
    path = put(tmp_path, "a.obo", "format-version: 1.2\n\n[Term]\nid: T:2\nname: two\nnamespace: p\nis_a: T:1 ! one\nrelationship: part_of T:0 ! zero\n\n[Term]\nid: T:1\nname: one\n")
    terms, edges = readers.read_obo(spark, path)
    assert sorted(x.term for x in terms.collect()) == ["T:1", "T:2"]
    assert sorted(map(tuple, edges.collect())) == [("T:2", "T:0", "part_of"), ("T:2", "T:1", "is_a")]


def test_table_requires_columns(spark, tmp_path):
    path = put(tmp_path, "t.tsv", "a\tb\n1\t2\n")
    assert readers.read_table(spark, path, ["a"]).first().b == "2"
    with pytest.raises(ValueError, match="missing: z"):
        readers.read_table(spark, path, ["z"])


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("c", 1, 5, 2), ("c", 9, 9, 1)], "seqid string, start long, stop long, depth long")
    sinks.write_bedgraph(runs, str(tmp_path / "bg"))
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "bg")).collect()) == ["c\t0\t5\t2", "c\t8\t9\t1"]
    sinks.write_wig(spark.createDataFrame([("c", 0, 1.5), ("c", 3, 2.0)], "seqid string, bin long, mean double"), str(tmp_path / "wig"), 10)
    assert "variableStep chrom=c span=10" in [x.value for x in spark.read.text(str(tmp_path / "wig")).collect()]
    sinks.write_matrix(spark.createDataFrame([("s1", "AC"), ("s2", "A-")], "sample string, seq string"), str(tmp_path / "phy"), "phylip")
    assert [x.value for x in spark.read.text(str(tmp_path / "phy")).collect()] == [" 2 2", "s1        AC", "s2        A-"]
    sinks.write_chunks(spark.range(10).coalesce(1), 4, str(tmp_path / "chunks"))
    assert len(list((tmp_path / "chunks").glob("*.parquet"))) == 3


def test_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for expected in (5, 8):
        run_available(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.where("id >= 0"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))


def test_reports_of_aligners(spark, tmp_path):
    banner = "/d/ref.fa /d/query.fa\nNUCMER\n\n[P1]\t[SUB]\t[SUB]\t[P2]\t[BUFF]\t[DIST]\t[FRM]\t[TAGS]\n"
    path = put(tmp_path, "a.snps", banner + "7\tA\t.\t9\t3\t7\t1\t-1\tr1\tq1\n")
    r = readers.read_show_snps(spark, path).first()
    assert (r.pos, r.ref_base, r.query_base, r.query_pos, r.query_frame, r.ref_seqid) == (7, "A", None, 9, -1, "r1")
    path = put(tmp_path, "a.coords", banner + "==========\n       1      100  |      90        1  |      100       90  |    98.50  | r1\tq1\n")
    r = readers.read_show_coords(spark, path).first()
    assert (r.start, r.stop, r.query_start, r.query_stop, r.pid, r.query_seqid, r.strand) == (1, 100, 1, 90, 98.5, "q1", "-")
    with pytest.raises(Exception, match="no banner"):
        readers.read_show_snps(spark, put(tmp_path, "b.snps", "7\tA\tG\t9\t3\t7\t1\t-1\tr1\tq1\n")).collect()


EXONERATE = """Command line: [exonerate --model est2genome]
C4 Alignment:
------------
  1 : ACGT : 4
vulgar: est1 0 30 + chr2 500 350 - 120 M 20 20 5 0 2 I 0 98 3 0 2 M 10 10
# --- START OF GFF DUMP ---
#
##gff-version 2
chr2\texonerate:est2genome\tgene\t351\t500\t120\t-\t.\tgene_id 1 ; sequence est1 ; gene_orientation +
chr2\texonerate:est2genome\texon\t481\t500\t.\t-\t.\tinsertions 0 ; deletions 0
# --- END OF GFF DUMP ---
-- completed exonerate analysis
"""

RNAZ = """############################  RNAz 2.1  ##############################

 Sequences: 3
 Reading direction: {0}
 Mean z-score:  -2.11
 SVM RNA-class probability: {1}
 Prediction: {2}

######################################################################

>chr2 {3} 120 {4} 1000
ACGUACGU
(((...))) ( -10.0)
>other 7 118 + 900
ACGUACGA
"""


def test_reports_of_gene_finders(spark, tmp_path):
    path = put(tmp_path, "a.exo", EXONERATE)
    r = readers.read_exonerate(spark, path).orderBy("start").collect()
    assert [(x.seqid, x.type, x.start, x.score, x.strand) for x in r] == [("chr2", "gene", 351, 120.0, "-"), ("chr2", "exon", 481, None, "-")] and r[0].attrs["sequence"].strip() == "est1"
    h = readers.read_exonerate_hits(spark, path).first()
    assert (h["query"], h.qstart, h.qstop, h.seqid, h.start, h.stop, h.strand, h.query_aligned, h.target_aligned, h.introns, h.gaps) == ("est1", 1, 30, "chr2", 351, 500, "-", 30, 30, 1, 0)
    text = "".join(RNAZ.format(*x) for x in (("forward", 0.2, "OTHER", 10, "+"), ("reverse", 0.97, "RNA", 10, "+"), ("forward", 0.8, "RNA", 300, "-"), ("forward", 0.4, "OTHER", 500, "+")))
    assert sorted(map(tuple, readers.read_rnaz(spark, put(tmp_path, "a.rnaz", text)).collect())) == [("chr2", 11, 130, "-", 0.97, -2.11), ("chr2", 581, 700, "-", 0.8, -2.11)]
    aug = "# start gene g1\nc1\tAUGUSTUS\tgene\t1\t90\t0.5\t+\t.\tg1\nc1\tAUGUSTUS\ttranscript\t1\t90\t0.5\t+\t.\tg1.t1\nc1\tAUGUSTUS\tCDS\t1\t60\t.\t+\t0\ttranscript_id \"g1.t1\"; gene_id \"g1\";\n# protein sequence = [MA]\n"
    from loomspan.operators.features import prediction_to_features

    r = prediction_to_features(readers.read_gene_predictions(spark, put(tmp_path, "a.aug", aug)), "x").orderBy("type").collect()
    assert [(x.type, x.attrs) for x in r] == [("CDS", {"gene_id": "g1", "transcript_id": "g1.t1"}), ("gene", {"ID": "x-g1", "Name": "x-g1"}), ("mRNA", {"ID": "x-g1.t1", "Name": "x-g1.t1"})]


def test_small_reports(spark, tmp_path):
    text = "# WU\n# Fields: qid\tsid\tE\nq1\ts1\t1e-5\n# Fields: sid\tqid\ns2\tq2\n"
    m9 = readers.to_m9(readers.read_named_fields(spark, put(tmp_path, "a.wu", text)), {"query": "qid", "hit": "sid", "evalue": "E"})
    assert sorted((x["query"], x.hit, x.evalue) for x in m9.collect()) == [("q1", "s1", "1e-5"), ("q2", "s2", None)]
    put(tmp_path, "s1.flagstat", "10 + 0 in total (QC-passed reads + QC-failed reads)\n2 + 0 duplicates\n8 + 0 mapped (80.00%:nan%)\n4 + 0 paired in sequencing\n")
    assert tuple(readers.flagstat_table(spark, str(tmp_path / "s1.flagstat")).first()) == ("s1", 10, 8, 2, 6)
    for name, v in (("bits", 3.5), ("cov", 0.25)):
        put(tmp_path, f"{name}/run_0.5_12.txt", f"Total {name} = {v}\n")
    assert tuple(readers.training_summary(spark, str(tmp_path / "bits"), str(tmp_path / "cov")).first()) == (0.5, 12.0, 3.5, 0.25)
    path = put(tmp_path, "a.hmm", "# target\nDom PF1.1 90 gene1 - 300 1e-20 50.0 0.1 1 2 1e-8 2e-8 40.5 0.1 1 88 10 99 9 100 0.95 Some long name\n")
    r = readers.read_hmmer(spark, path).first()
    assert (r.domain, r.gene, r.evalue, r.score, r.ali_from, r.ali_to, r.description) == ("Dom", "gene1", 2e-8, 40.5, 10, 99, "Some long name")
    sinks.split_records(spark.createDataFrame([("HMM\nNAME A\nx",), ("HMM\nNAME B\ny",)], "value string"), r"NAME\s+(\S+)", str(tmp_path / "models"))
    assert sorted(p.name for p in (tmp_path / "models").glob("name=*")) == ["name=A", "name=B"]
    sinks.write_by_key(spark.range(4).selectExpr("id", "id % 2 AS k"), ["k"], str(tmp_path / "keys"))
    assert spark.read.parquet(str(tmp_path / "keys" / "k=1")).count() == 2


def test_tables_of_hits(spark):
    hits = spark.createDataFrame([("q2", "a", 3.0), ("q1", "b", 1.0), ("q1", "c", 2.0)], "query string, hit string, bits double")
    url = "jdbc:derby:memory:hits;create=true"
    sinks.load_jdbc(hits, url, "hits", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    back = sinks.read_jdbc(spark, url, 'SELECT "query", "hit" FROM hits WHERE "bits" > 1.5', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert sorted(map(tuple, back.collect())) == [("q1", "c"), ("q2", "a")]
    sinks.load_table(hits, "some_hits", ["query"], ["query", "bits"], 4)
    assert [tuple(r) for r in spark.table("some_hits").orderBy("query", F.desc("bits")).collect()] == [("q1", "c", 2.0), ("q1", "b", 1.0), ("q2", "a", 3.0)]
