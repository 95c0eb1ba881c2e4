"""Sequence queries (H, and the sequence parts of B, D, E and F) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan import functions as X
from loomspan.operators import sequences as S
from loomspan.plans.views import query

CODE_SQL = "map([" + ", ".join(f"'{c}'" for c in X.codon_table()) + "], [" + ", ".join(f"'{a}'" for a in X.codon_table().values()) + "])"
CODONS_SQL = "list_transform(range(1, length(seq) // 3 + 1), lambda i: substr(seq, CAST(i * 3 - 2 AS BIGINT), 3))"
PEP_SQL = f"array_to_string(list_transform({CODONS_SQL}, lambda c: coalesce({CODE_SQL}[c], 'X')), '')"


@query("gc", "SELECT id, round((length(seq) - length(translate(seq, 'GC', '')))::DOUBLE / nullif(length(seq), 0), 9) AS gc FROM seqs")
def gc(v):
    return v.seqs.select("id", F.round(X.gc("seq"), 9).alias("gc"))


@query("revcomp", "SELECT id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seqs")
def revcomp(v):
    return v.seqs.select("id", X.revcomp("seq").alias("seq"))


@query("subseq", "SELECT id, CASE WHEN id % 2 = 0 THEN substr(seq, 3, 18) ELSE reverse(translate(substr(seq, 3, 18), 'ACGT', 'TGCA')) END AS seq FROM seqs")
def subseq(v):
    return v.seqs.select("id", X.subseq("seq", F.when(F.col("id") % 2 == 0, 3).otherwise(20), F.when(F.col("id") % 2 == 0, 20).otherwise(3)).alias("seq"))


@query("translate_cds", f"SELECT id, {PEP_SQL} AS pep FROM seqs")
def translate_cds(v):
    return v.seqs.select("id", X.translate_cds("seq").alias("pep"))


@query("check_translation", f"""WITH p AS (SELECT id, {PEP_SQL} AS p, substr({PEP_SQL}, 1, 20) AS g FROM seqs), q AS (SELECT id, regexp_replace(p, '\\*$', '') AS p, regexp_replace(g, '\\*$', '') AS g FROM p)
SELECT id, CASE WHEN contains(p, '*') THEN 'internal_stop' WHEN p = g THEN 'ok' ELSE 'differs' END AS status FROM q""")
def check_translation(v):
    pep = X.translate_cds("seq")
    return v.seqs.select("id", X.check_translation(pep, F.substr(pep, F.lit(1), F.lit(20))).alias("status"))


@query("iupac", "SELECT chrom, pos, map(['A','C','G','T','AG','CT','CG','AT','GT','AC'], ['A','C','G','T','R','Y','S','W','K','M'])[array_to_string(list_sort(list_distinct(list(allele))), '')] AS code FROM alleles GROUP BY ALL HAVING count(allele) > 0")
def iupac(v):
    return v.alleles.groupBy("chrom", "pos").agg(F.collect_set("allele").alias("a")).where(F.size("a") > 0).select("chrom", "pos", X.iupac(F.col("a")).alias("code"))


@query("iupac_expand", "SELECT chrom, pos, array_to_string(list_sort(list_distinct(list(allele))), '') AS bases FROM alleles GROUP BY ALL HAVING count(allele) > 0")
def iupac_expand(v):
    return iupac(v).select("chrom", "pos", F.array_join(X.iupac_expand("code"), "").alias("bases"))


@query("phred", "SELECT id, CAST(list_sum(list_transform(range(1, length(seq) + 1), lambda i: ascii(substr(seq, CAST(i AS BIGINT), 1)) - 33)) AS BIGINT) AS total FROM seqs WHERE length(seq) > 0")
def phred(v):
    return v.seqs.where("length(seq) > 0").select("id", F.aggregate(X.phred("seq"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("to_sanger", "SELECT id, translate(seq, 'ACGT', chr(ascii('A') - 31) || chr(ascii('C') - 31) || chr(ascii('G') - 31) || chr(ascii('T') - 31)) AS qual FROM seqs")
def to_sanger(v):
    return v.seqs.select("id", X.to_sanger("seq").alias("qual"))


@query("strip_isoform", "SELECT DISTINCT gene, regexp_replace(gene || 'T0', '(T\\d+|-[RP][A-Z]|\\.\\d+|_[tT]\\d+)$', '') AS stem FROM orthogroups")
def strip_isoform(v):
    return v.orthogroups.select("gene", X.strip_isoform(F.concat("gene", F.lit("T0"))).alias("stem")).distinct()


@query("split_gene", "SELECT DISTINCT query, split_part(query, '_', 1) AS species, split_part(query, '_', 2) AS gene FROM hits")
def split_gene(v):
    return v.hits.select("query", X.split_gene("query").alias("s")).select("query", "s.*").distinct()


@query("gff_escape", "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '%', '%25'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D'), '&', '%26'), '=', '%3D'), ';', '%3B'), ',', '%2C') AS text FROM documents")
def gff_escape(v):
    return v.table("documents").select("doc_id", X.gff_escape("text").alias("text"))


@query("rename", "SELECT DISTINCT parent, CASE WHEN regexp_full_match(parent, 'g[0-9]{1,2}') THEN regexp_replace(parent, '^g([0-9]{1,2})$', 'chr\\1') ELSE regexp_replace(parent, '^g([0-9]+)$', 'scaf_\\1') END AS name FROM features")
def rename(v):
    return v.features.select("parent", X.rename("parent", {r"g([0-9]{1,2})": "chr$1", r"g([0-9]+)": "scaf_$1"}).alias("name")).distinct()


@query("score_value", "SELECT query, hit, line_no, bits, round(1e6 * aln_len / pow(2, bits / 1000), 6) AS scaled, round(bits / aln_len, 6) AS per_residue FROM hits")
def score_value(v):
    return v.hits.select("query", "hit", "line_no", "bits", F.round(X.scaled_evalue(F.col("bits") / 1000, "aln_len", 1e6), 6).alias("scaled"), F.round(F.col("bits") / F.col("aln_len"), 6).alias("per_residue"))


@query("codon_change", f"""WITH c AS (SELECT id, substr(seq, 1, 3) AS a, substr(seq, 4, 3) AS old FROM seqs WHERE length(seq) >= 6), d AS (SELECT id, old, substr(old, 1, 1) || 'A' || substr(old, 3, 1) AS new FROM c)
SELECT id, 2 AS index, old, new, coalesce({CODE_SQL}[old], 'X') AS old_aa, coalesce({CODE_SQL}[new], 'X') AS new_aa FROM d""")
def codon_change(v):
    return v.seqs.where("length(seq) >= 6").select("id", X.codon_change("seq", F.lit(5), F.lit("A")).alias("c")).select("id", "c.*")


@query("fmt", "SELECT query, hit, line_no, bits, printf('%.2f', pid::DOUBLE) AS pid FROM hits")
def fmt(v):
    return v.hits.select("query", "hit", "line_no", "bits", X.fmt(F.col("pid").cast("double"), "%.2f").alias("pid"))


@query("min_length", "SELECT id, length(seq) AS length FROM seqs WHERE length(seq) >= 100")
def min_length(v):
    return S.min_length(v.seqs, 100).select("id", F.length("seq").alias("length"))


@query("drop_low_complexity", "SELECT id FROM seqs WHERE len(list_distinct(string_split(seq, ''))) > 2")
def drop_low_complexity(v):
    return S.drop_low_complexity(v.seqs).select("id")


@query("size_base_filter", "SELECT id, length(seq) AS length FROM seqs WHERE length(seq) BETWEEN 18 AND 300")
def size_base_filter(v):
    return S.size_base_filter(v.seqs, 18, 300).select("id", F.length("seq").alias("length"))


@query("assembly_stats", """
WITH l AS (SELECT length(seq) AS len, row_number() OVER (ORDER BY length(seq)) AS r, sum(length(seq)) OVER (ORDER BY length(seq) DESC RANGE UNBOUNDED PRECEDING) AS c, count(*) OVER () AS n, sum(length(seq)) OVER () AS t FROM seqs)
SELECT CAST(max(n) AS BIGINT) AS n, CAST(max(t) AS BIGINT) AS total, round(max(t)::DOUBLE / max(n), 6) AS mean, min(len) FILTER (r > n // 2) AS median, max(len) FILTER (2 * c >= t) AS n50, 0 AS n_bases, 0 AS n_runs, 0 AS n_run_bases FROM l""")
def assembly_stats(v):
    return S.assembly_stats(v.seqs).withColumn("mean", F.round("mean", 6))


@query("gc_summary", "SELECT CAST(sum(length(seq) - length(translate(seq, 'GC', ''))) AS BIGINT) AS gc, CAST(sum(length(seq)) AS BIGINT) AS length, round(100.0 * sum(length(seq) - length(translate(seq, 'GC', ''))) / sum(length(seq)), 6) AS gc_pc FROM seqs")
def gc_summary(v):
    return S.gc_summary(v.seqs).withColumn("gc_pc", F.round("gc_pc", 6))


FREE = "(" + ", ".join(f"'{c}'" for c, n in X.degeneracy().items() if n == 4) + ")"
GC3 = f"""
WITH c AS (SELECT id, unnest({CODONS_SQL}) AS codon FROM seqs), d AS (SELECT id, codon, codon IN {FREE} AS four, CASE WHEN substr(codon, 3, 1) IN ('G', 'C') THEN 1 ELSE 0 END AS g FROM c WHERE codon NOT IN ('TAA', 'TAG', 'TGA'))
SELECT {{by}} count(*) FILTER (four) AS n4, CAST(coalesce(sum(g) FILTER (four), 0) AS BIGINT) AS gc4, count(*) FILTER (NOT four) AS n_other, CAST(coalesce(sum(g) FILTER (NOT four), 0) AS BIGINT) AS gc_other,
  round(coalesce(sum(g) FILTER (four), 0)::DOUBLE / nullif(count(*) FILTER (four), 0), 9) AS gc3, round(coalesce(sum(g) FILTER (NOT four), 0)::DOUBLE / nullif(count(*) FILTER (NOT four), 0), 9) AS gc3_other FROM d {{group}}"""


def _gc3(v, per_gene):
    return S.gc3(v.seqs, per_gene).withColumns({"gc3": F.round("gc3", 9), "gc3_other": F.round("gc3_other", 9)})


@query("gc3", GC3.format(by="id,", group="GROUP BY id"))
def gc3(v):
    return _gc3(v, True)


@query("gc3_overall", GC3.format(by="", group=""))
def gc3_overall(v):
    return _gc3(v, False)


@query("full_orfs", f"WITH p AS (SELECT {PEP_SQL} AS p FROM seqs) SELECT count(*) AS n, count(*) FILTER (p LIKE 'M%' AND p LIKE '%*') AS full, round(100.0 * count(*) FILTER (p LIKE 'M%' AND p LIKE '%*') / count(*), 6) AS percent FROM p")
def full_orfs(v):
    return S.full_orfs(v.seqs).withColumn("percent", F.round("percent", 6))


@query("length_histogram", "SELECT length(seq) AS length, CAST(sum(1 + id % 5) AS BIGINT) AS n FROM seqs GROUP BY 1")
def length_histogram(v):
    return S.length_histogram(v.seqs.withColumn("w", 1 + F.col("id") % 5), "w")


@query("quality_histogram", "WITH c AS (SELECT unnest(string_split(seq, '')) AS c FROM (SELECT * FROM seqs ORDER BY id LIMIT 10000) s) SELECT ascii(c) - 33 AS score, count(*) AS n FROM c WHERE c <> '' GROUP BY 1")
def quality_histogram(v):
    return S.quality_histogram(v.seqs.withColumnRenamed("seq", "qual"))


@query("tile", "WITH t AS (SELECT id, seq, unnest(range(1, length(seq) - 118, 40)) AS start FROM seqs WHERE length(seq) >= 120) SELECT id, CAST(start AS INT) AS start, substr(seq, start, 120) AS seq FROM t")
def tile(v):
    return S.tile(v.seqs, 120, 40)


@query("fetch_seq", """SELECT f.seqid, f.start, f.stop, f.strand, f.parent, CASE WHEN f.strand = '-' THEN reverse(translate(substr(s.seq, f.start, f.stop - f.start + 1), 'ACGT', 'TGCA')) ELSE substr(s.seq, f.start, f.stop - f.start + 1) END AS seq
FROM (SELECT seqid, start % 900 + 1 AS start, start % 900 + 1 + stop - start AS stop, strand, parent FROM features) f JOIN seqs s ON s.id = f.seqid WHERE length(s.seq) >= f.stop""")
def fetch_seq(v):
    g = v.seqs.withColumnRenamed("id", "seqid")
    at = F.col("start") % 900 + 1
    f = v.features.select("seqid", at.alias("start"), (at + F.col("stop") - F.col("start")).alias("stop"), "strand", "parent")
    f = f.join(g.select("seqid", F.length("seq").alias("n")), "seqid").where("n >= stop").drop("n")
    return S.fetch_seq(f, g, 128).select("seqid", "start", "stop", "strand", "parent", "seq")


@query("clip_to_hit", """WITH h AS (SELECT query, min(ROW(line_no, qstart % 60 + 1, qstart % 60 + 20)) AS h FROM (SELECT CAST(split_part(query, '_', 2) AS BIGINT) AS query, line_no, qstart FROM hits) x GROUP BY query),
s AS (SELECT id, seq, h[2] AS a, h[3] AS b FROM seqs JOIN h ON seqs.id = h.query), p AS (SELECT id, 'left' AS part, substr(seq, 1, a - 1) AS seq FROM s UNION ALL SELECT id, 'right', substr(seq, b + 1) FROM s)
SELECT * FROM p WHERE length(seq) > 0""")
def clip_to_hit(v):
    h = v.hits.select(F.split("query", "_")[1].cast("long").alias("query"), "line_no", (F.col("qstart") % 60 + 1).alias("qstart"), (F.col("qstart") % 60 + 20).alias("qstop"))
    return S.clip_to_hit(h, v.seqs)


@query("longest_per", "WITH r AS (SELECT id, seq, id % 40 AS k, row_number() OVER (PARTITION BY id % 40 ORDER BY length(seq) DESC, id) AS n FROM seqs WHERE length(seq) >= 50) SELECT k, id, seq FROM r WHERE n = 1")
def longest_per(v):
    return S.longest_per(v.seqs.withColumn("k", F.col("id") % 40), "k", "id", 50)


@query("splice_site_matrix", """
WITH p AS (SELECT '5''' AS e, i, substr(seq, CAST(i AS BIGINT), 1) AS b FROM seqs, range(1, 7) t(i) WHERE length(seq) >= 9 UNION ALL SELECT '3''', i, substr(seq, length(seq) - 3 + i, 1) FROM seqs, range(1, 4) t(i) WHERE length(seq) >= 9),
n AS (SELECT e AS "end", CAST(i AS INT) AS position, count(*) FILTER (b = 'A') AS "A", count(*) FILTER (b = 'C') AS "C", count(*) FILTER (b = 'G') AS "G", count(*) FILTER (b = 'T') AS "T", count(*)::DOUBLE AS total FROM p GROUP BY ALL)
SELECT "end", position, "A", "C", "G", "T", round("A" / total, 9) AS "fA", round("C" / total, 9) AS "fC", round("G" / total, 9) AS "fG", round("T" / total, 9) AS "fT" FROM n""")
def splice_site_matrix(v):
    out = S.splice_site_matrix(v.seqs)
    return out.select("end", "position", *"ACGT", *(F.round(f"f{x}", 9).alias(f"f{x}") for x in "ACGT"))
