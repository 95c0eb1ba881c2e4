"""Operators on sequence tables (id, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import codons, degeneracy, revcomp, translate_cds
from loomspan.operators.intervals import earlier


def min_length(df: DataFrame, n: int, strict: bool = False) -> DataFrame:
    return df.where(F.length("seq") > n if strict else F.length("seq") >= n)


def drop_low_complexity(df: DataFrame, most: int = 2) -> DataFrame:
    """Sequences of more than ``most`` different letters."""
    return df.where(F.size(F.array_distinct(F.filter(F.split("seq", ""), lambda c: c != ""))) > most)


def size_base_filter(df: DataFrame, lo: int = 18, hi: int = 30) -> DataFrame:
    """Reads of lo to hi bases that begin and end in A, C, G or T."""
    return df.where(F.length("seq").between(lo, hi) & F.substr("seq", F.lit(1), F.lit(1)).isin(*"ACGT") & F.substr("seq", F.lit(-1), F.lit(1)).isin(*"ACGT"))


def assembly_stats(seqs: DataFrame, nlen: int = 50) -> DataFrame:
    """One row: n, total, mean, median (the element at n/2 of the sorted lengths), n50, N bases,
    runs of ``nlen`` N or more and their length. Ranks go over the distinct lengths, which are few."""
    runs = F.regexp_extract_all("seq", F.lit(f"([Nn]{{{nlen},}})"), F.lit(1))
    s = seqs.select(F.length("seq").cast("long").alias("len"), F.regexp_count("seq", F.lit("[Nn]")).alias("ns"), F.size(runs).alias("runs"), F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("run_len"))
    sizes = s.groupBy("len").agg(F.count(F.lit(1)).alias("c"))
    totals = sizes.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("len")).alias("total"))
    bases, tile = F.col("c") * F.col("len"), F.floor(F.log2(F.greatest("len", F.lit(1))) * 64)
    ranked = earlier(sizes, [], ["len"], F.col("c"), "sum", tile, inclusive=True).withColumnRenamed("__before", "upto")
    ranked = earlier(ranked, [], ["len"], bases, "sum", tile).join(F.broadcast(totals), how="cross")  # one row
    ranked = ranked.withColumn("covered", F.col("total") - F.col("__before"))
    picked = ranked.agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len"))).alias("median"), F.max(F.when(2 * F.col("covered") >= F.col("total"), F.col("len"))).alias("n50"))
    other = s.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.avg("len").alias("mean"), F.sum("ns").alias("n_bases"), F.sum("runs").cast("long").alias("n_runs"), F.sum("run_len").alias("n_run_bases"))
    return other.join(F.broadcast(picked), how="cross").select("n", "total", "mean", "median", "n50", "n_bases", "n_runs", "n_run_bases")


def gc_summary(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.sum(F.regexp_count("seq", F.lit("[GCgc]"))).alias("gc"), F.sum(F.length("seq")).alias("length")).withColumn("gc_pc", F.try_divide(100.0 * F.col("gc"), F.col("length")))


def gc3(seqs: DataFrame, per_gene: bool = True) -> DataFrame:
    """GC share at the third position of codons whose third base is free, and of the other coding codons."""
    free = [c for c, n in degeneracy().items() if n == 4]
    coding = list(degeneracy())
    c = seqs.select("id", F.explode(codons("seq")).alias("codon")).where(F.col("codon").isin(*coding))
    four, third = F.col("codon").isin(*free), F.substr("codon", F.lit(3), F.lit(1)).isin("G", "C").cast("int")
    g = c.groupBy("id") if per_gene else c.groupBy()
    g = g.agg(F.sum(F.when(four, 1).otherwise(0)).alias("n4"), F.sum(F.when(four, third).otherwise(0)).alias("gc4"), F.sum(F.when(~four, 1).otherwise(0)).alias("n_other"), F.sum(F.when(~four, third).otherwise(0)).alias("gc_other"))
    return g.withColumns({"gc3": F.try_divide(F.col("gc4").cast("double"), F.col("n4")), "gc3_other": F.try_divide(F.col("gc_other").cast("double"), F.col("n_other"))})


def full_orfs(cds: DataFrame, table: int = 1) -> DataFrame:
    p = cds.select(translate_cds("seq", table).alias("p"))
    full = (F.col("p").startswith("M") & F.col("p").endswith("*")).cast("int")
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum(full).alias("full"), (100 * F.avg(full)).alias("percent"))


def length_histogram(seqs: DataFrame, weight: str | None = None) -> DataFrame:
    return seqs.groupBy(F.length("seq").alias("length")).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("n"))


def quality_histogram(reads: DataFrame, limit: int | None = 10_000) -> DataFrame:
    """Rows (score, n) over the quality strings of the first ``limit`` reads by id; None: of all."""
    r = reads.orderBy("id").limit(limit) if limit else reads
    return r.select(F.explode(F.filter(F.split("qual", ""), lambda c: c != "")).alias("c")).groupBy((F.ascii("c") - 33).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def chunked(seqs: DataFrame, key: str = "id", chunk: int = 100_000, halo: int = 0, seq: str = "seq") -> DataFrame:
    """Sequences in chunks: key, k (from 0), ``part``, the chunk with the first ``halo`` letters of the next one (``chunk`` at
    most), and ``size`` without those. A sequence is cut in one pass; what follows sees chunks only, dealt anew."""
    c = seqs.select(key, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("c"))
    parts = F.transform("c", lambda x, i: F.struct(x.alias("own"), F.left(F.coalesce(F.get("c", i + 1), F.lit("")), F.lit(halo)).alias("next")))
    rows = c.select(key, F.posexplode(parts).alias("k", "p"))
    return rows.select(key, F.col("k").cast("long").alias("k"), F.concat("p.own", "p.next").alias("part"), F.length("p.own").alias("size")).repartition(key, "k")


def tile(seqs: DataFrame, size: int, step: int, chunk: int = 100_000) -> DataFrame:
    """Windows of ``size`` at every ``step`` (id, start, seq), cut from chunks that reach ``size`` - 1 letters into the next."""
    chunk = max(chunk, size)
    c = chunked(seqs, "id", chunk, size - 1).withColumn("at", F.col("k") * chunk)
    first = F.ceil(F.col("at") / step) * step
    last = F.col("at") + F.least(F.col("size"), F.length("part") - size + 1) - 1
    c = c.select("id", "part", "at", first.alias("first"), last.alias("last")).where("first <= last")
    c = c.select("id", "part", "at", F.explode(F.sequence("first", "last", F.lit(step).cast("long"))).alias("s"))
    return c.select("id", (F.col("s") + 1).cast("int").alias("start"), F.substr("part", (F.col("s") - F.col("at") + 1).cast("int"), F.lit(size)).alias("seq"))


def fetch_seq(features: DataFrame, genome: DataFrame, chunk: int = 100_000) -> DataFrame:
    """``features`` (seqid, start, stop, strand) with their sequence, reverse complement on '-'. The
    genome (seqid, seq) is cut into chunks that features are joined to, so no task needs a whole sequence for each."""
    parts = chunked(genome, "seqid", chunk).drop("size")
    keys = features.select("seqid", "start", "stop").distinct().withColumn("k", F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("stop") - 1) / chunk))))
    low, high = F.greatest("start", F.col("k") * chunk + 1), F.least("stop", (F.col("k") + 1) * chunk)
    bits = keys.join(parts, ["seqid", "k"]).select("seqid", "start", "stop", "k", F.substr("part", (low - F.col("k") * chunk).cast("int"), (high - low + 1).cast("int")).alias("bit"))
    whole = bits.groupBy("seqid", "start", "stop").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "bit"))), lambda x: x["bit"]), "").alias("seq"))
    return features.join(whole, ["seqid", "start", "stop"]).withColumn("seq", F.when(F.col("strand") == "-", revcomp("seq")).otherwise(F.col("seq")))


def clip_to_hit(hits: DataFrame, seqs: DataFrame) -> DataFrame:
    """Sequences before and after their first hit (query, line_no, qstart, qstop), parts that are empty left out."""
    first = hits.groupBy("query").agg(F.min(F.struct("line_no", "qstart", "qstop")).alias("h"))
    s = seqs.join(first, seqs.id == first["query"])
    left = s.select("id", F.lit("left").alias("part"), F.substr("seq", F.lit(1), (F.col("h.qstart") - 1).cast("int")).alias("seq"))
    right = s.select("id", F.lit("right").alias("part"), F.substr("seq", (F.col("h.qstop") + 1).cast("int"), F.length("seq")).alias("seq"))
    return left.union(right).where("length(seq) > 0")


def longest_per(df: DataFrame, key: str, order: str, least: int = 1) -> DataFrame:
    """The longest record of each key of ``least`` residues or more; of equal ones the first by ``order``."""
    best = df.where(F.length("seq") >= least).groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(-F.length("seq"), F.col(order))).alias("r"))
    return best.select("r.*")


def splice_site_matrix(introns: DataFrame, five: int = 6, three: int = 3) -> DataFrame:
    """Counts and shares of bases at the first ``five`` and last ``three`` positions of introns (seq)."""
    s = introns.where(F.length("seq") >= five + three)
    a = s.select(F.lit("5'").alias("end"), F.posexplode(F.split(F.substr("seq", F.lit(1), F.lit(five)), "")).alias("p", "base"))
    b = s.select(F.lit("3'").alias("end"), F.posexplode(F.split(F.substr("seq", F.lit(-three), F.lit(three)), "")).alias("p", "base"))
    n = a.union(b).where("base IN ('A','C','G','T')").groupBy("end", (F.col("p") + 1).alias("position")).pivot("base", list("ACGT")).count().fillna(0, list("ACGT"))
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return n.select("end", "position", *"ACGT", *((F.col(x) / total).alias(f"f{x}") for x in "ACGT"))
