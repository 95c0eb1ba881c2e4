"""Effects of variants on coding sequences, and candidate loci."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.functions import revcomp, translate_cds
from loomspan.operators.intervals import BIN, earlier, merge_intervals, overlap_join, tile_of
from loomspan.operators.sequences import fetch_seq
from loomspan.sources.scratch import kept

#: bases read on after a frameshift before the next stretch is tried; None is all that is left
READ_ON = (192, 3_072, None)


def coding_parts(models: DataFrame) -> DataFrame:
    """CDS exons (gene, seqid, start, stop, strand) with the coding offset of their first base along the strand."""
    w = W.partitionBy("gene").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))).rowsBetween(W.unboundedPreceding, -1)
    return models.withColumn("offset", F.coalesce(F.sum(F.col("stop") - F.col("start") + 1).over(w), F.lit(0)))


def coding_sequences(models: DataFrame, genome: DataFrame, chunk: int = 100_000) -> DataFrame:
    """The coding sequence of each gene (genome: seqid, seq)."""
    return _joined(coding_parts(models), genome, chunk)


def _joined(exons: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """The sequences of exons with their coding offsets, joined by gene."""
    parts = fetch_seq(exons, genome, chunk)
    return parts.groupBy("gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "seq"))), lambda x: x["seq"]), "").alias("cds"))


def _trimmed(variants: DataFrame) -> DataFrame:
    """Variants with what their alleles share at the front, then at the end, cut off: ``r`` is replaced by ``a`` from ``p`` on."""
    most = F.least(F.length("ref"), F.length("alt"))
    longest = lambda ok, n: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), ok)), F.lit(0))
    front = F.when(F.col("ref") == F.col("alt"), 0).otherwise(longest(lambda k: F.substr("ref", F.lit(1), k) == F.substr("alt", F.lit(1), k), most))
    v = variants.withColumn("__front", front)
    v = v.withColumns({"p": F.col("pos") + F.col("__front"), "r": F.substr("ref", F.col("__front") + 1), "a": F.substr("alt", F.col("__front") + 1)}).drop("__front")
    back = longest(lambda k: (k == 0) | (F.right("r", k) == F.right("a", k)), F.least(F.length("r"), F.length("a")))
    v = v.withColumn("__back", F.when(F.col("r") == F.col("a"), 0).otherwise(back))
    cut = lambda c: F.substr(c, F.lit(1), F.length(c) - F.col("__back"))
    return v.withColumns({"r": cut("r"), "a": cut("a")}).drop("__back")


def variant_effects(variants: DataFrame, models: DataFrame, genome: DataFrame, bin_size: int = BIN, chunk: int = 100_000) -> DataFrame:
    """Each variant (seqid, pos, ref, alt) with each gene that it touches and what it does to it.

    The span that changes is projected through the coding exons: bases of alt replace those of ref one by one, the rest of
    ref is deleted, the rest of alt inserted after the last of them; what lies outside the exons doesn't count. The class is
    intergenic, intron (in a gene, no coding base), frameshift, or from the codons that change and their translation
    synonymous, nonsense (a stop that is new, or comes earlier), missense, or inframe_indel where their number changes.
    old, new, old_aa and new_aa are the codons and residues that change; after a frameshift new_aa is read on in the edited
    sequence through its first stop. stop_at is the residue of that new stop, crosses whether bases outside coding exons
    change as well, cds_pos the first coding base that changes (of an insertion, the base before it on the sequence). Repeated
    variants count once. Writes intermediate tables."""
    v = _trimmed(variants.select("seqid", "pos", "ref", "alt").distinct())
    insertion = F.length("r") == 0
    v = v.withColumns({"start": F.col("p") - insertion.cast("int"), "stop": F.col("p") + F.greatest(F.length("r"), F.lit(1)) - 1 - insertion.cast("int")})
    v, exons = kept(v, "variants"), kept(coding_parts(models), "exons")  # both are read several times
    spans = exons.groupBy("gene", "seqid").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    key = ["seqid", "pos", "ref", "alt"]
    hit = overlap_join(v, spans, how="left", bin_size=bin_size).select(*key, "p", "r", "a", F.col("gene_r").alias("gene"))
    parts = overlap_join(v, exons, bin_size=bin_size)
    plus = F.col("strand_r") != "-"
    f, t, same = F.greatest("start", "start_r"), F.least("stop", "stop_r"), F.least(F.length("r"), F.length("a"))
    last = F.col("p") + same - 1  # the last base that is replaced
    piece = F.when(f <= last, F.substr("a", (f - F.col("p") + 1).cast("int"), (F.least(t, last) - f + 1).cast("int"))).otherwise("")
    piece = F.concat(piece, F.when((f <= last) & (last <= t), F.substr("a", same + 1)).otherwise(""))
    low = F.col("offset_r") + F.when(plus, f - F.col("start_r")).otherwise(F.col("stop_r") - t) + 1
    parts = parts.select(*key, F.col("gene_r").alias("gene"), F.col("strand_r").alias("strand"), low.alias("low"), (t - f + 1).alias("size"), F.struct(f.alias("f"), F.when(F.length("r") > 0, piece).otherwise(F.col("a")).alias("piece")).alias("bit"))
    edits = parts.groupBy(*key, "gene", "strand").agg(F.min("low").alias("c1"), F.max(F.col("low") + F.col("size") - 1).alias("c2"), F.sum("size").alias("covered"), F.array_sort(F.collect_list("bit")).alias("bits"))
    edits = edits.withColumn("put", F.array_join(F.transform("bits", lambda x: x["piece"]), "")).drop("bits")
    full = hit.join(edits, [*key, "gene"], "left").join(_joined(exons, genome, chunk), "gene", "left")
    minus = F.col("strand") == "-"
    put = F.when(minus, revcomp("put")).otherwise(F.col("put"))
    anchor = F.substr("cds", F.col("c1").cast("int"), F.lit(1))
    put = F.when(~insertion, put).when(minus, F.concat(put, anchor)).otherwise(F.concat(anchor, put))
    full = full.withColumns({"put": put, "w0": (F.floor((F.col("c1") - 1) / 3) * 3).cast("int"), "w1": (F.ceil(F.col("c2") / 3) * 3).cast("int")})
    cds = lambda low, high: F.substr("cds", (low + 1).cast("int"), F.greatest((high - low).cast("int"), F.lit(0)))
    before = cds(F.col("w0"), F.col("c1") - 1)
    shift = (F.length("put") - (F.col("c2") - F.col("c1") + 1)) % 3 != 0
    old, new = cds(F.col("w0"), F.col("w1")), F.concat(before, F.col("put"), cds(F.col("c2"), F.col("w1")))
    full = full.withColumns({"shift": shift, "old": old, "new": F.when(~shift, new)})
    # read on after a frameshift: a stretch at first, a longer one where it has no stop, and then all
    full, done = full.withColumn("beyond", F.lit(None).cast("string")), 0
    for ahead in READ_ON:
        upto = F.length("cds") if ahead is None else F.least(F.col("c2") + ahead, F.length("cds"))
        open_ = F.col("shift") & (F.col("beyond").isNull() | (F.instr("beyond", "*") == 0) & (F.col("c2") + done < F.length("cds")))
        done = ahead
        full = full.withColumn("beyond", F.when(open_, translate_cds(F.concat(before, F.col("put"), cds(F.col("c2"), upto)))).otherwise(F.col("beyond")))
    beyond = F.when(F.instr("beyond", "*") > 0, F.concat(F.substring_index("beyond", "*", 1), F.lit("*"))).otherwise(F.col("beyond"))
    full = full.withColumns({"old_aa": F.when(F.col("c1").isNotNull(), translate_cds("old")), "new_aa": F.when(F.col("shift"), beyond).when(F.col("c1").isNotNull(), translate_cds("new"))})
    at, was = F.instr("new_aa", "*"), F.instr("old_aa", "*")
    gain = (at > 0) & ((was == 0) | (at < was))
    kind = (
        F.when(F.col("gene").isNull(), "intergenic").when(F.col("c1").isNull(), "intron").when(F.col("shift"), "frameshift").when(F.col("old_aa") == F.col("new_aa"), "synonymous")
        .when(gain, "nonsense").when(F.length("old") == F.length("new"), "missense").otherwise("inframe_indel")
    )
    stop_at = F.when((F.col("shift") & (at > 0)) | gain, F.floor(F.col("w0") / 3) + at)
    crosses = F.when(F.col("c1").isNotNull(), ~insertion & (F.col("covered") < F.length("r")))
    return full.select(*key, "gene", kind.alias("class"), F.col("c1").alias("cds_pos"), "old", "new", "old_aa", "new_aa", crosses.alias("crosses"), stop_at.cast("long").alias("stop_at"))


def strain_cds(cds: DataFrame, snps: DataFrame) -> DataFrame:
    """Coding sequences (gene, cds) of each sample with its substitutions (sample, gene, cds_pos, allele), and their peptides."""
    s = snps.groupBy("gene", "sample").agg(F.array_sort(F.collect_list(F.struct("cds_pos", "allele"))).alias("s")).join(cds, "gene")
    out = F.aggregate("s", F.col("cds"), lambda a, x: F.overlay(a, x["allele"], x["cds_pos"].cast("int"), F.lit(1)))
    return s.select("gene", "sample", out.alias("cds")).withColumn("pep", translate_cds("cds"))


def mirna_candidates(windows: DataFrame, reads: DataFrame, genome: DataFrame, least: int = 50, size: int = 1000, before: int = 160, after: int = 20, bin_size: int = BIN) -> DataFrame:
    """Tiles of reads in windows (seqid, window, reads) above ``least``, each as two loci that reach ``before`` and ``after`` bases beyond its ends, cut at the sequence's."""
    hot = windows.where(F.col("reads") > least).select("seqid", (F.col("window") * size + 1).alias("start"), ((F.col("window") + 1) * size).alias("stop")).distinct()
    tiles = merge_intervals(overlap_join(reads.select("seqid", "start", "stop"), hot, bin_size=bin_size).select("seqid", "start", "stop")).join(genome, "seqid")
    both = F.array(F.struct(F.lit("left").alias("side"), F.lit(before).alias("b"), F.lit(after).alias("a")), F.struct(F.lit("right").alias("side"), F.lit(after).alias("b"), F.lit(before).alias("a")))
    t = tiles.select("seqid", F.col("start").alias("t_start"), F.col("stop").alias("t_stop"), "n", "length", F.inline(both))
    return t.select("seqid", "t_start", "t_stop", "n", "side", F.greatest(F.col("t_start") - F.col("b"), F.lit(1)).alias("start"), F.least(F.col("t_stop") + F.col("a"), "length").alias("stop"))


def tir_windows(gaps: DataFrame, size: int = 35, most_n: float = 0.5, tsd: int = 8) -> DataFrame:
    """Gap sequences (id, seq, left, right: the bases around) with their first and last ``size`` bases, the second
    reverse complemented, the length of their common prefix, and that of the longest equal end and begin of the flanks."""
    g = gaps.where((F.length("seq") >= 2 * size) & (F.regexp_count("seq", F.lit("[Nn]")) <= most_n * F.length("seq")))
    g = g.select("id", F.substr("seq", F.lit(1), F.lit(size)).alias("head"), revcomp(F.substr("seq", F.lit(-size), F.lit(size))).alias("tail"), "left", "right")
    longest = lambda ok, n: F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(n)), ok)), F.lit(0))
    tir = longest(lambda k: F.substr("head", F.lit(1), k) == F.substr("tail", F.lit(1), k), size)
    dup = longest(lambda k: (k == 0) | ((F.length("left") >= k) & (F.length("right") >= k) & (F.substr("left", F.length("left") - k + 1, k) == F.substr("right", F.lit(1), k))), tsd)
    return g.select("id", "head", "tail", tir.alias("tir"), dup.alias("tsd"))


def polya_est_sites(trimmed: DataFrame, alignments: DataFrame) -> DataFrame:
    """Where trimmed ESTs (est, length, clip_start, clip_stop) end on the genome: the alignment's end on the side
    that was trimmed, as 5prime or 3prime."""
    side = F.when(F.col("clip_start") > 1, "5prime").when(F.col("clip_stop") < F.col("length"), "3prime")
    t = trimmed.select("est", side.alias("side")).where("side IS NOT NULL").join(alignments, "est")
    at_start = (F.col("side") == "5prime") == (F.col("strand") != "-")
    return t.select("est", "side", "seqid", F.when(at_start, F.col("start")).otherwise(F.col("stop")).alias("pos"), "strand")


def gene_summary(cds: DataFrame, genome: DataFrame) -> DataFrame:
    """Genes with strand as 1 or -1, spliced length, exons, and position counted over all sequences in order of their names."""
    offset = earlier(genome.select("seqid", "length"), [], ["seqid"], F.col("length"), "sum", tile_of(genome, "seqid", 1000)).select("seqid", F.col("__before").alias("offset"))
    g = cds.groupBy("gene", "seqid", "strand").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(F.col("stop") - F.col("start") + 1).alias("spliced"), F.count(F.lit(1)).alias("exons"))
    return g.join(offset, "seqid").select("gene", "seqid", F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), "start", "stop", "spliced", "exons", (F.col("offset") + F.col("start")).alias("genome_start"))


def _branches(newick: str) -> Iterator[tuple[str, str, float]]:
    """(leaves below, leaves below the parent, length) of each branch of a tree in parentheses."""
    stack, leaves, name, length, reading, done = [[]], [], "", "", False, []

    def close():
        nonlocal name, length, reading, leaves
        if name.strip() and not leaves:
            leaves = [name.strip()]
        if leaves:
            stack[-1].append((sorted(leaves), float(length) if length.strip() else None))
        name, length, reading, leaves = "", "", False, []

    for c in newick:
        if c == "(":
            stack.append([])
        elif c in ",);":
            close()
            if c == ")":
                children = stack.pop()
                leaves = sorted(x for kids, _ in children for x in kids)
                done += [("|".join(kids), "|".join(leaves), n) for kids, n in children if n is not None]
        elif c == ":":
            reading = True
        elif reading:
            length += c
        else:
            name += c
    yield from done


def branch_means(trees: DataFrame) -> DataFrame:
    """Mean length and number of each branch over many trees (column newick), by its leaves and its parent's."""

    def run(batches):
        for batch in batches:
            rows = [b for tree in batch.column(0).to_pylist() if tree for b in _branches(tree)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["branch", "parent", "length"])

    rows = trees.select("newick").mapInArrow(run, "branch string, parent string, length double")
    return rows.groupBy("branch", "parent").agg(F.avg("length").alias("mean"), F.count(F.lit(1)).alias("n"))
