"""Graphs, spans of variants, greedy rounds, folds, splits and p-values against hand-made cases and sequential twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions import statistics as T
from loomspan.operators import comparative, features, intervals, ontology, popgen, reads, sequences, variants
from loomspan.sources import readers
from tests.test_operators import got


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


# Intervals


@pytest.mark.parametrize("size", [3, 2000])
def test_overlaps_of_mixed_lengths(spark, size):
    rng = random.Random(size)

    def side():
        out = [("c", 1, 200_000_000, 0)]
        for i in range(1, 160):
            at = rng.choice([1, rng.randint(1, 200_000_000), rng.randint(1, 4000)])
            out.append((rng.choice("cd"), at, at + int(10 ** rng.uniform(0, 8)) - rng.choice([1, 1, 2]), i))
        return out

    a, b = side(), side()
    schema = "seqid string, start long, stop long, id int"
    pairs = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])
    l, r = table(spark, schema, a), table(spark, schema, b)
    assert got(intervals.overlap_join(l, r, bin_size=size), "id", "id_r") == pairs
    if size == 2000:
        dealt = intervals._dealt(l, r, size, False).groupBy("id").count()
        assert dealt.agg(F.max("count")).first()[0] <= 2 * (intervals.FAN + 1) + 2 * intervals.LEVELS
        assert dealt.where("id = 0").first()["count"] < 40
        semi = got(intervals.overlap_semi(l, r), "id")
        assert semi == sorted({(i,) for i, _ in pairs})


def one_by_one(rows, order, chain=None):
    """Rows (key, start, stop, ...) that stay when they are taken in order."""
    kept, ended = [], set()
    for r in sorted(rows, key=order):
        if chain and r[chain] in ended:
            continue
        if any(k[0] == r[0] and k[1] <= r[2] and r[1] <= k[2] for k in kept):
            if chain:
                ended.add(r[chain])
            continue
        kept.append(r)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(2))
def test_greedy_rounds_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.choice("cd"), s, s + int(10 ** rng.uniform(0, 2.5))) for s in (rng.randint(1, 2500) for _ in range(150))})
    df = table(spark, "seqid string, start long, stop long", rows)
    by_length = intervals.greedy_disjoint(df, "seqid", [F.col("start") - F.col("stop"), F.col("start"), F.col("stop")])
    assert got(by_length, "seqid", "start", "stop") == one_by_one(rows, lambda r: (r[1] - r[2], r[1], r[2]))
    by_place = intervals.greedy_disjoint(df, "seqid", [F.col("start"), F.col("stop")])
    assert got(by_place, "seqid", "start", "stop") == one_by_one(rows, lambda r: (r[1], r[2]))
    chained = [(*r, f"g{rng.randint(0, 30)}", i) for i, r in enumerate(rows)]
    df = table(spark, "seqid string, start long, stop long, gene string, step int", chained)
    mine = intervals.greedy_disjoint(df, "seqid", [F.col("gene"), F.col("step")], chain="gene")
    assert got(mine, "seqid", "start", "stop", "gene", "step") == one_by_one(chained, lambda r: (r[3], r[4]), chain=3)


def test_greedy_of_nothing_and_of_equal_rows(spark):
    schema = "seqid string, start long, stop long, id int"
    assert intervals.greedy_disjoint(table(spark, schema, []), "seqid", [F.col("start")]).count() == 0
    same = table(spark, schema, [("c", 5, 9, 1)] * 3 + [("c", 9, 9, 2), ("c", 7, 6, 3)])
    assert got(intervals.greedy_disjoint(same, "seqid", [F.col("start")]), "id") == [(1,)]


@pytest.mark.parametrize("seed", range(2))
def test_promoters_never_overlap(spark, seed):
    rng = random.Random(seed)
    genes = [(f"g{i:02d}", "c", rng.choice("+-"), s, s + rng.randint(5, 60)) for i, s in enumerate(rng.randint(1, 9000) for _ in range(60))]
    df = table(spark, "gene string, seqid string, strand string, start long, stop long", genes)
    out = features.promoter_windows(df, table(spark, "seqid string, length long", [("c", 9100)]), steps=4, size=100, bin_size=50)
    expected = []
    for gene, _, strand, a, b in sorted(genes, key=lambda g: (g[3], g[0])):
        for step in range(1, 5):
            low = a - step * 100 if strand == "+" else b + (step - 1) * 100 + 1
            low, high = max(low, 1), min(low + 99, 9100)
            if low > high or any(x <= high and low <= y for *_, x, y in genes) or any(x <= high and low <= y for *_, x, y in expected):
                break
            expected.append((gene, step, low, high))
    assert got(out, "gene", "step", "start", "stop") == sorted(expected)


def test_two_divergent_genes_share_no_promoter(spark):
    genes = table(spark, "gene string, seqid string, strand string, start long, stop long", [("a", "c", "-", 1000, 2000), ("b", "c", "+", 3500, 4000)])
    out = features.promoter_windows(genes, table(spark, "seqid string, length long", [("c", 9000)]))
    assert got(out.where("start < 4000"), "gene", "start", "stop") == [("a", 2001, 3000)]


# Features


def est_twin(rows, max_intron, overlap=3):
    """Transcripts of one query and sequence, exon by exon as they come along each strand."""
    out = []
    for strand in "-+":
        last = None
        for qs, qe, hs, he in sorted((r[1:] for r in rows if r[0] == strand), key=lambda x: ((x[2] if strand == "+" else -x[2]), x[3], x[0])):
            if last is None or qs < last[0]:
                out.append((strand, []))
            elif strand == "+":
                gap = hs - last[2]
                if -overlap <= gap < 0:
                    hs, gap = hs - gap + 1, 1
                if gap < -overlap:
                    continue
                if gap > max_intron:
                    out.append((strand, []))
            else:
                gap = last[1] - he
                if -overlap < gap < 0:
                    he, gap = he + gap - 1, 1
                if gap < 0:
                    continue
                if gap > max_intron:
                    out.append((strand, []))
            out[-1][1].append((qs, qe, hs, he))
            last = qs, hs, he
    return sorted((s, min(e[2] for e in x), max(e[3] for e in x), len(x), min(e[0] for e in x), max(e[1] for e in x)) for s, x in out)


@pytest.mark.parametrize("seed", range(3))
def test_est_chains_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        hs, qs = rng.randint(1, 3000), rng.randint(1, 300)
        n = rng.randint(10, 60)
        rows.append((rng.choice("+-"), qs, qs + n, hs, hs + n))
    rows += [("+", 1, 50, 9000, 9049), ("+", 51, 90, 9048, 9090), ("+", 91, 99, 9080, 9095), ("+", 95, 120, 9100, 9130), ("-", 1, 50, 9500, 9550), ("-", 51, 60, 9400, 9501), ("-", 61, 70, 9390, 9403)]
    df = table(spark, "query string, seqid string, strand string, qstart long, qstop long, start long, stop long, qlen long", [("q", "c", *r, 400) for r in rows])
    out = features.chain_est(df.repartition(3), max_intron=50)
    assert got(out, "strand", "start", "stop", "exons", "qstart", "qstop") == est_twin(rows, 50)
    assert all(r.coverage == 100 * (r.qstop - r.qstart) // 400 >= 20 for r in features.chain_est(df, 50, min_cov=20).collect())


def test_codons_split_over_exons_bound_the_cds(spark):
    row = lambda kind, a, b, strand="+", t="t": ("g", t, "c", kind, a, b, strand)
    rows = [row("exon", 1, 100), row("exon", 201, 300), row("exon", 401, 500), row("CDS", 95, 100), row("CDS", 201, 298), row("CDS", 450, 460)]
    rows += [row("start_codon", 99, 100), row("start_codon", 201, 201), row("stop_codon", 299, 300), row("stop_codon", 401, 401)]
    rows += [row("exon", 1, 50, "-", "u"), row("exon", 101, 150, "-", "u"), row("CDS", 10, 50, "-", "u"), row("CDS", 101, 140, "-", "u"), row("start_codon", 128, 130, "-", "u"), row("stop_codon", 7, 9, "-", "u")]
    rows += [row("exon", 1, 9, "+", "n"), row("exon", 1, 50, "+", "p"), row("CDS", 10, 20, "+", "p"), row("CDS", 21, 30, "+", "p")]
    m = features.gene_models(table(spark, "gene string, transcript string, seqid string, type string, start long, stop long, strand string", rows))
    of = lambda t, kind: got(m.where(F.col("transcript") == t).where(F.col("type") == kind), "start", "stop")
    assert of("t", "CDS") == [(99, 100), (201, 300), (401, 401)]
    assert of("t", "five_prime_UTR") == [(1, 98)] and of("t", "three_prime_UTR") == [(402, 500)]
    assert of("u", "CDS") == [(7, 50), (101, 130)] and of("u", "five_prime_UTR") == [(131, 150)] and of("u", "three_prime_UTR") == [(1, 6)]
    assert of("n", "mRNA") == [(1, 9)] and of("n", "CDS") == [] and of("n", "five_prime_UTR") == []
    assert of("p", "CDS") == [(10, 20), (21, 30)]  # no codon: as they came


# Graphs


def test_longest_path_passes_by_dead_ends(spark):
    edges = table(spark, "child string, parent string", [("x", "a"), ("x", "b"), ("b", "root"), ("y", "c"), ("y", "d"), ("d", "e"), ("e", "root"), ("c", "root"), ("z", "p"), ("z", "q"), ("p", "root"), ("q", "root")])
    assert dict(got(ontology.lineage(edges, "root"), "term", "path")) == {
        "root": "root", "b": "root;b", "x": "root;b;x", "c": "root;c", "e": "root;e", "d": "root;e;d", "y": "root;e;d;y", "p": "root;p", "q": "root;q", "z": "root;p;z",
    }
    assert ontology.lineage(edges, "elsewhere").count() == 0
    with pytest.raises(Exception, match="a cycle below the root"):
        ontology.lineage(edges.union(table(spark, "child string, parent string", [("e", "y")])), "root").collect()


@pytest.mark.parametrize("seed", range(2))
def test_longest_paths_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"n{i:02d}", f"n{rng.randint(0, i - 1):02d}") for i in range(1, 30) for _ in range(2)})
    up = {}
    for c, p in edges:
        up.setdefault(c, []).append(p)

    def paths(term):
        return [[term]] if term == "n00" else [[term, *rest] for p in up.get(term, []) for rest in paths(p)]

    best = {t: ";".join(reversed(min(ps, key=lambda x: (-len(x), x)))) for t in ["n00", *up] if (ps := paths(t))}
    assert dict(got(ontology.lineage(table(spark, "child string, parent string", edges), "n00"), "term", "path")) == best


def test_a_slim_parent_stops_all_branches(spark):
    slim = table(spark, "term string", [("p1",), ("s2",)])
    rows = [("a", "p1", "is_a"), ("a", "p2", "is_a"), ("p2", "s2", "is_a"), ("b", "p2", "is_a"), ("b", "p1", "part_of"), ("s2", "p1", "is_a"), ("c", "a", "is_a"), ("c", "b", "is_a"), ("d", "x", "is_a")]
    out = ontology.map_to_slim(table(spark, "child string, parent string, rel string", rows), slim)
    assert got(out, "term", "slim") == [("a", "p1"), ("b", "s2"), ("c", "p1"), ("c", "s2"), ("p1", "p1"), ("p2", "s2"), ("s2", "s2")]


def test_ranks_counts_and_profiles(spark):
    edges = table(spark, "child string, parent string", [("k", "root"), ("f", "k"), ("g1", "f"), ("g2", "k"), ("s1", "g1"), ("s2", "g2")])
    ranks = table(spark, "term string, rank string", [("k", "kingdom"), ("f", "phylum"), ("g1", "genus"), ("g2", "genus"), ("s1", "species"), ("s2", "species")])
    out = ontology.taxonomy_summary(table(spark, "term string", [("s1",), ("s1",), ("s2",), ("g1",), ("zz",), ("root",)]), edges, "root", ranks)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("rank", "species", 3, None), ("rank", "genus", 1, None), ("rank", "no rank", 1, None), ("missing", None, 1, None), ("genus", "g1", 3, "f"), ("genus", "g2", 1, "Unranked"), ("phylum", "f", 3, None)], key=str
    )
    genes = table(spark, "gene string, term string", [("a", "s1"), ("a", "s1"), ("a", "zz"), ("b", "zz")])
    paths = ontology.go_paths(genes, edges, "root", 2)
    assert sorted(map(tuple, paths.collect())) == [("a", "s1", "k; f"), ("b", None, "Unknown")]


# Variants

GENOME = "".join(random.Random(5).choice("ACGT") for _ in range(400))


def effect_twin(pos, ref, alt, exons, strand):
    """Edited coding sequence, base by base, or None where no coding base changes."""
    front = 0
    while ref != alt and front < min(len(ref), len(alt)) and ref[front] == alt[front]:
        front += 1
    p, r, a = pos + front, ref[front:], alt[front:]
    back = 0
    while ref != alt and back < min(len(r), len(a)) and r[len(r) - 1 - back] == a[len(a) - 1 - back]:
        back += 1
    r, a = r[: len(r) - back], a[: len(a) - back]
    put = {}
    if not r:
        put[p - 1] = GENOME[p - 2] + a
    for i in range(len(r)):
        put[p + i] = (a[i] if i < min(len(r), len(a)) else "") + (a[len(r) :] if i == min(len(r), len(a)) - 1 else "")
    coding = [g for x, y in exons for g in range(x, y + 1)]
    if not set(put) & set(coding):
        return None
    turn = (lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]) if strand == "-" else str
    return turn("".join(GENOME[g - 1] for g in coding)), turn("".join(put.get(g, GENOME[g - 1]) for g in coding)), bool(r) and not set(put) <= set(coding)


@pytest.mark.parametrize("strand", ["+", "-"])
def test_effects_over_spans(spark, strand):
    rng = random.Random(strand)
    exons = [(101, 130), (151, 180), (201, 232)]
    given = set()
    for _ in range(140):
        pos = rng.randint(85, 250)
        ref = GENOME[pos - 1 : pos - 1 + rng.choice([1, 1, 2, 4, 12, 40])]
        alt = rng.choice([ref[0], ref + rng.choice(["A", "ACG"]), "".join(rng.choice("ACGT") for _ in range(rng.choice([1, len(ref), 3])))])
        given.add((pos, ref, alt))
    models = table(spark, "gene string, seqid string, start long, stop long, strand string", [("g", "c", a, b, strand) for a, b in exons])
    v = table(spark, "seqid string, pos long, ref string, alt string", [("c", *x) for x in sorted(given)])
    rows = variants.variant_effects(v, models, table(spark, "seqid string, seq string", [("c", GENOME)]), 50, 100).collect()
    assert len(rows) == len(given)
    from loomspan.functions import codon_table

    code = codon_table()
    translate = lambda s: "".join(code[s[i : i + 3]] for i in range(0, len(s) - 2, 3))
    seen = set()
    for r in rows:
        edit = effect_twin(r.pos, r.ref, r.alt, exons, strand)
        seen.add(r["class"])
        if edit is None:
            assert r["class"] == ("intron" if r.gene else "intergenic") and r.crosses is None
            continue
        old, new, crosses = edit
        assert r.crosses == crosses and r.gene == "g"
        if (len(new) - len(old)) % 3:
            assert r["class"] == "frameshift"
            whole = translate(new)
            start = (r.cds_pos - 1) // 3
            stop = whole.find("*", start)
            assert r.stop_at == (stop + 1 if stop >= 0 else None) and r.new_aa == (whole[start : stop + 1] if stop >= 0 else whole[start:])
            continue
        assert r["class"] in ("synonymous", "missense", "nonsense", "inframe_indel")
        assert (translate(old) == translate(new)) == (r["class"] == "synonymous")
        if r["class"] == "missense":
            assert len(old) == len(new)
        if r["class"] == "nonsense":
            assert translate(new)[r.stop_at - 1] == "*"
    assert seen >= {"intergenic", "intron", "frameshift", "missense"}


def test_deletion_into_an_exon_is_no_intergenic_variant(spark):
    models = table(spark, "gene string, seqid string, start long, stop long, strand string", [("g", "c", 101, 130, "+")])
    genome = table(spark, "seqid string, seq string", [("c", GENOME)])
    v = table(spark, "seqid string, pos long, ref string, alt string", [("c", 94, GENOME[93:104], GENOME[93]), ("c", 127, GENOME[126:140], GENOME[126]), ("c", 98, GENOME[97:102], GENOME[97])])
    found = {r.pos: r for r in variants.variant_effects(v, models, genome).collect()}
    assert found[94]["class"] == "frameshift" and found[94].crosses and found[94].cds_pos == 1  # 101 to 104: four bases
    assert found[127].crosses and found[127]["class"] in ("inframe_indel", "nonsense", "synonymous")  # 128 to 130: three bases
    assert found[98]["class"] == "frameshift" and found[98].crosses  # 101 and 102


# Populations and statistics


@pytest.mark.parametrize("size", [7, 16_384])
def test_packed_pairs_equal_the_loop(spark, size):
    rng = random.Random(size)
    names = ["s1", "s2", "s3", "s4"]
    sites = {(c, p): {n: rng.choice([["A"], ["A", "C"], ["G", "T"], ["A", "A"], ["AT", "A"]] + ([["."]] if p % 6 == 0 else [])) for n in names} for c in "xy" for p in range(1, 60)}
    df = table(spark, "chrom string, pos long, sample string, ref string, gt array<string>", [(c, p, n, "A", g) for (c, p), row in sites.items() for n, g in row.items()])
    shared, different, ref = {}, {}, {n: [0, 0, 0] for n in names}
    for row in sites.values():
        for n in names:
            ref[n][0] += len(set(row[n])) == 2
        if any("." in g for g in row.values()):
            continue
        for i, a in enumerate(names):
            ref[a][1 if "A" in row[a] else 2] += 1
            for b in names[i + 1 :]:
                x, y = set(row[a]), set(row[b])
                shared[a, b] = shared.get((a, b), 0) + len(x & y)
                different[a, b] = different.get((a, b), 0) + len(x ^ y)
    assert got(popgen.pairwise_alleles(df, size), "sample_a", "sample_b", "shared", "different") == sorted((*k, shared[k], different[k]) for k in shared)
    assert got(popgen.reference_alleles(df), "sample", "het", "shared_ref", "diff_ref") == sorted((n, *v) for n, v in ref.items())


def test_p_values_are_those_of_tables():
    # Kolmogorov's distribution at its tabulated points
    for x, p in ((1.2238478702170823, 0.1), (1.3580986393225505, 0.05), (1.6276236115189503, 0.01), (1.9494746035759047, 0.001)):
        assert T.kolmogorov(x) == pytest.approx(p, abs=1e-9)
    # F with 5 and 10 degrees of freedom: 3.325834529 and 5.636326187 cut off 5 and 1 percent
    for f, p in ((3.325834529923155, 0.05), (5.636326188169163, 0.01)):
        assert 1 - T.incomplete_beta(5 * f / (5 * f + 10), 2.5, 5.0) == pytest.approx(p, abs=1e-9)
    assert T.variance_ratio_p(3.325834529923155, 6, 11) == pytest.approx(0.1, abs=1e-9)
    assert T.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    for a, b, x in ((0.5, 0.5, 0.3), (2.0, 3.0, 0.4), (7.0, 2.0, 0.9)):
        n = 200_000
        steps = [((i + 0.5) / n * x) for i in range(n)]
        whole = sum(t ** (a - 1) * (1 - t) ** (b - 1) for t in steps) * x / n * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        assert T.incomplete_beta(x, a, b) == pytest.approx(whole, abs=2e-3 if a < 1 else 1e-9)
    # five against four values without ties: W = 4, and its normal limit with continuity correction
    assert T.rank_sum_p(19, 0, 5, 4) == pytest.approx(2 * T.normal_tail((6 - 0.5) / math.sqrt(5 * 4 / 12 * 10)), abs=1e-12)
    assert T.rank_sum_p(3, 24, 1, 2) is None


def test_groups_are_compared_pair_by_pair(spark):
    df = table(spark, "k string, v double", [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (4, 5, 6, 7)] + [("c", 2.0)] * 3 + [("a", None), (None, 1.0)])
    rows = {(r.one, r.two): r for r in popgen.compare_groups(df, "v", "k", [("a", "b"), ("b", "a"), ("a", "c"), ("c", "c2")]).collect()}
    assert set(rows) == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "c2")}
    ab, ba = rows["a", "b"], rows["b", "a"]
    assert ab.ks == ba.ks == pytest.approx(0.6) and ab.rank_sum == 17 and ba.rank_sum == 28
    assert ab.ks_p == pytest.approx(T.kolmogorov(0.6 * math.sqrt(20 / 9))) and ab.rank_p == pytest.approx(ba.rank_p) and ab.f_p == pytest.approx(ba.f_p)
    assert rows["a", "c"].f_ratio is None and rows["a", "c"].f_p is None and rows["c", "c2"].ks_p is None


# Sequences and files


@pytest.mark.parametrize("chunk", [8, 13, 1000])
def test_tiles_and_mapability_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    seqs = [(f"s{i}", "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 8, 26, 100))]
    df = table(spark, "id string, seq string", seqs)
    assert got(sequences.tile(df, 8, 3, chunk), "id", "start", "seq") == sorted((i, a + 1, s[a : a + 8]) for i, s in seqs for a in range(0, len(s) - 7, 3))
    calls = table(spark, "seqid string, calls string", [(i, s.replace("A", "!")) for i, s in seqs])
    out = reads.mapability(calls, 4, df.withColumnRenamed("id", "seqid"), 6, chunk=chunk)
    expected = []
    for i, s in seqs:
        for w in range(0, len(s), 4):
            hits = [a for a in range(w, min(w + 4, len(s))) if s[a] == "A"]
            gc = [sum(c in "GC" for c in s[a : a + 6]) / len(s[a : a + 6]) for a in hits]
            expected.append((i, w // 4, len(hits) / len(s[w : w + 4]), sum(gc) / len(gc) if gc else None))
    rows = sorted(out.collect(), key=lambda r: (r.seqid, r.window))
    assert [(r.seqid, r.window) for r in rows] == [e[:2] for e in expected]
    for r, e in zip(rows, expected):
        assert r.unique_share == pytest.approx(e[2]) and (r.gc is None) == (e[3] is None) and (e[3] is None or r.gc == pytest.approx(e[3]))


def test_fastq_splits_at_every_byte(spark, tmp_path):
    quals = ["@III", "IIII", "@@@@", "+@+@", "I@+I"]
    text = "".join(f"@r{i} x\nACGT\n+\n{quals[i % 5]}\n" for i in range(7))
    (tmp_path / "a.fq").write_text(text)
    expected = [(i, f"r{i}", "x", "ACGT", quals[i % 5]) for i in range(7)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in range(17, 45):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            df = readers.read_fastq(spark, str(tmp_path / "a.fq"), numbered=False)
            assert got(df, "id", "seq", "qual") == [e[1:2] + e[3:] for e in expected], size
            if size % 10 == 9:
                assert got(readers.read_fastq(spark, str(tmp_path / "a.fq")), "index", "id", "desc", "seq", "qual") == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ["@r1\nAC\n+\nII\nr2\nAC\n+\nII\n", "@r1\nAC\n-\nII\n", "@r1\nAC\n+\n", "@r1\nAC\n"])
def test_fastq_out_of_register_fails(spark, tmp_path, text):
    (tmp_path / "b.fq").write_text(text)
    with pytest.raises(Exception, match="out of register"):
        readers.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_best_hit_by_coverage_and_length(spark):
    lens = table(spark, "id string, length int", [("q", 100), ("h1", 140), ("h2", 100), ("h3", 110), ("h4", 100)])
    rows = [("q", "h1", 99.0, 90, 1, 100, 1, 139, 1), ("q", "h2", 99.0, 90, 1, 50, 1, 99, 2), ("q", "h3", 99.0, 90, 1, 70, 1, 60, 3), ("q", "h4", 59.0, 90, 1, 99, 1, 99, 4), ("q", "h3", 80.0, 90, 1, 70, 1, 70, 5), ("q", "h4", 99.0, 90, 1, 99, 1, 99, 6), ("q", "h9", 99.0, 90, 1, 99, 1, 99, 0)]
    hits = table(spark, "query string, hit string, pid double, aln_len int, qstart int, qend int, tstart int, tend int, line_no int", rows)
    assert got(comparative.best_hit(hits, ["line_no"], lens=lens), "query", "hit", "line_no") == [("q", "h3", 5)]
