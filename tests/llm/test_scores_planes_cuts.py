"""Compression scores, clusters by bit planes and fill-in-middle: against plain versions, and on odd rows."""

import hashlib
import pickle
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bitplanes, compression, fim
from tests.llm.test_operators import LONG, ODD, docs

# Compression classifier


def test_scores_hold_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = compression.op11_compression_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    good = np.array([r.quality == 1 for r in got])
    score = np.array([r.score for r in got])
    assert len(good) > 50 and np.mean([r.predicted for r in got] == good) > 0.93
    assert (score[good][:, None] > score[~good][None, :]).mean() > 0.9
    assert ((score >= 0) & (score <= 1)).all() and all(r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_change_nothing(spark):
    rows = [(i, ("plain words come here " if i % 3 else "### %%% $$$ ") * 9 + str(i)) for i in range(90)]
    table = docs(spark, rows)
    fold = compression.held_out()
    labels = table.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (compression.fit(table.where(~fold), x.where(~fold)) for x in (labels, turned))
    assert one.good == two.good and one.bad == two.bad and all((a == b).all() for a, b in zip(one.knots, two.knots))


def test_scores_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = np.array(["apple", "tree", "house", "river", "stone", "cloud", "bird", "under", "over", "slowly"])
    good = [" ".join(rng.choice(words, 80)) for _ in range(40)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 80)) for _ in range(20)]
    labelled = docs(spark, list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(60)] + [(3, None), (None, 0), (5, 1), (5, 1)], "doc_id long, quality int")
    model = compression.fit(labelled, labels)
    again = pickle.loads(pickle.dumps(model))
    got = compression.score(docs(spark, ODD + [(20, good[0]), (21, bad[0])]), model).collect()
    assert len(got) == len(ODD) + 2
    for (id_, text), row in zip(ODD + [(20, good[0]), (21, bad[0])], got):
        raw = (text or "").encode()
        plain = 0.0
        for low in range(0, len(raw), 1024):
            size = [len(c.compress(raw[low : low + 1024])) for c in again._compressors]
            plain += size[1] - size[0]
        assert row.doc_id == id_ and row.difference == plain / max(len(raw), 1) and 0 <= row.score <= 1
    assert got[-2].score > 0.8 and got[-1].score < 0.3
    empty = compression.score(docs(spark, []), model)
    assert empty.columns == ["doc_id", "difference", "score"] and empty.count() == 0


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1), (2, 1)], 2 / 3)])
def test_scores_without_labels_of_both_kinds(spark, labels, score):
    table = docs(spark, [(1, "some text"), (2, "other text"), (3, None)])
    model = compression.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = [r.score for r in compression.score(table, model).collect()]
    assert len(set(got)) == 1 and (not labels or got[0] >= 0.5) and (labels or got[0] == score)


def test_calibration_rises_and_pools():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, 4000)
    good = rng.random(4000) < 1 / (1 + np.exp(-30 * x))
    knots = compression.calibration(x, good)
    assert (np.diff(knots[0]) >= 0).all() and (np.diff(knots[1]) >= 0).all()
    for at in (-0.1, 0.0, 0.1):
        assert abs(np.interp(at, *knots) - 1 / (1 + np.exp(-30 * at))) < 0.08


# Bit planes


def brute_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    now = [list(v) for _, v in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        own = nearest()
        for n in range(len(now)):
            mine = [v for (_, v), (_, m) in zip(kept, own) if m == n]
            if mine:
                now[n] = [sum(x) // len(mine) for x in zip(*mine)]
    own = nearest()
    total = sum(d for d, _ in own)
    return [
        (i, n, d, sum(e for e, m in own if m == n), total, hashlib.sha256(",".join(map(str, now[n])).encode()).hexdigest())
        for (i, _), (d, n) in zip(kept, own)
    ]


VECTORS = "vec_id long, embedding array<float>, label int, id long, cluster string, planes int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 9, "x", 2) for i, v in rows], VECTORS)


def key(row):
    return (row[0] is None, str(row))


def test_clusters_brute(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 3 ** (i % 4), 64)]) for i in range(60)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (61, [0.0] * 64), (62, None), (63, []), (64, [1.0] * 63), (65, [1.0] * 128)]
    rows += [(66, [None] + [1.0] * 63), (67, [float("nan")] + [1.0] * 63), (68, [float("-inf")] + [1.0] * 63)]
    got = sorted((tuple(r) for r in bitplanes.clusters(vectors(spark, rows).repartition(5), k=6, rounds=3).collect()), key=key)
    assert got == sorted(brute_clusters(rows, 6, 3), key=key)


def test_few_equal_or_no_vectors(spark):
    one = [(i, [0.5] * 64) for i in (3, 1, 2)]
    got = bitplanes.clusters(vectors(spark, one)).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3] and {r.cluster for r in got} == {0} and {r.inertia for r in got} == {0}
    for rows in ([], [(1, None), (2, [1.0])]):
        out = bitplanes.clusters(vectors(spark, rows))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0
    huge = [(1, [1e30] * 64), (2, [-524288.0] * 64), (3, [524287.0] * 64)]
    got = sorted(bitplanes.clusters(vectors(spark, huge), k=1, rounds=0).collect())
    assert [r.vec_id for r in got] == [2, 3] and got[0].inertia == 64 * (1048575 * 256) ** 2


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    for bound in (1, 2, 300, 1 << 20, 1 << 27):
        x, y = rng.integers(-bound, bound, (9, 64)), rng.integers(-bound, bound, (5, 64))
        assert (bitplanes.unpack(bitplanes.pack(x)) == x).all()
        assert (bitplanes.products(bitplanes.pack(x), bitplanes.pack(y)) == x @ y.T).all()
        assert (bitplanes.squares(bitplanes.pack(x)) == (x * x).sum(axis=1)).all()


# Fill in the middle

UNITS = {"char": r"(?s).", "word": r"(?s)(?:\A[ \t-\r]*)?[^ \t-\r]+[ \t-\r]*", "line": r"[^\n]*\n|[^\n]+"}


def brute_form(id_, text, unit="char"):
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    whole = not parts  # white space alone has no word and goes where the cuts after nothing put it: after both
    x, y, z = "".join(parts[:a]), "".join(parts[a:b]), text if whole else "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(parts), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(parts), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_cuts_brute(spark, unit):
    rng = np.random.default_rng(4)
    letters = np.array(list("ab<PSM> \n\t") + ["é", "ß", "語", "\U0001f600", "\x85", "\r"])
    rows = ODD + [(100 + i, "".join(rng.choice(letters, rng.integers(0, 3000 if i % 9 else 90_000)))) for i in range(120)]
    rows += [(300, "<P>a<S>b<M>c"), (301, " \n "), (302, "<"), (303, "a\n"), (304, "語" * 511 + "x"), (305, "x" * 512), (306, "x" * 513), (307, "<P" * 2000)]
    made = fim.fill_in_middle(docs(spark, rows), unit=unit)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for (id_, text), r in zip(rows, got):
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (id_, *brute_form(id_, text, unit))
        assert r.back == (text or "") and r.n_chars == len(text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert len(LONG) > 100_000


def test_cuts_of_no_rows_and_unknown_units(spark):
    assert fim.fill_in_middle(docs(spark, [])).count() == 0
    with pytest.raises(Exception, match="none of char, word and line"):
        fim.fill_in_middle(docs(spark, ODD), unit="page").collect()


def test_tree_sums_and_descends():
    rng = np.random.default_rng(6)
    data = np.frombuffer("".join(rng.choice(list("aé語 \n"), 20_000)).encode(), np.uint8)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    off = np.concatenate([[0, 0], np.sort(lead[rng.integers(0, len(lead), 40)]), [len(data)]])
    index = fim.Blocks(data, off, block=16)
    points = np.array([len(data[a:b].tobytes().decode()) for a, b in zip(off[:-1], off[1:])])
    assert (index.total(index.units) == points).all()
    row = np.repeat(np.arange(len(points)), 5)
    ask = rng.integers(0, points[row] + 1)
    byte, chars = index.cuts(row, ask)
    assert (chars == ask).all()
    assert all(len(data[off[r] : b].tobytes().decode()) == n for r, b, n in zip(row, byte, ask))
