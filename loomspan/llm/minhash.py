"""Near-duplicate documents by SuperMinHash signatures.

Each distinct shingle deals the slots of the signature out in a random order of
its own, one slot a step, and offers the value ``step + random`` to it. All
shingles of many documents take a step together; a document stops as soon as
every slot is filled, as later steps can only offer larger values. Bands of
slots bring candidates together, the full shingle sets confirm them, and the
links' components are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, pieces, stored, table
from loomspan.llm._components import components
from loomspan.llm._words import ORDER, U, mix, shingle_sets, stream

SLOTS, BANDS, ROWS = 128, 21, 6
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def super_minhash(grams: np.ndarray, edge: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots, uint64) of the sets ``grams[edge[i]:edge[i + 1]]``; slots of empty sets stay EMPTY."""
    n = len(edge) - 1
    out = np.full(n * slots, EMPTY, U)
    row = np.repeat(np.arange(n), np.diff(edge))
    swaps: list[np.ndarray] = []
    seeds = stream(slots, 101)
    for step in range(slots):
        if not len(grams):
            break
        random = mix(grams ^ seeds[step])
        at = step + (((random & U(0xFFFFFF)) * U(slots - step)) >> U(24)).astype(np.int64)
        slot = at
        for t in range(step - 1, -1, -1):  # what earlier swaps have brought to this place
            slot = np.where(slot == swaps[t], t, slot)
        np.minimum.at(out, row * slots + slot, (U(step) << U(40)) | (random >> U(24)))
        swaps.append(at.astype(np.int16))
        open_rows = (out.reshape(n, slots) == EMPTY).any(axis=1)
        live = open_rows[row]
        if live.sum() < 0.7 * len(live):
            grams, row, swaps = grams[live], row[live], [s[live] for s in swaps]
    return out.reshape(n, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros((len(signatures), bands), U)
    for j in range(rows):
        keys += mix(signatures[:, j : bands * rows : rows]) * ORDER[j]
    return mix(keys + stream(bands, 7)[None, :]).view(np.int64)


def _set_prints(grams: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, in two arrays, that tell it from another."""
    out, sizes = [], np.diff(edge).astype(U)
    for seed in (3, 5):
        acc = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams ^ U(seed)), dtype=U)])
        out.append(mix(acc[edge[1:]] - acc[edge[:-1]] + sizes).view(np.int64))
    return out


def _fingerprints(k: int):
    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch, 1):
                grams, edge = shingle_sets(data, off, k)
                sizes = np.diff(edge)
                signatures = super_minhash(grams, edge)
                keys = band_keys(signatures)
                two = _set_prints(grams, edge)
                short = (mix(signatures) & U(0xFFFF)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(two[0]), pa.array(two[1]), lists, pa.array([x.tobytes() for x in short], pa.binary())],
                    ["id", "n_shingles", "set_a", "set_b", "bands", "signature"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part, data, off in pieces(batch, 1):
                grams, edge = shingle_sets(data, off, k)
                two = _set_prints(grams, edge)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[0]), pa.array(two[1]), pa.array([grams[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["set_a", "set_b", "grams"]
                )

    return run


def _agree(least: float):
    """Keeps pairs whose signatures agree in a share ``least`` of the slots."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= least))

    return run


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union on the full sets."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _sides(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    x = side.select(F.col("id").alias("a"), F.col(value).alias("x"))
    y = side.select(F.col("id").alias("b"), F.col(value).alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")


def _rest(at: DataFrame, sets: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """Links between members of one bucket that have other labels, by full sets.

    Every member outside the bucket's smallest label meets all members of the bucket, in
    tasks of ``block`` of either side at most; no pair is a row."""
    strays = at.where("label <> main").groupBy("band", "key").agg(F.count(F.lit(1)).alias("strays"))
    rows = at.join(strays, ["band", "key"]).select(
        "band", "key", "id", "label", F.col("label") != F.col("main"),
        F.ceil(F.col("strays") / block).cast("int").alias("left"), F.ceil(F.col("n") / block).cast("int").alias("right"),
    ).toDF("band", "key", "id", "label", "stray", "left", "right")
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    to = lambda side, cell: F.transform(F.sequence(F.lit(0), F.col(side) - 1), cell)
    everyone = to("left", lambda i: F.struct(i.alias("i"), (own % F.col("right")).alias("j"), F.lit(False).alias("asks")))
    asking = to("right", lambda j: F.struct((own % F.col("left")).alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    cells = rows.select("band", "key", "id", "label", F.explode(F.when(F.col("stray"), F.concat(everyone, asking)).otherwise(everyone)).alias("cell"))
    cells = cells.select("band", "key", "id", "label", "cell.*").join(sets, "id")
    return cells.groupBy("band", "key", "i", "j").applyInPandas(_meet(percent), "a long, b long").distinct()


def _meet(percent: int):
    def run(rows):
        import pandas as pd

        out = []
        ask, all_ = rows[rows.asks], rows[~rows.asks]
        if len(ask) and len(all_):
            grams = [np.frombuffer(x, U) for x in all_.grams]
            sizes = np.array([len(g) for g in grams])
            owner = np.repeat(np.arange(len(grams)), sizes)
            flat = np.concatenate(grams)
            order = np.argsort(flat)
            flat, owner, labels, ids = flat[order], owner[order], all_.label.to_numpy(), all_.id.to_numpy()
            for id_, label, mine in zip(ask.id, ask.label, ask.grams):
                mine = np.frombuffer(mine, U)
                low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
                ends = np.cumsum(high - low)
                hit = np.arange(ends[-1]) + np.repeat(low - (ends - (high - low)), high - low)
                shared = np.bincount(owner[hit], minlength=len(grams))
                good = (100 * shared >= percent * (len(mine) + sizes - shared)) & (labels != label)
                _, first = np.unique(labels[good], return_index=True)  # one link to each group does
                out += [(min(id_, x), max(id_, x)) for x in ids[good][first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def minhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85, hub_rounds: int = 2
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set
    holds its distinct k-word shingles, or its whole word sequence as one if it is
    shorter. Documents link where 100 * intersection >= percent * union, confirmed
    on full sets of 64-bit shingle hashes. 128 slots in 21 bands of 6 bring a pair
    at 0.85 together with probability 0.99995.

    Equal sets form one class first, which has a number of its own: ids may repeat, and each row
    goes by its own text. A bucket's members are then tested against a hub of the bucket, a new one
    each round; pairs whose members are already connected need no test. Members still outside their
    bucket's main group after ``hub_rounds`` meet all its members in bounded blocks, so that no link
    of the buckets is lost.

    Null, empty and word-less texts have no shingles and stand alone
    (component_id = own id, kept). Repeated rows share a component; rows that repeat
    the kept id are all marked kept. Rows of one id with different texts are different documents:
    each has the links of its text. A null id never stands for a class with other ids.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = stored(
        docs.mapInArrow(_fingerprints(k), "id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary")
        .withColumn("row", F.monotonically_increasing_id()),
        "fingerprints",
    )
    some = prints.where("n_shingles > 0 AND id IS NOT NULL")
    # a class is numbered by the first of its rows, as written; "id" is that number from here on
    classes = some.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.min("row").alias("class"))
    firsts = classes.select(F.col("class").alias("row"))
    buckets = some.join(firsts, "row", "left_semi").select(F.col("row").alias("id"), F.posexplode("bands").alias("band", "key"))
    several = buckets.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "key")
    # the only buckets that matter from here on, by far fewer than there are
    buckets = stored(buckets.join(several, ["band", "key"], "left_semi"), "buckets")
    wanted = some.join(buckets.select(F.col("id").alias("row")).distinct(), "row", "left_semi").select("row", "id", "set_a", "set_b", "signature")
    wanted = stored(wanted, "wanted")
    # texts are found again by the id of the class's first row, and then by their set
    texts = docs.join(wanted.select("id").distinct().hint("shuffle_hash"), "id", "left_semi").mapInArrow(_sets(k), "set_a long, set_b long, grams binary")
    sets = texts.groupBy("set_a", "set_b").agg(F.first("grams").alias("grams")).join(wanted.select("set_a", "set_b", F.col("row").alias("id")), ["set_a", "set_b"])
    sets = stored(sets.select("id", "grams"), "sets")
    signatures = wanted.select(F.col("row").alias("id"), "signature")

    least = percent / 100 - 0.15  # over four standard errors below the threshold
    labels = None
    for turn in range(hub_rounds + 1):
        at = buckets.withColumn("label", F.col("id"))
        if labels is not None:
            at = buckets.join(labels, "id", "left").select("id", "band", "key", F.coalesce("component", "id").alias("label"))
            torn = at.groupBy("band", "key").agg(F.min("label").alias("main"), F.max("label").alias("other"), F.count(F.lit(1)).alias("n"))
            at = stored(at.join(torn.where("main < other").drop("other"), ["band", "key"]), "torn")
            if at.isEmpty():
                break
        if turn < hub_rounds:
            first = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.col("id"), "id")
            hub = at.groupBy("band", "key").agg(F.min_by(F.struct("id", "label"), first).alias("hub"))
            pairs = at.join(hub, ["band", "key"]).where("id <> hub.id AND label <> hub.label")
            pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
            pairs = stored(_sides(pairs, signatures, "signature").mapInArrow(_agree(least), "a long, b long"), "candidates")
            found = _sides(pairs, sets, "grams").mapInArrow(_confirm(percent), "a long, b long")
        else:
            found = _rest(at, sets, percent)
        found = stored(found, "links")
        # the labels so far stand for the links that gave them
        old = labels
        labels = components(found if old is None else found.union(old.where("id <> component").toDF("a", "b")))
        for past in [found, *([pairs] if turn < hub_rounds else []), *([old, at] if old is not None else [])]:
            dropped(spark, past)
    for past in (sets, buckets, wanted):
        dropped(spark, past)
    named = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("set_a", "set_b", "rep", F.coalesce("component", "class").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select("set_a", "set_b", "component_id")
    alone = F.col("n_shingles") == 0
    return (
        prints.select("id", "n_shingles", F.when(~alone, F.col("set_a")).alias("set_a"), F.when(~alone, F.col("set_b")).alias("set_b"))
        .join(named, ["set_a", "set_b"], "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of ``docs``, all columns unchanged: that with the smallest id, null after
    all others. Rows are told apart by their place in a written copy of ``docs``, so that ids may repeat
    or be null; rows without words stay, each by itself."""
    keyed = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "dedup-rows")
    ids = keyed.select("row", F.col("doc")[id_col].alias("id"))
    groups = minhash_components(keyed.select("row", F.col("doc")[text_col].alias("text")), "row", "text", **options).select("row", "component_id")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"]
    kept = groups.join(ids, "row").groupBy("component_id").agg(least.alias("row")).select("row")
    out = keyed.join(kept.hint("shuffle_hash"), "row", "left_semi")
    return out.select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def op8_minhash_near_dedup(spark, sf_dir):
    """Near copies at 85 % in the whole of ``documents``. Null, empty and word-less texts stand alone; equal texts,
    repeated rows among them, share a component; a row without an id joins those with its shingle set only."""
    return minhash_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
undirected AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM undirected UNION SELECT r.a, u.b FROM reach r JOIN undirected u ON r.b = u.a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM sets d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, d.s
"""
