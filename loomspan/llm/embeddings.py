"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, more than one each. In every
shard a graph is built by robust pruning; the adjacency lists of all shards are
joined; greedy searches from each shard's medoid walk the graph and then expand over
all that lies within range. Pairs are verified in double precision, and a sample of
queries is audited against brute force; where it falls short, products of all blocks
of vectors finish the job.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import dropped, stored, table
from loomspan.llm._components import components
from loomspan.llm._words import U, mix

LOG = logging.getLogger(__name__)
DEGREE, CANDIDATES, FAR, BEAM, ALPHA = 24, 64, 24, 24, 1.2


def robust_prune(near: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each node (n x degree, -1 where fewer) out of ``near`` (n x candidates, the
    closest first): a candidate goes once a chosen one is ``alpha`` times closer to it than the node is."""
    n, width = near.shape
    rows = np.arange(n)
    away = np.sqrt(np.maximum(2 - 2 * sims[rows[:, None], near], 0))
    live = near != rows[:, None]
    out = np.full((n, degree), -1, np.int32)
    for k in range(degree):
        at = np.argmax(live, axis=1)
        some = live[rows, at]
        if not some.any():
            break
        chosen = near[rows, at]
        out[some, k] = chosen[some]
        between = np.sqrt(np.maximum(2 - 2 * sims[chosen[:, None], near], 0))
        live &= alpha * between > away
        live[rows, at] = False
    return out


def _pruned(x: np.ndarray, i: int, near: np.ndarray, degree: int, alpha: float = ALPHA) -> np.ndarray:
    """``robust_prune`` of one node with many candidates, the closest first; those pruned fill what is left of ``degree``."""
    away = np.sqrt(np.maximum(2 - 2 * (x[near] @ x[i]), 0))
    live, chosen = np.ones(len(near), bool), []
    while live.any() and len(chosen) < degree:
        at = int(np.argmax(live))
        chosen.append(at)
        live &= alpha * np.sqrt(np.maximum(2 - 2 * (x[near] @ x[near[at]]), 0)) > away
        live[at] = False
    left = np.setdiff1d(np.arange(len(near)), chosen)[: degree - len(chosen)]
    return near[np.concatenate([chosen, left]).astype(np.int64)]


def build(x: np.ndarray, seed: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Adjacency lists of unit vectors ``x`` and their medoid. Candidates are the nearest vectors
    and some far ones, which keep the graph in one piece. Edges go both ways; a node that these
    leave with more than twice ``DEGREE`` neighbours is pruned again."""
    n = len(x)
    sims = x @ x.T
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    width = min(CANDIDATES, n)
    near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    far = (mix(seed.view(U)[:, None] + np.arange(FAR, dtype=U)[None, :] * U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int64)
    near = np.concatenate([near, far], axis=1)
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
    chosen = robust_prune(near, sims)
    a, k = np.nonzero(chosen >= 0)
    b = chosen[a, k]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    count = np.bincount(pairs // n, minlength=n)
    edge, heavy = np.concatenate([[0], np.cumsum(count)]), np.flatnonzero(count > 2 * DEGREE)
    if len(heavy):
        thin = [pairs[np.isin(pairs // n, heavy, invert=True)]]
        for i in heavy:
            to = pairs[edge[i] : edge[i + 1]] % n
            to = to[np.argsort(-sims[i, to], kind="stable")]
            thin.append(i * n + _pruned(x, i, to, 2 * DEGREE))
        pairs = np.unique(np.concatenate(thin))
    seen = np.zeros(n, bool)
    while True:  # what the medoid doesn't lead to is tied to its nearest node that it does
        src, dst = pairs // n, pairs % n
        edge = np.searchsorted(src, np.arange(n + 1))
        front = np.array([medoid])
        seen[front] = True
        while len(front):
            ahead = np.unique(np.concatenate([dst[edge[i] : edge[i + 1]] for i in front]))
            front = ahead[~seen[ahead]]
            seen[front] = True
        if seen.all():
            break
        out, in_ = np.flatnonzero(~seen), np.flatnonzero(seen)
        i, j = np.unravel_index(np.argmax(sims[np.ix_(out, in_)]), (len(out), len(in_)))
        pairs = np.unique(np.append(pairs, [out[i] * n + in_[j], in_[j] * n + out[i]]))
    return [dst[edge[i] : edge[i + 1]] for i in range(n)], medoid


def search(x: np.ndarray, lists: list[np.ndarray], medoid: int, cosine: float) -> np.ndarray:
    """Which of the vectors lie within ``cosine`` of which, as far as searches find them: each
    vector walks greedily from the medoid with a beam, then expands over all found in range."""
    n = len(x)
    width = max(1, *(len(y) for y in lists))
    table_ = np.full((n, width), -1, np.int64)
    for i, y in enumerate(lists):
        table_[i, : len(y)] = y
    f = x.astype(np.float32)
    seen, inside = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for low in range(0, n, 256):
        ask = np.arange(low, min(low + 256, n))
        q, beam = len(ask), min(BEAM, n)
        local = np.arange(q)
        ids, score, done = np.full((q, beam), -1), np.full((q, beam), -2.0, np.float32), np.ones((q, beam), bool)
        ids[:, 0], score[:, 0], done[:, 0] = medoid, f[ask] @ f[medoid], False
        seen[ask, medoid] = True
        while True:
            open_ = np.where(done, -3.0, score)
            at = np.argmax(open_, axis=1)
            live = local[open_[local, at] > -3.0]
            if not len(live):
                break
            done[live, at[live]] = True
            next_ = table_[ids[live, at[live]]]
            fresh = (next_ >= 0) & ~seen[ask[live][:, None], next_]
            seen[np.repeat(ask[live], fresh.sum(axis=1)), next_[fresh]] = True
            value = np.where(fresh, np.einsum("qkd,qd->qk", f[next_], f[ask[live]]), -2.0)
            hit = value >= cosine - 1e-3
            r, c = np.nonzero(hit & fresh)
            inside[ask[live[r]], next_[r, c]] = True
            all_ids, all_score = np.concatenate([ids[live], np.where(fresh, next_, -1)], 1), np.concatenate([score[live], value], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            ids[live], score[live], done[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_score, all_done))
        a, b = np.nonzero(inside[ask])
        a = ask[a]
        while len(a):  # range expansion, at most some four million neighbours at a time
            pairs, step = [], max(1, (1 << 22) // width)
            for i in range(0, len(a), step):
                next_ = table_[b[i : i + step]]
                keep = (next_ >= 0) & ~seen[a[i : i + step, None], next_]
                pair = np.unique(np.repeat(a[i : i + step], keep.sum(axis=1)) * n + next_[keep])
                seen[pair // n, pair % n] = True
                pairs.append(pair)
            pair = np.concatenate(pairs)
            a, b = pair // n, pair % n
            good = np.concatenate([np.einsum("pd,pd->p", f[a[i : i + 65536]], f[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= cosine - 1e-3
            a, b = a[good], b[good]
            inside[a, b] = True
    inside |= inside.T
    np.fill_diagonal(inside, False)
    return inside


def _unit(rows) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(rows):
    import pandas as pd

    lists, medoid = build(_unit(rows.vec), rows.id.to_numpy(np.int64))
    ids = rows.id.to_numpy()
    return pd.DataFrame({"id": ids, "near": [ids[y] for y in lists], "medoid": np.arange(len(ids)) == medoid})


def _links(cosine: float):
    def run(key, rows, graph):
        import pandas as pd

        _, _, i, j = key
        x, ids = _unit(rows.vec), rows.id.to_numpy(np.int64)
        place = {v: k for k, v in enumerate(ids)}
        graph = graph.set_index("id").loc[ids]
        lists = [np.array([place[v] for v in y if v in place], np.int64) for y in graph.near]
        inside = search(x, lists, int(np.flatnonzero(graph.medoid)[0]), cosine)
        a, b = np.nonzero(inside)
        for low in range(0, len(a), 1 << 15):  # in double precision, a few megabytes of pairs at a time
            p, q = a[low : low + (1 << 15)], b[low : low + (1 << 15)]
            bad = np.einsum("pd,pd->p", x[p], x[q]) < cosine
            inside[p[bad], q[bad]] = False
        # a pair that several shards or cells hold is counted by one of them
        homes = np.array(rows.homes.tolist())
        mine, first = int(key[1]), np.full((len(ids), len(ids)), True)
        for h in range(homes.shape[1]):
            lower = np.where(homes[:, h] < mine, homes[:, h], -1 - np.arange(len(ids)))
            for g in range(homes.shape[1]):
                first &= lower[:, None] != homes[None, :, g]
        block = rows.block.to_numpy()
        first &= (block[:, None] != block[None, :]) if i != j else True
        links = (inside & first) @ rows.copies.to_numpy()
        root = np.arange(len(ids))
        while True:
            least = np.where(inside, ids[root][None, :], np.iinfo(np.int64).max).min(axis=1)
            new = np.minimum(ids[root], least)
            at = np.array([place[v] for v in new])
            at = at[at]
            if (at == root).all():
                break
            root = at
        return pd.DataFrame({"id": ids, "links": links, "root": ids[root]})

    return run


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; begins with every (n/k)-th of them."""
    at = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i : i + 4096] @ at.T, axis=1) for i in range(0, len(sample), 4096)])
        for c in range(k):
            total = sample[own == c].sum(axis=0)
            size = np.linalg.norm(total)
            if size > 0:
                at[c] = total / size
    return at


def merged(centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of centroids: those within ``cosine`` of each other, directly or over others, are one
    shard, as noise alone divides a group that they lie in. Gives the centroids shard by shard, where each shard
    begins, and the shards' numbers."""
    near = centres @ centres.T >= cosine
    np.fill_diagonal(near, True)
    root = np.arange(len(centres), dtype=np.int32)
    while True:
        new = np.where(near, root[None, :], np.int32(len(root))).min(axis=1)
        if (new == root).all():
            break
        root = new
    order = np.argsort(root, kind="stable")
    numbers, starts = np.unique(root[order], return_index=True)
    return centres[order], starts, numbers.astype(np.int64)


def _assign(centres: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], overlap: int):
    def run(batches):
        for batch in batches:
            vecs, dims = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            homes = np.zeros((len(vecs), overlap), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if int(d) not in centres:
                    continue
                c, starts, numbers = centres[int(d)]
                x = _unit([vecs[i] for i in at])
                order = np.argsort(-np.maximum.reduceat(x @ c.T, starts, axis=1), axis=1, kind="stable")[:, :overlap]
                homes[at] = numbers[order[:, [min(i, order.shape[1] - 1) for i in range(overlap)]]]
            lists = pa.ListArray.from_arrays(np.arange(len(vecs) + 1, dtype=np.int32) * overlap, pa.array(homes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "copies", "vec", "dim", "homes"])

    return run


def _count_true(queries: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float, tile: int = 512):
    """Links of each query with other classes, by brute force."""

    def run(batches):
        for batch in batches:
            vecs, dims, copies = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(1).to_numpy()
            own, ids, found = batch.column(0).to_numpy(), [], []
            for d in np.unique(dims):
                if int(d) in queries:
                    at = np.flatnonzero(dims == d)
                    q_ids, q = queries[int(d)]
                    x = _unit([vecs[i] for i in at])
                    for low in range(0, len(q), tile):
                        ask = q_ids[low : low + tile]
                        near = (q[low : low + tile] @ x.T >= cosine) & (ask[:, None] != own[at][None, :])
                        ids.append(ask)
                        found.append(near @ copies[at])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found).astype(np.int64))], ["id", "n"])

    return run


def _audit(reps: DataFrame, sample, cosine: float, audited: int, most: int = 4096) -> dict[int, int]:
    """The links with other classes of at least ``audited`` classes that have any, as far as ``sample`` holds so many."""
    truth, low, step = {}, 0, audited
    while low < len(sample) and len(truth) < audited:
        queries = {int(dim): (rows.id.to_numpy(), _unit(rows.vec)) for dim, rows in sample.iloc[low : low + step].groupby("dim")}
        counts = reps.mapInArrow(_count_true(queries, cosine), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        truth |= {r[0]: r[1] for r in counts.where("n > 0").collect()}  # the audited classes only
        low, step = low + step, min(4 * step, most)
    return truth


def recall(truth: dict[int, int], got: dict[int, int]) -> float:
    """The mean over the audited classes of the share of their links that was found."""
    return sum(min(got.get(i, 0), n) / n for i, n in truth.items()) / len(truth) if truth else 1.0


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, overlap: int = 2,
    shard_rows: int = 500, most_shards: int = 4096, most_rows: int = 2048, sample_rows: int = 20_000, sample_bytes: int = 128 << 20, audited: int = 256, least_recall: float = 0.95, exact_rows: int = 200_000,
) -> DataFrame:
    """One row per row of ``vectors``: its id, n_links, component_id, kept.

    Equal vectors form one class first. Centroids, one per ``shard_rows`` classes and
    ``most_shards`` at most, are fitted on the ``sample_rows`` first classes by a hash, or as many as
    ``sample_bytes`` hold; every
    class goes to its ``overlap`` nearest shards. A shard over ``most_rows`` is cut into
    blocks, and each pair of blocks is a shard of its own, so that a large group of near
    copies is neither gathered in one task nor searched in part. Links are counted where they
    are found, and shards pass on one edge per vector, so pairs are never rows. Classes of the
    sample are compared with all others by brute force until ``audited`` of them have links
    with other classes. If the mean share of these links that is found is below
    ``least_recall``, all is done again: with one more shard per class up to six in tables of
    over ``exact_rows`` classes, and then, or at once in smaller ones, by products of all blocks
    of classes, which miss no link and cost the square of the table. The log tells how many
    links were audited, and warns where no class of the sample has any, so that the recall is
    not measured. Shards whose centroids lie within ``cosine`` are one.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers link with nothing, nor
    do vectors of different lengths. Repeated rows are copies of each other and link; rows of one
    id with different vectors are different vectors, each with its own links. Null ids
    stand for no class with other ids. Other columns are ignored; an empty table gives none.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    raw = raw.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0))))
    classes = raw.where("v IS NOT NULL AND id IS NOT NULL").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # a class has a number of its own, as written: ids may repeat with different vectors
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = stored(classes.select("v", "id", "copies").mapInArrow(_packed, "id long, copies long, vec binary, dim int"), "vectors")
    by_dim = {int(r[0]): int(r[1]) for r in reps.groupBy("dim").count().collect()}  # one row per vector length
    most_sample = max(1, min(sample_rows, sample_bytes // (8 * max(by_dim, default=1))))
    sample = reps.orderBy(F.xxhash64("vec"), "id").limit(most_sample).select("id", "vec", "dim").toPandas()
    centres = {}
    for dim, rows in sample.groupby("dim"):
        x = _unit(rows.vec)
        k = max(1, min(math.ceil(by_dim[int(dim)] / shard_rows), most_shards, len(x)))
        centres[int(dim)] = merged(centroids(x, k), cosine)
    truth = _audit(reps, sample, cosine, audited)
    if not truth:
        LOG.warning("recall is not measured: none of %d sampled classes has links with another one", len(sample))
    exact = False
    while True:
        if exact:
            found = _all_links(reps, cosine)
        else:
            shards = reps.mapInArrow(_assign(centres, overlap), "id long, copies long, vec binary, dim int, homes array<long>")
            found = _shard_links(shards, cosine, most_rows)
        counted = stored(found.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root")), "counted")
        edges = stored(found.where("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")), "edges")
        dropped(raw.sparkSession, found)
        got = {r[0]: r[1] for r in counted.where(F.col("id").isin(list(truth))).select("id", "links").collect()} if truth else {}
        found_share = recall(truth, got)
        LOG.info("recall %.4f over %d links of %d audited vectors, %s", found_share, sum(truth.values()), len(truth), "all blocks" if exact else f"{overlap} shards each")
        if found_share >= least_recall:
            break
        if exact:
            raise RuntimeError(f"recall {found_share:.4f} of the audited links is below {least_recall}")
        exact = overlap >= 6 or sum(by_dim.values()) <= exact_rows
        overlap += 1
    named = counted.select("id", "links").join(components(edges), "id", "left").join(classes, "id")
    named = named.select("v", "rep", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select("v", "n_links", "component_id")
    out = raw.join(named, "v", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _packed(batches):
    for batch in batches:
        lists = batch.column(0)
        flat, off = np.asarray(lists.flatten(), np.float64), np.asarray(lists.offsets, np.int64)
        off = off - off[0]
        packed = pa.array([flat[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), packed, pa.array(np.diff(off).astype(np.int32))], ["id", "copies", "vec", "dim"])


def _shard_links(shards: DataFrame, cosine: float, most_rows: int) -> DataFrame:
    rows = shards.withColumn("shard", F.explode(F.array_distinct("homes")))
    sizes = rows.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) * 2 / most_rows).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("blocks", F.when(F.col("n") <= most_rows, 1).otherwise(F.col("blocks"))).drop("n")
    rows = rows.join(stored(sizes, "sizes"), ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    rows = stored(rows.withColumn("cell", F.explode(cell)).select("id", "copies", "vec", "dim", "homes", "shard", "block", "cell.*"), "cells")
    key = ["dim", "shard", "i", "j"]
    lists = stored(rows.groupBy(*key).applyInPandas(lambda key, pdf: _lists(pdf).assign(dim=key[0], shard=key[1], i=key[2], j=key[3]), "id long, near array<long>, medoid boolean, dim int, shard long, i int, j int"), "lists")
    # the lists of other shards join a shard's own where both ends are in it; of a shard in
    # blocks only the lists inside a block go out, so that an edge goes to overlap - 1 cells at most
    places = rows.where("i = j").select("id", "shard", "block")
    edges = lists.where("i = j").select(F.col("id").alias("a"), F.col("shard").alias("origin"), "near").join(places.toDF("a", "shard", "x"), "a").where("shard <> origin")
    edges = edges.select("a", "shard", "x", F.explode("near").alias("b")).join(places.toDF("b", "shard", "y"), ["b", "shard"])
    more = edges.groupBy(F.col("a").alias("id"), "shard", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(F.collect_set("b").alias("more"))
    graph = lists.join(more, ["id", "shard", "i", "j"], "left")
    graph = graph.withColumn("near", F.when(F.col("more").isNull(), F.col("near")).otherwise(F.array_union("near", "more"))).drop("more")
    links = stored(rows.groupBy(*key).cogroup(graph.groupBy(*key)).applyInPandas(_links(cosine), "id long, links long, root long"), "shard-links")
    dropped(rows.sparkSession, rows)
    dropped(rows.sparkSession, lists)
    return links


def _products(cosine: float, tile: int = 256):
    def run(key, rows):
        import pandas as pd

        _, i, j = key
        rows = rows.sort_values("id")
        x, ids, copies, block = _unit(rows.vec), rows.id.to_numpy(np.int64), rows.copies.to_numpy(np.int64), rows.block.to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        y, links, label = x[right], np.zeros(len(ids), np.int64), np.arange(len(ids))
        for low in range(0, len(left), tile):
            at = left[low : low + tile]
            near = x[at] @ y.T >= cosine
            if i == j:
                near[np.arange(len(at)), low + np.arange(len(at))] = False
            some = near.any(axis=1)
            at, near = at[some], near[some]
            links[at] += near @ copies[right]
            if i != j:
                links[right] += copies[at] @ near
            for a, row in zip(at, near):
                to = label[right[row]]
                if (to != label[a]).any():
                    both = np.unique(np.append(to, label[a]))
                    label[np.isin(label, both)] = both[0]
        return pd.DataFrame({"id": ids, "links": links, "root": ids[label]})

    return run


def _all_links(reps: DataFrame, cosine: float, block_bytes: int = 1 << 23) -> DataFrame:
    """Links of all classes without shards: every pair of blocks of ``block_bytes`` of vectors is a task."""
    sizes = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / block_bytes).cast("int").alias("blocks"))
    rows = reps.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    rows = rows.withColumn("cell", F.explode(cell)).select("id", "copies", "vec", "dim", "block", "cell.*")
    return stored(rows.groupBy("dim", "i", "j").applyInPandas(_products(cosine), "id long, links long, root long"), "all-links")


def op3_embedding_near_dedup(spark, sf_dir):
    """Links at cosine 0.95 or more among all rows of ``embeddings``, whatever their labels. Null, empty, zero and non-finite
    vectors have none and stand alone; repeated vectors link with each other; an empty table gives no rows."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON r.b = u.a)
SELECT e.vec_id, (SELECT count(*) FROM u WHERE u.a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = e.vec_id), e.vec_id)) AS kept
FROM e
"""
