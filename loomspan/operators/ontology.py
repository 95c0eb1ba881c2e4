"""Graphs of terms and taxa, term summaries and enrichment."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspan.operators.intervals import earlier
from loomspan.sources.scratch import kept


def ancestors(edges: DataFrame, most: int = 1000) -> DataFrame:
    """All (term, ancestor, distance) of a graph (child, parent), the shortest distance; a term is its own at 0.
    Each step joins the newest pairs alone; cycles end, as known pairs are dropped. A graph of over ``most`` steps is an error."""
    steps = kept(edges.select("child", "parent").distinct(), "edges")  # read in every step
    nodes = steps.select("child").union(steps.select("parent")).distinct()
    known = nodes.select(F.col("child").alias("term"), F.col("child").alias("ancestor"), F.lit(0).alias("distance"))
    newest = known
    for step in range(1, most + 1):
        next_ = newest.join(steps, newest.ancestor == steps.child).select("term", F.col("parent").alias("ancestor")).distinct()
        fresh = next_.join(known, ["term", "ancestor"], "left_anti").withColumn("distance", F.lit(step))
        newest = kept(fresh, "ancestors")
        if newest.isEmpty():
            return known
        known = known.union(newest)
    raise RuntimeError(f"the graph has paths of over {most} steps")


def lineage(edges: DataFrame, root: str, most: int = 1000) -> DataFrame:
    """The longest path from the root to each term of an acyclic graph (child, parent), joined by ';' (term, path).
    Of equally long ones that with the smaller parent, then grandparent, and so on; terms that don't lead to the root
    are left out, dead ends beside a way to it do no harm. A cycle below the root is an error."""
    longest = longest_paths(edges, root, most)
    return longest.select("term", F.array_join("path", ";").alias("path"))


def longest_paths(edges: DataFrame, root: str, most: int = 1000) -> DataFrame:
    """``lineage`` with the path as an array. Round k has the terms that a path of k steps leads to, each with one such
    path; the last round that has a term has its longest path, as its parent's is one shorter."""
    steps = kept(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "edges")
    newest = steps.where(F.col("parent") == root).select(F.col("parent").alias("term")).distinct().withColumn("up", F.array("term"))
    rounds = []
    for step in range(most + 1):
        newest = kept(newest, "paths")
        if newest.isEmpty():
            break
        rounds.append(newest.withColumn("step", F.lit(step)))
        looped = F.raise_error(F.concat(F.lit("a cycle below the root leads to "), F.col("child").cast("string"))).cast("boolean")
        next_ = newest.join(steps, newest.term == steps.parent).where(F.when(F.array_contains("up", F.col("child")), looped).otherwise(True))
        newest = next_.groupBy(F.col("child").alias("term")).agg(F.min(F.concat(F.array("child"), F.col("up"))).alias("up"))
    else:
        raise RuntimeError(f"the graph has paths of over {most} steps")
    if not rounds:
        return newest.select("term", F.col("up").alias("path"))
    both = reduce(DataFrame.unionByName, rounds)
    return both.groupBy("term").agg(F.reverse(F.max_by("up", "step")).alias("path"))


def ranked(paths: DataFrame, ranks: DataFrame, wanted: tuple[str, ...] = ("kingdom", "phylum", "genus")) -> DataFrame:
    """Paths (term, path as an array) with a column per rank: the term of that rank (ranks: term, rank) nearest to the
    end of the path, null where there is none."""
    at = paths.select("term", F.posexplode("path").alias("place", "node")).join(ranks.select(F.col("term").alias("node"), "rank").where(F.col("rank").isin(*wanted)), "node")
    found = at.groupBy("term").agg(*(F.max_by("node", F.when(F.col("rank") == w, F.col("place"))).alias(w) for w in wanted))
    return paths.join(found, "term", "left")


def map_to_slim(edges: DataFrame, slim: DataFrame) -> DataFrame:
    """Each term's nearest slim terms (slim: term) by is_a only, where edges have a column rel: itself if it is one;
    else those of its parents that are; only if none is, what all its parents map to."""
    e = kept((edges.where("rel = 'is_a'") if "rel" in edges.columns else edges).select("child", "parent").distinct(), "is-a")
    s = kept(slim.select(F.col("term").alias("parent")).distinct(), "slim")
    direct = e.join(s, "parent", "left_semi").select(F.col("child").alias("node"), F.col("parent").alias("slim"))
    own = e.select("child").union(e.select("parent")).distinct().join(s, F.col("child") == s.parent, "left_semi").select(F.col("child").alias("node"))
    # a term with a slim parent, or that is one, stops all its branches
    stops = direct.select("node").union(own).distinct()
    open_ = e.join(stops, e.child == stops.node, "left_anti").select("child", "parent")
    reach = ancestors(open_).where("term <> ancestor").select("term", F.col("ancestor").alias("node"))
    # what stops at a parent comes from it, and so does what began there
    reach = reach.union(stops.select(F.col("node").alias("term"), "node"))
    ends = direct.join(own, "node", "left_anti")
    return reach.join(ends, "node").select("term", "slim").union(own.select(F.col("node").alias("term"), F.col("node").alias("slim"))).distinct()


def go_summary(assoc: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct genes per term, and percent of all genes."""
    total = assoc.agg(F.countDistinct("gene").alias("all_genes"))
    n = assoc.groupBy("term").agg(F.countDistinct("gene").alias("genes")).join(F.broadcast(total), how="cross")
    n = n.select("term", "genes", (100.0 * F.col("genes") / F.col("all_genes")).alias("percent"))
    return n.join(names, "term", "left") if names is not None else n


def taxon_counts(ids: DataFrame, paths: DataFrame, level: int) -> DataFrame:
    """Ids per taxon at a level of the lineage (0 is the root); ids without one count as unknown."""
    p = ids.join(paths, "term", "left").withColumn("taxon", F.coalesce(F.get(F.split("path", ";"), F.lit(level)), F.lit("unknown")))
    return p.groupBy("taxon").agg(F.count(F.lit(1)).alias("n"))


def taxonomy_summary(ids: DataFrame, edges: DataFrame, root: str, ranks: DataFrame) -> DataFrame:
    """Counts of a list of taxa (ids: term, as often as it comes; ranks: term, rank): rows (kind, taxon, n, phylum) of kind
    rank (how many of each rank), genus (with its phylum, Unranked without one), phylum, and missing (not in the tree)."""
    known = ranked(longest_paths(edges, root), ranks, ("phylum", "genus")).select("term", "phylum", "genus", F.lit(True).alias("found"))
    rows = ids.select("term").groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(known, "term", "left").join(ranks.select("term", "rank"), "term", "left")
    found, none = F.coalesce("found", F.lit(False)), F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.when(found, "rank").otherwise("missing").alias("kind"), F.when(found, F.coalesce("rank", F.lit("no rank"))).alias("taxon"), none.alias("phylum")),
        F.when(found & F.col("genus").isNotNull(), F.struct(F.lit("genus").alias("kind"), F.col("genus").alias("taxon"), F.coalesce("phylum", F.lit("Unranked")).alias("phylum"))),
        F.when(found & F.col("phylum").isNotNull(), F.struct(F.lit("phylum").alias("kind"), F.col("phylum").alias("taxon"), none.alias("phylum"))),
    )
    out = rows.select("n", F.explode(kinds).alias("k")).where("k IS NOT NULL")
    return out.groupBy("k.kind", "k.taxon").agg(F.sum("n").alias("n"), F.min("k.phylum").alias("phylum"))


def author_counts(records: DataFrame, edges: DataFrame, root: str, ranks: DataFrame, genus: str) -> DataFrame:
    """How many records (term, authors) of the taxa of one genus each author list has."""
    mine = ranked(longest_paths(edges, root), ranks, ("genus",)).where(F.col("genus") == genus).select("term")
    return records.join(mine, "term", "left_semi").groupBy("authors").agg(F.count(F.lit(1)).alias("n"))


def product_names(hits: DataFrame, rank: int = 2) -> DataFrame:
    """A product name per protein from domain hits (protein, name, start, stop): names by summed length, ties by
    name; the ``rank``-th where there are so many, else the last. Trailing "domain", "family" and signs go."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"[,;]\s*$", ""), r"(?i)[ -]+(domain|family)( protein)?$", ""))
    n = hits.groupBy("protein", clean.alias("name")).agg(F.sum(F.col("stop") - F.col("start") + 1).alias("len"))
    w = W.partitionBy("protein").orderBy(F.desc("len"), "name")
    r = n.withColumns({"r": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy("protein"))})
    return r.where(F.col("r") == F.least(F.lit(rank), F.col("n"))).select("protein", "name", "len")


def go_associations(rows: DataFrame, aspects: DataFrame) -> DataFrame:
    """Distinct (gene, term) rows of '|' lists with each term's aspect (gene, terms; term, aspect)."""
    t = rows.select("gene", F.explode(F.split("terms", r"\|")).alias("term")).where("term <> ''").distinct()
    return t.join(aspects, "term", "left")


def go_paths(genes: DataFrame, edges: DataFrame, root: str, levels: int = 5) -> DataFrame:
    """A row per gene and distinct term (genes: gene, term) with the first ``levels`` steps below the root on the term's
    longest path, joined by '; '; terms that don't lead to the root have none, and a gene without others is Unknown."""
    p = longest_paths(edges, root).select("term", F.array_join(F.slice("path", 2, levels), "; ").alias("path"))
    known = genes.select("gene", "term").distinct().join(p, "term").select("gene", "term", "path")
    rest = genes.select("gene").distinct().join(known.select("gene"), "gene", "left_anti")
    return known.union(rest.select("gene", F.lit(None).cast("string"), F.lit("Unknown")))


def go_path_counts(paths: DataFrame) -> DataFrame:
    """How many genes have each path of ``go_paths``."""
    return paths.groupBy("path").agg(F.countDistinct("gene").alias("genes"))


def _hypergeometric(over: bool):
    def run(k: pd.Series, m: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for a, b, c, t in zip(k, m, n, total):
            low, high = max(0, b + c - t), min(b, c)
            i = np.arange(a, high + 1) if over else np.arange(low, a + 1)
            f = np.vectorize(math.lgamma, otypes=[float])
            logs = f(b + 1) - f(i + 1) - f(b - i + 1) + f(t - b + 1) - f(c - i + 1) - f(t - b - c + i + 1) - (f(t + 1) - f(c + 1) - f(t - c + 1))
            out.append(min(1.0, float(np.exp(logs).sum())))
        return pd.Series(out)

    return F.pandas_udf(run, "double")


def enrichment_counts(genes: DataFrame, assoc: DataFrame, edges: DataFrame, aspects: DataFrame | None = None) -> DataFrame:
    """Per term, with terms inherited upwards: genes of the list and of the universe (all associated genes) that have
    it, and the sizes of both. With ``aspects`` (term, aspect) each aspect is a test of its own: terms are inherited
    inside it, and the sizes are of the genes that have a term of it."""
    by = ["aspect"] if aspects is not None else []
    up = ancestors(edges).select("term", "ancestor")
    if by:
        up = up.join(aspects.select("term", "aspect"), "term").join(aspects.select(F.col("term").alias("ancestor"), F.col("aspect").alias("a")), "ancestor").where("aspect = a")
    full = assoc.join(up, "term").select("gene", F.col("ancestor").alias("term"), *by).distinct()
    marked = full.join(genes.select("gene", F.lit(1).alias("__in")).distinct(), "gene", "left")
    size = marked.groupBy(*by).agg(F.countDistinct("gene").alias("universe"), F.countDistinct(F.when(F.col("__in") == 1, F.col("gene"))).alias("listed"))
    n = marked.groupBy("term", *by).agg(F.count(F.lit(1)).alias("in_universe"), F.sum(F.coalesce("__in", F.lit(0))).alias("in_list"))
    return n.join(F.broadcast(size), by) if by else n.join(F.broadcast(size), how="cross")  # a row, or one per aspect


def go_enrichment(genes: DataFrame, assoc: DataFrame, edges: DataFrame, side: str = "over", p_max: float = 0.05, aspects: DataFrame | None = None) -> DataFrame:
    """``enrichment_counts`` with hypergeometric p and Benjamini-Hochberg q (per aspect, if these are given); rows with
    p of ``p_max`` at most."""
    by = ["aspect"] if aspects is not None else []
    c = enrichment_counts(genes, assoc, edges, aspects).where("in_list > 0" if side == "over" else "in_universe > 0")
    c = c.withColumn("p", _hypergeometric(side == "over")("in_list", "in_universe", "listed", "universe"))
    c = kept(c, "enrichment")  # read several times below
    v = c.groupBy("p", *by).agg(F.count(F.lit(1)).alias("n"))
    tile = F.floor(F.log10(F.greatest("p", F.lit(1e-300))) * 64)
    v = earlier(v, by, ["p"], F.col("n"), "sum", tile).withColumn("r", F.col("__before") + 1).drop("__before")
    tests = F.broadcast(c.groupBy(*by).agg(F.count(F.lit(1)).alias("m")))  # a row, or one per aspect
    v = (v.join(tests, by) if by else v.join(tests, how="cross")).withColumn("q0", F.col("p") * F.col("m") / F.col("r"))
    v = earlier(v, by, [F.desc("p")], -F.col("q0"), "max", -tile, inclusive=True)
    out = c.join(v.select("p", *by, F.least(F.lit(1.0), -F.col("__before")).alias("q")), ["p", *by]).where(F.col("p") <= p_max)
    return out.select("term", *by, "in_list", "in_universe", "listed", "universe", "p", "q")
