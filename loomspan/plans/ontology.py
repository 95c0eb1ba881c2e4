"""Graph and term queries (J, D36-D40, I10) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import ontology as O
from loomspan.plans.reads import rounded
from loomspan.plans.views import query

CLOSE = """
WITH RECURSIVE n AS (SELECT child AS x FROM edges UNION SELECT parent FROM edges), r(term, ancestor, distance) AS (SELECT x, x, 0 FROM n UNION SELECT r.term, e.parent, r.distance + 1 FROM r JOIN edges e ON r.ancestor = e.child),
a AS (SELECT term, ancestor, min(distance) AS distance FROM r GROUP BY ALL)"""
#: every path to the root, and the longest of each term: up is the path from the term
LONGEST = """
WITH RECURSIVE n AS (SELECT child AS x FROM edges UNION SELECT parent FROM edges), r(term, top, up) AS (SELECT x, x, [x] FROM n UNION SELECT r.term, e.parent, list_append(r.up, e.parent) FROM r JOIN edges e ON r.top = e.child),
l AS (SELECT term, up FROM r WHERE top = 'ROOT' QUALIFY row_number() OVER (PARTITION BY term ORDER BY len(up) DESC, up) = 1),
p AS (SELECT term, list_reverse(up) AS path FROM l)"""


@query("ancestors", CLOSE + " SELECT * FROM a")
def ancestors(v):
    return O.ancestors(v.edges)


@query("lineage", LONGEST + " SELECT term, array_to_string(path, ';') AS path FROM p")
def lineage(v):
    return O.lineage(v.edges, "ROOT")


#: a term with slim parents stops all its branches there; a slim term is its own
SLIM = """WITH RECURSIVE s AS (SELECT DISTINCT parent AS x FROM edges WHERE parent LIKE 'R%' OR parent LIKE 'M%'), n AS (SELECT child AS x FROM edges UNION SELECT parent FROM edges),
stop AS (SELECT x FROM s UNION SELECT child FROM edges WHERE parent IN (SELECT x FROM s)),
r(term, node) AS (SELECT x, x FROM n UNION SELECT r.term, e.parent FROM r JOIN edges e ON r.node = e.child WHERE r.node NOT IN (SELECT x FROM stop))
SELECT DISTINCT term, node AS slim FROM r WHERE term = node AND node IN (SELECT x FROM s)
UNION SELECT DISTINCT r.term, e.parent FROM r JOIN edges e ON r.node = e.child WHERE r.node NOT IN (SELECT x FROM s) AND e.parent IN (SELECT x FROM s)"""


@query("map_to_slim", SLIM)
def map_to_slim(v):
    return O.map_to_slim(v.edges, v.edges.where("parent LIKE 'R%' OR parent LIKE 'M%'").select(F.col("parent").alias("term")).distinct())


@query("slim_counts", SLIM.replace("SELECT DISTINCT term, node AS slim FROM r", ", m AS (SELECT DISTINCT term, node AS slim FROM r", 1) + ") SELECT slim, count(DISTINCT gene) AS genes FROM assoc JOIN m ON assoc.term = m.term GROUP BY slim")
def slim_counts(v):
    slim = v.edges.where("parent LIKE 'R%' OR parent LIKE 'M%'").select(F.col("parent").alias("term")).distinct()
    found = v.assoc.select("gene", "term").join(O.map_to_slim(v.edges, slim), "term")
    return found.groupBy("slim").agg(F.countDistinct("gene").alias("genes"))


@query("go_summary", "SELECT term, count(DISTINCT gene) AS genes, round(100.0 * count(DISTINCT gene) / (SELECT count(DISTINCT gene) FROM assoc), 6) AS percent FROM assoc GROUP BY term")
def go_summary(v):
    return rounded(O.go_summary(v.assoc), "percent")


@query("taxon_counts", LONGEST + " SELECT coalesce(path[2], 'unknown') AS taxon, count(*) AS n FROM assoc LEFT JOIN p ON assoc.term = p.term GROUP BY 1")
def taxon_counts(v):
    return O.taxon_counts(v.assoc.select("term"), O.lineage(v.edges, "ROOT"), 1)


#: what the terms of the graph stand for as taxa
RANKS = "SELECT x AS term, CASE substr(x, 1, 1) WHEN 'N' THEN 'genus' WHEN 'M' THEN 'phylum' WHEN 'C' THEN 'species' END AS rank FROM n WHERE x NOT LIKE 'RO%' AND x NOT LIKE 'R%'"


def _ranks(v):
    first = F.substring("term", 1, 1)
    n = v.edges.select(F.col("child").alias("term")).union(v.edges.select("parent")).distinct().where("term NOT LIKE 'R%'")
    return n.withColumn("rank", F.when(first == "N", "genus").when(first == "M", "phylum").when(first == "C", "species"))


@query("ranked", LONGEST + f""", k AS ({RANKS}), x AS (SELECT term, unnest(path) AS node, unnest(range(len(path))) AS i FROM p),
y AS (SELECT x.term, arg_max(node, i) FILTER (rank = 'genus') AS genus, arg_max(node, i) FILTER (rank = 'species') AS species FROM x JOIN k ON x.node = k.term GROUP BY x.term)
SELECT p.term, array_to_string(path, ';') AS path, genus, species FROM p LEFT JOIN y ON p.term = y.term""")
def ranked(v):
    return O.ranked(O.longest_paths(v.edges, "ROOT"), _ranks(v), ("genus", "species")).withColumn("path", F.array_join("path", ";"))


@query("taxonomy_summary", LONGEST + f""", k AS ({RANKS}), ids AS (SELECT term FROM assoc UNION ALL SELECT evidence FROM assoc UNION ALL SELECT parent FROM edges),
g AS (SELECT term, arg_max(node, i) FILTER (node LIKE 'N%') AS genus, arg_max(node, i) FILTER (node LIKE 'M%') AS phylum FROM (SELECT term, unnest(path) AS node, unnest(range(len(path))) AS i FROM p) x GROUP BY term),
j AS (SELECT ids.term, genus, phylum, g.term IS NOT NULL AS found, rank FROM ids LEFT JOIN g ON ids.term = g.term LEFT JOIN k ON ids.term = k.term)
SELECT CASE WHEN found THEN 'rank' ELSE 'missing' END AS kind, CASE WHEN found THEN coalesce(rank, 'no rank') END AS taxon, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS phylum FROM j GROUP BY ALL
UNION ALL SELECT 'genus', genus, count(*), min(coalesce(phylum, 'Unranked')) FROM j WHERE genus IS NOT NULL GROUP BY genus
UNION ALL SELECT 'phylum', phylum, count(*), NULL FROM j WHERE phylum IS NOT NULL GROUP BY phylum""")
def taxonomy_summary(v):
    ids = v.assoc.select("term").unionAll(v.assoc.select("evidence")).unionAll(v.edges.select("parent"))
    return O.taxonomy_summary(ids, v.edges, "ROOT", _ranks(v))


@query("author_counts", LONGEST + """, g AS (SELECT term, list_filter(path, lambda x: x LIKE 'N%')[-1] AS genus FROM p) SELECT gene AS authors, count(*) AS n FROM assoc JOIN g ON assoc.term = g.term WHERE genus = 'N7' GROUP BY gene""")
def author_counts(v):
    return O.author_counts(v.assoc.select("term", F.col("gene").alias("authors")), v.edges, "ROOT", _ranks(v), "N7")


@query("product_names", """WITH h AS (SELECT l_orderkey AS protein, regexp_replace(p_name || ' domain', '(?i)[ -]+(domain|family)( protein)?$', '') AS name, l_linenumber AS a, l_linenumber + CAST(l_quantity AS BIGINT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT protein, trim(name) AS name, CAST(sum(b - a + 1) AS BIGINT) AS len FROM h GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY protein ORDER BY len DESC, name) AS r, count(*) OVER (PARTITION BY protein) AS n FROM n) SELECT protein, name, len FROM r WHERE r = least(2, n)""")
def product_names(v):
    p = v.table("part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(" domain")).alias("name"))
    h = v.table("lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("protein"), "name", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).alias("stop"))
    return O.product_names(h)


@query("go_associations", "SELECT DISTINCT a.gene, t.term, CASE WHEN t.term LIKE 'C%' THEN 'P' ELSE 'F' END AS aspect FROM assoc a, unnest([a.term, a.evidence]) t(term)")
def go_associations(v):
    rows = v.assoc.select("gene", F.concat_ws("|", "term", "evidence").alias("terms"))
    aspects = v.assoc.select("term").distinct().union(v.assoc.select("evidence").distinct()).select("term", F.when(F.col("term").like("C%"), "P").otherwise("F").alias("aspect"))
    return O.go_associations(rows, aspects)


GO_PATHS = LONGEST + """, gp AS (SELECT DISTINCT gene, assoc.term, array_to_string(path[2:4], '; ') AS path FROM (SELECT gene, term FROM assoc WHERE gene NOT LIKE '%3' UNION ALL SELECT gene, evidence FROM assoc) assoc JOIN p ON assoc.term = p.term),
gq AS (SELECT * FROM gp UNION ALL SELECT DISTINCT gene, NULL, 'Unknown' FROM assoc WHERE gene NOT IN (SELECT gene FROM gp))"""


def _gene_terms(v):
    return v.assoc.where("gene NOT LIKE '%3'").select("gene", "term").unionAll(v.assoc.select("gene", F.col("evidence").alias("term")))


@query("go_paths", GO_PATHS + " SELECT gene, term, path FROM gq")
def go_paths(v):
    return O.go_paths(_gene_terms(v), v.edges, "ROOT", 3)


@query("go_path_counts", GO_PATHS + " SELECT path, count(DISTINCT gene) AS genes FROM gq GROUP BY path")
def go_path_counts(v):
    return O.go_path_counts(O.go_paths(_gene_terms(v), v.edges, "ROOT", 3))


@query("enrichment_counts", CLOSE + """, f AS (SELECT DISTINCT gene, ancestor AS term FROM assoc JOIN a ON assoc.term = a.term) SELECT term, count(*) AS in_universe, count(*) FILTER (gene LIKE '%7') AS in_list, (SELECT count(DISTINCT gene) FROM f) AS universe, (SELECT count(DISTINCT gene) FROM f WHERE gene LIKE '%7') AS listed FROM f GROUP BY term""")
def enrichment_counts(v):
    return O.enrichment_counts(v.assoc.where("gene LIKE '%7'").select("gene"), v.assoc, v.edges)


LF = "lgamma(({})::DOUBLE + 1)".format


@query("go_enrichment", CLOSE + f""", f AS (SELECT DISTINCT gene, ancestor AS term FROM assoc JOIN a ON assoc.term = a.term), c AS (SELECT term, count(*) AS in_universe, count(*) FILTER (gene LIKE '%7') AS in_list, (SELECT count(DISTINCT gene) FROM f) AS universe, (SELECT count(DISTINCT gene) FROM f WHERE gene LIKE '%7') AS listed FROM f GROUP BY term HAVING count(*) FILTER (gene LIKE '%7') > 0),
x AS (SELECT *, unnest(range(in_list, least(in_universe, listed) + 1)) AS i FROM c), e AS (SELECT term, in_list, in_universe, listed, universe, least(1.0::DOUBLE, sum(exp({LF("in_universe")} - {LF("i")} - {LF("in_universe - i")} + {LF("universe - in_universe")} - {LF("listed - i")} - {LF("universe - in_universe - listed + i")} - ({LF("universe")} - {LF("listed")} - {LF("universe - listed")})))) AS p FROM x GROUP BY ALL),
ranked AS (SELECT *, round(p, 12) * count(*) OVER () / rank() OVER (ORDER BY round(p, 12)) AS q0 FROM e) SELECT term, in_list, in_universe, listed, universe, round(p, 8) AS p, round(least(1.0, min(q0) OVER (ORDER BY round(p, 12) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM ranked""")
def go_enrichment(v):
    return rounded(O.go_enrichment(v.assoc.where("gene LIKE '%7'").select("gene"), v.assoc, v.edges, p_max=1.0), "p", "q", digits=8)


#: regions and nations are one aspect, segments another; customers have both, so a term of theirs counts in neither
ASPECTS = "SELECT x AS term, CASE WHEN x LIKE 'M%' THEN 'F' ELSE 'P' END AS aspect FROM n WHERE x NOT LIKE 'C%' UNION ALL SELECT x, 'P' FROM n WHERE x LIKE 'C%' AND x LIKE '%1' UNION ALL SELECT x, 'F' FROM n WHERE x LIKE 'C%' AND x NOT LIKE '%1'"


@query("go_enrichment_by_aspect", CLOSE + f""", s AS ({ASPECTS}), f AS (SELECT DISTINCT gene, a.ancestor AS term, s1.aspect FROM assoc JOIN a ON assoc.term = a.term JOIN s s1 ON s1.term = a.term JOIN s s2 ON s2.term = a.ancestor AND s1.aspect = s2.aspect),
t AS (SELECT aspect, count(DISTINCT gene) AS universe, count(DISTINCT gene) FILTER (gene LIKE '%7') AS listed FROM f GROUP BY aspect),
c AS (SELECT term, f.aspect, count(*) AS in_universe, count(*) FILTER (gene LIKE '%7') AS in_list, any_value(universe) AS universe, any_value(listed) AS listed FROM f JOIN t ON f.aspect = t.aspect GROUP BY term, f.aspect HAVING count(*) FILTER (gene LIKE '%7') > 0),
x AS (SELECT *, unnest(range(in_list, least(in_universe, listed) + 1)) AS i FROM c), e AS (SELECT term, aspect, in_list, in_universe, listed, universe, least(1.0::DOUBLE, sum(exp({LF("in_universe")} - {LF("i")} - {LF("in_universe - i")} + {LF("universe - in_universe")} - {LF("listed - i")} - {LF("universe - in_universe - listed + i")} - ({LF("universe")} - {LF("listed")} - {LF("universe - listed")})))) AS p FROM x GROUP BY ALL),
ranked AS (SELECT *, round(p, 12) * count(*) OVER (PARTITION BY aspect) / rank() OVER (PARTITION BY aspect ORDER BY round(p, 12)) AS q0 FROM e) SELECT term, aspect, in_list, in_universe, listed, universe, round(p, 8) AS p, round(least(1.0, min(q0) OVER (PARTITION BY aspect ORDER BY round(p, 12) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM ranked""")
def go_enrichment_by_aspect(v):
    n = v.edges.select(F.col("child").alias("term")).union(v.edges.select("parent")).distinct()
    aspect = F.when(F.col("term").like("M%"), "F").when(F.col("term").like("C%") & ~F.col("term").like("%1"), "F").otherwise("P")
    return rounded(O.go_enrichment(v.assoc.where("gene LIKE '%7'").select("gene"), v.assoc, v.edges, p_max=1.0, aspects=n.withColumn("aspect", aspect)), "p", "q", digits=8)
