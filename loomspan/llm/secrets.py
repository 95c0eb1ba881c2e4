"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. Only pairs
of a blob and a rule version that the ledger lacks are scanned, each blob once
however many paths hold it; findings are joined back to all paths. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm._base import stored, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: the group that must have ``least`` characters, and how many
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # runs are maximal either way
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

FOUND = "array<struct<start:int,rank:int,kind:string,stop:int>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _matches(rule: Rule, rank: int, text: str, hits: str) -> Column:
    """Spans of a rule's matches in column ``text``, whose matched strings are in ``hits``.

    Between two matches lies one part of the split text, so that running lengths of
    parts and matches give code point positions."""
    parts = F.split(F.col(text), F.lit(rule.pattern), -1)
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), F.col(hits), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.array_append(acc["out"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop"))).alias("out"),
    )
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if rule.least > 1:
        sizes = F.transform(F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group)), F.length)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), sizes.alias("n")), lambda x: x["n"] >= rule.least), lambda x: x["s"])
    named = F.transform(spans, lambda x: F.struct(x["start"], F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["stop"]))
    return F.when(F.size(hits) > 0, named).otherwise(F.array().cast(FOUND))


def scan(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(index, ledger): the rows (path, blob) of ``versions``, and the ledger with what was
    scanned now: rows (blob, rules, found), one per blob and scan.

    ``versions`` holds a row per path and historical version; a null text counts as
    empty, a null path is a path like others, repeated rows share their blob, an empty
    table leaves the ledger as it is. Other columns are ignored. Spans of one kind don't
    overlap and are the leftmost ones; ends are exclusive code point positions.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path_col).alias("path"), text_or_empty(text_col).alias("text"))
    index = stored(rows.select("path", blob_of(F.col("text")).alias("blob")), "blobs")
    old = ledger if ledger is not None else spark.createDataFrame([], LEDGER)
    wanted = F.array(*(F.lit(r.key) for r in rules))
    seen = old.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # rule versions only
    todo = index.groupBy("blob").agg(F.min("path").alias("at")).join(seen, "blob", "left")
    todo = todo.select("blob", "at", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)
    # a path may have other versions; only the one with the blob's content is scanned
    work = rows.join(todo.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("at"))).where(blob_of(F.col("text")) == F.col("blob"))
    hits = {r: f"hits_{i}" for i, r in enumerate(rules)}
    none = F.array().cast("array<string>")
    work = work.select(
        "blob", "rules", "text",
        *(F.when(F.array_contains("rules", r.key), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(h) for r, h in hits.items()),
    )
    found = F.array_sort(F.concat(*(_matches(r, i, "text", h) for i, (r, h) in enumerate(hits.items()))))
    fresh = stored(work.select("blob", "rules", found.alias("found")).dropDuplicates(["blob"]), "ledger")
    return index, fresh if ledger is None else ledger.union(fresh)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (blob, found) for blobs in which the ledger's scans by the current rule versions found something."""
    current = F.array(*(F.lit(r.key) for r in rules))
    kinds = F.transform(F.filter("rules", lambda r: F.array_contains(current, r)), lambda r: F.split(r, "@")[0])
    rows = ledger.select("blob", F.filter("found", lambda x: F.array_contains(kinds, x["kind"])).alias("found")).where(F.size("found") > 0)
    return rows.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))  # one list per scan of one blob


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_report(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``versions``: its id, a count for each base kind, the digest of
    the base spans and all spans, each ``kind:start:end``, by start, then in the rules' order."""
    index, ledger = scan(versions, id_col, text_col, ledger, rules)
    none = F.array().cast(FOUND)
    out = index.join(findings(ledger, rules), "blob", "left").select(F.col("path").alias(id_col), F.coalesce("found", none).alias("found"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    of_kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select(id_col, *counts, F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every span, overlapping ones as one, replaced by ``[REDACTED_kind]``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("[REDACTED_"), x["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``, secrets in ``text_col`` redacted and, where a text
    changed, its length put right. Texts without secrets, nulls among them, stay as they are."""
    _, ledger = scan(docs, id_col, text_col, None, rules)
    spans = findings(ledger, rules).select(F.col("blob").alias("__blob"), F.col("found").alias("__found"))
    out = docs.withColumn("__blob", blob_of(text_or_empty(text_col))).join(spans, "__blob", "left")
    out = out.withColumn(text_col, F.when(F.col("__found").isNotNull(), redacted(F.col(text_col), F.col("__found"))).otherwise(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("__found").isNotNull(), F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(docs.columns)


def op6_secret_scans(spark, sf_dir):
    """A row per row of ``documents``, with a ledger that begins empty: every distinct text is scanned once, whole. Null and
    empty texts have no spans; repeated rows and equal texts get equal findings."""
    return secret_report(table(spark, sf_dir, "documents"))


_CASED = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")


def _oracle() -> str:
    parts, names = [], []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", _CASED).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS sizes, "
            f"list_transform(regexp_extract_all(t, '{pattern}', {r.group}), lambda x: length(x)) AS checked, {r.least} AS least FROM d"
        )
        names.append(r.kind)
    rows = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({rows}),
s AS (
  SELECT doc_id, rank, kind, unnest(range(1, len(sizes) + 1)) AS i, gaps, sizes, checked, least FROM m WHERE len(sizes) > 0
), p AS (
  SELECT doc_id, rank, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS BIGINT) AS b, sizes[i] AS size FROM s WHERE checked[i] >= least
), g AS (
  SELECT doc_id, {counts},
    coalesce(string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, rank) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || b || ':' || (b + size), ',' ORDER BY b, rank) AS spans FROM p GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = _oracle()
