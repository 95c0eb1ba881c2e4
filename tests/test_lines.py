"""Lines of files that are cut into splits: numbers and what is filled down, without a shuffle of lines."""

from loomspan.sources import readers


def test_lines_of_many_splits(spark, tmp_path):
    want = []
    for name in "ab":
        rows, names = [], None
        for i in range(4000):
            if i % 701 == 5:
                names = ["qid", "sid"] if i % 2 else ["sid", "qid"]
                rows.append("# Fields: " + "\t".join(names))
            rows.append(f"{name}{i}\tx{i}")
            want.append((name, len(rows), dict(zip(names, rows[-1].split("\t"))) if names else None))
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    conf = {"spark.sql.files.maxPartitionBytes": "9000", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "97"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    try:
        df = readers.read_named_fields(spark, str(tmp_path))
        got = [(r["file"][-1], r["line_no"], r["fields"]) for r in df.collect()]
        hits = readers.read_blast_tab(spark, str(tmp_path)).select("file", "line_no", "qlen").collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert sorted(got, key=lambda r: r[:2]) == want and df.rdd.getNumPartitions() > 2
    assert sorted((r["file"][-1], r["line_no"]) for r in hits) == [r[:2] for r in want] and not any(r["qlen"] for r in hits)
    # the window is over a row per split, which is broadcast: lines are not sorted by it
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_lengths_are_filled_down_over_splits(spark, tmp_path):
    hit = "q\th\t99.0\t10\t0\t0\t1\t10\t5\t14\t1e-5\t50"
    rows = [f"# Query: q{i} ({i} aa)" if i % 90 == 0 and i else hit for i in range(2000)]
    (tmp_path / "a.m8").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = readers.read_blast_tab(spark, str(tmp_path)).select("line_no", "qlen").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(i + 1, i // 90 * 90 or None) for i in range(2000) if i % 90 or not i]


def test_reports_are_written_compressed(spark):
    """The reports are far larger than the rows they are made of."""
    from loomspan import catalog
    from tests.conftest import SF

    files = catalog.queries()["read_rnaz"](spark, SF).inputFiles()
    assert files and all(f.endswith(".gz") for f in files)
