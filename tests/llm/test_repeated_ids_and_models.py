"""Ids that repeat with different texts or vectors, and two models in one worker."""

import json
import logging
import signal
from contextlib import contextmanager

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomspan.llm import embeddings, minhash, sentencepiece, toolcalls


@contextmanager
def within(seconds):
    def over(*_):
        raise TimeoutError(f"took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, over)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.mark.parametrize("second", [5, 6])
def test_each_row_of_a_repeated_id_links_by_its_own_text(spark, second):
    w, x = ([f"{c}{i}" for i in range(300)] for c in "wx")
    rows = [(5, " ".join(w)), (second, " ".join(x)), (7, " ".join(w[:-1])), (9, " ".join(x[:-1])), (11, "alone")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.minhash_components(df).collect())
        assert got == sorted([(5, 5, True), (second, second, True), (7, 5, False), (9, second, False), (11, 11, True)])


def test_each_row_of_a_repeated_id_links_by_its_own_vector(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.01]), (11, [0.0, 0.0, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(3)
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
        assert got == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False), (11, 0, 11, True)]


def test_recall_that_is_not_measured_is_said(spark, caplog):
    rows = [(i, [float(k == i) for k in range(8)]) for i in range(8)]
    with caplog.at_level(logging.WARNING, logger="loomspan.llm.embeddings"):
        embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert "recall is not measured" in caplog.text


def test_long_vectors_bound_the_sample(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(40)]
    rows += [(100 + i, v) for i, v in rows[:5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.component_id for r in embeddings.near_vectors(df, sample_bytes=10 * 64 * 8).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def small_model(pieces):
    """A byte-pair model of ``<unk>``, the pieces in order of their merges, and the characters."""

    def field(number, kind, body):
        head = bytes([number << 3 | kind])
        return head + (bytes([len(body)]) + body if kind == 2 else body)

    out = b""
    for i, (text, kind) in enumerate([("<unk>", 2), *((p, 1) for p in pieces)]):
        out += field(1, 2, field(1, 2, text.encode()) + field(2, 5, np.float32(-i).tobytes()) + field(3, 0, bytes([kind])))
    return out + field(2, 2, field(3, 0, bytes([2]))) + field(3, 2, field(3, 0, b"\0") + field(4, 0, b"\0"))


def test_two_models_in_one_worker():
    one, two = (sentencepiece.parse(small_model(p)) for p in (["ab", "bc", "abc", "a", "b", "c"], ["aa", "ab", "aab", "a", "b", "c"]))
    texts = {"x": "abcab bcabc aab", "y": "aabab abab caab"}

    def ids(v, text):
        data = np.frombuffer(text.encode(), np.uint8)
        return sentencepiece.encode_rows(v, data, np.array([0, len(data)]))[0].tolist()

    with within(60):
        fresh = {(m, k): ids(sentencepiece.parse(small_model(p)), t) for m, p in ((0, ["ab", "bc", "abc", "a", "b", "c"]), (1, ["aa", "ab", "aab", "a", "b", "c"])) for k, t in texts.items()}
        for order in (((0, one), (1, two)), ((1, two), (0, one))):
            for _ in range(2):
                for m, v in order:
                    assert {k: ids(v, t) for k, t in texts.items()} == {k: fresh[m, k] for k in texts}


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"b":1.0,"a":1e2,"c":[1.50,-0.0,10000000,1e7,1e30,0.1,12345678901234567890]}', '{"a":100,"b":1,"c":[1.5,0,10000000,10000000,1E30,0.1,12345678901234567890]}'),
        ('{"x":"a 1.0 \\" 2.50","y":1.0}', '{"x":"a 1.0 \\" 2.50","y":1}'), ("3.0", "3"), ('[true,"1"]', '[true,"1"]'), ("no 1.0", '"no 1.0"'),
    ],
)
def test_equal_numbers_have_one_text(spark, text, expected):
    assert spark.createDataFrame([(text,)], "a string").select(toolcalls.canonical(F.col("a"))).first()[0] == expected


def test_long_texts_with_numbers_are_canonical(spark):
    text = json.dumps({"t": '\n"3.50' * 100_000, "n": 2.0})
    got = spark.createDataFrame([(text,)], "a string").select(toolcalls.canonical(F.col("a"))).first()[0]
    assert json.loads(got) == json.loads(text) and got.startswith('{"n":2,')


def test_enum_compares_values(spark):
    tools = {"t": {"properties": {"v": {"enum": [True, "1", 2, "x", 1.5]}}}}
    rows = {'{"v":true}': True, '{"v":1}': False, '{"v":"1"}': True, '{"v":2.0}': True, '{"v":"true"}': False, '{"v":"2"}': False, '{"v":1.50}': True, "{}": True}
    got = spark.createDataFrame([(x,) for x in rows], "a string").select("a", toolcalls.argument_errors(F.lit("t"), F.col("a"), tools).alias("e")).collect()
    assert {r.a: not r.e for r in got} == rows
