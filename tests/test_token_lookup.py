"""Token matrices looked up late: policy, ragged lengths, hot sequences, and how often matrices are exchanged."""

import re

import pytest

from pairlab.operators import token_lookup as TL
from pairlab.operators import tokens as TK

PAIRS = "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int, chain string"


@pytest.fixture(scope="module")
def store(spark):
    rows = [(f"s{i}", [[float(i), float(j)] for j in range(1 + i % 5)]) for i in range(40)] + [("s3", [[9.0, 9.0]])]
    return TL.store_tokens(spark.createDataFrame(rows, "seq string, tokens array<array<double>>"), buckets=4)


def test_policy_and_ragged_lengths(spark, store):
    rows = [(1, "s1", "s2", "s4", 1, "x"), (2, "s1", None, "s4", 0, "x"), (3, "s1", "", "s4", 0, "x"), (4, "s1", "none", "s4", 0, "x"), (5, "none", "s2", "s4", 0, "x"),
            (6, "s1", "s2", None, 0, "x"), (7, "s9", "s9", "s9", 1, "x"), (7, "s9", "s9", "s9", 0, "y"), (8, "s3", "s3", "s1", 0, "x")]
    got = sorted(TL.lookup_tokens(spark.createDataFrame(rows, PAIRS), store).collect(), key=lambda r: (r.row_id, r.label))
    assert [(r.row_id, r.light_status) for r in got] == [(1, "hit"), (2, "empty"), (3, "empty"), (4, "missing"), (7, "hit"), (7, "hit"), (8, "hit")]
    by = {r.row_id: r for r in got}
    assert by[1].heavy_tokens == [[1.0, 0.0], [1.0, 1.0]] and len(by[1].light_tokens) == 3 and len(by[1].antigen_tokens) == 5
    assert by[2].light_tokens == [] and by[4].light_tokens is None and by[7].heavy_tokens == by[7].antigen_tokens and by[7].chain == "x" or by[7].chain == "y"
    assert by[8].heavy_tokens == by[8].light_tokens  # one row for each stored sequence
    assert TL.lookup_tokens(spark.createDataFrame([], PAIRS), store).collect() == []


def test_hot_sequence_changes_nothing(spark, store, monkeypatch):
    rows = [(i, f"s{i % 40}", "s7" if i % 2 else "none", "s5", 1, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, PAIRS)

    def table(**kw):
        return sorted((r.row_id, r.light_status, str(r.heavy_tokens), str(r.antigen_tokens)) for r in TL.lookup_tokens(df, store, **kw).collect())

    want = table(hot=False)
    assert len(want) == 3000 and table() == want
    monkeypatch.setattr(TL, "HOT_BYTES", 0)  # too wide to broadcast
    assert table() == want


def test_matrices_pass_one_exchange(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"s{i % 40}", "s7", "s5", 1, "x") for i in range(100)], PAIRS)
        plan = TL.lookup_tokens(df, store, hot=False)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        exchanges = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments", plan)
        wide = [e for e in exchanges if re.search(r"tokens#|first#|value#|any_value", e)]
        assert exchanges and len(wide) == 1, exchanges
        assert "BroadcastExchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_matrices_of_hot_sequences_pass_no_exchange(spark, store):
    """Sequences asked for often are broadcast together while they fit, and the others find their matrices as before."""
    rows = [(i, f"s{i % 40}", "s7" if i % 3 else None, f"s{i % 5}", 1, "x") for i in range(400)] + [(900 + i, f"s{i}", "none", "s1", 0, "x") for i in range(3)]
    df = spark.createDataFrame(rows, PAIRS)
    kept = df.selectExpr("row_id", "explode(array(heavy_seq, light_seq, antigen_seq)) AS seq").where("seq IS NOT NULL")
    assert TL._hot(spark, kept, store).count() == 40
    out = TL.lookup_tokens(df, store)
    out.write.format("noop").mode("overwrite").save()
    by = {r.row_id: r for r in out.collect()}
    want = {r.row_id: r for r in TL.lookup_tokens(df, store, hot=False).collect()}
    assert by == want and len(by) == 403


def test_stored_floats_come_back_as_doubles(spark):
    flat = spark.createDataFrame([("a", [1.5, 2.5, 3.5, 4.5], [2, 2]), ("b", [], [0, 2])], "text string, data array<float>, shape array<long>")
    store = TL.store_tokens(TK.decode_tokens(flat, wide=False), "text", buckets=2)
    assert store.schema["tokens"].dataType.simpleString() == "array<array<float>>"
    df = spark.createDataFrame([(1, "a", "b", "a", 1, "x"), (2, "a", None, "b", 0, "x")], PAIRS)
    for hot in (True, False):
        got = TL.lookup_tokens(df, store, hot=hot)
        assert got.schema["light_tokens"].dataType.simpleString() == "array<array<double>>"
        assert [(r.heavy_tokens, r.light_tokens, r.light_status) for r in got.orderBy("row_id").collect()] == [
            ([[1.5, 2.5], [3.5, 4.5]], [], "hit"), ([[1.5, 2.5], [3.5, 4.5]], [], "empty")]


def test_few_hot_sequences_fit(spark, store, monkeypatch):
    """The most requested ones are taken first; the rest is fetched by the exchange."""
    df = spark.createDataFrame([(i, f"s{i % 40}", "s7", "s5", 1, "x") for i in range(200)], PAIRS)
    want = sorted(TL.lookup_tokens(df, store, hot=False).collect())
    monkeypatch.setattr(TL, "HOT_BYTES", 1000)
    asked = df.selectExpr("row_id", "explode(array(heavy_seq, light_seq, antigen_seq)) AS seq")
    assert {r.seq for r in TL._hot(spark, asked, store).collect()} == {"s5", "s7"}
    assert sorted(TL.lookup_tokens(df, store).collect()) == want
