import os
import random

import pytest

from skyloom.llm.mixing import VOCABULARY, budgets, count_tokens, mix_sources

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
DOC, TARGET = "doc_id bigint, text string, source string, copies int, rate int", "source string, target_share double, max_repeats int, n_tokens int"


def test_budgets():
    assert budgets({"a": (0.5, 1), "b": (0.5, 1)}, {"a": 100, "b": 300}) == {"a": 100.0, "b": 300.0}
    got = budgets({"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 5)}, {"a": 1000, "b": 50})
    assert got["b"] == 50 and got["c"] == 0 and abs(got["a"] - 1000) < 1e-9


def test_counts_tokens_exactly(spark):
    df = spark.createDataFrame([(1, "hello world <|endoftext|>"), (2, None), (3, ""), (4, "été " * 5000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, "text").collect()}
    assert got[2] == got[3] == 0 and got[1] > 3 and got[4] >= 5000


def test_shares_caps_and_report(spark):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(5, 60), rng.choice(["Night-Log", "night_log", "help page", "abstract", None, "other"]), 1, 2) for i in range(900)] + [(1000, None, "abstract", 1, 2), (1001, "", "abstract", 1, 2)]
    goals = [("night log", 0.3, 1, 1), ("help_page", 0.4, 2, 1), ("Abstract", 0.25, 3, 1), ("gone", 0.05, 4, 1), (None, 0.1, 1, 1), ("zero", None, 1, 1)]
    copies, report = mix_sources(spark.createDataFrame(rows, DOC), spark.createDataFrame(goals, TARGET))
    c = copies.collect()
    assert len(c) == sum(r[2] is not None and r[2] != "other" for r in rows)
    most = {"night_log": 1, "help_page": 2, "abstract": 3}
    assert all(0 <= r["copies"] <= most[r["source"]] and 0 <= r["rate"] <= most[r["source"]] for r in c) and all(r["copies"] == 0 for r in c if not r["n_tokens"])
    rep = {r["source"]: r for r in report.collect()}
    for s in most:
        used = sum(r["copies"] * r["n_tokens"] for r in c if r["source"] == s)
        expected = sum(r["rate"] * r["n_tokens"] for r in c if r["source"] == s)
        assert rep[s]["used_tokens"] == used and abs(used - rep[s]["budget"]) <= 65 and abs(expected - rep[s]["budget"]) <= 1e-4 * rep[s]["budget"]
    assert abs(sum(r["share"] for r in rep.values()) - 1) < 1e-9 and rep["gone"]["limited"] and rep["gone"]["share"] == 0 and not rep["zero"]["limited"]
    assert abs(rep["help_page"]["share"] / rep["abstract"]["share"] - 0.4 / 0.25) < 0.02


def test_empty(spark):
    copies, report = mix_sources(spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 2, 1)], TARGET))
    assert copies.count() == 0 and [r["used_tokens"] for r in report.collect()] == [0]
