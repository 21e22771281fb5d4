"""The k-th smallest value of a key, and patterns filed under literals."""

import math
import random
import re

import pytest

from vulnlake.functions import patterns
from vulnlake.operators import evaluation


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.9, 1e-9])
def test_kth_smallest_equals_sorting(spark, alpha):
    r = random.Random(7)
    values = {"many": [r.gauss(0, 100) for _ in range(5000)], "few": [r.choice([1.0, 2.0, 2.5]) for _ in range(400)], "one": [3.25], "same": [4.0] * 50, "odd": [float("inf"), -1e300, 0.0, -0.0, 1e-12]}
    rows = [(k, v) for k, own in values.items() for v in own] + [("many", None), ("none", None)]
    got = {x["key"]: x for x in evaluation.kth_smallest(spark.createDataFrame(rows, "key string, d double"), alpha).collect()}
    assert set(got) == set(values)
    for key, own in values.items():
        k = max(1, min(len(own), math.ceil((len(own) + 1) * (1.0 - alpha))))
        want = sorted(own)[k - 1]
        assert (got[key]["n"], got[key]["k"]) == (len(own), k)
        assert got[key]["q"] == want or math.isclose(got[key]["q"], want, rel_tol=1e-9, abs_tol=6e-5)


def test_only_one_part_of_a_key_is_sorted(spark):
    plan = evaluation.kth_smallest(spark.range(100_000).selectExpr("'a' AS key", "rand(1) AS d"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 4 and "Join" in plan  # the part that holds the k-th is joined in before the last window


def test_required_literals_stand_in_every_match():
    cases = {r"github\.com/x/([a-f]{7,40})": ["github.com/x/"], r"[?&]id=([a-f]+)": ["id="], "Linux.*CVE": ["linux", "cve"], "a|b": [], "colou?r": ["colo", "r"], r"CVE-\d{4}-\d+.*(Linux|kernel)": ["cve-", "-"], "(?:abc)?d": ["d"], "ab*c+": ["a", "c"], "x{0,2}y": ["y"], "a{2}b": ["a", "b"], r"\(z\)": ["(z)"], "[^]a]q": ["q"], "^a$": ["a"]}
    for pattern, want in cases.items():
        assert patterns.required_literals(pattern) == want, pattern
        re.compile(pattern)


def test_the_index_covers_every_pattern_once():
    index = patterns.literal_index({"p1": ["linux kernel cve"], "p2": ["the linux kernel"], "p3": ["bsd"], "p4": []})
    assert index == [("linux kernel", ["p1", "p2"]), ("bsd", ["p3"]), (None, ["p4"])] or [sorted(o) for _, o in index] == [["p1", "p2"], ["p3"], ["p4"]]
    assert patterns.literal_index({}) == []
