import pytest
from pyspark.sql import functions as F

from tracelathe.operators import rules


@pytest.fixture(scope="module")
def events(spark):
    rows = [("k1", "posix", "read", 5000, 10, "test_value", 4096), ("k2", "stdio", "write", 50, 10, None, None)]
    return spark.createDataFrame(rows, "k string, cat string, name string, dur bigint, ts bigint, tag string, size bigint")


FIELDS = {
    "cat": (F.col, "cat", "text"), "name": (F.col, "name", "text"), "dur": (F.col, "dur", "integer"), "ts": (F.col, "ts", "integer"),
    "tags.test_key": (F.col, "tag", "text"), "tags.size": (F.col, "size", "integer"),
}

CASES = [
    ("cat == 'posix'", True, False), ("name != 'read'", False, True), ("cat IN {'stdio','posix'}", True, True), ("cat IN {'stdio','mpi'}", False, True),
    ("cat IN { 'posix','mpi'}", False, False), ("name LIKE '*ea*'", True, False), ("name LIKE '*rit'", False, False), ("name LIKE 're*'", True, False),
    ("name LIKE 'r*d'", False, False), ("cat == 5", False, False), ("cat != 5", False, False), ("tags.test_key == 'test_value'", True, False),
    ("tags.test_key LIKE 'test*'", True, False), ("tags.missing == ''", True, True), ("tags.size LIKE '4096'", True, False), ("dur < 100", False, True),
    ("dur > 100", True, False), ("dur > 1.5", False, False), ("dur >= 12ab", True, True), ("NOT dur < 100", True, False),
    ("NOT cat == 'posix' AND dur < 100", True, True), ("name == 'read' OR name == 'write' AND dur < 100", False, True), ("no rule", True, True), ("dur != '50'", True, False),
]


@pytest.mark.parametrize("text, k1, k2", CASES)
def test_rule(events, text, k1, k2):
    fields = {n: (f(c), kind) for n, (f, c, kind) in FIELDS.items()}
    got = {r.k: r.x for r in events.select("k", rules.rule(text, fields).alias("x")).collect()}
    assert got == {"k1": k1, "k2": k2}


def test_inclusion_and_exclusion(events):
    fields = {n: (f(c), kind) for n, (f, c, kind) in FIELDS.items()}
    count = lambda *a, **k: events.filter(rules.should_aggregate(*a, fields, **k)).count()
    assert count([], []) == 2 and count([], ["dur < 100"]) == 0 and count([], ["dur < 100"], full=True) == 2
    assert count(["cat == 'posix'", "name LIKE 'w*'"], ["dur < 100"]) == 1


def test_rule_file():
    text = "# selective\ninclusion:\n  - cat IN {'posix'}\n  - \"name == 'read' OR name == 'x'\"\nexclusion:\n- NOT dur < 1000\n"
    assert rules.load_rules(text) == (["cat IN {'posix'}", "name == 'read' OR name == 'x'"], ["NOT dur < 1000"])


def test_rules_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id as dur", "'posix' as cat").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = frame.filter(rules.rule("cat == 'posix' AND dur < 5", {"cat": (F.col("cat"), "text"), "dur": (F.col("dur"), "integer")}, guard=False))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThan(dur,5)" in plan


def test_shadowed_prefixes(spark):
    rows = spark.createDataFrame([("/a/x",), ("/a/b/x",), ("/a/b",), ("/c",), ("/a/x.py",), ("/b",)], "p string")
    got = [r.p for r in rows.filter(rules.path_traced(F.col("p"), ["/a", "/a/b", "/c"])).collect()]
    assert got == ["/a/b/x", "/a/b", "/c"]
