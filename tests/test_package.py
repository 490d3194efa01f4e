"""The package on other machines, settings, errors, plans and results in order."""

import os
import random
import subprocess
import sys

import oracle
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.config import Config
from millrace.errors import EngineError, engine_error
from millrace.operators.asof import asof_join
from millrace.plans import dialect, tpch
from millrace.sinks import Sink
from millrace.sources import files
from millrace.spec import contains

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from millrace.session import local_session
from millrace.plans import records
spark = local_session(2, 2, "1g", **{{"spark.ui.showConsoleProgress": "false"}})
print("sessions", records.p6_found(spark, {folder!r}).count())
"""


def test_python_operators_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, folder=oracle.FOLDER)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sessions" in run.stdout, run.stderr[-2000:]


class _Context:
    master = "spark://somewhere:7077"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(_Session())


def test_config(tmp_path):
    (tmp_path / "c.ini").write_text("; about\n[spark]\nspark.sql.shuffle.partitions = 7\n[Names]\nKey = a = b\n")
    config = Config.load(str(tmp_path / "c.ini"))
    assert config.sections == ["spark", "Names"] and config.section("spark") == {"spark.sql.shuffle.partitions": "7"}
    assert config.get("Names", "Key") == "a = b" and config.get("Names", "none", "x") == "x" and config.section("none") == {}
    for bad in (lambda: config.get("Names", "none"), lambda: Config("no section"), lambda: Config.load(str(tmp_path / "none"))):
        with pytest.raises(EngineError) as e:
            bad()
        assert e.value.kind == "configuration"


def test_errors_have_a_kind(spark):
    for text, kind in (("SELEC 1", "sql"), ("SELECT nothing", "plan")):
        with pytest.raises(Exception) as e:
            spark.sql(text)
        assert engine_error(e.value).kind == kind and "\n" not in str(engine_error(e.value))
    assert engine_error(EngineError("plan", "x")).kind == "plan" and engine_error(ValueError()).kind == "other"


def test_plans_are_told_by_their_nodes(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    a = spark.range(9).withColumn("Sort", F.lit("Join Window"))
    assert not any(contains(plan(a), w) for w in ("sort", "join", "aggregate", "window"))
    joined = plan(a.hint("merge").join(spark.range(5), "id"))
    assert contains(joined, "join") and not contains(joined, "aggregate")
    assert contains(plan(a.orderBy("id")), "sort") and contains(plan(a.groupBy("id").count()), "aggregate")
    assert not contains("SortMergeJoin [id]", "sort") and not contains("SortAggregate(key=[id])", "sort")


def test_relations_of_a_text(spark):
    text = "WITH x AS (SELECT * FROM bid b JOIN auction ON a_id = auction) SELECT 'FROM person' FROM x WHERE EXISTS (SELECT 1 FROM campaign) AND price > (SELECT max(o) FROM orders)"
    assert [t for t in dialect.relations(spark, text) if t != "x"] == ["auction", "bid", "campaign", "orders"]


ORDERS = {
    1: "returnflag linestatus", 3: "-revenue orderdate", 4: "orderpriority", 5: "-revenue", 7: "supp cust yr", 8: "yr", 9: "nation -yr", 10: "-revenue", 11: "-worth", 12: "shipmode", 13: "-customers -orders",
    15: "suppkey", 16: "-suppliers brand type size", 18: "-price orderdate", 20: "s_name", 21: "-waits s_name", 22: "code",
}


@pytest.mark.parametrize("number", ORDERS)
def test_results_come_in_order(spark, number):
    df = tpch.QUERIES[f"tpch_q{number:02d}"](spark, oracle.FOLDER)
    rows = [r.asDict() for r in df.collect()]
    column = lambda name: next(c for c in df.columns if c == name or c.split("_", 1)[-1] == name)
    key = [(column(k.lstrip("-")), k.startswith("-")) for k in ORDERS[number].split()]
    for one, two in zip(rows, rows[1:], strict=False):
        for c, down in key:
            if one[c] != two[c]:
                assert (one[c] > two[c]) == down, (c, one, two)
                break


def test_streamed_csv_keeps_every_row(spark, tmp_path):
    spark.range(10).selectExpr("id AS a", "concat('x', id) AS b").coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = files.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    sink = Sink("csv", str(tmp_path / "out"))
    sink.start(stream, str(tmp_path / "state")).awaitTermination(120)
    got = sink.read(spark)
    assert got.columns == ["a", "b"] and sorted(tuple(r) for r in got.collect()) == [(i, f"x{i}") for i in range(10)]


def test_asof_join_matches_brute_force(spark):
    rng = random.Random(3)
    left = [(rng.choice([None, 1, 1, 1, rng.randrange(20)]), rng.choice([None, rng.randrange(5000)]), i, "l") for i in range(800)]
    right = [(rng.choice([None, 1, 1, 2, rng.randrange(20)]), rng.choice([None, rng.randrange(5000)]), rng.randrange(300), f"r{i}") for i in range(400)]
    shape = "k bigint, ms bigint, o bigint, match string"
    for bucket in (50, 1000, 10**6):
        got = asof_join(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), "k", "ms", "o", bucket)
        found = {(r[2], (r[-1]["ms"], r[-1]["o"]) if r[-1] else None) for r in got.collect()}
        want = set()
        for k, ms, o, _ in left:
            near = [(m, p) for q, m, p, _ in right if k is not None and ms is not None and q == k and m is not None and m <= ms]
            want.add((o, max(near) if near else None))
        assert found == want and got.count() == len(left)
    none = asof_join(spark.createDataFrame(left, shape), spark.createDataFrame([], shape), "k", "ms", "o").collect()
    assert len(none) == len(left) and all(r[-1] is None for r in none)
