import subprocess
import sys
from pathlib import Path

import pytest

import sqlite_graph
from perilmap.sources import graph_store

SCHEMA = graph_store.SCHEMAS["edges"]
HERE = Path(__file__).resolve().parent


@pytest.fixture
def db(spark, tmp_path):
    graph_store.register(spark)
    # Workers import the client by name.
    spark.sparkContext.addPyFile(str(HERE / "sqlite_graph.py"))
    graph = sqlite_graph.client({"db": str(tmp_path / "g.db")})
    graph.create()
    return graph


def options(graph, **more):
    return {"client": "sqlite_graph:client", "db": graph.path, **more}


def edges(n):
    return [(k, f"h{k % 7}", "HUMAN_FACTOR", ("LEADS_TO", "CAUSED_BY")[k % 2], f"t{k % 5}", "QUALITY_DEFECT") for k in range(n)]


def held(graph, kind="edges"):
    with graph.connection() as db:
        return {t: db.execute(f"SELECT count(*) FROM {t}").fetchone()[0] for t in (kind, f"staged_{kind}", f"committed_{kind}")}


def test_merge_is_idempotent(spark, db):
    df = spark.createDataFrame(edges(50) * 2, SCHEMA).repartition(4)
    for _ in range(2):
        df.write.format("property_graph").mode("append").options(**options(db, batch="7")).save()
        assert held(db) == {"edges": 50, "staged_edges": 0, "committed_edges": 0}
    nodes = spark.createDataFrame([("a", "X", [0.5, 1.0]), ("b", "Y", None), ("a", "X", [0.5, 1.0])], graph_store.SCHEMAS["nodes"])
    nodes.write.format("property_graph").mode("append").options(**options(db, kind="nodes")).save()
    back = spark.read.format("property_graph").options(**options(db, kind="nodes")).load()
    assert sorted(map(tuple, back.collect())) == [("a", "X", [0.5, 1.0]), ("b", "Y", None)]


def test_scan_pushes_the_relation_down(spark, db):
    spark.createDataFrame(edges(40), SCHEMA).write.format("property_graph").mode("append").options(**options(db)).save()
    read = spark.read.format("property_graph").options(**options(db, parts="3")).load()
    assert sorted(map(tuple, read.collect())) == sorted(edges(40))
    Path(db.path + ".scans").unlink()
    some = read.filter("relation = 'LEADS_TO' AND head <> 'h0'").groupBy("head", "tail").count()
    assert sum(r["count"] for r in some.collect()) == sum(e[3] == "LEADS_TO" and e[1] != "h0" for e in edges(40))
    assert sorted(Path(db.path + ".scans").read_text().splitlines()) == [f"edges ['LEADS_TO'] {k}/3" for k in range(3)]


def test_a_failed_job_publishes_nothing(spark, db):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edges(60), SCHEMA).repartition(3).withColumn("tail", F.when(F.col("case_id") == 59, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("tail")))
    with pytest.raises(Exception, match="broken"):
        df.write.format("property_graph").mode("append").options(**options(db, batch="5")).save()
    assert held(db)["edges"] == 0
    with pytest.raises(Exception, match="a key of edges is null"):
        spark.createDataFrame([(1, None, "a", "R", "b", "c")], SCHEMA).write.format("property_graph").mode("append").options(**options(db)).save()
    for bad, mode in ((spark.range(3), "append"), (spark.createDataFrame(edges(2), SCHEMA), "overwrite")):
        with pytest.raises(Exception, match="need the columns|never overwritten"):
            bad.write.format("property_graph").mode(mode).options(**options(db)).save()


RETRIED = """
import sys
sys.path[:0] = [{here!r}, {root!r}]
from pyspark import TaskContext
from pyspark.sql import SparkSession
from perilmap.sources import graph_store
from test_graph_store import edges, SCHEMA

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
graph_store.register(spark)

def broken(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
        raise OSError("this attempt is lost after its rows were staged")

df = spark.createDataFrame(edges(200), SCHEMA).repartition(3).mapInArrow(broken, SCHEMA)
df.write.format("property_graph").mode("append").options(client="sqlite_graph:client", db={db!r}, batch="10").save()
"""


def test_a_lost_attempt_counts_once(tmp_path):
    """A task stages rows, fails and runs again; every edge is there once and the lost attempt's rows are gone."""
    graph = sqlite_graph.client({"db": str(tmp_path / "g.db")})
    graph.create()
    code = RETRIED.format(here=str(HERE), root=str(HERE.parent), db=graph.path)
    env = {"PYTHONPATH": f"{HERE}:{HERE.parent}", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
    import os

    run = subprocess.run([sys.executable, "-c", code], env={**os.environ, **env, "PATH": os.environ["PATH"]}, capture_output=True, text=True, timeout=180)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "this attempt is lost" in run.stderr and held(graph) == {"edges": 200, "staged_edges": 0, "committed_edges": 0}


def test_cypher_statements():
    sent = []

    def run(statement, parameters):
        sent.append((statement, parameters))
        return [(1, "a", "A", "LEADS_TO", "b", "B")] if "RETURN" in statement else []

    graph = graph_store.CypherGraph(run)
    graph.stage("edges", "j", "t", [{"case_id": 1}])
    graph.publish("edges", "j", ["t"])
    graph.publish("nodes", "j", [])
    graph.discard("nodes", "j")
    assert list(graph.scan("edges", ["LEADS_TO"], 0, 2)) == [(1, "a", "A", "LEADS_TO", "b", "B")]
    assert [p.get("attempts") for _, p in sent] == [None, ["t"], [], None, None] and "MERGE" in sent[1][0] and "r.relation IN $values" in sent[4][0]
