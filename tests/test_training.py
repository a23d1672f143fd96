import pytest
from pyspark.sql import functions as F

from rivulet.operators import models, training


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(200).select(F.concat(F.lit("f"), "id").alias("flow_id"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(1.0).alias("c"), (F.col("id") % 2).cast("double").alias("proto"))
    return df.withColumn("heavy", (F.col("a") > 3).cast("int")).persist()


def test_fit_scores_and_votes(rows):
    m = training.fit(rows, ["a", "b", "c", "proto"], ["a", "b"], trees=4, depth=3)
    assert "a" in m.selected
    p = m.predict(rows)
    assert p.where("predicted <> heavy").count() == 0
    votes = training.tree_scores(m, rows)
    assert votes.count() == 800
    assert models.vote(votes, 0.5).where("predicted = 1").count() > 0
    assert 0 <= models.search_threshold(votes, 80) <= 1


def test_nodes_and_pruning(spark, rows, tmp_path):
    m = training.fit(rows, ["a", "b"], [], trees=3, depth=2, select=False)
    nodes = training.tree_nodes(spark, m.forest, str(tmp_path / "m"))
    assert nodes.count() == m.forest.totalNumNodes
    assert training.prune(m, rows, nodes, 1).count() == 2


def test_search_cascade_and_cost(rows):
    s = training.random_search(rows, ["a", "b"], [], {"trees": [2], "depth": [1, 2]}, draws=2)
    assert s.orderBy("rank").first()["ap"] > 0.5
    ms, last = training.cascade([rows, rows.where("b > 1")], [["a"], ["a", "b"]])
    assert len(ms) == 2 and last.count() > 0
    assert training.relabel_by_cost(rows, ["a"], ((0, 1), (1, 0)), rounds=2).where("heavy = 1").count() > 0


def test_continual_loop(rows):
    loop = training.Continual(lambda df: training.fit(df, ["a", "b"], [], trees=2, depth=2, select=False), policy="add", every=2)
    got = loop.run(rows.limit(150), [(1, rows), (2, rows)])
    assert [m for m, _ in got] == [1, 2] and all(ap > 0.5 for _, ap in got)
