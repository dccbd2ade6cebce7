"""Hand-checkable cases of the DataFrame operators."""

import random

from papyrine.operators import folds
from papyrine.operators.components import connected_components
from papyrine.operators.kmeans import kmeans
from papyrine.operators.similarity import similar_pairs


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_similar_pairs_any_block_size(spark):
    rng = random.Random(1)
    rows = []
    for i in range(50):
        v = [rng.gauss(0, 1) for _ in range(6)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, i % 4, [x / n for x in v]))
    near = {i: [] for i in range(50)}
    for a in rows:
        for b in rows:
            s = sum(x * y for x, y in zip(a[2], b[2]))
            if a[1] != b[1] and s >= 0.3:
                near[a[0]].append((-s, b[0]))
    want = {(min(i, j), max(i, j)) for i, x in near.items() for _, j in sorted(x)[:3]}
    df = spark.createDataFrame(rows, "id long, owner long, v array<double>")
    for block in (7, 1000):
        assert {(r["i"], r["j"]) for r in similar_pairs(df, 0.3, 3, block).collect()} == want


def test_greedy_chunks_item_above_limit(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([4, 5, 30, 2, 8, 1])], "k long, o long, size double")
    assert [r["chunk"] for r in folds.greedy_chunks(df, "k", "size", 10, "o").orderBy("o").collect()] == [0, 0, 1, 2, 2, 3]


def test_admission_refused_adds_nothing(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([6, 7, 4, 1])], "k long, o long, cost double")
    assert [r["admitted"] for r in folds.admit(df, "k", "cost", 10, "o").orderBy("o").collect()] == [True, False, True, False]


def test_first_seen_rejected_rows_register_no_keys(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "y"), (1, 4, None, "y")], "g long, o long, d string, t string")
    assert [r["o"] for r in folds.first_seen(df, "g", "o", ["d", "t"]).orderBy("o").collect()] == [1, 3]


def test_louvain_two_triangles(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3), (1, 4, 5), (1, 5, 6), (1, 4, 6)], "g long, a long, b long")
    got = {r["node"]: r["community"] for r in folds.louvain(df, "g").collect()}
    assert got[1] == got[2] == got[3] != got[4] == got[5] == got[6]


def test_kmeans_fixed_centres(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [1.0]), (3, [9.0])], "id long, v array<double>")
    assert [r["cluster"] for r in kmeans(df, 2).orderBy("id").collect()] == [0, 1, 0, 1]


def test_g7_links_through_all_lines_of_an_order(spark, tmp_path):
    from papyrine.plans import programs

    lines = [(1, 10, 1, 50.0), (1, 11, 2, 3.0), (2, 11, 1, 50.0), (2, 12, 2, 1.0), (3, 13, 1, 50.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["node"]: r["component"] for r in programs.g7_components(spark, str(tmp_path)).collect()}
    assert got == {1: -12, 2: -12, -10: -12, -11: -12, -12: -12, 3: -13, -13: -13}


def test_tables_of_a_scope_are_swept(spark):
    from papyrine import shared

    with shared.scope() as made:
        first = shared.keep(spark.range(3), "first")
        second = shared.keep(first.selectExpr("id * 2 AS id"), "second")
        shared.sweep(spark, made, second)
    assert sorted(r[0] for r in second.collect()) == [0, 2, 4] and len(made) == 1
    assert not spark._jvm.java.io.File(first.inputFiles()[0].removeprefix("file://")).exists()


def test_no_local_folder_on_a_cluster():
    import pytest

    from papyrine import shared

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_components_of_edges_that_differ_each_time_they_are_made(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    groups = spark.range(0, 400, 1, 8).select((F.col("id") % 40).alias("g"), F.col("id").alias("node"))

    def star(table: pa.Table) -> pa.Table:  # any star connects a group; which one is drawn anew
        import random

        nodes = table.column("node").to_pylist()
        random.SystemRandom().shuffle(nodes)
        return pa.table({"src": [nodes[0]] * (len(nodes) - 1), "dst": nodes[1:]})

    edges = groups.groupBy("g").applyInArrow(star, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {n: n % 40 for n in range(400)}
