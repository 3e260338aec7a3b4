"""Every query of the sea world against its DuckDB twin."""

import duckdb
import pytest

from tidemark.plans import build, catalogue, shapes
from tidemark.sources.world import VIEWS, view, with_views

SF = "/root/testdata/sf0.001"
TABLES = "nation customer part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v + 0.0 if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("name", catalogue.ORACLE)
def test_query_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert ordered(tuple(plain(r[c]) for c in columns) for r in df.collect()) == ordered(want)


@pytest.mark.parametrize("name", VIEWS)
def test_views(spark, duck, name):
    df = view(spark, SF, name)
    want = duck.execute(with_views(f"SELECT {', '.join(df.columns)} FROM {name}")).fetchall()
    assert ordered(map(tuple, df.collect())) == ordered(want)


def test_routes_cost_what_a_search_from_the_origin_says(spark):
    costs = catalogue.world_costs(spark, SF, [1], ["default"]).persist()
    from pyspark.sql import functions as F

    from tidemark.operators import routing

    asked = catalogue.pairs(spark, SF, 20).withColumns({"month": F.lit(1), "vessel": F.lit("default")})
    found = {r.goal: r.cost for r in routing.routes(asked, costs).join(asked.select("query_id", "goal"), "query_id").collect()}
    origin = spark.createDataFrame([(1, 1, 1, "default")], "query_id long, origin long, month int, vessel string")
    all_costs = {r.node_id: r.cost for r in routing.costs_from(origin, costs).collect()}
    assert len(found) > 5
    assert {k: round(v, 3) for k, v in found.items() if v is not None} == {k: round(all_costs[k], 3) for k in found if k in all_costs}


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(e.oracle_sql()) <= set(e.queries())


def test_build_can_be_taken_up_again(spark, tmp_path):
    from tidemark.sources import files

    path = str(tmp_path / "graph")
    n = {t: rows().count() for t, _, rows in build.stages(spark, SF)}
    assert build.build(spark, SF, path) == n
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    nodes.limit(100).write.parquet(f"{path}2/nodes")
    again = build.build(spark, SF, path + "2")
    assert again["nodes"] == n["nodes"] - 100 and again["edges"] == n["edges"]
    assert build.build(spark, SF, path) == {t: 0 for t in n}
    (about,) = spark.read.json(f"{path}/metadata").collect()
    assert (about.name, about.node_count, about.edge_count) == ("world", nodes.count(), 2 * edges.count())
    assert about.bounds.west < about.bounds.east


def test_graph_out_and_in_again(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.operators import graph
    from tidemark.sources import files

    path = str(tmp_path / "graph")
    nodes = view(spark, SF, "w_nodes").select(F.col("node_id").cast("string").alias("key"), F.create_map(F.lit("lat"), "lat", F.lit("lng"), "lng").alias("attributes"))
    e = catalogue.world_edges(spark, SF)
    edges = e.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.create_map(F.lit("length_m"), "length_m").alias("attributes"))
    files.write_graph(nodes, edges, path)
    got_nodes, got_edges = files.read_graph(spark, path)
    assert {r.key: r.attributes for r in got_nodes.collect()} == {r.key: r.attributes for r in nodes.collect()}
    assert {(r.source, r.target): r.attributes for r in got_edges.collect()} == {(r.source, r.target): r.attributes for r in edges.collect()}
    files.write_adjacency(graph.adjacency(e, "length_m"), path + "/adjacency")
    assert spark.read.json(path + "/adjacency").count() == e.select("source").distinct().count()
    nodes.write.parquet(path + "/table")
    files.to_csv(spark, f"{SF}/nation.parquet", path + "/csv")
    assert spark.read.csv(path + "/csv", header=True).count() == 25


def test_searches_in_many_tiles(spark, monkeypatch):
    """Costs, hops and paths do not depend on how the graph is tiled, nor on lanes."""
    from pyspark.sql import functions as F

    from tidemark.operators import graph, routing, search

    costs = catalogue.world_costs(spark, SF, [1, 7], ["default"]).persist()
    asked = catalogue.pairs(spark, SF, 30).withColumns({"month": F.explode(F.array(F.lit(1), F.lit(7))), "vessel": F.lit("default")})
    want = {(r.query_id, r.month): (r.cost, r.path) for r in routing.routes(asked, costs).collect()}
    hops = sorted(map(tuple, graph.reachable(view(spark, SF, "w_edges"), 1).collect()))
    monkeypatch.setattr(search, "TILE_NODES", 37)
    monkeypatch.setattr(search, "LANE_QUERIES", 2)
    monkeypatch.setattr(search, "COMPACT", 2)
    got = {(r.query_id, r.month): (r.cost, r.path) for r in routing.routes(asked, costs).collect()}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(got[k][1] == p and (p is None or abs(got[k][0] - c) <= 1e-9 * c) for k, (c, p) in want.items())
    assert sorted(map(tuple, graph.reachable(view(spark, SF, "w_edges"), 1).collect())) == hops


def test_return_fails_as_a_whole(spark):
    from tidemark.operators import routing

    rows = spark.createDataFrame([(1, 1, "v", True, 5.0), (-1, 1, "v", False, None), (2, 1, "v", True, 3.0), (-2, 1, "v", True, 4.0)], "query_id long, month int, vessel string, reached boolean, cost double")
    assert sorted(map(tuple, routing.both_or_none(rows).collect())) == [(-2, 1, "v", True, 4.0), (-1, 1, "v", False, None), (1, 1, "v", False, None), (2, 1, "v", True, 3.0)]
