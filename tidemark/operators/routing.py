"""Batches of route queries: costs by Catalyst, searches in rounds over tiles of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.session import Tables

_ON = ["query_id", "month", "vessel"]


def _weights(costs: DataFrame) -> DataFrame:
    return costs.select("month", "vessel", "source", "target", F.col("route_cost").alias("weight"))


def _known(nodes: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Queries whose node has an edge in its graph."""
    ends = edges.select("month", "vessel", F.explode(F.array("source", "target")).alias(column)).distinct()
    return nodes.join(ends, ["month", "vessel", column], "left_semi")


def routes(queries: DataFrame, costs: DataFrame) -> DataFrame:
    """query_id, month, vessel, reached, cost, path for each row of ``queries``.

    ``queries``: query_id, origin, goal, month, vessel; of rows with one id, month and vessel
    there is one. ``costs``: directed edges with route_cost by month and vessel; infinite ones
    are no edges. A goal that cannot be reached, or a node that the graph lacks, has reached
    false and no path. Of equally cheap ways that over smaller ids is taken, from the goal back.
    """
    tables = Tables(queries.sparkSession)
    edges = search.prepared(_weights(costs), tables)
    asked = tables.keep(_known(_known(queries.select(*_ON, "origin", "goal"), edges, "origin"), edges, "goal"), "asked")
    least = search.by_tile(search.least_costs(asked, edges, tables), tables)
    at_goal = least.drop("tile").withColumnRenamed("node_id", "goal")
    paths = search.paths(asked, least, edges, tables)
    found = asked.join(at_goal, [*_ON, "goal"]).join(paths, _ON).select(*_ON, "cost", "path")
    return queries.select(*_ON).join(found, _ON, "left").select(*_ON, F.col("path").isNotNull().alias("reached"), "cost", "path")


def costs_from(origins: DataFrame, costs: DataFrame) -> DataFrame:
    """query_id, month, vessel, node_id, cost: all nodes within reach of each origin that the graph has."""
    tables = Tables(origins.sparkSession)
    edges = search.prepared(_weights(costs), tables)
    asked = tables.keep(_known(origins.select(*_ON, "origin"), edges, "origin"), "asked")
    return search.least_costs(asked, edges, tables)


def legs(paths: DataFrame) -> DataFrame:
    """The edges of each path: query_id, month, vessel, position, source, target."""
    nodes = paths.where("reached").select("query_id", "month", "vessel", F.posexplode("path").alias("position", "source"))
    step = Window.partitionBy("query_id", "month", "vessel").orderBy("position")
    return nodes.withColumn("target", F.lead("source").over(step)).where("target is not null")


def totals(paths: DataFrame, costs: DataFrame) -> DataFrame:
    """Nodes, length, and time of each path; edges of infinite time count in the length alone."""
    edges = costs.select("month", "vessel", "source", "target", "length_m", "time_s")
    summed = legs(paths).join(edges, ["month", "vessel", "source", "target"]).groupBy("query_id", "month", "vessel").agg(F.sum("length_m").alias("total_length_m"), F.sum(F.when(F.col("time_s") < float("inf"), F.col("time_s"))).alias("total_time_s"))
    return paths.join(summed, ["query_id", "month", "vessel"], "left").select("query_id", "month", "vessel", "reached", "cost", F.coalesce(F.size("path"), F.lit(0)).alias("n_nodes"), "total_length_m", "total_time_s")


def seasonal(queries: DataFrame, months: list[int] | None = None) -> DataFrame:
    """Each query in every month."""
    return queries.drop("month").withColumn("month", F.explode(F.array(*(F.lit(m) for m in months or range(1, 13)))))


def with_return(queries: DataFrame) -> DataFrame:
    """Each query and its way back, whose id is negative. Ids are positive."""
    back = queries.withColumns({"query_id": -F.col("query_id"), "origin": F.col("goal"), "goal": F.col("origin")})
    return queries.unionByName(back)


def both_or_none(told: DataFrame) -> DataFrame:
    """Results of ``with_return``: where one way fails, both do; then reached is false and the other columns are null."""
    pair = Window.partitionBy(F.abs("query_id"), "month", "vessel")
    out = told.withColumn("reached", F.min("reached").over(pair))
    rest = [c for c in told.columns if c not in (*_ON, "reached")]
    return out.select(*_ON, "reached", *(F.when(F.col("reached"), F.col(c)).alias(c) for c in rest))
