"""Files in and out: GeoJSON, GeoPackage, JSON graphs, CSV."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_geojson(spark: SparkSession, path: str, geometry: str, properties: str, whole_file: bool = True) -> DataFrame:
    """Features of collections: geometry and properties with the given DDL schemas. A collection is a file, or else a line."""
    schema = f"features array<struct<geometry: {geometry}, properties: {properties}>>"
    return spark.read.schema(schema).json(path, multiLine=whole_file).select(F.explode("features").alias("f")).select("f.geometry", "f.properties")


_ATTRIBUTES = "map<string, double>"


def read_graph(spark: SparkSession, path: str, node_attributes: str = _ATTRIBUTES, edge_attributes: str = _ATTRIBUTES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph document, or of a folder that ``write_graph`` made; gzip is read as it is.

    Attributes are numbers by name unless their types are given, as of nodes with conditions by
    month: ``struct<lat: double, lng: double, env: map<string, struct<wind_x: double>>>``.
    """
    node, edge = f"key string, attributes {node_attributes}", f"source string, target string, attributes {edge_attributes}"
    if not path.endswith((".json", ".json.gz")):
        return spark.read.schema(node).json(f"{path}/nodes"), spark.read.schema(edge).json(f"{path}/edges")
    doc = spark.read.schema(f"nodes array<struct<{node}>>, edges array<struct<{edge}>>").json(path, multiLine=True)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (key, attributes) and edges (source, target, attributes) as gzipped JSON lines, one folder each: the form that scales."""
    nodes.write.mode("overwrite").json(f"{path}/nodes", compression="gzip")
    edges.write.mode("overwrite").json(f"{path}/edges", compression="gzip")


def write_adjacency(neighbours: DataFrame, path: str) -> None:
    """source and its map of neighbours, as gzipped JSON lines."""
    neighbours.write.mode("overwrite").json(path, compression="gzip")


def write_metadata(nodes: DataFrame, edges: DataFrame, path: str, name: str) -> None:
    """One JSON line: name, bounds, node count, and twice the undirected edges, as both directions are sailed."""
    box = F.struct(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))
    about = nodes.agg(F.lit(name).alias("name"), box.alias("bounds"), F.count("*").alias("node_count"))
    about.crossJoin(edges.agg((2 * F.count("*")).alias("edge_count"))).coalesce(1).write.mode("overwrite").json(path)


def catalogue(layers: DataFrame, prefix: str = "") -> DataFrame:
    """layer, kind, level, place: the layers (layer) whose names begin with a prefix, in order of kind and then of the number that ends them, so r10 comes after r9; layers without a number come first."""
    level = F.nullif(F.regexp_extract("layer", r"_r(\d+)$", 1), F.lit("")).cast("long")
    named = layers.where(F.col("layer").startswith(prefix)).select("layer", F.regexp_replace("layer", r"_r\d+$", "").alias("kind"), level.alias("level")).distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("level").asc_nulls_first(), "layer"))
    return named.withColumn("place", place)


def finest(layers: DataFrame) -> DataFrame:
    """kind, level, layer: of the layers (layer) whose names end in a resolution, the finest of each kind."""
    level = F.regexp_extract("layer", r"_r(\d+)$", 1).cast("long")
    named = layers.select("layer", F.regexp_replace("layer", r"_r\d+$", "").alias("kind"), level.alias("level")).where("level is not null")
    return named.groupBy("kind").agg(F.max("level").alias("level"), F.max_by("layer", "level").alias("layer"))


def write_geojson(features: DataFrame, group: str, feature: str, path: str) -> None:
    """Features (text) as one FeatureCollection for each group: a folder of documents, each a line of its own."""
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.sort_array(F.collect_list(feature)), ","), F.lit("]}"))
    features.groupBy(group).agg(collection.alias("value")).select("value").write.mode("overwrite").text(path)


def layer_at(spark: SparkSession, path: str, resolution: int | None = None) -> DataFrame:
    """The layer of the asked resolution of what ``write_layer`` wrote, else the finest."""
    table = spark.read.parquet(path)
    if resolution is None:
        resolution = table.agg(F.max("resolution").alias("r")).collect()[0].r
    return table.where(F.col("resolution") == resolution)


def write_layer(layer: DataFrame, path: str) -> None:
    """Write the resolutions that a layer has, leaving others as they are."""
    layer.write.partitionBy("resolution").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def to_csv(spark: SparkSession, source: str, target: str, force: bool = False) -> None:
    """A Parquet table as CSV with a header; an existing target stays unless forced."""
    spark.read.parquet(source).write.mode("overwrite" if force else "ignore").csv(target, header=True)


class _Layer(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _LayerReader(DataSourceReader):
    def __init__(self, path: str, wanted: str | None):
        self.path, self.wanted = path, wanted

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            names = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents ORDER BY table_name")]
        return [_Layer(n) for n in names if self.wanted is None or n.startswith(self.wanted)]

    def read(self, partition):
        name = partition.name.replace('"', '""')
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            db.row_factory = sqlite3.Row
            for row in db.execute(f'SELECT * FROM "{name}"'):
                keys = row.keys()
                geometry = next((row[k] for k in keys if isinstance(row[k], bytes)), None)
                yield partition.name, {k: str(row[k]) for k in keys if row[k] is not None and not isinstance(row[k], bytes)}, geometry


class GeoPackage(DataSource):
    """Layers of a GeoPackage file that executors can open, a partition each: layer, attributes, geometry (its blob, which ``geometry.from_wkb`` reads).

    Options: path, and prefix of the layers wanted.
    """

    @classmethod
    def name(cls):
        return "geopackage"

    def schema(self):
        return "layer string, attributes map<string, string>, geometry binary"

    def reader(self, schema):
        return _LayerReader(self.options["path"], self.options.get("prefix"))


def resolution_of(layer: str) -> int | None:
    """The number that ends a layer's name: hexes_r7 -> 7."""
    m = re.search(r"_r(\d+)$", layer)
    return int(m[1]) if m else None
