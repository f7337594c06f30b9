"""Dictionaries, label catalogues and networks as text and XML files, by Spark's own sources."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """w: one word to a line; blanks around it and empty lines are left out; words once each."""
    return spark.read.text(path).select(F.trim("value").alias("w")).where("w <> ''").distinct()


#: A compiled dictionary's nodes: V the letter (a character code), C/I the numbers of the nodes that follow.
WORD_NODE = "_V int, C struct<I: array<long>>"


def read_word_nodes(spark: SparkSession, path: str) -> DataFrame:
    """ch, children of a compiled dictionary's nodes; files keep the nodes in the order of their numbers."""
    nodes = spark.read.format("xml").option("rowTag", "WLE").schema(WORD_NODE).load(path)
    return nodes.select(F.col("_V").alias("ch"), F.coalesce(F.col("C.I"), F.array().cast("array<long>")).alias("children"))


def write_word_nodes(nodes: DataFrame, path: str) -> None:
    out = nodes.select(F.col("ch").alias("_V"), F.struct(F.col("children").alias("I")).alias("C"))
    out.write.format("xml").option("rootTag", "WLEs").option("rowTag", "WLE").save(path)


def network_tables(spark: SparkSession, layers: list[tuple[np.ndarray, np.ndarray]], input_max: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """nodes (id, layer, type, threshold, input_max) and edges (src, dst, weight) of a network."""
    first = layers[0][0].shape[1]
    nodes = [(i, 0, "in", 0.0, float(input_max[i])) for i in range(first)]
    edges, base = [], 0
    for k, (w, t) in enumerate(layers, 1):
        start = base + w.shape[1]
        nodes += [(start + j, k, "out" if k == len(layers) else "hidden", float(t[j]), 1.0) for j in range(len(t))]
        edges += [(base + i, start + j, float(w[j, i])) for j in range(w.shape[0]) for i in range(w.shape[1])]
        base = start
    return spark.createDataFrame(nodes, "id int, layer int, type string, threshold double, input_max double"), spark.createDataFrame(edges, "src int, dst int, weight double")


def network_of(nodes: DataFrame, edges: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The layers and input maxima of such tables; a network is small."""
    n = nodes.orderBy("id").toPandas()
    e = edges.toPandas()
    layers = []
    for k in range(1, int(n["layer"].max()) + 1):
        own, before = n[n["layer"] == k]["id"].tolist(), n[n["layer"] == k - 1]["id"].tolist()
        row, column = {i: j for j, i in enumerate(own)}, {i: j for j, i in enumerate(before)}
        w = np.zeros((len(own), len(before)))
        for s, d, x in e[e["dst"].isin(own)].itertuples(index=False):
            w[row[d], column[s]] = x
        layers.append((w, n[n["layer"] == k]["threshold"].to_numpy()))
    return layers, n[n["layer"] == 0]["input_max"].to_numpy()


def save_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as XML rows, with attributes."""
    for df, name in ((nodes, "node"), (edges, "connection")):
        df.select(*[F.col(c).alias(f"_{c}") for c in df.columns]).coalesce(1).write.format("xml").option("rootTag", "network").option("rowTag", name).save(f"{path}/{name}s")


def load_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    kinds = {"node": "id int, layer int, type string, threshold double, input_max double", "connection": "src int, dst int, weight double"}
    out = []
    for name, kind in kinds.items():
        columns = [c.strip().split(" ") for c in kind.split(",")]
        df = spark.read.format("xml").option("rowTag", name).schema(", ".join(f"_{c} {t}" for c, t in columns)).load(f"{path}/{name}s")
        out.append(df.select(*[F.col(f"_{c}").alias(c) for c, _ in columns]))
    return out[0], out[1]


FLAGS = ["Ascent", "Height", "Center", "Base", "Descent"]
_ENTRY = "_Shape string, _SampleFolder string, " + ", ".join(f"_{f} boolean" for f in FLAGS) + ", Position struct<" + ", ".join(f"_{f}: boolean" for f in FLAGS) + ">"
_NODE = "_InputMax double, _Treshold double, _Type string, _Layer int, _Id int, Connections struct<Connection: array<struct<_Start: int, _End: int, _Weight: double>>>"
#: How network files name the kinds of nodes.
KINDS = {"eInput": "in", "eOutput": "out", "eHidden": "hidden"}


def _position(entry):
    return F.struct(*[F.coalesce(entry["Position"][f"_{f}"], entry[f"_{f}"], F.lit(False)).alias(f.lower()) for f in FLAGS])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """label, sample_dir and the five flags of the expected position of a label catalogue's entries; the flags are in an element ``Position`` or the entry's own."""
    rows = spark.read.format("xml").option("rowTag", "ShapeListEntry").schema(_ENTRY).load(path).select(F.struct("*").alias("e"))
    return rows.select(F.col("e._Shape").alias("label"), F.col("e._SampleFolder").alias("sample_dir"), _position(F.col("e")).alias("position"))


def read_nets(spark: SparkSession, path: str) -> DataFrame:
    """net_id (the place in the file), name, examples, search_folders, labels, nodes, edges of a file of label catalogues with their networks."""
    schema = f"_Name string, _lNumberExamples int, _bSearchFolders boolean, ShapeList struct<ShapeListEntry: array<struct<{_ENTRY}>>>, NeuralNetwork struct<Nodes: struct<Node: array<struct<{_NODE}>>>>"
    rows = spark.read.format("xml").option("rowTag", "ShapeNet").schema(schema).load(path)
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    nodes = F.coalesce(F.col("NeuralNetwork.Nodes.Node"), F.array())
    kind = lambda n: F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), n["_Type"])
    return rows.select(
        (F.row_number().over(Window.orderBy("at")) - 1).alias("net_id"),  # a file has a few networks
        F.col("_Name").alias("name"), F.col("_lNumberExamples").alias("examples"), F.col("_bSearchFolders").alias("search_folders"),
        F.transform(F.coalesce("ShapeList.ShapeListEntry", F.array()), lambda e: F.struct(e["_Shape"].alias("label"), e["_SampleFolder"].alias("sample_dir"), _position(e).alias("position"))).alias("labels"),
        F.transform(nodes, lambda n: F.struct(n["_Id"].alias("id"), n["_Layer"].alias("layer"), kind(n).alias("type"), n["_Treshold"].alias("threshold"), n["_InputMax"].alias("input_max"))).alias("nodes"),
        F.flatten(F.transform(nodes, lambda n: F.transform(F.coalesce(n["Connections"]["Connection"], F.array()), lambda c: F.struct(c["_Start"].alias("src"), c["_End"].alias("dst"), c["_Weight"].alias("weight"))))).alias("edges"),
    )


def chosen_net(nets: DataFrame, net_id: int) -> tuple[DataFrame, DataFrame]:
    """nodes and edges, as tables, of one network of a file."""
    own = nets.where(F.col("net_id") == net_id)
    return own.select(F.explode("nodes").alias("n")).select("n.*"), own.select(F.explode("edges").alias("e")).select("e.*")


def write_nets(nets: DataFrame, path: str) -> None:
    """Catalogues and networks as ``read_nets`` gives them, as one XML file."""
    back = {v: k for k, v in KINDS.items()}
    kind = lambda n: F.element_at(F.create_map(*[F.lit(x) for pair in back.items() for x in pair]), n["type"])
    entries = F.transform("labels", lambda e: F.struct(e["label"].alias("_Shape"), e["sample_dir"].alias("_SampleFolder"), F.struct(*[e["position"][f.lower()].alias(f"_{f}") for f in FLAGS]).alias("Position")))
    inward = lambda n: F.transform(F.filter("edges", lambda e: e["dst"] == n["id"]), lambda e: F.struct(e["src"].alias("_Start"), e["dst"].alias("_End"), e["weight"].alias("_Weight")))
    nodes = F.transform("nodes", lambda n: F.struct(n["input_max"].alias("_InputMax"), n["threshold"].alias("_Treshold"), kind(n).alias("_Type"), n["layer"].alias("_Layer"), n["id"].alias("_Id"), F.struct(inward(n).alias("Connection")).alias("Connections")))
    out = nets.orderBy("net_id").select(F.col("name").alias("_Name"), F.col("examples").alias("_lNumberExamples"), F.col("search_folders").alias("_bSearchFolders"), F.struct(entries.alias("ShapeListEntry")).alias("ShapeList"), F.struct(F.struct(nodes.alias("Node")).alias("Nodes")).alias("NeuralNetwork"))
    out.coalesce(1).write.format("xml").option("rootTag", "ShapeNets").option("rowTag", "ShapeNet").save(path)


def write_labels(labels: DataFrame, path: str) -> None:
    columns = [F.col("label").alias("_Shape"), F.col("sample_dir").alias("_SampleFolder"), *[F.col(f"position.{f.lower()}").alias(f"_{f}") for f in FLAGS]]
    labels.select(*columns).coalesce(1).write.format("xml").option("rootTag", "ShapeList").option("rowTag", "ShapeListEntry").save(path)


def curated_names(existing: DataFrame, chosen: DataFrame) -> DataFrame:
    """path, label, sample: the next free eight-digit file names of each label for newly labelled samples (path, label).

    ``existing`` has the labels' samples so far (label, sample). Nothing is moved or deleted: the rows say what to copy.
    """
    last = existing.groupBy("label").agg(F.max(F.regexp_extract("sample", r"(\d+)\.bmp$", 1).cast("long")).alias("last"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("path"))
    return chosen.join(last, "label", "left").select("path", "label", F.concat(F.lpad((F.coalesce("last", F.lit(0)) + place).cast("string"), 8, "0"), F.lit(".bmp")).alias("sample"))
