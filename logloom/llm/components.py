"""Connected components of links between ids, by tables in the shared folder; nothing reaches the driver but counts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, label) for the ends of ``links`` (a, b: long, not null); the label is the component's smallest id.

    In each round a node takes the smallest label around it and then its label's label. Labels are kept as a table
    for each round, the one before is dropped, and joins are between plain tables, so that a node with very many
    links can be split by adaptive execution.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select("a", "b")
    edges = common.stored(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{folder}/links")
    number = itertools.count()
    paths = [f"{folder}/labels-{next(number)}"]
    labels = common.stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), paths[0])
    while True:
        around = edges.join(labels, edges["a"] == labels["node"]).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        taken = around.union(labels.select("node", "label", F.col("label").alias("own"))).groupBy("node").agg(F.min("label").alias("label"), F.min("own").alias("own"))
        paths.append(f"{folder}/labels-{next(number)}")
        taken = common.stored(taken, paths[-1])
        if taken.where("label < own").isEmpty():
            labels = taken.select("node", "label")
            break
        above = taken.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        paths.append(f"{folder}/labels-{next(number)}")
        labels = common.stored(taken.join(above, taken["label"] == above["up"]).select("node", F.col("up_label").alias("label")), paths[-1])
        while len(paths) > 1:
            common.drop_path(spark, paths.pop(0))
    return labels
