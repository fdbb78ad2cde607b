"""Message templates by the Drain algorithm (He et al., 2017), exact and in parallel.

The tree's first level is the count of tokens, and clusters never cross it, so messages of different counts are
mined on their own, each in the order of their sequence numbers. Ids are given afterwards by the place of each
cluster's first message, which is the order in which one miner would have given them. This holds as long as neither
the count of children nor of clusters is bounded by less than what there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SPACE
from ..session import stored

WILD = "<*>"


@dataclass
class Cluster:
    number: int
    tokens: list[str]
    size: int = 0
    wild: int = 0


class Leaf:
    """The clusters of a leaf, by the tokens at their places too. A place that has become a wildcard stays listed under
    its old token, which only makes a candidate more."""

    def __init__(self) -> None:
        self.clusters: list[Cluster] = []
        self.index: dict[tuple[int, str], list[int]] = {}

    def add(self, cluster: Cluster) -> None:
        for at in enumerate(cluster.tokens):
            self.index.setdefault(at, []).append(len(self.clusters))
        self.clusters.append(cluster)

    def candidates(self, tokens: list[str], need: int) -> list[Cluster]:
        """Clusters, in order, that hold all those with ``need`` tokens in common: such a cluster is in one of the lists
        of any places but ``need`` - 1, so the shortest lists do."""
        if need <= 0 or len(self.clusters) < FEW:
            return self.clusters
        lists = sorted((self.index.get(at, ()) for at in enumerate(tokens) if at[1] != WILD), key=len)
        found = set().union(*lists[: max(0, len(lists) - need + 1)])
        return [self.clusters[i] for i in sorted(found)]


#: Clusters of a leaf up to which all are looked at.
FEW = 16


class Miner:
    """One sequential miner. ``depth`` counts the root, the level of lengths and the leaf's level."""

    def __init__(self, similarity: float = 0.4, depth: int = 4, max_children: int = 999_999):
        self.similarity, self.levels, self.max_children = similarity, max(0, depth - 3), max_children
        self.tree: dict = {}
        self.count = 0

    def add(self, message: str) -> tuple[int, str, str]:
        """(cluster, template after this message, change)."""
        tokens = message.split()
        leaf = self._leaf(tokens, insert=False)
        found = self._best(leaf, tokens) if leaf is not None else None
        if found is None:
            self.count += 1
            found = Cluster(self.count, tokens, 1, tokens.count(WILD))
            self._leaf(tokens, insert=True).add(found)
            return found.number, " ".join(tokens), "cluster_created"
        merged = [a if a == b else WILD for a, b in zip(found.tokens, tokens, strict=True)]
        change = "none" if merged == found.tokens else "cluster_template_changed"
        found.tokens, found.size, found.wild = merged, found.size + 1, merged.count(WILD)
        return found.number, " ".join(merged), change

    def _leaf(self, tokens: list[str], insert: bool) -> Leaf | None:
        node = self.tree.get(len(tokens))
        if node is None:
            if not insert:
                return None
            node = self.tree[len(tokens)] = {"next": {}, "leaf": Leaf()}
        for token in tokens[: self.levels]:
            children = node["next"]
            if token in children:
                node = children[token]
                continue
            if not insert:
                if WILD not in children:
                    return None
                node = children[WILD]
                continue
            plain = not any(c.isdigit() for c in token) and len(children) - (WILD in children) < self.max_children
            node = children.setdefault(token if plain else WILD, {"next": {}, "leaf": Leaf()})
        return node["leaf"]

    def _best(self, leaf: Leaf, tokens: list[str]) -> Cluster | None:
        """The cluster with most equal tokens, then with most wildcards, then the earliest, if it is similar enough."""
        best, best_rank, has_wild = None, (-1, -1), WILD in tokens
        for cluster in leaf.candidates(tokens, ceil(self.similarity * len(tokens) - 1e-9)):
            same = sum(map(eq, cluster.tokens, tokens))
            if has_wild:
                same -= sum(a == WILD == b for a, b in zip(cluster.tokens, tokens, strict=True))
            if same >= best_rank[0] and (rank := (same, cluster.wild)) > best_rank:
                best, best_rank = cluster, rank
        share = best_rank[0] / len(tokens) if tokens else 1.0
        return best if best is not None and share >= self.similarity else None


def n_tokens(message: Column) -> Column:
    """The count of tokens, as :meth:`Miner.add` splits a message."""
    return F.size(F.filter(F.split(message, f"(?U){SPACE}+"), lambda t: t != ""))


def mine(messages: DataFrame, similarity: float = 0.4, depth: int = 4, max_children: int = 999_999) -> DataFrame:
    """From rows (miner, seq, message) the columns cluster_id, template (as it was on arrival) and change_type.

    One shuffle, by miner and count of tokens; a task holds the clusters of its groups, not their messages. Null
    messages are left out. The mined rows are written to the shared folder, as they are read twice and mining is dear.
    """
    rows = messages.where("message is not null").select("miner", F.col("seq").cast("long").alias("seq"), "message", n_tokens(F.col("message")).alias("n"))
    dealt = rows.repartition("miner", "n").sortWithinPartitions("miner", "n", "seq")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, miner, first = None, None, {}
        for part in parts:
            out = []
            for name, seq, message, n in part.itertuples(index=False, name=None):
                if (name, n) != current:
                    current, miner, first = (name, n), Miner(similarity, depth, max_children), {}
                number, template, change = miner.add(message)
                out.append((name, seq, message, template, change, first.setdefault(number, seq)))
            yield pd.DataFrame(out, columns=["miner", "seq", "message", "template", "change_type", "first_seq"])

    mined = stored(dealt.mapInPandas(work, "miner string, seq long, message string, template string, change_type string, first_seq long"), "mined")
    ids = numbered(mined.where("change_type = 'cluster_created'").select("miner", F.col("seq").alias("first_seq")))
    return mined.join(ids, ["miner", "first_seq"]).select("miner", "seq", "message", "cluster_id", "template", "change_type")


def numbered(clusters: DataFrame) -> DataFrame:
    """(miner, first_seq, cluster_id) from (miner, first_seq): the place of each among its miner's, from 1.

    Places are counted in cells of 2^20 sequence numbers and cells in cells of cells, so no task holds more than
    2^24 rows for a miner, however many clusters it has. Sequence numbers must be distinct.
    """
    rows = clusters.select("miner", "first_seq", F.shiftright("first_seq", 20).alias("cell"), F.shiftright("first_seq", 40).alias("area"))
    own = Window.partitionBy("miner", "area", "cell")
    rows = rows.select("*", F.row_number().over(own.orderBy("first_seq")).alias("place"), F.count(F.lit(1)).over(own).alias("n"))
    earlier = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = Window.partitionBy("miner", "area")
    cells = rows.where("place = 1").select("miner", "area", "cell", earlier(area.orderBy("cell"), "n").alias("in_area"), F.sum("n").over(area).alias("n"), F.row_number().over(area.orderBy("cell")).alias("k"))
    areas = cells.where("k = 1").select("miner", "area", earlier(Window.partitionBy("miner").orderBy("area"), "n").alias("in_miner"))
    before = cells.join(areas, ["miner", "area"]).select("miner", "area", "cell", (F.col("in_miner") + F.col("in_area")).alias("before"))
    return rows.join(before, ["miner", "area", "cell"]).select("miner", "first_seq", (F.col("before") + F.col("place")).alias("cluster_id"))


def final_templates(mined: DataFrame) -> DataFrame:
    """miner, cluster_id, template (after the last message), size, first_seq."""
    return mined.groupBy("miner", "cluster_id").agg(F.max_by("template", "seq").alias("template"), F.count(F.lit(1)).alias("size"), F.min("seq").alias("first_seq"))


def running_size(mined: DataFrame) -> DataFrame:
    over = Window.partitionBy("miner", "cluster_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return mined.withColumn("cluster_size", F.count(F.lit(1)).over(over))


def coverage(mined: DataFrame) -> DataFrame:
    """Each template's size, its share of the miner's messages in percent, and its count of wildcards."""
    templates = final_templates(mined)
    share = 100.0 * F.col("size") / F.sum("size").over(Window.partitionBy("miner"))
    return templates.select("*", F.round(share, 6).alias("percentage"), F.regexp_count("template", F.lit("<\\*>")).alias("wildcards"))


def by_file(mined: DataFrame, files: DataFrame) -> DataFrame:
    """Messages of each cluster in each file, and in all files (a null source_file with ``overall`` true), from
    ``files`` (miner, seq, source_file): one shuffle of counts for both levels. Messages without a file count as
    a file of null, with ``overall`` false."""
    rows = mined.select("miner", "seq", "cluster_id").join(files.select("miner", F.col("seq").cast("long").alias("seq"), "source_file"), ["miner", "seq"], "left")
    sets = [["miner", "source_file", "cluster_id"], ["miner", "cluster_id"]]
    counts = rows.groupingSets([[F.col(c) for c in one] for one in sets], "miner", "source_file", "cluster_id")
    return counts.agg((F.grouping("source_file") == 1).alias("overall"), F.count(F.lit(1)).alias("n"))


def coverage_summary(covered: DataFrame, high: float = 10.0, low: float = 1.0) -> DataFrame:
    """Counts of templates of high, medium and low coverage (bounds are ours) and the percentages' range."""
    p = F.col("percentage")
    return covered.groupBy("miner").agg(F.count(F.lit(1)).alias("templates"), F.count_if(p >= high).alias("high"), F.count_if((p < high) & (p >= low)).alias("medium"), F.count_if(p < low).alias("low"), F.avg(p).alias("avg_percentage"), F.max(p).alias("max_percentage"), F.min(p).alias("min_percentage"))
