"""A reference database as a directory of Parquet tables and text models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.kernels.hmm import Profile
from reedbank.kernels.likelihood import Tree, node_heights
from reedbank.kernels.models import Model
from reedbank.sources.text_models import load_model, load_profile, save_model, save_profile

NODE = "id LONG, parent LONG, name STRING, length DOUBLE, is_leaf BOOLEAN, anno STRING, anno_dist DOUBLE, height DOUBLE, seq STRING"
PARTS = ("msa", "node", "kmer")


@dataclass
class Database:
    """msa (id, name, aln); node (NODE); kmer: the index; profile and model."""

    msa: DataFrame
    node: DataFrame
    kmer: DataFrame
    profile: Profile
    model: Model
    rates: np.ndarray | None = None

    def tree(self) -> tuple[Tree, list]:
        """The tree's arrays and node rows on the driver, by id; a reference tree is bounded (some 100,000 nodes)."""
        rows = self.node.orderBy("id").collect()
        codes = np.array([["ACGT".find(c) for c in r.seq] for r in rows], np.int8)
        tree = Tree(np.array([-1 if r.parent is None else r.parent for r in rows]), np.array([r.length or 0.0 for r in rows]), codes)
        return tree, rows

    def save(self, path: str) -> None:
        spark = self.node.sparkSession
        for part in PARTS:
            getattr(self, part).write.mode("overwrite").parquet(f"{path}/{part}")
        save_profile(spark, self.profile, f"{path}/profile")
        save_model(spark, self.model, f"{path}/model")
        rates = [float(x) for x in self.rates] if self.rates is not None else [1.0]
        spark.createDataFrame([(rates,)], "rates array<double>").coalesce(1).write.mode("overwrite").json(f"{path}/rates")


def load(spark: SparkSession, path: str) -> Database:
    rates = np.array(spark.read.schema("rates array<double>").json(f"{path}/rates").first().rates)
    tables = {p: spark.read.parquet(f"{path}/{p}") for p in PARTS}
    return Database(**tables, profile=load_profile(spark, f"{path}/profile"), model=load_model(spark, f"{path}/model"), rates=rates if len(rates) > 1 else None)


def node_table(spark: SparkSession, tree: Tree, names, annos, anno_dists, sequences: np.ndarray) -> DataFrame:
    letters = np.array(list("ACGT-"))
    heights = node_heights(tree)
    rows = [
        (i, None if p < 0 else int(p), names[i], float(tree.length[i]), tree.is_leaf(i), annos[i], anno_dists[i], float(heights[i]), "".join(letters[np.where(sequences[i] < 0, 4, sequences[i])]))
        for i, p in enumerate(tree.parent)
    ]
    return spark.createDataFrame(rows, NODE).withColumn("seq", F.col("seq"))
