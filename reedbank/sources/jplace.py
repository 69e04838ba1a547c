"""Placements as jplace JSON, version 3."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank import __version__
from reedbank.operators.assignment import jplace_columns, join_edges
from reedbank.sources.newick import build, write

#: The format's field names.
FIELDS = ("edge_num", "likelihood", "like_weight_ratio", "distal_length", "proximal_length", "pendant_length")


def placements(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, *FIELDS) of assigned reads whose branch is one of the tree's."""
    joined = join_edges(assignments.where("branch_id is not null"), edges).where("edge_id >= 0")
    more = jplace_columns(F.col("branch_ratio"), F.col("length"), F.col("anno_dist"), F.col("Q_placement"))
    columns = {"edge_num": F.col("edge_id"), "likelihood": F.col("loglik")} | more
    return joined.select(F.col("id").alias("name"), *[columns[f].cast("double" if f != "edge_num" else "long").alias(f) for f in FIELDS])


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): a JSON object for each read."""
    numbers = F.array(*[F.col(f).cast("double") for f in FIELDS])
    return rows.select(F.to_json(F.struct(F.array(numbers).alias("p"), F.array("name").alias("n"))).alias("value"))


def tree_text(rows: list[tuple]) -> str:
    """Newick of (id, parent, name, length) rows with {edge number} behind each branch."""
    number = {}
    tree = build(rows)
    stack = [(tree, None)]
    by_id = sorted(rows, key=lambda r: r[0])
    order = iter(by_id)
    while stack:
        node, _ = stack.pop()
        number[id(node)] = next(order)[0]
        stack += [(c, node) for c in node.children]
    return write(tree, lambda n: f"{{{number[id(n)]}}}")


def document(tree: str, rows: DataFrame, metadata: dict | None = None):
    """Lines of the whole document; placements come from the executors one by one."""
    yield '{"version": 3, "tree": ' + json.dumps(tree) + ', "fields": ' + json.dumps(list(FIELDS)) + ', "metadata": ' + json.dumps({"software": f"reedbank {__version__}"} | (metadata or {})) + ', "placements": ['
    before = ""
    for r in json_rows(rows).toLocalIterator():
        yield before + r.value
        before = ","
    yield "]}"
