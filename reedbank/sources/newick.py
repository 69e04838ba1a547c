"""Newick trees: text to nodes and back.

A tree is (name, length, children).  Ids count nodes as a stack visits them: the root is 0 and a node's last child comes first."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedbank.session import meet, spread

NODE = "id LONG, parent LONG, name STRING, length DOUBLE, is_leaf BOOLEAN"
_SPECIAL = set(" \t\n()[]':;,")


@dataclass
class Tree:
    name: str = ""
    length: float | None = None
    children: list = field(default_factory=list)


def parse(text: str) -> Tree:
    """One tree; names may be quoted, a quote in a quoted name is doubled, comments in brackets are skipped."""
    at, n = 0, len(text)

    def skip():
        nonlocal at
        while at < n and (text[at].isspace() or text[at] == "["):
            if text[at] == "[":
                at = text.index("]", at)
            at += 1

    def label() -> str:
        nonlocal at
        skip()
        if at < n and text[at] == "'":
            out, at = [], at + 1
            while True:
                if at >= n:
                    raise ValueError("a quoted name isn't closed")
                if text[at] == "'":
                    if text[at + 1 : at + 2] != "'":
                        break
                    at += 1
                out.append(text[at])
                at += 1
            at += 1
            return "".join(out)
        begin = at
        while at < n and text[at] not in "()[]':;,":
            at += 1
        return text[begin:at].strip()

    def tail(node: Tree) -> None:
        nonlocal at
        node.name = label()
        skip()
        if at < n and text[at] == ":":
            at += 1
            node.length = float(label())

    root = Tree()
    stack: list[Tree] = [root]
    while True:
        skip()
        if at < n and text[at] == "(":
            at += 1
            child = Tree()
            stack[-1].children.append(child)
            stack.append(child)
            continue
        tail(stack[-1])
        while True:
            skip()
            mark = text[at] if at < n else ";"
            at += 1
            if mark == ",":
                stack.pop()
                if not stack:
                    raise ValueError("a comma outside of parentheses")
                child = Tree()
                stack[-1].children.append(child)
                stack.append(child)
                break
            if mark == ")":
                stack.pop()
                if not stack:
                    raise ValueError("a parenthesis too much is closed")
                tail(stack[-1])
                continue
            if mark == ";":
                if len(stack) != 1:
                    raise ValueError("a parenthesis isn't closed")
                return root
            raise ValueError(f"unexpected {mark!r} at {at - 1}")


def flatten(tree: Tree) -> list[tuple]:
    """(id, parent, name, length, is_leaf) of all nodes, by id."""
    out, stack = [], [(tree, None)]
    while stack:
        node, parent = stack.pop()
        here = len(out)
        out.append((here, parent, node.name, node.length, not node.children))
        stack += [(c, here) for c in node.children]
    return out


#: A structural character and the label behind it: names in quotes (a doubled one is a quote), comments in brackets, anything else.
_SEGMENT = r"[(),;](?:'(?:[^']|'')*'|\[[^\]]*\]|[^'\[(),;])*"
_LABEL = r"^\s*('(?:[^']|'')*'|[^:']*?)\s*(?::\s*(\S*)\s*)?$"


def parse_table(trees: DataFrame, tree: str = "tree", text: str = "text") -> DataFrame:
    """(tree, id, parent, name, length, is_leaf) of all nodes of all trees, one text a row, without a parser's loop: a text is cut at its structural characters, a
    running sum of parentheses is the depth, a segment is a node unless an open parenthesis follows it, and its parent is the next segment that closes its depth.
    Ids are as flatten gives them: read from the end, the root comes first and a node's last child next.  Empty and null texts have no nodes; parentheses
    that don't match are an error."""
    cut = F.regexp_extract_all(F.concat(F.lit(","), F.trim(F.col(text))), F.lit(_SEGMENT), F.lit(0))
    rows = spread(trees.where(F.trim(F.col(text)) != "")).select(F.col(tree).alias("tree"), F.posexplode(cut).alias("at", "segment"))
    rows = rows.select("tree", "at", F.substring("segment", 1, 1).alias("mark"), F.regexp_replace(F.expr("substring(segment, 2)"), r"\[[^\]]*\]", "").alias("label"))
    whole = W.partitionBy("tree").orderBy("at")
    step = F.when(F.col("mark") == "(", 1).when(F.col("mark") == ")", -1).otherwise(0)
    rows = rows.withColumns({"depth": F.sum(step).over(whole), "next": F.lead("mark").over(whole)})
    # what follows the end mark isn't read
    ended = F.max(F.when(F.col("mark") == ";", 1).otherwise(0)).over(whole)
    rows = rows.withColumn("ended", ended).where("ended = 0")
    is_last = F.col("next").isNull() | (F.col("next") == ";")
    wrong = (F.col("depth") < 0) | (is_last & (F.col("depth") != 0)) | ((F.col("depth") == 0) & (F.col("next") == ","))
    rows = rows.withColumn("depth", F.when(wrong, F.raise_error(F.concat(F.lit("parentheses don't match in tree "), F.col("tree").cast("string"))).cast("long")).otherwise(F.col("depth")))
    nodes = rows.where((F.col("next") != "(") | F.col("next").isNull()).withColumn("id", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("at"))).cast("long") - 1)
    # a node at a depth belongs to the next closing parenthesis around it: both stand in one window of that depth
    level = F.col("depth") + F.when(F.col("mark") == ")", F.lit(1)).otherwise(0)
    inside = nodes.select("tree", "id", "at", "depth", F.lit(None).cast("long").alias("closes"))
    around = nodes.where("mark = ')'").select("tree", F.lit(None).cast("long").alias("id"), "at", level.alias("depth"), F.col("id").alias("closes"))
    ahead = W.partitionBy("tree", "depth").orderBy("at", F.col("id").isNotNull()).rowsBetween(W.currentRow, W.unboundedFollowing)
    parents = inside.unionByName(around).withColumn("parent", F.first("closes", ignorenulls=True).over(ahead)).where("id is not null").select("tree", "id", "parent")
    name = F.regexp_extract("label", _LABEL, 1)
    length = F.regexp_extract("label", _LABEL, 2)
    named = nodes.select("tree", "id", name.alias("name"), F.when(length != "", length.cast("double")).alias("length"), (F.col("mark") != ")").alias("is_leaf"))
    named = named.withColumn("name", F.when(F.startswith("name", F.lit("'")), F.replace(F.expr("substring(name, 2, length(name) - 2)"), F.lit("''"), F.lit("'"))).otherwise(F.col("name")))
    return meet(named, parents, ["tree", "id"]).select("tree", "id", "parent", "name", "length", "is_leaf")


def nodes_of(spark: SparkSession, tree: Tree) -> DataFrame:
    return spark.createDataFrame(flatten(tree), NODE)


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).toLocalIterator())
    return nodes_of(spark, parse(text))


def quote(name: str) -> str:
    return "'" + name.replace("'", "''") + "'" if set(name) & _SPECIAL else name


def build(rows) -> Tree:
    """A tree from (id, parent, name, length) rows; children by falling id, so that flatten numbers them as they were."""
    made = {r[0]: Tree(r[2] or "", r[3]) for r in rows}
    root = None
    for r in sorted(rows, key=lambda r: -r[0]):
        if r[1] is None:
            root = made[r[0]]
        else:
            made[r[1]].children.append(made[r[0]])
    if root is None:
        raise ValueError("no root")
    return root


def write(tree: Tree, suffix=lambda node: "") -> str:
    """Text of a tree; suffix adds to each node (edge marks of placement files, say).  No recursion, so deep trees are fine."""
    parts: dict[int, str] = {}
    stack = [(tree, False)]
    while stack:
        node, done = stack.pop()
        if node.children and not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children]
            continue
        inner = "(" + ",".join(parts.pop(id(c)) for c in node.children) + ")" if node.children else ""
        parts[id(node)] = inner + quote(node.name) + (f":{node.length:g}" if node.length is not None and node.length >= 0 else "") + suffix(node)
    return parts[id(tree)] + ";"
