"""Likelihoods on trees as tables, by parallel contraction: no tree and no message is held by one process.

A row is a node at a site.  In each round nodes that are known (at first the leaves) are raked: their messages go to parents that wait for two children or more and are added there, as sums of
logarithms by base, so a parent of very many children is summed before it is shuffled.  A node that waits for one child only is a linear function of it, a 4 x 4 matrix; such nodes are
compressed: each puts the function of the node that it points at into its own and points where that one does, so chains halve in a round.  Rounds are about as many as
the number of nodes has binary digits, however deep the tree is.  Every round is written, so a lost executor costs tasks of one round.

From the root downwards all functions are linear and known at once, so pointers double there alone.

Most nodes lie in small subtrees, and need no rounds: subtrees whose cells fit a task are taken as a whole, up once and, when the rest of the tree is known, down
once; only letters and messages at their tops are shuffled.  What is left above is a smaller tree, whose leaves have messages for letters, and is treated in the same way.
Trees of which too little would go (long chains) are contracted.

Messages are as in kernels.likelihood: a leaf's gap has the base frequencies, with several rates a node's message is the mean over rates.  Values are scaled to a
largest entry of 1, with the logarithm of the scale beside them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbank.kernels.forest import Forest, letter_messages
from reedbank.kernels.models import Model
from reedbank.operators import tree
from reedbank.session import meet, spread, stored

BASES = "ACGT"
FOUR = range(4)


def _num(x: float) -> str:
    return f"({float(x)!r}D)"


def _lin(weights, values) -> str:
    """Sum of weights times values, without those of weight 0."""
    return " + ".join(f"{_num(w)} * {v}" for w, v in zip(weights, values, strict=True) if w) or "0.0D"


def _array(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(values)})")


class Branches:
    """Expressions of a model's transition probabilities, for each of its rates.  They are written as SQL, as they have hundreds of terms."""

    def __init__(self, model: Model, rates=None):
        self.w, self.left, self.right = model.spectrum()
        self.rates = [1.0] if rates is None else [float(r) for r in rates]
        self.n = len(self.rates)

    def decays(self, length: str) -> Column:
        """The array that the others take as e."""
        return _array([f"exp({_num(w * r)} * {length})" for r in self.rates for w in self.w])

    def matrix(self, e: str, r: int, x: int, y: int) -> str:
        return f"greatest({_lin(self.left[x] * self.right[:, y], [f'{e}[{4 * r + k}]' for k in FOUR])}, 0.0D)"

    def turned(self, v: str) -> Column:
        """The array that through takes as t, of an array of four."""
        return _array([_lin(self.right[k], [f"{v}[{y}]" for y in FOUR]) for k in FOUR])

    def through(self, e: str, t: str) -> list[str]:
        """What t was made from after the branch, by rate and base."""
        return [f"greatest({_lin(self.left[x], [f'{e}[{4 * r + k}] * {t}[{k}]' for k in FOUR])}, 0.0D)" for r in range(self.n) for x in FOUR]

    def mean(self, values: list[str]) -> list[str]:
        """Over rates, by base."""
        return [f"({' + '.join(values[4 * r + x] for r in range(self.n))}) / {self.n}.0D" for x in FOUR]

    def function(self, e: str, d: str) -> list[str]:
        """The matrix by which a node follows from what is beyond branch e, with d (by rate and base) known of it."""
        return [f"({' + '.join(f'{d}[{4 * r + x}] * {self.matrix(e, r, x, y)}' for r in range(self.n))}) / {self.n}.0D" for x in FOUR for y in FOUR]


def _apply(a: str, v: str) -> list[str]:
    return ["(" + " + ".join(f"{a}[{4 * x + y}] * {v}[{y}]" for y in FOUR) + ")" for x in FOUR]


def _product(a: str, b: str) -> list[str]:
    return ["(" + " + ".join(f"{a}[{4 * x + k}] * {b}[{4 * k + y}]" for k in FOUR) + ")" for x in FOUR for y in FOUR]


def _scaled(df: DataFrame, name: str, values: list[str], scale: str, before: Column) -> DataFrame:
    """df with array name of values by their largest, whose logarithm is added to before as scale; null where the values are."""
    df = df.withColumn("_v", _array(values)).withColumn("_top", F.array_max("_v"))
    some = F.col("_top") > 0
    return df.withColumns({
        name: F.when(F.col("_top").isNotNull(), F.transform("_v", lambda x: F.when(some, x / F.col("_top")).otherwise(x))),
        scale: before + F.when(some, F.log("_top")).when(F.col("_top").isNotNull(), F.lit(0.0)),
    }).drop("_v", "_top")


def _exps(df: DataFrame) -> DataFrame:
    """df with d: exp of the logarithms g by their largest, top."""
    df = df.withColumn("top", F.array_max("g")).withColumn("top", F.when(F.col("top") > float("-inf"), F.col("top")).otherwise(0.0))
    return df.withColumn("d", F.transform("g", lambda x: F.exp(x - F.col("top"))))


def leaf_sites(aligned: DataFrame, seq_id: str = "id", seq: str = "aln") -> DataFrame:
    """(id, site, base): the letters of aligned rows, one a row."""
    return spread(aligned.select(seq_id, seq)).select(F.col(seq_id).alias("id"), F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("site", "base")).where("base <> ''").withColumn("site", F.col("site") + 1)


ROW = ("id", "site", "parent", "length", "k", "rest", "g", "gs", "a", "sa", "to", "l", "ls", "done")


def _start(nodes: DataFrame, sites: DataFrame, n_sites: int, model: Model, n_rates: int) -> DataFrame:
    """Leaves with their states; inner nodes that wait for k children, whose ids sum up to rest."""
    waits = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").cast("int").alias("k"), F.sum("id").alias("rest"))
    cells = spread(meet(nodes.select("id", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length")), waits, "id", "left"))
    cells = cells.withColumn("site", F.explode(F.sequence(F.lit(1), F.lit(n_sites))))
    none, zeros = F.lit(None).cast("array<double>"), F.array(*[F.lit(0.0)] * (4 * n_rates))
    inner = cells.where("k is not null").select(
        "id", "site", "parent", "length", "k", "rest", zeros.alias("g"), F.lit(0.0).alias("gs"), none.alias("a"), F.lit(0.0).alias("sa"), F.when(F.col("k") == 1, F.col("rest")).alias("to"), none.alias("l"), F.lit(0.0).alias("ls"), F.lit(None).cast("int").alias("done")
    )
    if "base" in sites.columns:
        own = F.coalesce("base", F.lit("-"))
        state, scale = F.array(*[F.when(own.isin(*BASES), (own == b).cast("double")).otherwise(F.lit(float(p))) for b, p in zip(BASES, model.pi, strict=True)]), F.lit(0.0)
    else:
        sites = sites.select("id", "site", F.col("l").alias("own"), F.col("ls").alias("own_s"))
        state, scale = F.col("own"), F.col("own_s")
    at = meet(cells.where("k is null"), sites, ["id", "site"], "left")
    leaves = at.select(
        "id", "site", "parent", "length", F.lit(0).alias("k"), F.lit(None).cast("long").alias("rest"), zeros.alias("g"), F.lit(0.0).alias("gs"), none.alias("a"), F.lit(0.0).alias("sa"), F.lit(None).cast("long").alias("to"), state.alias("l"), scale.alias("ls"), F.lit(0).alias("done")
    )
    return leaves.unionByName(inner).select(*ROW)


def _rake(now: DataFrame, rows: DataFrame, step: int, by: Branches) -> DataFrame:
    """rows (waiting for two children or more) with the messages of nodes that the last round has made known."""
    fresh = now.where((F.col("done") == step - 1) & F.col("parent").isNotNull()).withColumn("e", by.decays("length")).withColumn("t", by.turned("l"))
    size = 4 * by.n
    logs = [f"coalesce(ln({v}), double('-Infinity')) AS m{i}" for i, v in enumerate(by.through("e", "t"))]
    sent = fresh.selectExpr("parent AS id", "site", "id AS child", "ls", *logs)
    sent = sent.groupBy("id", "site").agg(F.count("*").cast("int").alias("came"), F.sum("child").alias("gone"), F.sum("ls").alias("more"), *[F.sum(f"m{i}").alias(f"m{i}") for i in range(size)])
    out = meet(rows, sent, ["id", "site"], "left")
    some = F.col("came").isNotNull()
    left = F.col("k") - F.coalesce("came", F.lit(0))
    out = out.withColumns({
        "g": F.when(some, _array([f"g[{i}] + m{i}" for i in range(size)])).otherwise(F.col("g")), "gs": F.col("gs") + F.coalesce("more", F.lit(0.0)),
        "rest": F.col("rest") - F.coalesce("gone", F.lit(0)), "k": left,
    }).withColumn("to", F.when(F.col("k") == 1, F.col("rest")))
    known = F.col("k") == 0
    out = _scaled(_exps(out), "made", by.mean([f"d[{i}]" for i in range(size)]), "made_s", F.col("gs") + F.col("top"))
    return out.withColumns({"l": F.when(known, F.col("made")), "ls": F.when(known, F.col("made_s")).otherwise(0.0), "done": F.when(known, F.lit(step))}).select(*ROW)


def _compress(seen: DataFrame, rows: DataFrame, step: int, by: Branches) -> DataFrame:
    """rows (waiting for one child) by the function of the node in seen that they point at: known, if that is; pointing farther, if that waits for one child as well."""
    of = seen.select(F.col("id").alias("to"), "site", F.col("length").alias("len2"), F.col("a").alias("a2"), F.col("sa").alias("sa2"), F.col("to").alias("to2"), F.col("l").alias("l2"), F.col("ls").alias("ls2"))
    out = _exps(meet(rows, of, ["to", "site"]).withColumn("e", by.decays("len2")))
    own = F.col("a").isNotNull()
    out = out.withColumn("f", F.when(own, F.col("a")).otherwise(_array(by.function("e", "d")))).withColumn("sf", F.when(own, F.col("sa")).otherwise(F.col("gs") + F.col("top")))
    out = _scaled(out, "made", _apply("f", "l2"), "made_s", F.col("sf") + F.col("ls2"))
    out = _scaled(out, "joined", _product("f", "a2"), "joined_s", F.col("sf") + F.col("sa2"))
    known, jump = F.col("l2").isNotNull(), F.col("a2").isNotNull()
    return out.withColumns({
        "l": F.when(known, F.col("made")), "ls": F.when(known, F.col("made_s")).otherwise(0.0), "done": F.when(known, F.lit(step)),
        "a": F.when(jump & ~known, F.col("joined")).otherwise(F.col("f")), "sa": F.when(jump & ~known, F.col("joined_s")).otherwise(F.col("sf")), "to": F.when(jump & ~known, F.col("to2")).otherwise(F.col("to")),
    }).select(*ROW)


def messages_up(nodes: DataFrame, sites: DataFrame, model: Model, rates=None) -> DataFrame:
    """(id, site, parent, length, l, ls): the likelihood of all leaves below each node by its state, l times exp(ls).

    nodes (id, parent, length), of any number of trees; sites (id, site from 1, base) of leaves, missing ones are gaps; or (id, site, l, ls) of all leaves."""
    by = Branches(model, rates)
    n_sites = sites.agg(F.coalesce(F.max("site"), F.lit(0))).first()[0]
    if not n_sites:
        raise ValueError("no leaf has a site")
    now = stored(_start(nodes, sites, n_sites, model, by.n), "tree_up")
    known, step = [now.where("done = 0")], 0
    while True:
        waiting = now.where("done is null")
        kinds = {r.one for r in waiting.select((F.col("k") == 1).alias("one")).distinct().collect()}
        if not kinds:
            break
        step += 1
        made = [_rake(now, waiting.where("k > 1"), step, by)] if False in kinds else []
        if True in kinds:
            # pointers may reach a node long after it has become known
            made.append(_compress(_union([waiting, *known]), waiting.where("k = 1"), step, by))
        now = stored(_union(made), "tree_up")
        known.append(now.where(F.col("done") == step))
    return _union(known).select("id", "site", "parent", "length", "l", "ls")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def site_loglik(up: DataFrame, model: Model) -> DataFrame:
    """(root, site, loglik) of each tree at each site."""
    total = F.expr(_lin(model.pi, [f"l[{x}]" for x in FOUR]))
    return up.where("parent is null").select(F.col("id").alias("root"), "site", (F.log(total) + F.col("ls")).alias("loglik"))


def messages_down(up: DataFrame, model: Model, rates=None) -> DataFrame:
    """(id, site, d, ds): what all leaves that aren't below a node say, as seen from it at its parent; the root has none."""
    by = Branches(model, rates)
    size = 4 * by.n
    own = up.where("parent is not null").withColumn("e", by.decays("length")).withColumn("t", by.turned("l"))
    own = own.select("id", "site", "parent", "ls", _array(by.through("e", "t")).alias("m"))
    finite, zero = (lambda i: f"coalesce(ln(m[{i}]), 0.0D)"), (lambda i: f"int(m[{i}] <= 0)")
    sums = own.groupBy("parent", "site").agg(F.sum("ls").alias("all_s"), *[F.expr(f"sum({of(i)}) AS {name}{i}") for i in range(size) for name, of in (("f", finite), ("z", zero))])
    rest = meet(own, sums, ["parent", "site"])
    # without a node's own message; zeros are counted, as they can't be divided out
    rest = rest.withColumn("g", _array([f"if(z{i} > {zero(i)}, double('-Infinity'), f{i} - {finite(i)})" for i in range(size)]))
    rest = _exps(rest)
    above = up.select(F.col("id").alias("parent"), "site", F.col("parent").alias("next"), F.col("length").alias("up_length"))
    rest = meet(rest, above, ["parent", "site"]).withColumn("e", by.decays("up_length")).withColumn("s", F.col("all_s") - F.col("ls") + F.col("top"))
    top = _scaled(rest.where("next is null"), "made", by.mean([f"d[{i}]" for i in range(size)]), "made_s", F.col("s"))
    inner = _scaled(rest.where("next is not null"), "b", by.function("e", "d"), "bs", F.col("s"))
    none, zero_, nowhere = F.lit(None).cast("array<double>"), F.lit(0.0), F.lit(None).cast("long")
    now = top.select("id", "site", nowhere.alias("to"), none.alias("b"), zero_.alias("bs"), F.col("made").alias("d"), F.col("made_s").alias("ds"), F.lit(0).alias("done")).unionByName(
        inner.select("id", "site", F.col("parent").alias("to"), "b", "bs", none.alias("d"), zero_.alias("ds"), F.lit(None).cast("int").alias("done"))
    )
    now = stored(now, "tree_down")
    known, step = [now.where("done = 0")], 0
    while now.where("done is null").take(1):
        step += 1
        of = _union([now.where("done is null"), *known]).select(F.col("id").alias("to"), "site", F.col("b").alias("b2"), F.col("bs").alias("bs2"), F.col("d").alias("d2"), F.col("ds").alias("ds2"), F.col("to").alias("to2"))
        out = meet(now.where("done is null"), of, ["to", "site"])
        out = _scaled(out, "made", _apply("b", "d2"), "made_s", F.col("bs") + F.col("ds2"))
        out = _scaled(out, "joined", _product("b", "b2"), "joined_s", F.col("bs") + F.col("bs2"))
        there = F.col("d2").isNotNull()
        out = out.withColumns({
            "d": F.when(there, F.col("made")), "ds": F.when(there, F.col("made_s")).otherwise(0.0), "done": F.when(there, F.lit(step)),
            "b": F.when(~there, F.col("joined")), "bs": F.when(~there, F.col("joined_s")).otherwise(0.0), "to": F.when(~there, F.col("to2")),
        })
        now = stored(out.select(*now.columns), "tree_down")
        known.append(now.where(F.col("done") == step))
    return _union(known).select("id", "site", "d", "ds")


def state_weights(up: DataFrame, down: DataFrame, model: Model, rates=None) -> DataFrame:
    """(id, site, wa, wc, wg, wt): how likely each base is at each node and site, given all leaves of its tree."""
    by = Branches(model, rates)
    both = meet(up.where("parent is not null"), down, ["id", "site"]).withColumn("e", by.decays("length")).withColumn("t", by.turned("d")).withColumn("o", _array(by.mean(by.through("e", "t"))))
    inner = both.selectExpr("id", "site", *[f"l[{x}] * o[{x}] AS p{x}" for x in FOUR])
    rows = inner.unionByName(up.where("parent is null").selectExpr("id", "site", *[f"l[{x}] AS p{x}" for x in FOUR]))
    total = F.expr("p0 + p1 + p2 + p3")
    # where leaves contradict each other over branches of no length nothing is known
    return rows.select("id", "site", *[F.when(total > 0, F.col(f"p{x}") / total).otherwise(0.25).alias(f"w{b}") for x, b in enumerate("acgt")])


def ancestral_states(weights: DataFrame) -> DataFrame:
    """(id, site, base, weight): the most likely base of each node, of equal ones (to nine digits) the first, and its weight."""
    near = [F.round(f"w{b}", 9) for b in "acgt"]
    best = F.greatest(*near)
    weight = F.greatest(*[f"w{b}" for b in "acgt"])
    base = F.when(near[0] == best, "A").when(near[1] == best, "C").when(near[2] == best, "G").otherwise("T")
    return weights.select("id", "site", base.alias("base"), weight.alias("weight"))


def letters(states: DataFrame) -> DataFrame:
    """(id, seq): the states of each node as a sequence."""
    return states.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("site", "base"))), lambda x: x["base"]), "").alias("seq"))


#: Sites that are taken together; cells (nodes at sites) of the largest subtree that is taken as a whole, of a forest in memory, and of a task.
SITES_A_BLOCK, CELLS_A_SUBTREE, CELLS_A_FOREST, CELLS_A_TASK = 64, 1 << 17, 1 << 18, 1 << 19


def side_by_side(sites: DataFrame) -> DataFrame:
    """(id, seq): the letters (id, site, base) of leaves in a row, missing ones as gaps."""
    listed = sites.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("site", F.coalesce("base", F.lit("-")).alias("base")))).alias("listed"))
    before = lambda i: F.coalesce(F.get("listed", i - 1)["site"], F.lit(0))
    return listed.select("id", F.array_join(F.transform("listed", lambda x, i: F.concat(F.repeat(F.lit("-"), x["site"] - before(i) - 1), x["base"])), "").alias("seq"))


class Subtrees:
    """A tree in levels: rows of subtrees that tasks take as a whole, with what leaves say at their tops; then of the tree above those; and so on.

    leaves: (id, site from 1, base), or (id, seq) with all letters in a row."""

    def __init__(self, nodes: DataFrame, leaves: DataFrame, model: Model, rates=None):
        self.model, self.rates, self.kind = model, rates, nodes.schema["id"].dataType
        self.letters = leaves if "seq" in leaves.columns else side_by_side(leaves)
        self.sites = self.letters.agg(F.coalesce(F.max(F.length("seq")), F.lit(0))).first()[0]
        if not self.sites:
            raise ValueError("no leaf has a site")
        self.width = min(SITES_A_BLOCK, self.sites)
        self.blocks = -(-self.sites // self.width)
        most = max(1, CELLS_A_SUBTREE // self.width)
        nodes = nodes.select(F.col("id").cast("long").alias("id"), F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
        start = F.col("block") * self.width + 1
        own = self.letters.select(F.col("id").cast("long").alias("id"), "seq", self._each_block()).select("id", "block", F.substring("seq", start, F.lit(self.width)).alias("seq"), *[F.lit(None).cast("array<double>").alias(c) for c in ("l", "ls")])
        #: Rows and number of tasks of each level, the tops' messages of each, and what is left to be contracted: a tree, with messages of its leaves on all levels but the first.
        self.levels, self.tops, self.rest = [], [], None
        while True:
            n = nodes.count()
            tasks = max(1, -(-n * self.sites // CELLS_A_TASK))
            if n <= most:
                self._add(nodes.withColumn("top", F.lit(0).cast("long")), own, tasks)
                return
            of = stored(tree.subtrees(nodes, most), "subtrees")
            above = of.where("top is null or top = id").select("id", "parent", "length")
            if 2 * above.count() > n:
                self.rest = nodes, own
                return
            self._add(of.where("top is not null"), own, tasks)
            nodes, own = above, self.tops[-1].select("id", "block", F.lit(None).cast("string").alias("seq"), "l", "ls")

    def _each_block(self) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")

    def _add(self, nodes: DataFrame, own: DataFrame, tasks: int) -> None:
        rows = stored(meet(nodes.select("*", self._each_block()), own, ["id", "block"], "left"), "tree_rows")
        self.levels.append((rows, tasks))
        self.tops.append(stored(self._run(rows, tasks, "up"), "tree_tops"))

    def _run(self, rows: DataFrame, tasks: int, what: str) -> DataFrame:
        """Forests of whole subtrees, one after the other.  up: (id, block, parent, l, ls) of the tops; down: (id, block, inner, d, w) of the nodes, w having all weights of a block; long: their weights by
        site.  Nodes whose tops have neither d nor a place at a root are left out."""
        model, rates, width, sites = self.model, self.rates, self.width, self.sites

        def run(batches):
            import pyarrow as pa

            for table in _whole(batches, max(1, CELLS_A_FOREST // width)):
                column = {name: table.column(name).combine_chunks() for name in table.column_names}
                ids, block, length = (column[c].to_numpy(zero_copy_only=False) for c in ("id", "block", "length"))
                root = column["parent"].is_null().to_numpy(zero_copy_only=False)
                forest = Forest(_places(ids, block, column["parent"].fill_null(0).to_numpy(zero_copy_only=False), ~root), length, model, rates)
                l, ls = letter_messages(column["seq"].to_pylist(), width, model), np.zeros((len(ids), width))  # noqa: E741
                given = column["l"].is_valid().to_numpy(zero_copy_only=False)
                l[given], ls[given] = column["l"].flatten().to_numpy().reshape(-1, width, 4), column["ls"].flatten().to_numpy().reshape(-1, width)
                l, ls = forest.up(l, ls)  # noqa: E741
                n, order = forest.bounds[1], forest.order
                if what == "up":
                    at = order[:n]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(block[at]), column["parent"].take(pa.array(at)), _lists(l[:n]), _lists(ls[:n])], names=["id", "block", "parent", "l", "ls"])
                    continue
                d, known = np.ones((len(ids), width, 4)), column["d"].is_valid().to_numpy(zero_copy_only=False)
                d[known] = column["d"].flatten().to_numpy().reshape(-1, width, 4)
                d, weights, known = forest.down(l, d, root, known | root)
                ids, block, root = ids[order], block[order], root[order]
                if what == "down":
                    inner = np.isin(np.arange(len(ids)), forest.parent)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[known]), pa.array(block[known]), pa.array(inner[known]), _lists(d[known], root[known]), _lists(weights[known])], names=["id", "block", "inner", "d", "w"])
                    continue
                site = block[:, None] * width + np.arange(width) + 1
                some = known[:, None] & (site <= sites)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], site.shape)[some]), pa.array(site[some].astype(np.int32)), *[pa.array(weights[..., x][some]) for x in FOUR]], names=["id", "site", "wa", "wc", "wg", "wt"])

        of = {
            "up": "id long, block int, parent long, l array<double>, ls array<double>",
            "down": "id long, block int, inner boolean, d array<double>, w array<double>",
            "long": "id long, site int, wa double, wc double, wg double, wt double",
        }
        return rows.repartition(tasks, "top", "block").sortWithinPartitions("top", "block").mapInArrow(run, of[what])

    def _by_site(self, rows: DataFrame) -> DataFrame:
        """rows of blocks with at, the place of each site that there is, and site."""
        site = F.col("block") * self.width + F.col("at") + 1
        return rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(self.width - 1)))).withColumn("site", site).where(F.col("site") <= self.sites)

    def _contracted(self) -> DataFrame:
        """Messages of the tree that is left."""
        nodes, own = self.rest
        if self.levels:
            sites = self._by_site(own).selectExpr("id", "site", "slice(l, 4 * at + 1, 4) AS l", "ls[at] AS ls")
        else:
            sites = leaf_sites(self.letters, seq="seq")
        return messages_up(nodes, sites, self.model, self.rates)

    def at_roots(self) -> DataFrame:
        """(id, site, parent, l, ls) of the roots."""
        if self.rest:
            return self._contracted().where("parent is null").select("id", "site", "parent", "l", "ls")
        return self._by_site(self.tops[-1].where("parent is null")).selectExpr("id", "site", "parent", "slice(l, 4 * at + 1, 4) AS l", "ls[at] AS ls")

    def weights(self) -> DataFrame:
        """(id, site, wa, wc, wg, wt) of all nodes."""
        out, beyond, levels = [], None, list(self.levels)
        if self.rest:
            up = stored(self._contracted(), "tree_messages")
            down = messages_down(up, self.model, self.rates)
            weights = state_weights(up, down, self.model, self.rates)
            if levels:
                tops = self.tops[-1].select("id").distinct()
                out.append(meet(weights, tops, "id", "left_anti"))
                beyond = self._in_blocks(meet(down, tops, "id", "left_semi"))
            else:
                out.append(weights)
        while levels:
            rows, tasks = levels.pop()
            rows = rows.withColumn("d", F.lit(None).cast("array<double>")) if beyond is None else meet(rows, beyond, ["id", "block"], "left")
            if not levels:
                out.append(self._run(rows, tasks, "long"))
                break
            made = stored(self._run(rows, tasks, "down"), "tree_beyond")
            out.append(self._by_site(made.where("inner")).selectExpr("id", "site", *[f"w[4 * at + {x}] AS w{b}" for x, b in enumerate("acgt")]))
            beyond = made.where("not inner").select("id", "block", "d")
        return _union(out).withColumn("id", F.col("id").cast(self.kind))

    def _in_blocks(self, down: DataFrame) -> DataFrame:
        """(id, block, d) of (id, site, d)."""
        block = F.floor((F.col("site") - 1) / self.width).cast("int")
        rows = down.groupBy("id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("site", "d"))).alias("x"))
        d = F.flatten(F.transform("x", lambda x: x["d"]))
        return rows.select("id", "block", F.concat(d, F.array_repeat(F.lit(1.0), F.lit(4 * self.width) - F.size(d))).alias("d"))


def _whole(batches, most: int):
    """Tables of about so many rows or more, that end where a block of sites of a subtree does."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        top, block = (table.column(c).to_numpy() for c in ("top", "block"))
        begin = np.flatnonzero((top[1:] != top[:-1]) | (block[1:] != block[:-1])) + 1
        if not len(begin):
            continue
        # pieces of about that size, each ending before the first row of a subtree
        ends = np.unique(begin[np.minimum(np.searchsorted(begin, np.arange(most, n + most, most)), len(begin) - 1)])
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
            yield table.slice(a, b - a)
        held, n = table.slice(ends[-1]).to_batches(), n - int(ends[-1])
    if n:
        yield pa.Table.from_batches(held)


def _places(ids: np.ndarray, block: np.ndarray, parent: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Where the row of each row's parent for the same block is, -1 where there is none."""
    order = np.lexsort((ids, block))
    begin = np.searchsorted(block[order], block, "left")
    end = np.searchsorted(block[order], block, "right")
    out = np.full(len(ids), -1)
    for b in np.unique(block):
        of = np.flatnonzero(block == b)
        mine = order[begin[of[0]] : end[of[0]]]
        at = np.minimum(np.searchsorted(ids[mine], parent[of]), len(mine) - 1)
        out[of] = np.where(has[of] & (ids[mine][at] == parent[of]), mine[at], -1)
    return out


def _lists(values: np.ndarray, none: np.ndarray | None = None):
    import pyarrow as pa

    each = int(np.prod(values.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * each, pa.int32()), pa.array(values.reshape(-1)), mask=None if none is None else pa.array(none))


def root_messages(nodes: DataFrame, leaves: DataFrame, model: Model, rates=None) -> DataFrame:
    """(id, site, parent, l, ls) of the roots, as messages_up has them; leaves as for weights_of."""
    return Subtrees(nodes, leaves, model, rates).at_roots()


def weights_of(nodes: DataFrame, leaves: DataFrame, model: Model, rates=None) -> DataFrame:
    """State weights of all nodes, in one pass up and one down; leaves: (id, site from 1, base), or (id, seq) with all letters in a row."""
    return Subtrees(nodes, leaves, model, rates).weights()
