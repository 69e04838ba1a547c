"""Queries of trees as tables, and of what substitution models are trained from."""

from pyspark.sql import functions as F

from reedbank.functions import numeric
from reedbank.operators import substitution, tree
from reedbank.plans.fixtures import fx_aln, fx_node, fx_seq, table, with_
from reedbank.plans.registry import query
from reedbank.session import meet

N = with_("fx_node")
R = with_("fx_node", recursive=True)
_UP = """up(start, node, depth, distance) AS (SELECT id, id, 0, 0.0::DOUBLE FROM fx_node WHERE {} UNION ALL SELECT u.start, n.parent, u.depth + 1, u.distance + n.length FROM up u JOIN fx_node n ON n.id = u.node WHERE n.parent IS NOT NULL)"""
_LEAF = "id NOT IN (SELECT parent FROM fx_node WHERE parent IS NOT NULL)"


#: Each inner node with two levels below it.
_LOCAL = """b AS (SELECT p.id AS tree, p.id AS node, []::BIGINT[] AS way FROM fx_node p UNION ALL SELECT c.parent, c.id, [-c.id] FROM fx_node c WHERE c.parent IS NOT NULL
  UNION ALL SELECT c.parent, g.id, [-c.id, -g.id] FROM fx_node c JOIN fx_node g ON g.parent = c.id WHERE c.parent IS NOT NULL),
i AS (SELECT tree, node, way, row_number() OVER (PARTITION BY tree ORDER BY way) - 1 AS id FROM b)"""


@query(f"""{N}, {_LOCAL} SELECT i.tree, i.id, u.id AS parent, CASE WHEN n.id % 3 = 0 THEN n.name || ' it''s' ELSE 'n' || n.id END AS name, CASE WHEN n.id % 5 > 0 THEN n.length END AS length,
NOT EXISTS (SELECT 1 FROM i c WHERE c.tree = i.tree AND len(c.way) = len(i.way) + 1 AND c.way[1:len(i.way)] = i.way) AS is_leaf
FROM i JOIN fx_node n ON n.id = i.node LEFT JOIN i u ON u.tree = i.tree AND len(i.way) > 0 AND u.way = i.way[1:len(i.way) - 1]""")
def newick_flatten(spark, d):
    """Newick texts of each node with two levels below it, back to nodes; names in quotes, blanks, comments and branches without a length."""
    from reedbank.sources.newick import parse_table

    nodes = fx_node(spark, d)
    odd = F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit(" it''s' [note, (a)]"))
    own = F.concat(F.when(F.col("id") % 3 == 0, odd).otherwise(F.concat(F.lit(" n"), F.col("id").cast("string"))), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" : "), F.col("length").cast("string"))).otherwise(""))
    own = nodes.select("id", "parent", own.alias("text"))

    def around(below):
        """Each node's text with those below it (parent, text) in parentheses."""
        kids = below.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("kids"))
        inner = F.concat(F.lit("("), F.array_join(F.transform("kids", lambda k: k["text"]), ", "), F.lit(")"))
        return meet(own, kids, "id", "left").select("id", "parent", F.concat(F.coalesce(inner, F.lit("")), "text").alias("text"))

    return parse_table(around(around(own)).select(F.col("id").alias("tree"), F.concat("text", F.lit(";")).alias("text")))


@query("WITH " + with_("fx_node", "fx_aln")[5:] + f" SELECT n.id, aln, aln IS NOT NULL AS found FROM fx_node n LEFT JOIN (SELECT * FROM fx_aln WHERE id % 5 <> 0) a ON a.id = n.id WHERE n.{_LEAF}")
def leaf_msa_join(spark, d):
    rows = fx_aln(spark, d).where("id % 5 <> 0")
    return tree.leaves(fx_node(spark, d)).select("id").join(rows, "id", "left").select("id", "aln", F.col("aln").isNotNull().alias("found"))


@query(f"{N}, a AS (SELECT p_brand || '|' || p_type AS name, p_name AS anno, p_partkey AS line FROM part WHERE p_size % 2 = 0), l AS (SELECT name, arg_max(anno, line) AS anno FROM a GROUP BY name) SELECT id, parent, length, name, coalesce(anno, name) AS anno FROM fx_node LEFT JOIN l USING (name)")
def annotate_join(spark, d):
    lines = table(spark, d, "part").where("p_size % 2 = 0").select(F.concat_ws("|", "p_brand", "p_type").alias("name"), F.col("p_name").alias("anno"), F.col("p_partkey").alias("line"))
    return tree.annotate(fx_node(spark, d), lines).select("id", "parent", "length", "name", "anno")


@query(f"{R}, {_UP.format('true')}, h AS (SELECT start, depth, node, distance FROM up WHERE node % 10 = 1 QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth) = 1) SELECT start AS id, node AS anno_id, round(distance, 9) AS anno_dist FROM h")
def annotate_path(spark, d):
    nodes = fx_node(spark, d).withColumn("anno", F.when(F.col("id") % 10 == 1, F.concat(F.lit("g__n"), F.col("id").cast("string"))).otherwise("x"))
    return tree.annotation_paths(nodes).withColumn("anno_dist", F.round("anno_dist", 9))


@query(f"{N} SELECT id, name FROM fx_node WHERE {_LEAF}")
def tree_leaf_antijoin(spark, d):
    return tree.leaves(fx_node(spark, d)).select("id", "name")


@query(f"{N} SELECT parent AS id FROM fx_node WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and({_LEAF})")
def tree_tips(spark, d):
    return tree.tips(fx_node(spark, d))


@query(f"""{R}, {_UP.format('id = 77')}, w AS (SELECT u.node AS id, n.parent AS op, n.length AS ol FROM up u JOIN fx_node n ON n.id = u.node), b AS (SELECT op AS id, id AS np, ol AS nl FROM w WHERE op IS NOT NULL)
SELECT n.id, CASE WHEN w.id IS NOT NULL THEN b.np ELSE n.parent END AS parent, round(CASE WHEN w.id IS NOT NULL THEN coalesce(b.nl, 0) ELSE n.length END, 9) AS length FROM fx_node n LEFT JOIN w ON w.id = n.id LEFT JOIN b ON b.id = n.id""")
def tree_reroot(spark, d):
    return tree.reroot(fx_node(spark, d), 77).withColumn("length", F.round("length", 9))


@query(f"{N} SELECT parent, min(id) AS first_child, max(id) AS last_child, count(*) AS n_children FROM fx_node WHERE parent IS NOT NULL GROUP BY parent")
def first_last_child(spark, d):
    return tree.first_last_child(fx_node(spark, d))


@query(f"{N} SELECT parent, min(id) AS a, max(id) AS b FROM fx_node WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2")
def sibling_pairs(spark, d):
    return tree.sibling_pairs(fx_node(spark, d))


@query(f"{R}, {_UP.format(_LEAF)} SELECT node AS id, round(min(distance), 9) AS height FROM up GROUP BY node")
def node_height(spark, d):
    return tree.heights(fx_node(spark, d)).withColumn("height", F.round("height", 9))


@query(f"{R}, {_UP.format(_LEAF)} SELECT node AS id, min(start) AS first_leaf, max(start) AS last_leaf, count(*) AS n_leaves FROM up GROUP BY node")
def leaves_below(spark, d):
    return tree.leaves_below(fx_node(spark, d))


@query(f"{R}, {_UP.format('id % 97 = 0')} SELECT DISTINCT node AS id FROM up")
def ancestor_closure(spark, d):
    nodes = fx_node(spark, d)
    return tree.ancestor_closure(nodes, nodes.where("id % 97 = 0"))


@query(f"{R}, {_UP.format('id % 97 = 0')}, c AS (SELECT DISTINCT node AS id FROM up) SELECT id, parent, length FROM fx_node WHERE parent IS NULL OR parent IN (SELECT parent FROM fx_node WHERE id IN (SELECT id FROM c) AND parent IS NOT NULL)")
def otu_tree_closure(spark, d):
    nodes = fx_node(spark, d)
    return tree.pruned(nodes, nodes.where("id % 97 = 0"))


@query(f"{N}, z AS (SELECT id, parent, CASE WHEN id % 3 = 0 THEN 0 ELSE length END AS length FROM fx_node) SELECT id, parent, CASE WHEN {_LEAF} AND length <= 0 THEN 1e-5::DOUBLE ELSE length END AS length FROM z")
def fix_branch_length(spark, d):
    nodes = fx_node(spark, d).withColumn("length", F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("length")))
    return tree.fix_lengths(nodes).select("id", "parent", "length")


@query(f"{N} SELECT count(*) AS n_nodes, 2 * count(parent) AS n_edges, count(*) FILTER (parent IS NULL) AS n_roots, count(*) FILTER ({_LEAF}) AS n_leaves FROM fx_node")
def inspect_summary(spark, d):
    return tree.summary(fx_node(spark, d))


_SIB = "sb AS (SELECT parent, min(id) AS a, max(id) AS b FROM fx_node WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2)"
_SNODE = with_("fx_node", "fx_seq")
_I = "LATERAL (SELECT unnest(range(1, 33))::INT AS i)"
_PAIRS = f"{_SIB}, t AS (SELECT substr(x.seq, i, 1) AS from_base, substr(y.seq, i, 1) AS to_base, count(*) AS n FROM sb JOIN fx_seq x ON x.id = a JOIN fx_seq y ON y.id = b, {_I} GROUP BY ALL)"


def _pairs(spark, d):
    return substitution.sibling_sequences(tree.sibling_pairs(fx_node(spark, d)), fx_seq(spark, d))


@query(f"{_SNODE}, {_PAIRS} SELECT * FROM t")
def sibling_transitions(spark, d):
    return substitution.transitions_of_pairs(substitution.pair_sites(_pairs(spark, d), "seq_a", "seq_b"))


@query(f"""{_SNODE}, {_SIB}, x AS (SELECT substr(o.seq, i, 1) AS o, substr(x.seq, i, 1) AS p, substr(y.seq, i, 1) AS q FROM sb JOIN fx_seq o ON o.id = parent JOIN fx_seq x ON x.id = a JOIN fx_seq y ON y.id = b, {_I}),
z AS (SELECT CASE WHEN o = p OR o = q THEN o WHEN p = q THEN p END AS from_base, p, q FROM x) SELECT from_base, to_base, count(*) AS n FROM (SELECT from_base, unnest([p, q]) AS to_base FROM z WHERE from_base IS NOT NULL) GROUP BY ALL""")
def triplet_transitions(spark, d):
    outer = fx_seq(spark, d).select(F.col("id").alias("parent"), F.col("seq").alias("seq_o"))
    return substitution.transitions_of_triplets(substitution.pair_sites(_pairs(spark, d).join(outer, "parent"), "seq_o", "seq_a", "seq_b"))


@query(f"""{_SNODE}, {_PAIRS}, c AS (SELECT n, from_base || to_base IN ('AG','GA','CT','TC') AS ti FROM t WHERE from_base <> to_base)
SELECT sum(n) FILTER (ti)::BIGINT AS n_transitions, sum(n) FILTER (NOT ti)::BIGINT AS n_transversions, round(sum(n) FILTER (ti)::DOUBLE / sum(n) FILTER (NOT ti)::DOUBLE, 9) AS ratio FROM c""")
def titv_ratio(spark, d):
    counts = substitution.transitions_of_pairs(substitution.pair_sites(_pairs(spark, d), "seq_a", "seq_b"))
    return substitution.titv(counts).withColumn("ratio", F.round("ratio", 9))


_MUT = f"m AS (SELECT i AS site, count(*) FILTER (substr(x.seq, i, 1) <> substr(y.seq, i, 1)) AS n_mutations FROM fx_node n JOIN fx_seq x ON x.id = n.id JOIN fx_seq y ON y.id = n.parent, {_I} GROUP BY i)"


def _mutations(spark, d):
    up = fx_node(spark, d).where("parent is not null").select(F.col("parent"), F.col("id").alias("a"), F.col("parent").alias("b"))
    return substitution.mutations_by_site(substitution.sibling_sequences(up, fx_seq(spark, d)))


@query(f"{_SNODE}, {_MUT} SELECT * FROM m")
def site_mutations(spark, d):
    return _mutations(spark, d)


@query(f"{_SNODE}, {_MUT}, k AS (SELECT n_mutations % 13 AS n FROM m) SELECT round(CASE WHEN var_samp(n) > avg(n) THEN avg(n) * avg(n) / (var_samp(n) - avg(n)) END, 9) AS alpha FROM k")
def gamma_shape_moment(spark, d):
    return _mutations(spark, d).select((F.col("n_mutations") % 13).alias("n")).agg(F.round(numeric.gamma_shape_by_moments(F.col("n")), 9).alias("alpha"))
