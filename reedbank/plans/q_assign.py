"""Queries of assignments and placement windows."""

from pyspark.sql import functions as F

from reedbank.functions import numeric, taxon
from reedbank.operators import assignment, placement
from reedbank.plans.fixtures import fx_assign, fx_node, fx_place, table, with_
from reedbank.plans.registry import query

A, P = with_("fx_assign"), with_("fx_place")


def _clean(c, digits=6):
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


@query("SELECT l_orderkey AS id, l_linenumber AS seq_start, l_quantity AS cost, l_shipmode_ AS anno FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_ FROM lineitem)")
def scan_assignment(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.concat("l_returnflag", "l_linestatus")).alias("line"))
    return assignment.parse_lines(lines, "line", "id LONG, seq_start INT, cost DOUBLE, anno STRING")


@query(f"{A} SELECT sample, taxon_id, q_taxon FROM fx_assign WHERE taxon_id >= 0 AND q_taxon >= 50")
def assign_filter(spark, d):
    return assignment.filter_by_quality(fx_assign(spark, d), 50)


@query("WITH " + with_("fx_assign", "fx_node")[5:] + " SELECT sample, taxon_id, name, parent FROM fx_assign JOIN fx_node ON taxon_id = id")
def assign_taxon_join(spark, d):
    return assignment.join_taxa(fx_assign(spark, d), fx_node(spark, d)).select("sample", "taxon_id", "name", "parent")


@query("SELECT s_name AS sample, l_partkey AS taxon_id, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def sample_rename_join(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("taxon_id"))
    named = assignment.rename_samples(rows, table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_name").alias("sample")))
    return named.groupBy("sample", "taxon_id").agg(F.count("*").alias("n"))


def _branches(spark, d):
    items = table(spark, d, "lineitem")
    child = F.col("l_partkey") + 1
    parent = F.when(F.col("l_linenumber") == 7, child + 1).otherwise(F.floor(child / 2))
    return items.select("l_orderkey", "l_linenumber", taxon.branch_id(child, parent).alias("branch_id"), (F.col("l_discount") * 5).alias("ratio"), (F.col("l_tax") * 1000).alias("q"))


_BRANCH = "b AS (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS child, CASE WHEN l_linenumber = 7 THEN l_partkey + 2 ELSE (l_partkey + 1) // 2 END AS parent, l_discount * 5 AS ratio, l_tax * 1000 AS q FROM lineitem)"


def _edges(spark, d):
    up = fx_node(spark, d).where("parent is not null").select(F.col("id").alias("u"), F.col("parent").alias("v"), "length")
    return up


@query(f"WITH {with_('fx_node')[5:]}, {_BRANCH} SELECT l_orderkey, l_linenumber, child, b.parent, coalesce(length, -1) AS length, CASE WHEN length IS NULL THEN -1 ELSE child END AS edge_id FROM b LEFT JOIN fx_node n ON n.id = child AND n.parent = b.parent")
def edge_join(spark, d):
    return assignment.join_edges(_branches(spark, d), _edges(spark, d)).select("l_orderkey", "l_linenumber", "child", "parent", F.coalesce("length", F.lit(-1.0)).alias("length"), "edge_id")


@query(f"WITH {_BRANCH} SELECT l_orderkey, l_linenumber, child || '->' || parent AS branch_id, child, parent FROM b")
def branch_id_parse(spark, d):
    child, parent = taxon.parse_branch_id(F.col("branch_id"))
    return _branches(spark, d).select("l_orderkey", "l_linenumber", "branch_id", child.alias("child"), parent.alias("parent"))


@query(f"""WITH {with_('fx_node')[5:]}, {_BRANCH} SELECT l_orderkey, l_linenumber, child AS edge_num, round(length * ratio, 6) + 0.0 AS distal_length, round(length * (1 - ratio), 6) + 0.0 AS proximal_length,
round(1.5 - CASE WHEN ratio <= 0.5 THEN length * ratio ELSE length * (1 - ratio) END, 6) + 0.0 AS pendant_length, round(1 - pow(10.0, -q / 10), 6) + 0.0 AS like_weight_ratio FROM b JOIN fx_node n ON n.id = child AND n.parent = b.parent""")
def jplace_rows(spark, d):
    joined = assignment.join_edges(_branches(spark, d), _edges(spark, d)).where("edge_id >= 0")
    columns = assignment.jplace_columns(F.col("ratio"), F.col("length"), F.lit(1.5), F.col("q"))
    return joined.select("l_orderkey", "l_linenumber", F.col("edge_id").alias("edge_num"), *[_clean(c).alias(k) for k, c in columns.items()])


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 7 <> l_suppkey % 7 AND l_discount - l_tax > 0.02) AS is_chimera FROM lineitem")
def chimera_split(spark, d):
    flag = assignment.is_chimera(F.col("l_partkey") % 7, F.col("l_suppkey") % 7, F.col("l_discount") - F.col("l_tax"), 0.02)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", flag.alias("is_chimera"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey <= l_suppkey * 20 AND l_partkey + l_quantity <= l_suppkey * 20 + 30) AS in_order FROM lineitem")
def orientation_check(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey") * 20
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", assignment.in_order((p, p + F.col("l_quantity")), (s, s + 30)).alias("in_order"))


@query("""SELECT count(*) FILTER (l_discount < l_tax) AS n_forward, count(*) FILTER (l_discount > l_tax) AS n_reverse,
CASE WHEN count(*) FILTER (l_discount < l_tax) >= 0.9 * count(*) FILTER (l_discount <> l_tax) THEN 1 WHEN count(*) FILTER (l_discount > l_tax) >= 0.9 * count(*) FILTER (l_discount <> l_tax) THEN 2 ELSE 0 END AS strand FROM lineitem""")
def strand_vote(spark, d):
    return assignment.strand_vote(table(spark, d, "lineitem").select(F.col("l_discount").alias("cost_fwd"), F.col("l_tax").alias("cost_rev")))


@query("SELECT o_orderkey AS ordinal, o_orderstatus AS forward, c_name AS reverse FROM orders JOIN customer ON o_orderkey = c_custkey")
def paired_zip_join(spark, d):
    forward = table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("forward"))
    return assignment.zip_pairs(forward, table(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("reverse")))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber <= l_quantity AND l_suppkey <= l_partkey AND length(l_returnflag) > 0")
def alignment_valid(spark, d):
    ok = assignment.is_valid_alignment(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_returnflag"))
    return table(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber", "l_partkey")


_Q = f"""{P}, e AS (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY read)) AS e FROM fx_place), t AS (SELECT *, sum(e) OVER (PARTITION BY read) AS t, sum(e) OVER (PARTITION BY read, taxon) AS x FROM e)
SELECT read, node, taxon, round(CASE WHEN t - e <= 1e-12 THEN 250 ELSE least(250, -10 * log10((t - e) / t)) END, 4) + 0.0 AS q_placement, round(CASE WHEN t - x <= 1e-12 THEN 250 ELSE least(250, -10 * log10((t - x) / t)) END, 4) + 0.0 AS q_taxon FROM t"""


@query(_Q)
def qvalues(spark, d):
    out = placement.posteriors(fx_place(spark, d))
    return out.select("read", "node", "taxon", _clean("q_placement", 4).alias("q_placement"), _clean("q_taxon", 4).alias("q_taxon"))


@query(f"{P} SELECT DISTINCT read, round(ln(sum(exp(loglik)) OVER (PARTITION BY read)), 6) + 0.0 AS total FROM fx_place")
def logsumexp(spark, d):
    return fx_place(spark, d).select("read", _clean(numeric.log_sum_exp(F.col("loglik"), numeric.per("read"))).alias("total")).distinct()


@query(f"{P} SELECT read, node, round(loglik, 6) + 0.0 AS loglik FROM fx_place QUALIFY row_number() OVER (PARTITION BY read ORDER BY loglik DESC, node) = 1")
def best_placement(spark, d):
    return placement.best(fx_place(spark, d), F.desc("loglik"), F.col("node")).select("read", "node", _clean("loglik").alias("loglik"))


@query(f"{P} SELECT read, node, taxon FROM fx_place QUALIFY max(loglik) OVER (PARTITION BY read) - loglik <= 2")
def loglik_slack_filter(spark, d):
    return placement.within_loglik(fx_place(spark, d), 2.0).select("read", "node", "taxon")


@query(f"{P} SELECT read, node, taxon FROM fx_place QUALIFY -loglik - min(-loglik) OVER (PARTITION BY read) <= 1.5")
def dist_slack_filter(spark, d):
    return placement.within_distance(fx_place(spark, d).withColumn("dist", -F.col("loglik")), 1.5).select("read", "node", "taxon")


@query(f"{P} SELECT read, node, CASE WHEN node % 2 = 0 THEN 5 ELSE 3 END AS segment FROM fx_place")
def segment_union(spark, d):
    places = fx_place(spark, d)
    five, three = places.where("node % 2 = 0").select("read", "node", F.lit(5).alias("segment")), places.where("node % 2 = 1").select("read", "node", F.lit(3).alias("segment"))
    return five.unionByName(three)
