"""Queries of sequence, taxon and number functions."""

from pyspark.sql import functions as F

from reedbank.functions import distance, numeric, sequence, taxon, text
from reedbank.plans.fixtures import fx_aln, fx_node, fx_seq, fx_taxon, table, with_
from reedbank.plans.registry import query

S, L = with_("fx_seq"), with_("fx_aln")
_REV = "translate(reverse(seq), 'ACGT', 'TGCA')"
_SUB = "regexp_replace({}, '[-._]', '', 'g')"


@query(f"{S} SELECT id, seq, {_REV} AS revcomp, translate(seq, 'ACGT', 'TGCA') AS comp FROM fx_seq")
def revcomp(spark, d):
    return fx_seq(spark, d).select("id", "seq", sequence.reverse_complement(F.col("seq")).alias("revcomp"), sequence.complement(F.col("seq")).alias("comp"))


@query(f"{L} SELECT id, translate(aln, 'ACGT', '0123') AS codes, aln AS decoded FROM fx_aln")
def encode_decode(spark, d):
    codes = sequence.encode(F.col("aln"))
    return fx_aln(spark, d).select("id", codes.alias("codes"), sequence.decode(codes).alias("decoded"))


@query(f"{L} SELECT id, " + ", ".join(f"length(aln) - length(replace(aln, '{b}', '')) AS n_{n}" for b, n in zip("ACGT-", ("a", "c", "g", "t", "gap"), strict=True)) + " FROM fx_aln")
def base_class_counts(spark, d):
    of = lambda b: sequence.symbol_count(F.col("aln"), b).cast("long")
    return fx_aln(spark, d).select("id", of("A").alias("n_a"), of("C").alias("n_c"), of("G").alias("n_g"), of("T").alias("n_t"), sequence.gap_count(F.col("aln")).cast("long").alias("n_gap"))


@query("""WITH k AS (SELECT unnest(['A','C','G','T','R','Y','S','W','K','M','B','D','H','V','N']) AS k, unnest(['A','C','G','T','AG','CT','CG','AT','GT','AC','CGT','AGT','ACT','ACG','ACGT']) AS s),
p AS (SELECT p_partkey AS id, (list(k ORDER BY k) OVER ())[1 + p_partkey % 15] AS a, (list(k ORDER BY k) OVER ())[1 + p_size % 15] AS b FROM part, (SELECT list(k ORDER BY k) AS k FROM k)
) SELECT id, a, b, EXISTS (SELECT 1 FROM k x, k y WHERE x.k = p.a AND y.k = p.b AND len(list_intersect(string_split(x.s, ''), string_split(y.s, ''))) > 0) AS is_match FROM p""".replace("(list(k ORDER BY k) OVER ())", "k"))
def degenerate_match(spark, d):
    letters = F.array(*[F.lit(c) for c in sorted("ACGTRYSWKMBDHVN")])
    pick = lambda c: F.get(letters, (c % 15).cast("int"))
    pairs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey")).alias("a"), pick(F.col("p_size")).alias("b"))
    return pairs.withColumn("is_match", sequence.degenerate_match(F.col("a"), F.col("b")))


@query(f"{L} SELECT id, {_SUB.format('aln')} AS ungapped, length(aln) - length({_SUB.format('aln')}) AS n_gaps FROM fx_aln")
def ungap(spark, d):
    return fx_aln(spark, d).select("id", sequence.ungap(F.col("aln")).alias("ungapped"), sequence.gap_count(F.col("aln")).cast("long").alias("n_gaps"))


@query(f"{S} SELECT id, substr(seq, 5, 10) AS inner_part, substr(seq, 21) AS tail FROM fx_seq")
def subseq(spark, d):
    return fx_seq(spark, d).select("id", sequence.subsequence(F.col("seq"), 4, 10).alias("inner_part"), sequence.subsequence(F.col("seq"), 20, -1).alias("tail"))


@query("SELECT p_partkey AS id, ascii(substr(p_name, 3, 1)) - 33 AS q, 30 AS q_default FROM part")
def phred_score(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), sequence.quality_at(F.col("p_name"), 2).alias("q"), sequence.quality_at(F.lit(None).cast("string"), 2).alias("q_default"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_name ELSE '"' || p_name END AS bare, length(translate(p_brand, '#13', '')) < length(p_brand) AS has_any, regexp_replace(p_type, 'L$', '') AS cut FROM part""")
def quoted_text(spark, d):
    name, key = F.col("p_name"), F.col("p_partkey")
    quoted = F.when(key % 3 == 0, F.concat(F.lit('"'), name, F.lit('"'))).when(key % 3 == 1, F.concat(F.lit("'"), name, F.lit("'"))).otherwise(F.concat(F.lit('"'), name))
    return table(spark, d, "part").select(key.alias("id"), text.strip_quotes(quoted).alias("bare"), text.has_any(F.col("p_brand"), "#13").alias("has_any"), text.remove_end(F.col("p_type"), "L").alias("cut"))


@query("SELECT p_partkey AS id, regexp_full_match(upper(p_brand), '[ACGTUMRWSYKVHDBN._-]*') AS name_ok, true AS seq_ok FROM part")
def validate_seq(spark, d):
    from reedbank.plans.fixtures import dna

    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), sequence.is_valid(F.col("p_brand")).alias("name_ok"), sequence.is_valid(dna(F.col("p_partkey"))).alias("seq_ok"))


@query("""SELECT p_partkey AS id, starts_with(p_name, 'part') AS starts, suffix(p_type, 'L') AS ends, replace(p_brand, '#', '') AS removed, contains(p_type, ' ') AS has_space,
string_split(p_name, ' ')[-1] AS base, array_to_string(list_sort(list_distinct(string_split(p_brand, ''))), '') AS chars, array_to_string(list_sort(list_distinct(list_intersect(string_split(p_brand, ''), string_split(p_type, '')))), '') AS common FROM part""")
def string_utils(spark, d):
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.startswith("p_name", F.lit("part")).alias("starts"),
        F.endswith("p_type", F.lit("L")).alias("ends"),
        text.remove_all(F.col("p_brand"), "#").alias("removed"),
        text.has_space(F.col("p_type")).alias("has_space"),
        text.base_name(F.col("p_name"), " ").alias("base"),
        text.distinct_characters(F.col("p_brand")).alias("chars"),
        text.common_characters(F.col("p_brand"), F.col("p_type")).alias("common"),
    )


_PAD = "i AS (SELECT id, lower(substr(seq, 1, (id % 9)::INT)) AS ins, 6 AS w FROM fx_seq), p AS (SELECT id, ins, substr(ins, 1, w) AS s, w - length(substr(ins, 1, w)) AS room, w FROM i)"


@query(f"""{S}, {_PAD} SELECT id, s || repeat('-', room) AS lefted, repeat('-', room) || substr(ins, greatest(length(ins) - w, 0) + 1) AS righted, repeat('-', room // 2) || s || repeat('-', room - room // 2) AS middled,
substr(s, 1, (length(s) + 1) // 2) || repeat('-', room) || substr(s, (length(s) + 1) // 2 + 1) AS justified FROM p""")
def pad_modes(spark, d):
    ins = F.lower(F.substring("seq", F.lit(1), (F.col("id") % 9).cast("int")))
    rows = fx_seq(spark, d).select("id", ins.alias("ins"))
    mode = lambda m: sequence.pad(F.col("ins"), F.lit(6), m)
    return rows.select("id", mode("left").alias("lefted"), mode("right").alias("righted"), mode("middle").alias("middled"), mode("justified").alias("justified"))


_FA = "'>' || id || ' len=' || length(seq) || chr(10) || substr(seq, 1, 20) || chr(10) || substr(seq, 21)"


@query(f"{S} SELECT id, {_FA} AS record FROM fx_seq")
def fasta_format(spark, d):
    note = F.concat(F.lit("len="), F.length("seq").cast("string"))
    return fx_seq(spark, d).select("id", sequence.fasta(F.col("id").cast("string"), note, F.col("seq"), 20).alias("record"))


@query(f"{S} SELECT id::VARCHAR AS id, 'len=' || length(seq) AS description, seq FROM fx_seq")
def scan_fasta(spark, d):
    from reedbank.sources.fasta import parse_fasta

    return parse_fasta(fasta_format(spark, d), "record")


@query(f"{S} SELECT id::VARCHAR AS id, seq, repeat('?', length(seq)) AS qual FROM fx_seq")
def scan_fastq(spark, d):
    from reedbank.sources.fasta import parse_fastq

    text = fx_seq(spark, d).select(sequence.fastq(F.col("id").cast("string"), F.lit(None).cast("string"), F.col("seq"), F.lit(None).cast("string")).alias("record"))
    return parse_fastq(text, "record").select("id", "seq", "qual")


_PAIR = "p AS (SELECT a.id, a.{0} AS x, b.{0} AS y FROM {1} a JOIN {1} b ON b.id = a.id // 2)"
_SITES = "list_filter(list_transform(range(1, 33), lambda i: substr(x, i::INT, 1) || substr(y, i::INT, 1)), lambda s: {})"


@query(f"{L}, {_PAIR.format('aln', 'fx_aln')}, q AS (SELECT id, {_SITES.format(chr(78) + 'OT contains(s, ' + chr(39) + '-' + chr(39) + ')')} AS s FROM p) SELECT id, round(len(list_filter(s, lambda v: v[1] <> v[2])) / nullif(len(s), 0)::DOUBLE, 9) AS p_dist FROM q")
def pdist(spark, d):
    a, b = fx_aln(spark, d), fx_aln(spark, d).select(F.col("id").alias("up"), F.col("aln").alias("other"))
    return a.join(b, F.floor(F.col("id") / 2) == F.col("up")).select("id", F.round(distance.p_distance(F.col("aln"), F.col("other")), 9).alias("p_dist"))


@query(f"{L}, {_PAIR.format('aln', 'fx_aln')} SELECT id, round(hamming(x, y) / 32.0::DOUBLE, 9) AS p_dist FROM p")
def pdist_string(spark, d):
    a, b = fx_aln(spark, d), fx_aln(spark, d).select(F.col("id").alias("up"), F.col("aln").alias("other"))
    return a.join(b, F.floor(F.col("id") / 2) == F.col("up")).select("id", F.round(distance.string_distance(F.col("aln"), F.col("other")), 9).alias("p_dist"))


@query(f"{L}, w AS (SELECT id, substr(aln, 3, (5 + id % 20)::INT) AS s FROM fx_aln) SELECT id, round(length({_SUB.format('s')}) / length(s)::DOUBLE, 9) AS identity FROM w")
def align_identity(spark, d):
    end = (F.col("id") % 20 + 7).cast("int")
    return fx_aln(spark, d).select("id", F.round(sequence.alignment_identity(F.col("aln"), F.lit(3), end), 9).alias("identity"))


@query(f"{L} SELECT id, round(len(list_filter([4,8,9,15,16,23], lambda c: substr(aln, c, 1) <> '-')) / 6.0::DOUBLE, 9) AS identity FROM fx_aln")
def hmm_identity(spark, d):
    columns = F.array(*[F.lit(c) for c in (1, 2, 4, 8, 9, 15, 16, 23, 31)])
    return fx_aln(spark, d).select("id", F.round(sequence.profile_identity(F.col("aln"), columns, F.lit(3), F.lit(30)), 9).alias("identity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax <= 0 THEN 250 ELSE -10 * log10(l_tax) END, 6) + 0.0 AS q, round(pow(10.0, -l_quantity / 10), 9) AS p FROM lineitem")
def phred_pq(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.round(numeric.p_to_q(F.col("l_tax")), 6) + 0.0).alias("q"), F.round(numeric.q_to_p(F.col("l_quantity")), 9).alias("p"))


_TX = with_("fx_taxon")


@query(f"{_TX}, p AS (SELECT id, list_filter(regexp_split_to_array(taxonomy, '[;: ]+'), lambda x: x <> '') AS p FROM fx_taxon) SELECT id, len(list_filter(p, lambda x: regexp_matches(x, '^[dkpcofgs]__.+$'))) = len(p) AS is_full, len(list_filter(p, lambda x: regexp_matches(x, '^[dkpcofgs]__.+$'))) > 0 AS is_part FROM p")
def taxon_canonical(spark, d):
    return fx_taxon(spark, d).select("id", taxon.is_fully_canonical(F.col("taxonomy")).alias("is_full"), taxon.is_partly_canonical(F.col("taxonomy")).alias("is_part"))


@query(f"{_TX} SELECT id, array_to_string(list_filter(regexp_split_to_array(taxonomy, '[;: ]+'), lambda x: regexp_matches(x, '^[dkpcofgs]__.+$')), ';') AS taxonomy FROM fx_taxon")
def taxon_format(spark, d):
    return fx_taxon(spark, d).select("id", taxon.canonical(F.col("taxonomy")).alias("taxonomy"))


_V = "v AS (SELECT p_partkey AS id, p_size / 100.0::DOUBLE AS v FROM part)"


@query(f"WITH {_V} SELECT id, round((1 + 3 * exp(-4 * v / 3)) / 4, 9) AS same, round((1 - exp(-4 * v / 3)) / 4, 9) AS other FROM v")
def jc69_prob(spark, d):
    same, other = distance.jc69_probability(F.col("length"))
    return fx_node(spark, d).select((F.col("id") - 1).alias("id"), F.round(same, 9).alias("same"), F.round(other, 9).alias("other"))


_SEQS = "p AS (SELECT a.id, a.seq AS x, b.seq AS y FROM fx_seq a JOIN fx_seq b ON b.id = a.id // 2)"


def _seq_pairs(spark, d):
    a, b = fx_seq(spark, d), fx_seq(spark, d).select(F.col("id").alias("up"), F.col("seq").alias("other"))
    return a.join(b, F.floor(F.col("id") / 2) == F.col("up"))


@query(f"{S}, {_SEQS}, q AS (SELECT id, hamming(x, y) / 32.0::DOUBLE / 4 AS p FROM p) SELECT id, round(CASE WHEN p < 0.75 THEN -0.75 * ln(1 - 4 * p / 3) END, 9) + 0.0 AS dist FROM q")
def subdist_jc69(spark, d):
    p = distance.p_distance(F.col("seq"), F.col("other")) / 4
    return _seq_pairs(spark, d).select("id", (F.round(distance.jc69(p), 9) + 0.0).alias("dist"))


@query(f"""{S}, {_SEQS}, q AS (SELECT id, len(list_filter(range(1, 33), lambda i: substr(x, i::INT, 1) || substr(y, i::INT, 1) IN ('AG','GA','CT','TC'))) / 128.0::DOUBLE AS p, hamming(x, y) / 128.0::DOUBLE AS h FROM p)
SELECT id, round(CASE WHEN 1 - 2 * p - (h - p) > 0 AND 1 - 2 * (h - p) > 0 THEN -0.5 * ln(1 - 2 * p - (h - p)) - 0.25 * ln(1 - 2 * (h - p)) END, 9) + 0.0 AS dist FROM q""")
def subdist_k80(spark, d):
    pairs = F.zip_with(F.split("seq", ""), F.split("other", ""), lambda a, b: F.concat(a, b))
    p = F.size(F.filter(pairs, lambda s: s.isin("AG", "GA", "CT", "TC"))) / 128.0
    q = distance.p_distance(F.col("seq"), F.col("other")) / 4 - p
    return _seq_pairs(spark, d).select("id", (F.round(distance.k80(p, q), 9) + 0.0).alias("dist"))


@query("SELECT e.vec_id, round(list_aggregate(e.embedding::DOUBLE[], 'sum'), 4) + 0.0 AS total, list_position(e.embedding, list_max(e.embedding)) - 1 AS which_max, len(list_filter(e.embedding, lambda v: v > 0)) AS n_positive FROM embeddings e")
def array_stats(spark, d):
    x = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.round(numeric.total(x), 4) + 0.0).alias("total"), numeric.which_max(x).alias("which_max"), F.size(F.filter(x, lambda v: v > 0)).alias("n_positive"))


_NEXT = "p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _vector_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {_NEXT} SELECT vec_id, round(list_distance(x, y), 6) + 0.0 AS dist FROM p")
def euclidean(spark, d):
    return _vector_pairs(spark, d).select("vec_id", (F.round(numeric.euclidean(F.col("x"), F.col("y")), 6) + 0.0).alias("dist"))


_SM = "list_transform({0}, lambda v: exp(v - list_max({0})) / list_aggregate(list_transform({0}, lambda w: exp(w - list_max({0}))), 'sum'))"


@query(f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT vec_id, {_SM.format('x')} AS s FROM e) SELECT vec_id, round(list_max(s), 6) AS top, round(s[1], 6) AS head FROM s")
def softmax(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", numeric.softmax(F.col("embedding").cast("array<double>")).alias("s"))
    return rows.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(F.get("s", F.lit(0)), 6).alias("head"))


@query(f"WITH {_NEXT}, s AS (SELECT vec_id, {_SM.format('x')} AS p, {_SM.format('y')} AS q FROM p) SELECT vec_id, round(list_aggregate(list_transform(range(1, len(p) + 1), lambda i: p[i] * ln(p[i] / q[i])), 'sum'), 6) + 0.0 AS kl, round(-ln(list_aggregate(list_transform(range(1, len(p) + 1), lambda i: sqrt(p[i] * q[i])), 'sum')), 6) + 0.0 AS bhattacharyya FROM s")
def kl_divergence(spark, d):
    rows = _vector_pairs(spark, d).select("vec_id", numeric.softmax(F.col("x")).alias("p"), numeric.softmax(F.col("y")).alias("q"))
    return rows.select("vec_id", (F.round(numeric.kl_divergence(F.col("p"), F.col("q")), 6) + 0.0).alias("kl"), (F.round(numeric.bhattacharyya(F.col("p"), F.col("q")), 6) + 0.0).alias("bhattacharyya"))
