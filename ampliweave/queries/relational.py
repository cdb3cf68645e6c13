"""Queries of the operators on tables: filters, tag correction, pileups and consensus, references, cells, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import events as E
from ..functions import quality as Q
from ..functions import sequence as S
from ..functions import tags as T
from ..operators import cells, consensus, correct, filters, graph, radius, reference
from ..synth import READS, dna, reads, sql_dna
from ..tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_c = F.col


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL; WITH and the synthetic reads are put before SQL that begins with a comma or FROM."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {READS}{sql}" if sql.lstrip()[0] == "," else f"WITH {READS}\n{sql}" if sql.lstrip().startswith("SELECT") else sql.lstrip().removeprefix("=")
        return f

    return add


def _molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir).withColumn("mol", F.substr("molecule", F.lit(1), F.lit(14))).withColumn("q", (_c("read_id") % 21 + 20).cast("int"))


_KEYS = ["ref_name", "mol"]
_PILE = """,
    c AS (SELECT ref_name, substr(molecule, 1, 14) AS mol, read_id, read_id % 21 + 20 AS q, ref_aln, read_aln, unnest(range(1, length(ref_aln) + 1)) AS i FROM reads),
    x AS (SELECT *, substr(ref_aln, i, 1) AS r, substr(read_aln, i, 1) AS b, substr(ref_aln, 1, i) AS head FROM c),
    y AS (SELECT *, CAST(length(replace(head, '-', '')) AS INT) AS pos, CAST(CASE WHEN r = '-' THEN length(head) - length(rtrim(head, '-')) ELSE 0 END AS INT) AS ins FROM x),
    pile AS (SELECT ref_name, mol, pos, ins, min(r) AS ref, count_if(b = 'A') AS n_a, count_if(b = 'C') AS n_c, count_if(b = 'G') AS n_g, count_if(b = 'T') AS n_t, count_if(b = 'N') AS n_n, count_if(b = '-') AS n_gap FROM y GROUP BY ALL)"""
_CALL = (
    _PILE
    + """,
    sizes AS (SELECT ref_name, substr(molecule, 1, 14) AS mol, count(*) AS n FROM reads GROUP BY ALL),
    best AS (SELECT *, greatest(n_a, n_c, n_g, n_t) AS m, CASE WHEN n_t >= greatest(n_a, n_c, n_g) THEN 'T' WHEN n_g >= greatest(n_a, n_c) THEN 'G' WHEN n_c >= n_a THEN 'C' ELSE 'A' END AS top FROM pile JOIN sizes USING (ref_name, mol)),
    called AS (SELECT ref_name, mol, pos, ins, ref, n, CASE WHEN ins > 0 THEN top WHEN n_gap >= 0.75 * n THEN '-' WHEN m > 0 THEN top WHEN n_n > 0 THEN 'N' ELSE '-' END AS base FROM best WHERE ins = 0 OR m >= 0.75 * n)"""
)
_CONSENSUS = (
    _CALL
    + """,
    con AS (SELECT ref_name, mol, min(n) AS n, string_agg(CASE WHEN ins > 0 THEN '-' ELSE ref END, '' ORDER BY pos, ins) AS ref_aln, string_agg(base, '' ORDER BY pos, ins) AS read_aln FROM called GROUP BY ALL)"""
)


@query("SELECT read_id, ref_name FROM reads WHERE flag NOT IN (4, 256)")
def flt1_primary(spark, sf_dir):
    return filters.keep(reads(spark, sf_dir), ("primary", _c("flag"))).select("read_id", "ref_name")


@query("SELECT read_id, mol FROM (SELECT read_id, substr(molecule, 1, 14) AS mol, seq FROM reads) WHERE read_id % 21 + 20 >= 30 AND read_id % 5 >= 2 AND (contains(seq, 'ACG') OR contains(seq, 'TTA'))")
def flt6_lineage_read(spark, sf_dir):
    return _molecules(spark, sf_dir).where(filters.lineage_read(_c("seq"), _c("q"), _c("read_id") % 5, ["ACG", "TTA"], 30, 2)).select("read_id", "mol")


@query("SELECT read_id FROM reads WHERE length(replace(read_aln, '-', '')) >= 30 AND length(replace(read_aln, '-', '')) < 33")
def flt7_fitting_length(spark, sf_dir):
    return reads(spark, sf_dir).where(filters.fitting_length(F.length(F.replace("read_aln", F.lit("-"), F.lit(""))), 32, 1.0, 30)).select("read_id")


@query("SELECT count(*) AS total, count_if(flag = 4) AS unmapped, count_if(flag = 256) AS secondary, count_if(read_id % 7 = 0) AS inserted, count_if(flag = 0 AND read_id % 7 <> 0) AS passing FROM reads")
def agg8_filter_counts(spark, sf_dir):
    return filters.counts(reads(spark, sf_dir), unmapped=_c("flag") == 4, secondary=_c("flag") == 256, inserted=_c("read_id") % 7 == 0)


@query("SELECT ref_name, cell_tag, count(*) AS n FROM reads GROUP BY ALL")
def agg1_distinct_tags(spark, sf_dir):
    return correct.distinct_tags(reads(spark, sf_dir), ["ref_name"], "cell_tag")


_LISTS = """,
    tags AS (SELECT DISTINCT cell_tag AS tag FROM reads), wl AS (SELECT DISTINCT substr(molecule, 1, 8) AS seq FROM reads WHERE read_id % 10 <> 0 AND read_id % 3 < 2),
    rest AS (SELECT tag FROM tags WHERE tag NOT IN (SELECT seq FROM wl))"""


def _tags(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = reads(spark, sf_dir)
    whitelist = r.where("read_id % 10 <> 0 AND read_id % 3 < 2").select(F.substr("molecule", F.lit(1), F.lit(8)).alias("seq")).distinct()
    return r.select(_c("cell_tag").alias("tag")).distinct(), whitelist


@query(_LISTS + """
    SELECT tag, tag AS corrected, 0 AS distance FROM tags WHERE tag IN (SELECT seq FROM wl)
    UNION ALL SELECT tag, min(seq), CAST(min(hamming(tag, seq)) AS INT) FROM rest, wl WHERE hamming(tag, seq) <= 1 GROUP BY tag HAVING count(*) = 1""")
def jon2_hamming_whitelist(spark, sf_dir):
    return radius.corrected(*_tags(spark, sf_dir), 1, "hamming")


_NEAREST = _LISTS + """,
    near AS (SELECT tag, seq, levenshtein(tag, seq) AS d FROM rest, wl WHERE levenshtein(tag, seq) <= 2),
    low AS (SELECT *, min(d) OVER (PARTITION BY tag) AS m FROM near),
    corr AS (SELECT tag, tag AS corrected, 0 AS distance FROM tags WHERE tag IN (SELECT seq FROM wl)
             UNION ALL SELECT tag, min(seq), CAST(min(d) AS INT) FROM low WHERE d = m GROUP BY tag HAVING count(*) = 1)"""


@query(_NEAREST + " SELECT * FROM corr")
def jon3_levenshtein_whitelist(spark, sf_dir):
    return radius.corrected(*_tags(spark, sf_dir), 2, "levenshtein", length=8)


@query(_NEAREST + " SELECT tag, corrected FROM corr WHERE distance > 0")
def jon4_top_lookup(spark, sf_dir):
    return radius.corrected(*_tags(spark, sf_dir), 2, length=8).where("distance > 0").select("tag", "corrected")


@query(_NEAREST + " SELECT read_id, ref_name, corrected FROM reads JOIN corr ON cell_tag = tag")
def jon5_apply_corrections(spark, sf_dir):
    level = correct.Level("cell_tag", 8, 2, _tags(spark, sf_dir)[1])
    return correct.correct_level(reads(spark, sf_dir), ["ref_name"], level).select("read_id", "ref_name", _c("cell_tag_corr").alias("corrected"))


@query(_NEAREST + " SELECT count_if(corrected IS NULL) AS dropped, count(*) AS total FROM reads LEFT JOIN corr ON cell_tag = tag")
def flt9_unmatched(spark, sf_dir):
    level = correct.Level("cell_tag", 8, 2, _tags(spark, sf_dir)[1])
    return correct.correct_level(reads(spark, sf_dir), ["ref_name"], level, keep_all=True).agg(F.count_if(_c("cell_tag_corr").isNull()).alias("dropped"), F.count("*").alias("total"))


_CLUSTER = """,
    n AS (SELECT {g} AS g, {tag} AS tag, count(*) AS n FROM {source} GROUP BY ALL),
    offer AS (SELECT a.g, a.tag, b.tag AS parent, row_number() OVER (PARTITION BY a.g, a.tag ORDER BY b.n DESC, levenshtein(a.tag, b.tag), b.tag) AS k
              FROM n a JOIN n b ON a.g = b.g AND a.tag <> b.tag AND levenshtein(a.tag, b.tag) <= {d} AND b.n >= a.n * {ratio}),
    up AS (SELECT g, tag, parent FROM offer WHERE k = 1),
    walk AS (SELECT g, tag, tag AS at FROM n UNION ALL SELECT w.g, w.tag, up.parent FROM walk w JOIN up ON up.g = w.g AND up.tag = w.at),
    root AS (SELECT w.g, w.tag, w.at AS root FROM walk w LEFT JOIN up ON up.g = w.g AND up.tag = w.at WHERE up.tag IS NULL)"""
_RECURSIVE = "=WITH RECURSIVE " + READS


@query(_RECURSIVE + _CLUSTER.format(g="ref_name", tag="substr(seq, 1, 7)", source="reads", d=1, ratio=2) + " SELECT g, tag, root FROM root")
def clu1_degenerate_clusters(spark, sf_dir):
    n = reads(spark, sf_dir).groupBy(_c("ref_name").alias("g"), F.substr("seq", F.lit(1), F.lit(7)).alias("tag")).agg(F.count("*").alias("n"))
    return correct.clusters(n, 1, 2.0, 7)


@query(_RECURSIVE + _NEAREST + """,
    one AS (SELECT read_id, ref_name, umi, corrected AS cell FROM reads JOIN corr ON cell_tag = tag)"""
    + _CLUSTER.format(g="ref_name || '/' || cell", tag="umi", source="one", d=1, ratio=2)
    + " SELECT read_id, ref_name, cell, root AS umi FROM one JOIN root ON g = ref_name || '/' || cell AND tag = umi")
def agg2_hierarchical_correct(spark, sf_dir):
    levels = [correct.Level("cell_tag", 8, 2, _tags(spark, sf_dir)[1]), correct.Level("umi", 6, 1, ratio=2.0)]
    return correct.hierarchical(reads(spark, sf_dir), levels).select("read_id", "ref_name", _c("cell_tag_corr").alias("cell"), _c("umi_corr").alias("umi"))


@query(_NEAREST + " SELECT read_id, corrected AS e0, cell_tag AS o0 FROM reads JOIN corr ON cell_tag = tag")
def agg4_correct_mode(spark, sf_dir):
    from ..plans.collapse import collapse

    out = collapse(reads(spark, sf_dir), [correct.Level("cell_tag", 8, 2, _tags(spark, sf_dir)[1])], mode="correct")
    return out.select("read_id", _c("cell_tag_corr").alias("e0"), _c("cell_tag").alias("o0"))


@query(_PILE + " SELECT * FROM pile")
def agg6_pileup(spark, sf_dir):
    return consensus.pileup(_molecules(spark, sf_dir), _KEYS)


@query(_PILE + " SELECT ref_name, mol, pos, ins, round(n_a::DOUBLE / (n_a + n_c + n_g + n_t + n_n + n_gap), 6) AS share FROM pile")
def agg7_base_share(spark, sf_dir):
    return consensus.pileup(_molecules(spark, sf_dir), _KEYS).select(*_KEYS, "pos", "ins", F.round(consensus.base_share("n_a"), 6).alias("share"))


@query(_CALL + " SELECT ref_name, mol, pos, ins, ref, base FROM called")
def con2_column_calls(spark, sf_dir):
    r = _molecules(spark, sf_dir)
    return consensus.called(r, _KEYS).select(*_KEYS, "pos", "ins", "ref", "base")


@query(_CALL + " SELECT ref_name, mol, pos, ins, base FROM called WHERE ins > 0")
def con4_insertions(spark, sf_dir):
    r = _molecules(spark, sf_dir)
    return consensus.called(r, _KEYS).where("ins > 0").select(*_KEYS, "pos", "ins", "base")


@query(_CONSENSUS + " SELECT * FROM con")
def con5_consensus(spark, sf_dir):
    return consensus.consensus(_molecules(spark, sf_dir), _KEYS).drop("cigar")


@query(_CONSENSUS + " SELECT ref_name, mol, ref_aln, read_aln FROM con WHERE n = 1")
def con7_singletons(spark, sf_dir):
    return consensus.consensus(_molecules(spark, sf_dir), _KEYS).where("n = 1").select(*_KEYS, "ref_aln", "read_aln")


@query(_CONSENSUS + """,
    names AS (SELECT ref_name, substr(molecule, 1, 14) AS mol, string_agg(CAST(read_id AS VARCHAR), ',' ORDER BY CAST(read_id AS VARCHAR)) AS ar FROM reads GROUP BY ALL)
    SELECT ref_name, mol, n AS rc, CAST(least(n, 40) AS INT) AS dc, ar, round(rm, 6) AS rm, read_aln FROM (
        SELECT *, list_filter(list_zip(string_split(ref_aln, ''), string_split(read_aln, '')), lambda x: unicode(x[1]) > 64 AND x[1] <> 'N' AND unicode(x[2]) > 64) AS l,
               len(list_filter(l, lambda x: x[1] = x[2]))::DOUBLE / nullif(len(l), 0) AS rm FROM con JOIN names USING (ref_name, mol))""")
def agg3_collapse(spark, sf_dir):
    return consensus.collapse(_molecules(spark, sf_dir), _KEYS, "read_id").select(*_KEYS, "rc", "dc", "ar", F.round("rm", 6).alias("rm"), "read_aln")


_POSTERIOR = """,
    e AS (SELECT ref_name, mol, pos, r, b, pow(10.0, -q / 10.0) AS p FROM y WHERE ins = 0),
    l AS (SELECT ref_name, mol, pos, """ + ", ".join(
    f"log2(CASE WHEN min(r) = '{a}' THEN 0.75 ELSE 0.0625 END) + sum(CASE WHEN b NOT IN ('A', 'C', 'G', 'T', 'N') THEN 0.0 WHEN b = '{a}' THEN log2(1 - p) ELSE log2(p / 3) END) AS {a.lower()}" for a in Q.ALLELES
) + " FROM e GROUP BY ALL)"


def _logs(spark, sf_dir):
    piles = consensus.pileup(_molecules(spark, sf_dir), _KEYS, _c("q")).where("ins = 0")
    start = lambda a: F.log2(F.when(_c("ref") == a, F.lit(0.75)).otherwise(F.lit(0.0625)))
    return piles, [_c(f"log_{a.lower()}") + start(a) for a in Q.ALLELES]


@query(_PILE + _POSTERIOR + " SELECT ref_name, mol, pos, round(a, 4) AS log_a, round(n, 4) AS log_n FROM l")
def qual6_allele_log2(spark, sf_dir):
    piles, logs = _logs(spark, sf_dir)
    return piles.select(*_KEYS, "pos", F.round(logs[0], 4).alias("log_a"), F.round(logs[4], 4).alias("log_n"))


@query(_PILE + _POSTERIOR + " SELECT ref_name, mol, pos, round(1 / (1 + pow(2.0, c - a) + pow(2.0, g - a) + pow(2.0, t - a) + pow(2.0, n - a)), 6) AS p_a FROM l")
def qual7_posterior(spark, sf_dir):
    piles, logs = _logs(spark, sf_dir)
    return piles.select(*_KEYS, "pos", F.round(Q.normalised(logs)[0], 6).alias("p_a"))


@query()
def con3_consensus_qualities(spark, sf_dir):
    return consensus.consensus(_molecules(spark, sf_dir), _KEYS, _c("q"))


@query("SELECT mol, ref_name, n FROM (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY n DESC, ref_name) AS k FROM (SELECT substr(molecule, 1, 3) AS mol, ref_name, count(*) AS n FROM reads GROUP BY ALL)) WHERE k = 1")
def agg5_majority_reference(spark, sf_dir):
    return consensus.majority(reads(spark, sf_dir).withColumn("mol", F.substr("molecule", F.lit(1), F.lit(3))), ["mol"], "ref_name")


@query(""",
    b AS (SELECT ref_name, substr(molecule, 1, 14) AS mol, i, substr(seq, i, 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(1, 33)) AS i FROM reads) GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY ref_name, mol, i ORDER BY n DESC, base IN ('N', '-'), base DESC) AS k FROM b)
    SELECT ref_name, mol, string_agg(base, '' ORDER BY i) AS seq FROM k WHERE k = 1 GROUP BY ALL""")
def agg14_modal_bases(spark, sf_dir):
    return consensus.modal_bases(_molecules(spark, sf_dir), _KEYS, "seq")


_REFS = f""",
    refs AS (SELECT n_name AS name, {sql_dna('n_name')} AS sequence, n_nationkey FROM nation),
    k AS (SELECT name, substr(sequence, CAST(i AS INT), 8) AS kmer FROM (SELECT *, unnest(range(1, 26)) AS i FROM refs)),
    u AS (SELECT kmer, min(name) AS ref_name FROM k GROUP BY kmer HAVING count(*) = 1),
    q AS (SELECT event_id AS read_id, substr(sequence, CAST(event_id % 5 + 1 AS INT), 22) || substr({sql_dna('event_id')}, 1, 10) AS seq FROM events JOIN refs ON user_id % 25 = n_nationkey),
    v AS (SELECT read_id, ref_name, count(*) AS n FROM (SELECT read_id, substr(seq, CAST(i AS INT), 8) AS kmer FROM (SELECT *, unnest(range(1, 26, 4)) AS i FROM q)) JOIN u USING (kmer) GROUP BY ALL)"""


def _references(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    refs = table(spark, sf_dir, "nation").select(_c("n_name").alias("name"), dna(_c("n_name")).alias("sequence"), "n_nationkey")
    e = table(spark, sf_dir, "events").join(refs, _c("user_id") % 25 == _c("n_nationkey"))
    seq = F.concat(F.substr("sequence", (_c("event_id") % 5 + 1).cast("int"), F.lit(22)), F.substr(dna(_c("event_id")), F.lit(1), F.lit(10)))
    return refs.drop("n_nationkey"), e.select(_c("event_id").alias("read_id"), seq.alias("seq"))


@query(_REFS + " SELECT kmer, ref_name FROM u")
def agg9_unique_kmers(spark, sf_dir):
    return reference.unique_kmers(_references(spark, sf_dir)[0])


@query(_REFS + " SELECT read_id, array_to_string(list_sort(list(ref_name)), ',') AS refs FROM v GROUP BY read_id")
def agg10_voted_references(spark, sf_dir):
    refs, r = _references(spark, sf_dir)
    return reference.voted(reference.votes(r, reference.unique_kmers(refs))).select("read_id", F.array_join("refs", ",").alias("refs"))


@query(_REFS + " SELECT * FROM v")
def jon6_kmer_votes(spark, sf_dir):
    refs, r = _references(spark, sf_dir)
    return reference.votes(r, reference.unique_kmers(refs))


@query(_REFS + " SELECT read_id, CASE WHEN max(n) > 0.9 * sum(n) THEN arg_max(ref_name, n) END AS ref_name FROM v GROUP BY read_id")
def aln14_kmer_vote(spark, sf_dir):
    refs, r = _references(spark, sf_dir)
    return reference.choose(reference.votes(r, reference.unique_kmers(refs))).select("read_id", "ref_name")


@query("=SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def jon8_missing_references(spark, sf_dir):
    return cells.missing(table(spark, sf_dir, "orders").select(_c("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("=SELECT count_if(doc_id IN (SELECT doc_id FROM labels)) AS known, count_if(doc_id NOT IN (SELECT doc_id FROM labels)) AS unknown FROM documents")
def jon9_semi_anti_counts(spark, sf_dir):
    return cells.known_and_unknown(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("=SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jon10_translated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(_c("o_orderkey").alias("l_orderkey"), "o_custkey")
    return cells.translated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey", "o_custkey")


@query("=SELECT count_if(o_totalprice > 100000) AS known, count_if(NOT o_totalprice > 100000) AS unknown FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jon11_known_cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(_c("o_orderkey").alias("l_orderkey"))
    return cells.known_and_unknown(table(spark, sf_dir, "lineitem").select("l_orderkey"), o, "l_orderkey")


@query("=SELECT l_partkey, count(DISTINCT l_suppkey) AS cells, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_partkey HAVING count(*) > 20")
def jon12_integrations(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size < 40").select(_c("p_partkey").alias("l_partkey"))
    return cells.integrations(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), known, "l_suppkey", "l_partkey", 20)


@query(""",
    e AS (SELECT read_id, read_id % 700 AS start, read_id % 700 + read_id % 90 AS stop FROM reads), t AS (SELECT n_name AS target, n_nationkey * 30 AS lo, n_nationkey * 30 + 17 AS hi FROM nation)
    SELECT read_id, target FROM e JOIN t ON start <= hi AND stop >= lo""")
def jon13_interval(spark, sf_dir):
    e = reads(spark, sf_dir).select("read_id", (_c("read_id") % 700).alias("start"), (_c("read_id") % 700 + _c("read_id") % 90).alias("stop"))
    t = table(spark, sf_dir, "nation").select(_c("n_name").alias("target"), (_c("n_nationkey") * 30).alias("lo"), (_c("n_nationkey") * 30 + 17).alias("hi"))
    return cells.events_in_windows(e, t).select("read_id", "target")


_SHORT = ", s AS (SELECT DISTINCT substr(seq, 9, 10) AS v FROM reads), edges AS (SELECT x.v AS a, y.v AS b, CAST({f}(x.v, y.v) AS INT) AS distance FROM s x JOIN s y ON x.v < y.v AND {f}(x.v, y.v) <= {d})"


def _short(spark, sf_dir) -> DataFrame:
    return reads(spark, sf_dir).select(F.substr("seq", F.lit(9), F.lit(10)).alias("v")).distinct()


@query(_SHORT.format(f="levenshtein", d=1) + " SELECT * FROM edges")
def jon14_edit_distance_pairs(spark, sf_dir):
    return radius.close_pairs(_short(spark, sf_dir), "v", 1, length=10)


@query(_SHORT.format(f="hamming", d=2) + " SELECT * FROM edges")
def clu2_similarity_graph(spark, sf_dir):
    return graph.similarity_graph(_short(spark, sf_dir), "v", 2, 10)


_REACH = ", reach AS (SELECT v, v AS w FROM s UNION SELECT r.v, CASE WHEN e.a = r.w THEN e.b ELSE e.a END FROM reach r JOIN edges e ON e.a = r.w OR e.b = r.w) SELECT v, min(w) AS component FROM reach GROUP BY v"


@query(_RECURSIVE + _SHORT.format(f="hamming", d=1) + _REACH)
def clu3_components(spark, sf_dir):
    s = _short(spark, sf_dir)
    return graph.components(s, graph.similarity_graph(s, "v", 1, 10))


@query()
def clu4_balanced_parts(spark, sf_dir):
    return graph.balanced_parts(graph.similarity_graph(_short(spark, sf_dir), "v", 1, 10), 1)


@query()
def clu5_complete_subgraphs(spark, sf_dir):
    return graph.complete_subgraphs(graph.similarity_graph(_short(spark, sf_dir), "v", 1, 10))


@query(_RECURSIVE + _SHORT.format(f="levenshtein", d=1) + _REACH)
def clu6_single_linkage(spark, sf_dir):
    return graph.single_linkage(_short(spark, sf_dir), "v", length=10)


@query(""",
    p AS (SELECT x.v AS a, y.v AS b FROM (SELECT DISTINCT umi AS v FROM reads) x, (SELECT DISTINCT umi AS v FROM reads) y)
    SELECT round(avg(hamming(a, b)), 6) AS mean, CAST(max(hamming(a, b)) AS INT) AS greatest FROM p""")
def agg11_mean_distance(spark, sf_dir):
    return graph.mean_distance(reads(spark, sf_dir), "umi").withColumn("mean", F.round("mean", 6))


@query("SELECT cell_tag || '.' || umi AS cell, array_to_string(list_sort(list(read_id)), ',') AS reads, count(*) AS n FROM reads GROUP BY ALL")
def agg12_cell_addresses(spark, sf_dir):
    return cells.reads_of_cells(cells.address(reads(spark, sf_dir), ["cell_tag", "umi"])).select("cell", F.array_join(_c("reads").cast("array<string>"), ",").alias("reads"), "n")


@query("SELECT ref_name, umi, array_to_string(list_sort(list(cell_tag)), ',') AS outcomes, CAST(sum(read_id % 5) AS BIGINT) AS count FROM reads GROUP BY ALL")
def agg13_outcomes(spark, sf_dir):
    r = reads(spark, sf_dir).withColumn("k", _c("read_id") % 5)
    return cells.outcomes(r, "ref_name", "umi", "cell_tag", "k").withColumn("outcomes", F.array_join("outcomes", ","))


@query(_NEAREST + ", r AS (SELECT ref_name, corrected, read_id FROM reads JOIN corr ON cell_tag = tag) SELECT *, row_number() OVER (ORDER BY ref_name, corrected, read_id) AS place FROM r")
def srt1_total_order(spark, sf_dir):
    """The order of output records. Places come from a range partitioning and the sizes of its parts, not from one window over all rows."""
    from ..operators.order import numbered

    level = correct.Level("cell_tag", 8, 2, _tags(spark, sf_dir)[1])
    r = correct.correct_level(reads(spark, sf_dir), ["ref_name"], level).select("ref_name", _c("cell_tag_corr").alias("corrected"), "read_id")
    return numbered(r, ["ref_name", "corrected", "read_id"], "place")


@query("SELECT count(*) = 0 AS subset FROM (SELECT cell_tag FROM reads WHERE read_id % 10 <> 0 EXCEPT SELECT substr(molecule, 1, 8) FROM reads)")
def set1_subset(spark, sf_dir):
    r = reads(spark, sf_dir)
    other = r.select(F.substr("molecule", F.lit(1), F.lit(8)).alias("cell_tag"))
    return spark.createDataFrame([(cells.is_subset(r.where("read_id % 10 <> 0").select("cell_tag"), other, "cell_tag"),)], "subset boolean")


@query("SELECT DISTINCT cell_tag FROM reads WHERE cell_tag NOT IN (SELECT substr(molecule, 1, 8) FROM reads)")
def set2_difference(spark, sf_dir):
    r = reads(spark, sf_dir)
    return cells.missing(r.select("cell_tag"), r.select(F.substr("molecule", F.lit(1), F.lit(8)).alias("cell_tag")), "cell_tag")


@query("""SELECT read_id, CAST(coalesce(list_sum(list_transform(range(1, length(ref_aln) + 1), lambda i: CASE WHEN substr(ref_aln, i, 1) = '-' AND (i = 1 OR substr(ref_aln, i - 1, 1) <> '-') THEN 1
              WHEN substr(read_aln, i, 1) = '-' AND substr(ref_aln, i, 1) <> '-' AND (i = 1 OR substr(read_aln, i - 1, 1) <> '-' OR substr(ref_aln, i - 1, 1) = '-') THEN 1 ELSE 0 END)), 0) AS INT) AS n_events FROM reads""")
def evt6_events_of_alignments(spark, sf_dir):
    from ..functions import cigar as C
    from ..functions import sequence as S

    ops = C.of_pair(_c("ref_aln"), _c("read_aln"))
    return reads(spark, sf_dir).select("read_id", F.size(E.from_cigar(ops, S.strip_gaps(_c("read_aln")))).alias("n_events"))


@query("= SELECT string_agg(substr('ACGT', CAST((i // CAST(power(4, 2 - j) AS INT)) % 4 AS INT) + 1, 1), '' ORDER BY j) AS kmer FROM range(64) a(i), range(3) b(j) GROUP BY i")
def seq13_combinations(spark, sf_dir):
    return spark.range(4**3).select(S.combinations(3).alias("kmer"))


_FLANKS = """,
    c AS (SELECT read_id, unnest(range(1, length(tagged) + 1)) AS i, tagged, read_aln FROM reads),
    m AS (SELECT read_id, string_agg(CASE WHEN substr(tagged, i, 1) IN ('0', '1') THEN 'T' WHEN substr(tagged, i, 1) IN ('-', 'N') THEN '' WHEN substr(tagged, i, 1) = substr(read_aln, i, 1) THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM c GROUP BY read_id),
    p AS (SELECT read_id, string_split_regex(s, 'T+') AS parts FROM m),
    f AS (SELECT read_id, list_filter(list_concat(list_transform(parts[1:-2], lambda x: right(x, 10)), list_transform(parts[2:], lambda x: left(x, 10))), lambda x: length(x) > 0) AS sides FROM p)"""


@query(_FLANKS + " SELECT read_id FROM f WHERE len(list_filter(sides, lambda x: length(replace(x, '0', '')) < 0.9 * length(x))) = 0")
def flt3_well_flanked(spark, sf_dir):
    return reads(spark, sf_dir).where(T.well_flanked(_c("tagged"), _c("read_aln"), 0.9)).select("read_id")


@query(_FLANKS + " SELECT read_id, round(list_min(list_transform(sides, lambda x: length(replace(x, '0', ''))::DOUBLE / length(x))), 6) AS least FROM f")
def win3_flank_identity(spark, sf_dir):
    return reads(spark, sf_dir).select("read_id", F.round(F.array_min(T.flanks(_c("tagged"), _c("read_aln"))), 6).alias("least"))


@query(" SELECT ref_name, substr(molecule, 1, 14) AS mol, count(*) AS n, count_if(read_id % 9 = 0 OR read_id % 11 = 0) AS held FROM reads GROUP BY ALL")
def con6_quarantine(spark, sf_dir):
    """Every ninth read has lost a column and every eleventh has one of two gaps; no read ends the job."""
    r = _molecules(spark, sf_dir)
    i, end = _c("read_id"), F.when(_c("read_id") % 11 == 0, "-").otherwise("")
    r = r.withColumn("ref_aln", F.concat("ref_aln", end)).withColumn("read_aln", F.concat(F.when(i % 9 == 0, F.substr("read_aln", F.lit(2))).otherwise(_c("read_aln")), end))
    return consensus.quarantined(r, _KEYS)[1]


_TARGETS = [("view", 0, "CAS9_DSB", 0, True), ("view", 1, "CAS9_DSB", 5, False), ("click", 0, "CAS12A_DSB", 2, True), ("purchase", 0, "CAS9_ABE", 4, True)]


@query(f""",
    t AS (SELECT * FROM (VALUES ('view', 0, 14, 19), ('view', 1, 8, 14), ('click', 0, 16, 25), ('purchase', 0, 6, 23)) v(ref_name, target, lo, hi)),
    ev AS (SELECT read_id, CAST(read_id % 11 + 2 AS INT) AS pos, CAST(read_id % 11 + 2 AS INT) AS last, 'I' AS kind, CAST(read_id % 3 + 1 AS INT) AS n FROM reads WHERE read_id % 7 = 0
           UNION ALL SELECT read_id, CAST(read_id % 10 + 15 AS INT), CAST(read_id % 10 + 15 + read_id % 4 AS INT), 'D', CAST(read_id % 4 + 1 AS INT) FROM reads WHERE read_id % 5 = 0)
    SELECT r.read_id, r.ref_name, CAST(t.target AS INT) AS target,
           coalesce((SELECT string_agg(n || kind || '+' || pos || CASE WHEN kind = 'I' THEN '+' || substr('ACGTA', 1, n) ELSE '' END, '&' ORDER BY pos) FROM ev WHERE ev.read_id = r.read_id AND pos <= hi AND last >= lo), 'WT') AS call
    FROM reads r JOIN t USING (ref_name)""")
def pipe4_target_calls(spark, sf_dir):
    targets = spark.createDataFrame(_TARGETS, "ref_name string, target int, kind string, position int, forward boolean")
    return cells.call_targets(reads(spark, sf_dir), targets)
