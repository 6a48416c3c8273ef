"""Registered queries over the derived ensembles, and their closed forms in SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quartets as fq
from ..functions import text
from ..operators import consensus, frames, paralog, qed, stats, trees
from ..operators.ensemble import Ensemble
from ..operators.topology import quartet_topology
from ..operators.topology import topology_wide as topology_wide_rows
from ..streaming.counts import tree_topologies
from . import derived

Query = Callable[[SparkSession, str], DataFrame]
TAXA = 10  # quartets of the first taxa by name

_RANKS = derived.RANKS.replace("{lineitem}", "lineitem").replace("{supplier}", "supplier").replace("{nation}", "nation")
_LADDER, _PARTIAL = _RANKS.replace("{having}", ""), _RANKS.replace("{having}", derived.PARTIAL)
_STAR = derived.STAR.replace("{lineitem}", "lineitem").replace("{nation}", "nation").replace("{region}", "region")


def _first(ens: Ensemble, n: int = TAXA) -> fq.Quartets:
    return ens.quartets(q := list(itertools.combinations(range(min(n, len(ens.taxa))), 4)), count=len(q))


def _taxa(source: str) -> str:
    names = f"(SELECT DISTINCT taxon FROM {source})"
    return f"taxa AS (SELECT x.taxon, count(y.taxon) AS gid FROM {names} x LEFT JOIN {names} y ON y.taxon < x.taxon GROUP BY 1)"


def _quartets(n: int = TAXA) -> str:
    return f"""q AS (
  SELECT a.gid AS ga, b.gid AS gb, c.gid AS gc, d.gid AS gd, a.taxon AS a, b.taxon AS b, c.taxon AS c, d.taxon AS d,
         a.gid + b.gid * (b.gid - 1) // 2 + c.gid * (c.gid - 1) // 2 * (c.gid - 2) // 3
           + d.gid * (d.gid - 1) // 2 * (d.gid - 2) // 3 * (d.gid - 3) // 4 AS quartet_idx
  FROM taxa a JOIN taxa b ON a.gid < b.gid JOIN taxa c ON b.gid < c.gid JOIN taxa d ON c.gid < d.gid WHERE d.gid < {n})"""


_TOPO = """CASE WHEN poly AND r0 = r1 AND r1 = r2 THEN 3 WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END"""

#: (quartet, tree) pairs of ladders with pair sums and leaf depths.
_LADDER_PAIRS = """sums AS (
  SELECT q.*, ra.grp, ra.tree_id, FALSE AS poly,
         least(ra.r, rb.r) + least(rc.r, rd.r) - 2 AS r0, least(ra.r, rc.r) + least(rb.r, rd.r) - 2 AS r1,
         least(ra.r, rd.r) + least(rb.r, rc.r) - 2 AS r2,
         least(ra.r, ra.n - 1) + least(rb.r, ra.n - 1) + least(rc.r, ra.n - 1) + least(rd.r, ra.n - 1) AS leaves
  FROM q JOIN ranks ra ON ra.taxon = q.a JOIN ranks rb ON rb.taxon = q.b AND rb.tree_id = ra.tree_id
  JOIN ranks rc ON rc.taxon = q.c AND rc.tree_id = ra.tree_id JOIN ranks rd ON rd.taxon = q.d AND rd.tree_id = ra.tree_id)"""


def _star_pairs(zero: bool) -> str:
    """The same for two-level trees; with ``zero``, regions of even key have length 0 and are unresolved."""
    length = "CASE WHEN rk % 2 = 0 THEN 0 ELSE len END" if zero else "len"

    def pair(x: str, y: str) -> tuple[str, str]:
        value = f"CASE WHEN {x}.rk = {y}.rk THEN {x}.ln ELSE 0 END"
        poly = f"(CASE WHEN {x}.rk = {y}.rk THEN NOT ({x}.last_nation OR {y}.last_nation) {f'OR {x}.ln = 0' if zero else ''} ELSE NOT ({x}.last_region OR {y}.last_region) END)"
        return value, poly

    p = {x + y: pair("s" + x, "s" + y) for x, y in itertools.combinations("abcd", 2)}
    poly = " OR ".join(v[1] for v in p.values())
    joins = " ".join(f"JOIN st s{x} ON s{x}.taxon = q.{x} AND s{x}.tree_id = sa.tree_id" for x in "bcd")
    return f"""st AS (SELECT *, {length} AS ln FROM star), sums AS (
  SELECT q.*, sa.grp, sa.tree_id, ({poly}) AS poly, {p['ab'][0]} + {p['cd'][0]} AS r0, {p['ac'][0]} + {p['bd'][0]} AS r1,
         {p['ad'][0]} + {p['bc'][0]} AS r2, sa.ln + sb.ln + sc.ln + sd.ln + 4 AS leaves
  FROM q JOIN st sa ON sa.taxon = q.a {joins})"""


_COUNTED = f"""topo AS (SELECT *, {_TOPO} AS k FROM sums),
len AS (SELECT *, leaves - (CASE k WHEN 1 THEN r1 WHEN 2 THEN r2 ELSE r0 END + r0 + r1 + r2) / 2.0 AS s FROM topo),
cells AS (SELECT quartet_idx, grp, k, count(*) AS n, sum(s) AS ss, min(s) AS mn, max(s) AS mx, sum(s * s) AS sq FROM len GROUP BY 1, 2, 3),
full_grid AS (SELECT q.quartet_idx, q.a, q.b, q.c, q.d, g.grp, t.k, coalesce(n, 0) AS n, coalesce(ss, 0.0) AS ss, mn, mx, sq
  FROM q CROSS JOIN (SELECT DISTINCT grp FROM GROUPS_OF) g CROSS JOIN (VALUES (0), (1), (2), (3)) t(k)
  LEFT JOIN cells ON cells.quartet_idx = q.quartet_idx AND cells.grp = g.grp AND cells.k = t.k)"""
_COUNTS = """SELECT quartet_idx, a, b, c, d, grp AS "group", k AS topology, CAST(n AS INTEGER) AS count FROM full_grid"""
_STEINER = """SELECT quartet_idx, a, b, c, d, grp AS "group", k AS topology, CAST(n AS INTEGER) AS count,
  CAST(ss AS DOUBLE) AS steiner_sum, CAST(mn AS DOUBLE) AS steiner_min, CAST(mx AS DOUBLE) AS steiner_max,
  CASE WHEN n > 0 THEN round(CAST(sq AS DOUBLE) / n - (CAST(ss AS DOUBLE) / n) * (CAST(ss AS DOUBLE) / n), 6) END AS steiner_var FROM full_grid"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _ladder_sql(final: str, partial: bool = False) -> str:
    return _with(_PARTIAL if partial else _LADDER, _taxa("ranks"), _quartets(), _LADDER_PAIRS, _COUNTED.replace("GROUPS_OF", "ranks")) + final


def _star_sql(final: str, zero: bool = False) -> str:
    return _with(_STAR, _taxa("star"), _quartets(), _star_pairs(zero), _COUNTED.replace("GROUPS_OF", "star")) + final


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _millionths(x: Column) -> Column:
    """Rounded to six places in floating point, as DuckDB does it: large values differ from exact rounding by a last digit."""
    return F.round(x * 1e6) / 1e6


def _counts(kind: str, strategy: str = "auto", steiner: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ens = derived.ensemble(spark, sf_dir, kind)
        if kind == "crowd":  # a taxon for each customer
            ens = ens.first(TAXA)
        df = quartet_topology(ens, _first(ens), steiner, strategy).drop("qi")
        return df.withColumn("steiner_var", _millionths(F.col("steiner_var"))) if steiner else df

    return run


for _name, _kind, _plan in (
    ("quartet_counts_long", "ladder", "auto"), ("quartet_counts_blocks", "ladder", "blocks"), ("quartet_counts_relational", "partial", "relational"),
    ("quartet_counts_partial", "partial", "auto"), ("quartet_counts_polytomy", "star", "auto"), ("quartet_counts_zero_length", "zero", "auto"),
):
    _query(_name, _ladder_sql(_COUNTS, _kind == "partial") if _kind in ("ladder", "partial") else _star_sql(_COUNTS, _kind == "zero"))(_counts(_kind, _plan))
_query("quartet_steiner", _ladder_sql(_STEINER))(_counts("ladder", steiner=True))
_query("steiner_bl_variants", _star_sql(_STEINER))(_counts("star", steiner=True))
_query("quartet_steiner_blocks", _star_sql(_STEINER))(_counts("star", "blocks", steiner=True))


_query("quartet_counts_both", _star_sql(_COUNTS, True))(_counts("both"))
_CROWD = derived.CROWD.replace("{customer}", "customer").replace("STRING", "VARCHAR")
_CROWD_SQL = _with(_CROWD, _taxa("ranks"), _quartets(), _LADDER_PAIRS, _COUNTED.replace("GROUPS_OF", "ranks"))
_query("quartet_counts_crowd", _CROWD_SQL + _COUNTS)(_counts("crowd"))
_query("quartet_steiner_crowd", _CROWD_SQL + _STEINER)(_counts("crowd", steiner=True))
_MEAN = 'SELECT quartet_idx, grp AS "group", k AS topology, round(CAST(ss AS DOUBLE) / greatest(n, 1), 6) AS steiner_mean FROM full_grid'


@_query("quartet_steiner_mean", _ladder_sql(_MEAN, True))
def quartet_steiner_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir, "partial")
    return frames.mean_steiner(quartet_topology(ens, _first(ens), True)).select("quartet_idx", "group", "topology", F.round("steiner_mean", 6).alias("steiner_mean"))


@_query("newick_supports", _with(_STAR) + """, pos AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY rk, nk) - 1 AS p FROM star WHERE rep = 1)
SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(min(p) AS INTEGER) AS leaf_lo, CAST(max(p) AS INTEGER) AS leaf_hi, CAST(max(len) AS DOUBLE) AS length, (rk + 1) / 10.0::DOUBLE AS support, CAST(max(len) AS DOUBLE) AS root_distance FROM pos GROUP BY tree_id, rk""")
def newick_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = trees.nodes(derived.ensemble(spark, sf_dir, "supported").trees).where("support is not null")
    return n.select("tree_id", "leaf_lo", "leaf_hi", "length", "support", "root_distance")


@_query("multifurcation_flags", _with(_STAR) + """, m AS (SELECT tree_id, max(c) AS most, count(*) AS regions FROM (SELECT tree_id, rk, count(*) AS c FROM star GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(tree_id AS BIGINT) AS tree_id, most > 2 OR regions > 2 AS in_text, most > 2 OR regions > 2 AS in_tree FROM m""")
def multifurcation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derived.star(spark, sf_dir).select("tree_id", text.has_multifurcations(F.col("newick")).alias("in_text"))
    parsed = derived.ensemble(spark, sf_dir, "star").trees.select("tree_id", F.col("had_multifurcations").alias("in_tree"))
    return parsed.join(source.withColumn("tree_id", F.col("tree_id").cast("bigint")), "tree_id").select("tree_id", "in_text", "in_tree")


@_query("topology_numbers", """WITH p AS (SELECT w.n_nationkey AS a, x.n_nationkey AS b, y.n_nationkey AS c, z.n_nationkey AS d FROM nation w, nation x, nation y, nation z
  WHERE greatest(a, b, c, d) < 6 AND a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d),
s AS (SELECT *, least(a, b, c, d) AS lo, CASE least(a, b, c, d) WHEN a THEN b WHEN b THEN a WHEN c THEN d ELSE c END AS partner, (a IN (c, d, 5))::INT + (b IN (c, d, 5))::INT AS shared FROM p)
SELECT a, b, c, d, CAST((a < partner AND a <> lo)::INT + (b < partner AND b <> lo)::INT + (c < partner AND c <> lo)::INT + (d < partner AND d <> lo)::INT AS INTEGER) AS topology,
  TRUE AS valid, round(shared / (4 + (c <> 5 AND d <> 5)::INT - shared), 6) AS jaccard FROM s""")
def topology_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 6").select("n_nationkey")
    df = n.withColumnRenamed("n_nationkey", "a")
    for x in "bcd":
        df = df.crossJoin(n.withColumnRenamed("n_nationkey", x))
    q = F.array(*"abcd")
    five = F.lit(5).cast("int")
    df = df.where(fq.valid_quartet(q))
    sets = F.array("a", "b"), F.array("c", "d", five)
    return df.select(*"abcd", fq.topology_index_column(*[F.col(x) for x in "abcd"]).alias("topology"), fq.valid_quartet(q).alias("valid"), F.round(fq.jaccard(*sets), 6).alias("jaccard"))


@_query("newick_tree_stats", _with(_LADDER) + 'SELECT DISTINCT CAST(tree_id AS BIGINT) AS tree_id, grp AS "group", CAST(n AS INTEGER) AS n_leaves, CAST(2 * n - 1 AS INTEGER) AS n_nodes, CAST(n - 1 AS INTEGER) AS max_depth, 0 AS n_poly, 0 AS n_zero_length, CAST(2 * n - 2 AS DOUBLE) AS total_length FROM ranks')
def newick_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_stats(derived.ensemble(spark, sf_dir).trees)


@_query("newick_validate", _with(_LADDER) + """, t AS (SELECT DISTINCT tree_id FROM ranks WHERE n >= 2)
SELECT CAST(tree_id AS BIGINT) AS tree_id, v AS form, v IN (0, 4) AS valid, FALSE AS multifurcating FROM t CROSS JOIN (VALUES (0), (1), (2), (3), (4)) x(v)""")
def newick_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("newick")
    bare = F.regexp_replace(t, ";", "")
    forms = F.array(t, bare, F.concat(F.lit("("), t), F.concat(F.lit(")("), t), text.format_newick(F.concat(F.lit(" "), bare)))
    x = derived.ladder(spark, sf_dir).select("tree_id", "newick", F.posexplode(forms).alias("form", "x"))
    return x.select("tree_id", "form", text.valid_newick(F.col("x")).alias("valid"), text.has_multifurcations(t).alias("multifurcating"))


@_query("polytomy_stats", _with(_STAR) + """SELECT grp AS "group", count(*) AS n_trees, count(*) AS n_with_polytomy, CAST(sum(p) AS BIGINT) AS n_poly_nodes, CAST(0 AS BIGINT) AS n_zero_length
FROM (SELECT grp, tree_id, CAST(count(*) - count(DISTINCT rk) * 2 + count(DISTINCT rk) - 2 AS BIGINT) AS p FROM star GROUP BY 1, 2) GROUP BY 1""")
def polytomy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.polytomy_stats(derived.ensemble(spark, sf_dir, "star"))


@_query("taxon_namespace", _with(_LADDER, _taxa("ranks")) + "SELECT CAST(gid AS INTEGER) AS gid, taxon AS name, taxon AS genome, 0 AS copy FROM taxa")
def taxon_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ensemble(spark, sf_dir).taxa_table()


@_query("group_coverage", _with(_PARTIAL) + """, u AS (SELECT grp, count(DISTINCT taxon) AS m FROM ranks GROUP BY 1), t AS (SELECT grp, tree_id, max(n) AS n FROM ranks WHERE n >= 2 GROUP BY 1, 2)
SELECT t.grp AS "group", count(*) AS n_trees, max(m) AS n_taxa, round(avg(n / m), 9) AS mean_coverage, round(min(n / m), 9) AS min_coverage FROM t JOIN u ON t.grp = u.grp GROUP BY 1""")
def group_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_coverage(derived.ensemble(spark, sf_dir, "partial")).withColumns({c: F.round(c, 9) for c in ("mean_coverage", "min_coverage")})


@_query("group_jaccard", _with(_PARTIAL) + """, p AS (SELECT DISTINCT grp, taxon FROM ranks WHERE n >= 2), s AS (SELECT grp, count(*) AS n FROM p GROUP BY 1)
SELECT x.grp AS group_a, y.grp AS group_b, round(coalesce(b.n, 0) / (x.n + y.n - coalesce(b.n, 0)), 9) AS jaccard FROM s x JOIN s y ON x.grp < y.grp
LEFT JOIN (SELECT p.grp AS g, r.grp AS h, count(*) AS n FROM p JOIN p r ON p.taxon = r.taxon GROUP BY 1, 2) b ON b.g = x.grp AND b.h = y.grp""")
def group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_jaccard(derived.ensemble(spark, sf_dir, "partial")).withColumn("jaccard", F.round("jaccard", 9))


@_query("taxa_per_tree", _with(_PARTIAL) + "SELECT count(DISTINCT tree_id) AS n_trees, count(DISTINCT taxon) AS n_taxa, round(count(*) / count(DISTINCT tree_id), 9) AS mean_taxa_per_tree, round(count(*) / count(DISTINCT taxon), 9) AS mean_trees_per_taxon FROM ranks WHERE n >= 2")
def taxa_per_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.taxa_per_tree(derived.ensemble(spark, sf_dir, "partial")).withColumns({c: F.round(c, 9) for c in ("mean_taxa_per_tree", "mean_trees_per_taxon")})


@_query("pair_lca", _with(_PARTIAL, _taxa("ranks")) + """SELECT CAST(x.tree_id AS BIGINT) AS tree_id, CAST(tx.gid AS INTEGER) AS i, CAST(ty.gid AS INTEGER) AS j, CAST(least(x.r, y.r) - 1 AS DOUBLE) AS rd, FALSE AS is_poly
FROM ranks x JOIN ranks y ON x.tree_id = y.tree_id JOIN taxa tx ON tx.taxon = x.taxon JOIN taxa ty ON ty.taxon = y.taxon WHERE tx.gid < ty.gid""")
def pair_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.lca_pairs(derived.ensemble(spark, sf_dir, "partial")).drop("lca")


@_query("pairwise_distances", _with(_PARTIAL, _taxa("ranks")) + """SELECT CAST(x.tree_id AS BIGINT) AS tree_id, CAST(tx.gid AS INTEGER) AS i, CAST(ty.gid AS INTEGER) AS j, CAST(least(x.r, x.n - 1) + least(y.r, x.n - 1) - 2 * (least(x.r, y.r) - 1) AS DOUBLE) AS distance
FROM ranks x JOIN ranks y ON x.tree_id = y.tree_id JOIN taxa tx ON tx.taxon = x.taxon JOIN taxa ty ON ty.taxon = y.taxon WHERE tx.gid < ty.gid""")
def pairwise_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.distances(derived.ensemble(spark, sf_dir, "partial"))


@_query("branch_distance", _with(_PARTIAL, _taxa("ranks")) + """, p AS (SELECT ranks.*, gid FROM ranks JOIN taxa ON ranks.taxon = taxa.taxon WHERE n >= 2),
t AS (SELECT DISTINCT grp, tree_id FROM p)
SELECT CAST(t.tree_id AS BIGINT) AS tree_id, t.grp AS "group", 1 AS multiplicity, CAST(CASE WHEN x.r IS NOT NULL AND y.r IS NOT NULL THEN least(x.r, x.n - 1) + least(y.r, x.n - 1) - 2 * (least(x.r, y.r) - 1) END AS DOUBLE) AS distance
FROM t LEFT JOIN p x ON x.tree_id = t.tree_id AND x.gid = 0 LEFT JOIN p y ON y.tree_id = t.tree_id AND y.gid = 3""")
def branch_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir, "partial")
    return trees.branch_distance(ens, ens.taxa[0], ens.taxa[3])


@_query("multi_lca_steiner", _with(_LADDER) + """SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(0 AS BIGINT) AS set_id, CAST(min(r) - 1 AS DOUBLE) AS lca_depth,
CAST(sum(least(r, n - 1)) - (min(r) - 1) - sum(CASE WHEN above IS NOT NULL THEN least(r, above) - 1 ELSE 0 END) AS DOUBLE) AS steiner
FROM (SELECT *, lead(r) OVER (PARTITION BY tree_id ORDER BY r) AS above FROM (SELECT * FROM ranks WHERE r IN (2, 3, 5))) GROUP BY 1""")
def multi_lca_steiner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir)
    n = trees.nodes(ens.trees)
    members = n.where("is_leaf and node_id in (1, 2, 4)").select("tree_id", F.lit(0).cast("bigint").alias("set_id"), "node_id")
    m = trees.multi_lca(n, members)
    depth = n.select("tree_id", F.col("node_id").alias("lca"), F.col("root_distance").alias("lca_depth"))
    return m.join(depth, ["tree_id", "lca"]).select("tree_id", "set_id", "lca_depth", "steiner")


@_query("quartet_split", _with(_LADDER, _taxa("ranks"), _quartets(6), _LADDER_PAIRS) + "SELECT quartet_idx, CAST(tree_id AS BIGINT) AS tree_id, CASE WHEN r0 > r1 AND r0 > r2 THEN 0 WHEN r1 > r0 AND r1 > r2 THEN 1 ELSE 2 END AS topology FROM sums")
def quartet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir)
    q = _first(ens, 6)
    return trees.tree_splits(ens, q).join(q.table(spark).select("qi", "quartet_idx"), "qi").select("quartet_idx", "tree_id", "topology")


@_query("tree_dedup_multiplicity", _with(_STAR) + """SELECT grp AS "group", CAST(min(tree_id) AS BIGINT) AS tree_id, CAST(count(DISTINCT rep) AS INTEGER) AS multiplicity, CAST(count(DISTINCT rep % 3) AS INTEGER) AS n_variants FROM star GROUP BY 1""")
def tree_dedup_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ensemble(spark, sf_dir, "star").topologies.select("group", "tree_id", "multiplicity", "n_variants")


@_query("quartet_rank", "WITH taxa AS (SELECT CAST(range AS BIGINT) AS gid, CAST(range AS VARCHAR) AS taxon FROM range(20)), " + _quartets(20) + " SELECT ga AS a, gb AS b, gc AS c, gd AS d, quartet_idx FROM q")
def quartet_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fq.all_quartets(spark.range(20).withColumnRenamed("id", "gid"))
    return q.withColumn("quartet_idx", fq.rank_column(*[F.col(x) for x in "abcd"]))


@_query("quartet_unrank", "WITH taxa AS (SELECT CAST(range AS BIGINT) AS gid, CAST(range AS VARCHAR) AS taxon FROM range(20)), " + _quartets(20) + " SELECT quartet_idx, CAST(ga AS INTEGER) AS a, CAST(gb AS INTEGER) AS b, CAST(gc AS INTEGER) AS c, CAST(gd AS INTEGER) AS d FROM q")
def quartet_unrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.unrank_table(spark.range(4845).withColumnRenamed("id", "quartet_idx"))


def _drawn(n: int, rows: str) -> str:
    """The pseudo-random sequence as a recursive query; ``rows`` gives (pos, off)."""
    nxt = "xor(xor(xor(s3, (s3 << 11) & 4294967295), xor(s3, (s3 << 11) & 4294967295) >> 8), xor(s0, s0 >> 19))"
    return f"""WITH RECURSIVE rows_in AS ({rows}), walk AS (
  SELECT pos, (off & 4294967295) AS s0, (off >> 32) AS s1, CAST(2654435769 AS BIGINT) AS s2, CAST(2135587861 AS BIGINT) AS s3, CAST([] AS BIGINT[]) AS o FROM rows_in
  UNION ALL
  SELECT pos, v, s0, s1, s2, CASE WHEN list_contains(o, v % {n}) THEN o ELSE list_append(o, v % {n}) END FROM (SELECT *, {nxt} AS v FROM walk WHERE len(o) < 4)
), done AS (SELECT pos, list_sort(o) AS o FROM walk WHERE len(o) = 4)
SELECT CAST(pos AS BIGINT) AS qi, CAST(o[1] AS INTEGER) AS a, CAST(o[2] AS INTEGER) AS b, CAST(o[3] AS INTEGER) AS c, CAST(o[4] AS INTEGER) AS d FROM done"""


_25 = [f"t{i}" for i in range(25)]


@_query("quartet_random", _drawn(25, "SELECT CAST(range AS BIGINT) AS pos, CAST(42 + range AS BIGINT) AS off FROM range(2000)").replace("2135587861", str(0x7F4A7C13)))
def quartet_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.Quartets.random(_25, 2000, 42).table(spark).drop("quartet_idx")


@_query("quartet_mixed_window", "SELECT * FROM (" + _drawn(25, f"SELECT CAST(range + 2 AS BIGINT) AS pos, CAST({0x12345678} * 0 + SEED + range AS BIGINT) AS off FROM range(500)").replace("2135587861", str(0x7F4A7C13)) + ") UNION ALL SELECT 0, 3, 5, 7, 11 UNION ALL SELECT 1, 0, 1, 2, 24")
def quartet_mixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fq.Quartets(_25, [(11, 7, 5, 3), (24, 0, 1, 2)], 0, 502).table(spark).drop("quartet_idx")


ORACLES["quartet_mixed_window"] = ORACLES["quartet_mixed_window"].replace("SEED", str(fq.Quartets(_25, [(11, 7, 5, 3), (24, 0, 1, 2)], 0, 1).rng_seed))

_QED = """, wide AS (SELECT quartet_idx, a, b, c, d, grp, sum(CASE WHEN k = 0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS n1, sum(CASE WHEN k = 2 THEN n ELSE 0 END) AS n2 FROM full_grid GROUP BY ALL),
fav AS (SELECT *, n0 + n1 + n2 AS nn, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS f FROM wide),
scored AS (SELECT x.quartet_idx, x.a, x.b, x.c, x.d, x.grp AS group_a, y.grp AS group_b,
  CASE WHEN x.nn = 0 OR y.nn = 0 THEN 0.0 ELSE (CASE WHEN x.f = y.f THEN 1 ELSE -1 END) * (1
    + CASE WHEN x.n0 * y.n0 > 0 THEN (x.n0 / x.nn) * (y.n0 / y.nn) * ln((x.n0 / x.nn) * (y.n0 / y.nn)) ELSE 0 END * 0.9102392266268374
    + CASE WHEN x.n1 * y.n1 > 0 THEN (x.n1 / x.nn) * (y.n1 / y.nn) * ln((x.n1 / x.nn) * (y.n1 / y.nn)) ELSE 0 END * 0.9102392266268374
    + CASE WHEN x.n2 * y.n2 > 0 THEN (x.n2 / x.nn) * (y.n2 / y.nn) * ln((x.n2 / x.nn) * (y.n2 / y.nn)) ELSE 0 END * 0.9102392266268374) END AS s
  FROM fav x JOIN fav y ON x.quartet_idx = y.quartet_idx AND {pairs})"""
_SCORED = " SELECT quartet_idx, a, b, c, d, group_a, group_b, round(s, 6) AS qed FROM scored"


def _scores(spark: SparkSession, sf_dir: str, pairs: list | None = None) -> tuple[Ensemble, DataFrame, DataFrame]:
    ens = derived.ensemble(spark, sf_dir, "partial")
    t = quartet_topology(ens, _first(ens))
    return ens, t, qed.qed(t, ens.groups, pairs).withColumn("qed", F.round("qed", 6))


def _qed_sql(final: str, pairs: str = "x.grp < y.grp") -> str:
    return _ladder_sql("", True).rstrip() + _QED.replace("{pairs}", pairs) + final


@_query("qed_pairs", _qed_sql(_SCORED))
def qed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir, "partial")
    return qed.quartet_qed(ens, _first(ens)).drop("qi").withColumn("qed", F.round("qed", 6))


@_query("qed_custom_pairs", _qed_sql(_SCORED, "((x.grp = 'R' AND y.grp = 'A') OR (x.grp = 'N' AND y.grp = 'N'))"))
def qed_custom_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, [("R", "A"), ("N", "N")])[2].drop("qi")


@_query("qed_mean", _qed_sql(" SELECT round(avg(s), 6) AS mean_qed FROM scored"))
def qed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir, "partial")
    return qed.mean_qed(qed.quartet_qed(ens, _first(ens))).select(F.round("mean_qed", 6).alias("mean_qed"))


@_query("topology_wide", _ladder_sql("SELECT quartet_idx, a, b, c, d, " + ", ".join(f"CAST(sum(CASE WHEN grp = '{g}' AND k = {k} THEN n END) AS INTEGER) AS \"{g}_t{k}\"" for g in "ANR" for k in range(4)) + " FROM full_grid GROUP BY 1, 2, 3, 4, 5", True))
def topology_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens = derived.ensemble(spark, sf_dir, "partial")
    return topology_wide_rows(ens, _first(ens))


@_query("qed_wide", _qed_sql(" SELECT quartet_idx, a, b, c, d, " + ", ".join(f"max(CASE WHEN group_a = '{x}' AND group_b = '{y}' THEN round(s, 6) END) AS \"{x}_vs_{y}\"" for x, y in ("AN", "AR", "NR")) + " FROM scored GROUP BY 1, 2, 3, 4, 5"))
def qed_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens, _, s = _scores(spark, sf_dir)
    return frames.qed_frame(s, qed.default_pairs(ens.groups), "wide")


@_query("topology_qed_join", _qed_sql(' SELECT g.quartet_idx, g.a, g.b, g.c, g.d, g.grp AS "group", g.k AS topology, CAST(g.n AS INTEGER) AS count, group_a, group_b, round(s, 6) AS qed FROM full_grid g LEFT JOIN scored ON scored.quartet_idx = g.quartet_idx'))
def topology_qed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, t, s = _scores(spark, sf_dir)
    return frames.topology_with_qed(t, s)


def _mul(spark: SparkSession, sf_dir: str) -> tuple[Ensemble, fq.Quartets]:
    source = derived.copies(spark, sf_dir)
    names = [r[0] for r in derived.ranked(spark, sf_dir).select("taxon").distinct().collect()]
    mapping = {f"{g}_{i}": g for g in sorted(names)[:2] for i in range(2)}
    ens = Ensemble(spark, source, taxon_map=mapping)
    return ens, ens.quartets(None, 0, 300)


_MUL = """nm AS (SELECT taxon, row_number() OVER (ORDER BY taxon) AS p FROM (SELECT DISTINCT taxon FROM ranks)),
few AS (SELECT tree_id, grp, ranks.taxon, r, p FROM ranks JOIN nm ON nm.taxon = ranks.taxon WHERE p <= 3 OR r <= 6),
two AS (SELECT tree_id, grp, taxon, p, taxon || '_' || i AS leaf, (r * 7 * (i + 1)) % 31 AS k FROM few CROSS JOIN (VALUES (0), (1)) v(i)),
pos AS (SELECT *, CASE WHEN p <= 2 THEN taxon ELSE leaf END AS label, row_number() OVER (PARTITION BY tree_id ORDER BY k, leaf) - 1 AS leaf_id FROM two),
shape AS (SELECT tree_id, grp, string_agg(label, ',' ORDER BY leaf_id) AS names FROM pos GROUP BY 1, 2),
one AS (SELECT min(tree_id) AS tree_id FROM shape GROUP BY grp, names),
slot AS (SELECT tree_id, taxon AS genome, leaf_id, row_number() OVER (PARTITION BY tree_id, taxon ORDER BY leaf_id) - 1 AS copy FROM pos WHERE p <= 2)"""


@_query("paralog_namespace", _with(_LADDER, _MUL) + """, names AS (SELECT DISTINCT label AS genome, p <= 2 AS many FROM pos), copies AS (SELECT DISTINCT genome, copy FROM slot)
SELECT CAST(row_number() OVER (ORDER BY many, names.genome, coalesce(copy, 0)) - 1 AS INTEGER) AS gid, CASE WHEN many THEN names.genome || '_copy' || copy ELSE names.genome END AS name, names.genome, CAST(coalesce(copy, 0) AS INTEGER) AS copy
FROM names LEFT JOIN copies ON copies.genome = names.genome""")
def paralog_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mul(spark, sf_dir)[0].taxa_table()


@_query("paralog_quartets", _with(_LADDER, _MUL) + """, copies AS (SELECT DISTINCT genome, copy FROM slot), g AS (SELECT *, row_number() OVER (ORDER BY genome, copy) - 1 AS s FROM copies),
m AS (SELECT count(DISTINCT label) AS singles FROM pos WHERE p > 2), ids AS (SELECT genome, s + singles AS gid FROM g CROSS JOIN m), total AS (SELECT max(gid) + 1 AS n FROM ids),
w AS (SELECT n - 8 + a.range AS a, n - 8 + b.range AS b, n - 8 + c.range AS c, n - 8 + d.range AS d, row_number() OVER (ORDER BY a.range, b.range, c.range, d.range) - 1 AS qi
  FROM total, range(8) a, range(8) b, range(8) c, range(8) d WHERE a.range < b.range AND b.range < c.range AND c.range < d.range)
SELECT DISTINCT genome, CAST(qi AS BIGINT) AS qi FROM w JOIN ids ON gid IN (a, b, c, d)""")
def paralog_quartets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens, _ = _mul(spark, sf_dir)
    n = len(ens.taxa)
    q = list(itertools.combinations(range(n - 8, n), 4))
    return paralog.quartet_index(ens, ens.quartets(q, 0, len(q)))


@_query("paralog_slots", _with(_LADDER, _MUL) + """, grid AS (SELECT DISTINCT slot.genome, slot.copy, one.tree_id FROM slot CROSS JOIN one)
SELECT grid.genome, CAST(grid.copy AS INTEGER) AS copy, CAST(grid.tree_id AS BIGINT) AS tree_id, CAST(leaf_id AS INTEGER) AS leaf_id
FROM grid LEFT JOIN slot ON slot.tree_id = grid.tree_id AND slot.genome = grid.genome AND slot.copy = grid.copy""")
def paralog_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paralog.assignments(_mul(spark, sf_dir)[0])


@_query("paralog_delta")
def paralog_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ens, q = _mul(spark, sf_dir)
    return paralog.counts_delta(ens, q, next(iter(ens.paralogs)), (1, 0))


@_query("paralog_optimise")
def paralog_optimise(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, r = paralog.optimize(*_mul(spark, sf_dir), max_iter=3)
    return spark.createDataFrame([(i, float(x), r.converged) for i, x in enumerate(r.qed_history)], "sweep int, mean_qed double, converged boolean")


def _graph(spark: SparkSession, sf_dir: str) -> consensus.ConsensusGraph:
    ens = derived.ensemble(spark, sf_dir, "star")
    text = derived.star(spark, sf_dir).orderBy("tree_id").first()["newick"]
    return consensus.ConsensusGraph(text, ens.taxa)


@_query("branch_qsupp", _with(_STAR) + """, t AS (SELECT * FROM star WHERE tree_id = (SELECT min(tree_id) FROM star)),
pos AS (SELECT *, row_number() OVER (ORDER BY rk, nk) - 1 AS p FROM t), reg AS (SELECT rk, min(p) AS lo, max(p) AS hi, count(*) AS m, max(len) AS len FROM pos GROUP BY 1),
tot AS (SELECT sum(m) AS s, sum(m * m) AS s2 FROM reg)
SELECT CAST(lo AS INTEGER) AS leaf_lo, CAST(hi AS INTEGER) AS leaf_hi, CAST(len AS DOUBLE) AS length,
CAST(((s - m) * (s - m) - (s2 - m * m)) // 2 * (m * (m - 1)) // 2 AS BIGINT) AS n_qsupp FROM reg CROSS JOIN tot WHERE m > 1""")
def branch_qsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).branch_table(spark).drop("branch")


@_query("prune_newick", _with(_STAR) + """, t AS (SELECT * FROM star WHERE tree_id = (SELECT min(tree_id) FROM star)),
reg AS (SELECT rk, '(' || string_agg(taxon, ',' ORDER BY nk) || ')' AS x, string_agg(taxon, ',' ORDER BY nk) AS y FROM t GROUP BY 1)
SELECT '(' || string_agg(x, ',' ORDER BY rk) FILTER (rk > (SELECT min(rk) FROM reg)) || ',' || max(y) FILTER (rk = (SELECT min(rk) FROM reg)) || ');' AS newick FROM reg""")
def prune_newick(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    g.prune(min(g.active_branch_ids))
    return spark.createDataFrame([(g.to_newick(),)], "newick string")


@_query("tree_topologies", _with(_LADDER, _taxa("ranks"), _quartets(), _LADDER_PAIRS, _COUNTED.replace("GROUPS_OF", "ranks")) + 'SELECT grp AS "group", quartet_idx, k AS topology, CAST(count(*) AS INTEGER) AS count, CAST(sum(s) AS DOUBLE) AS steiner_sum FROM len GROUP BY 1, 2, 3')
def tree_topology_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = derived.ladder(spark, sf_dir)
    taxa = sorted(r[0] for r in derived.ranked(spark, sf_dir).select("taxon").distinct().collect())
    q = fq.Quartets(taxa, x := list(itertools.combinations(range(min(TAXA, len(taxa))), 4)), 0, len(x))
    rows = tree_topologies(source, q).groupBy("group", "qi", "topology").agg(F.count("*").cast("int").alias("count"), F.sum("steiner").alias("steiner_sum"))
    return rows.join(q.table(spark).select("qi", "quartet_idx"), "qi").drop("qi")


def queries() -> dict[str, Query]:
    """All registered queries."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express."""
    return dict(ORACLES)
