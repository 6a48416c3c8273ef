"""Ensembles derived from the star-schema tables, as NEWICK text.

The tables hold no trees. Nations are taxa, return flags are groups, shipping months
are replicates; quantities shipped decide the shape. The text goes through the whole
engine, while closed forms of the same trees can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ensemble import Ensemble

#: Taxa of each tree ranked by quantity; {having} may thin them out.
RANKS = """
base AS (
  SELECT l_returnflag AS grp, month(l_shipdate) AS rep, s_nationkey AS nk, sum(l_quantity) AS q
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY 1, 2, 3 {having}
), ranks AS (
  SELECT grp, rep, replace(n_name, ' ', '_') AS taxon, ascii(grp) * 100 + rep AS tree_id,
         row_number() OVER (PARTITION BY grp, rep ORDER BY q DESC, nk) AS r,
         count(*) OVER (PARTITION BY grp, rep) AS n
  FROM base JOIN {nation} ON nk = n_nationkey
)"""
PARTIAL = "HAVING count(*) % 4 <> 0"
#: Two-level trees: regions below the root, nations below regions.
STAR = """
reps AS (SELECT DISTINCT l_returnflag AS grp, month(l_shipdate) AS rep FROM {lineitem}),
star AS (
  SELECT grp, rep, ascii(grp) * 100 + rep AS tree_id, r_regionkey AS rk, replace(n_name, ' ', '_') AS taxon,
         1 + (rep + r_regionkey) % 3 AS len,
         n_nationkey = max(n_nationkey) OVER (PARTITION BY grp, rep, r_regionkey) AS last_nation,
         r_regionkey = max(r_regionkey) OVER (PARTITION BY grp, rep) AS last_region, n_nationkey AS nk
  FROM reps CROSS JOIN {nation} JOIN {region} ON n_regionkey = r_regionkey
)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver tables by name."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier", "nation", "region")}


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    t = tables(spark, sf_dir)
    return spark.sql(text, **{k: v for k, v in t.items() if "{" + k + "}" in text})


def ranked(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    """``(grp, rep, tree_id, taxon, r, n)``."""
    return _sql(spark, sf_dir, "WITH " + RANKS.replace("{having}", PARTIAL if partial else "") + " SELECT * FROM ranks")


def ladder(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    """Caterpillars by rank, unit lengths: ``(tree_id, group, newick)``."""
    r = ranked(spark, sf_dir, partial)
    t = r.where("n >= 2").groupBy("tree_id", F.col("grp").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "taxon"))), lambda x: x["taxon"]).alias("x"))
    n = F.size("x")
    text = F.concat(
        F.lit("("), F.array_join(F.transform(F.slice("x", 1, n - 1), lambda v: F.concat(v, F.lit(":1"))), ",("),
        F.lit(","), F.element_at("x", -1), F.lit(":1"), F.repeat(F.lit("):1"), n - 2), F.lit(");"),
    )
    return t.select("tree_id", "group", text.alias("newick"))


def star(spark: SparkSession, sf_dir: str, zero: bool = False) -> DataFrame:
    """Two-level multifurcating trees; ``zero``: regions with an even key have length 0."""
    s = _sql(spark, sf_dir, "WITH " + STAR + " SELECT * FROM star")
    length = F.when(F.lit(zero) & (F.col("rk") % 2 == 0), 0).otherwise(F.col("len"))
    inner = s.groupBy("tree_id", "grp", "rk", length.alias("len")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nk", "taxon"))), lambda x: F.concat(x["taxon"], F.lit(":1"))).alias("x"))
    region = F.concat(F.lit("("), F.array_join("x", ","), F.lit("):"), F.col("len").cast("string"))
    outer = inner.select("tree_id", "grp", F.struct("rk", region.alias("t")).alias("p")).groupBy("tree_id", F.col("grp").alias("group")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return outer.select("tree_id", "group", F.concat(F.lit("("), F.array_join(F.transform("p", lambda x: x["t"]), ","), F.lit(");")).alias("newick"))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ladders in which the first nations by name have two copies, ranked apart."""
    r = ranked(spark, sf_dir)
    names = sorted(x[0] for x in r.select("taxon").distinct().collect())
    few = r.where(F.col("taxon").isin(names[:3]) | (F.col("r") <= 6)).select("tree_id", "grp", "taxon", "r")
    two = few.select("tree_id", "grp", F.explode(F.array(*[F.struct(F.concat("taxon", F.lit(f"_{i}")).alias("leaf"), (F.col("r") * 7 * (i + 1) % 31).alias("k")) for i in range(2)])).alias("x")).select("tree_id", "grp", "x.*")
    return _ladders(two)


#: Ladders over all customers, more taxa than pair tables are made for.
CROWD = """
ranks AS (
  SELECT 'W' AS grp, rep, 'C' || lpad(CAST(c_custkey AS STRING), 7, '0') AS taxon, rep AS tree_id,
         row_number() OVER (PARTITION BY rep ORDER BY (c_custkey * (2 * rep + 1) * 7919) % 10007, c_custkey) AS r,
         count(*) OVER (PARTITION BY rep) AS n
  FROM {customer} CROSS JOIN (VALUES (1), (2), (3)) v(rep)
)"""


def crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(tree_id, group, newick)`` of the ladders over customers."""
    r = spark.sql("WITH " + CROWD + " SELECT * FROM ranks", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return _ladders(r.select("tree_id", "grp", F.col("r").alias("k"), F.col("taxon").alias("leaf")))


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level trees whose regions have supports, from the first replicate of each group."""
    s = _sql(spark, sf_dir, "WITH " + STAR + " SELECT * FROM star WHERE rep = 1")
    leaf = F.transform(F.array_sort(F.collect_list(F.struct("nk", "taxon"))), lambda x: F.concat(x["taxon"], F.lit(":0.5")))
    inner = s.groupBy("tree_id", "grp", "rk", "len").agg(leaf.alias("x"))
    region = F.concat(F.lit("("), F.array_join("x", ","), F.lit(")0."), (F.col("rk") + 1).cast("string"), F.lit(":"), F.col("len").cast("string"))
    outer = inner.select("tree_id", "grp", F.struct("rk", region.alias("t")).alias("p")).groupBy("tree_id", F.col("grp").alias("group")).agg(F.array_sort(F.collect_list("p")).alias("p"))
    # a comment and blanks don't matter
    return outer.select(F.col("tree_id").cast("bigint"), "group", F.concat(F.lit(" [made] ("), F.array_join(F.transform("p", lambda x: x["t"]), " , "), F.lit(");")).alias("newick"))


def _ladders(rows: DataFrame) -> DataFrame:
    """Caterpillars of rows (tree_id, grp, k, leaf) in order of (k, leaf), unit lengths, from four leaves on."""
    t = rows.groupBy("tree_id", F.col("grp").alias("group")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "leaf"))), lambda x: x["leaf"]).alias("x"))
    n = F.size("x")
    text = F.concat(
        F.lit("("), F.array_join(F.transform(F.slice("x", 1, n - 1), lambda v: F.concat(v, F.lit(":1"))), ",("),
        F.lit(","), F.element_at("x", -1), F.lit(":1"), F.repeat(F.lit("):1"), n - 2), F.lit(");"),
    )
    return t.where(n >= 4).select("tree_id", "group", text.alias("newick"))


def ensemble(spark: SparkSession, sf_dir: str, kind: str = "ladder") -> Ensemble:
    """A derived ensemble: ladder, partial, star, zero or both (star with zero-length regions), crowd or supported."""
    if kind in ("ladder", "partial"):
        return Ensemble(spark, ladder(spark, sf_dir, kind == "partial"), checked=False)
    if kind in ("star", "zero", "both"):
        strategy = {"star": "multifurcation", "zero": "zero-length-branch", "both": "both"}[kind]
        return Ensemble(spark, star(spark, sf_dir, kind != "star"), polytomy_strategy=strategy, checked=False)
    if kind in ("crowd", "supported"):
        return Ensemble(spark, (crowd if kind == "crowd" else supported)(spark, sf_dir), checked=False)
    raise ValueError(f"unknown ensemble {kind!r}")
