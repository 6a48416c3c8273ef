"""Ensembles: grouped trees over one namespace of taxa, as DataFrames.

``trees`` has one row for each input tree, ``topologies`` one for each different topology of a
group, with its multiplicity. The different sets of branch lengths of a topology are
rows of ``variants``; they meet their topology only where lengths are measured, some
``SETS`` of them in a row. A tree is never split over rows, so everything that looks
inside one is narrow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quartets import Quartets
from ..sources import newick
from ..ship import ship
from ..sources.readers import tree_table

#: Sets of branch lengths in one row, about.
SETS = 64

_INT, _DOUBLE = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
TREE_FIELDS = [
    T.StructField("n_leaves", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("parent", _INT), T.StructField("left", _INT), T.StructField("right", _INT), T.StructField("length", _DOUBLE), T.StructField("support", _DOUBLE),
    T.StructField("rd", _DOUBLE), T.StructField("depth", _INT), T.StructField("lo", _INT), T.StructField("hi", _INT),
    T.StructField("poly", T.ArrayType(T.BooleanType())), T.StructField("gap", _INT), T.StructField("topo_hash", T.StringType()), T.StructField("tree_hash", T.StringType()),
    T.StructField("had_multifurcations", T.BooleanType()), T.StructField("n_zero_length", T.IntegerType()),
]


def parse_trees(df: DataFrame, taxon_map: Mapping[str, str] | None = None, strategy: str = "multifurcation", missing_length: float = 1.0) -> DataFrame:
    """``(tree_id, group)`` and the arrays of each tree of ``(tree_id, group, newick)``.

    ``labels`` are the leaf labels, ``names`` the genomes they map to. Absent lengths,
    supports, parents and children are null. A null tree raises like a malformed one.
    """
    if strategy not in newick.STRATEGIES:
        raise ValueError(f"polytomy strategy must be one of {', '.join(newick.STRATEGIES)}")
    ship(df.sparkSession)
    mapping = dict(taxon_map or {})
    schema = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("group", T.StringType()), *TREE_FIELDS])

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                t = newick.parse(text, strategy, missing_length)
                labels = t.names
                t.names = [mapping.get(x, x) for x in labels]
                none = lambda x: [None if v < 0 else int(v) for v in x]
                real = lambda x: [None if np.isnan(v) else float(v) for v in x]
                rows.append([
                    t.n_leaves, t.names, labels, none(t.parent), none(t.children[:, 0]), none(t.children[:, 1]), real(t.length), real(t.support),
                    t.rd.tolist(), t.depth.tolist(), t.lo.tolist(), t.hi.tolist(), t.poly.tolist(), t.gap.tolist(), t.topology_key(), t.length_key(), t.had_multifurcations, t.n_zero_length,
                ])
            from pyspark.sql.pandas.types import to_arrow_type

            columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(TREE_FIELDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *columns], names=schema.names)

    return df.select(F.col("tree_id").cast("bigint"), F.col("group").cast("string"), "newick").mapInArrow(run, schema)


def parse_parts(df: DataFrame, keep: int, strategy: str = "multifurcation", missing_length: float = 1.0) -> DataFrame:
    """``(tree_id, group)``, the keys of each tree of ``(tree_id, group, newick)`` and the arrays of its first ``keep`` names.

    See :func:`~tetraclade.sources.newick.parse_part`.
    """
    ship(df.sparkSession)
    fields = [f for f in TREE_FIELDS if f.name in ("n_leaves", "names", "rd", "depth", "poly", "gap", "topo_hash", "tree_hash")]
    schema = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("group", T.StringType()), *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = []
            for text in batch.column(2):
                t = newick.parse_part(text.as_py(), keep, strategy, missing_length)
                rows.append([t.n_leaves, t.names, t.rd, t.depth, t.poly, t.gap, t.topology_key, t.length_key])
            columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), *columns], names=schema.names)

    return df.select(F.col("tree_id").cast("bigint"), F.col("group").cast("string"), "newick").mapInArrow(run, schema)


class Ensemble:
    """Trees, groups and namespace; everything derived is lazy.

    ``data`` is a DataFrame ``(tree_id, group, newick)`` or anything that
    :func:`~tetraclade.sources.readers.normalize_input` takes. ``taxon_map`` maps leaf
    labels to genomes, of which a tree may then hold several copies.
    """

    def __init__(
        self,
        spark: SparkSession,
        data: object,
        taxon_map: Mapping[str, str] | None = None,
        polytomy_strategy: str = "multifurcation",
        missing_length: float = 1.0,
        checked: bool = True,
    ):
        self.spark = spark
        source = data if isinstance(data, DataFrame) else tree_table(spark, data)
        self.taxon_map = dict(taxon_map or {})
        self.polytomy_strategy, self.missing_length = polytomy_strategy, missing_length
        self._source, self._keep = source, None
        self.trees = parse_trees(source, taxon_map, polytomy_strategy, missing_length).persist()
        if checked and isinstance(data, DataFrame):
            again = self.trees.groupBy("tree_id").count().where("count > 1").first()
            if again:
                raise ValueError(f"tree_id {again[0]} stands for {again[1]} trees")
        if checked and not self.taxon_map:
            twice = self.trees.where(F.size(F.array_distinct("names")) < F.size("names")).select("tree_id").first()
            if twice:
                raise ValueError(f"tree {twice[0]} repeats a leaf name; a taxon_map is needed for copies")

    @cached_property
    def _labels(self) -> list:
        """Groups (n null), and names with the most copies that a tree has; one job, its rows bounded by taxa and groups.

        Copies are counted inside each tree, so only (name, number) pairs move.
        """
        groups = self.trees.select(F.col("group").alias("label"), F.lit(None).cast("int").alias("n")).distinct()
        if self.taxon_map:
            times = F.transform(F.array_distinct("names"), lambda x: F.struct(x.alias("label"), F.size(F.filter("names", lambda y: y == x)).alias("n")))
        else:
            times = F.transform("names", lambda x: F.struct(x.alias("label"), F.lit(1).alias("n")))
        names = self.trees.select(F.explode(times).alias("x")).select("x.*").groupBy("label").agg(F.max("n").alias("n"))
        return groups.union(names).collect()

    @cached_property
    def groups(self) -> list[str]:
        """Group labels in order."""
        return sorted(r["label"] for r in self._labels if r["n"] is None)

    @cached_property
    def _copies(self) -> list:
        return sorted((r["label"], r["n"]) for r in self._labels if r["n"] is not None)[: self._keep]

    @cached_property
    def paralogs(self) -> dict[str, int]:
        """Genomes of several copies and the number of their slots."""
        return {name: n for name, n in self._copies if n > 1}

    @cached_property
    def taxa(self) -> list[str]:
        """Names by global id: single ones in order, then the copy slots of each genome."""
        single = [name for name, n in self._copies if n == 1]
        return single + [f"{g}_copy{i}" for g, n in self.paralogs.items() for i in range(n)]

    def taxa_table(self) -> DataFrame:
        """``(gid, name, genome, copy)``."""
        single = len(self.taxa) - sum(self.paralogs.values())
        rows = [(i, t, t, 0) for i, t in enumerate(self.taxa[:single])]
        at = single
        for g, n in self.paralogs.items():
            rows += [(at + i, self.taxa[at + i], g, i) for i in range(n)]
            at += n
        return self.spark.createDataFrame(rows, "gid int, name string, genome string, copy int")

    def slot_ids(self, genome: str) -> list[int]:
        """Global ids of a genome's copy slots."""
        first = self.taxa.index(f"{genome}_copy0")
        return list(range(first, first + self.paralogs[genome]))

    def group_table(self) -> DataFrame:
        """``(group, group_idx)``."""
        return self.spark.createDataFrame(list(zip(self.groups, range(len(self.groups)))), "group string, group_idx int")

    @property
    def n_trees(self) -> int:
        return self.trees.count()

    @property
    def n_groups(self) -> int:
        return len(self.groups)

    @cached_property
    def variants(self) -> DataFrame:
        """``(group, topo_hash, tree_hash, first, multiplicity, rd)``: the different sets of lengths of a topology."""
        own = F.min(F.struct("tree_id", "rd")).alias("x")
        v = self.trees.groupBy("group", "topo_hash", "tree_hash").agg(F.count("*").cast("int").alias("multiplicity"), own)
        return v.select("group", "topo_hash", "tree_hash", F.col("x.tree_id").alias("first"), "multiplicity", F.col("x.rd").alias("rd"))

    @cached_property
    def topologies(self) -> DataFrame:
        """One row for each topology of a group: its first tree, multiplicity and number of variants.

        Nothing is joined by ``tree_id``, so counts are right even if identifiers repeat.
        """
        same = ["group", "topo_hash"]
        tree = F.struct(*[c for c in self.trees.columns if c not in (*same, "tree_hash")])
        v = self.trees.groupBy(*same, "tree_hash").agg(F.count("*").alias("m"), F.min_by(tree, "tree_id").alias("t"))
        v = v.groupBy(*same).agg(F.sum("m").cast("int").alias("multiplicity"), F.count("*").cast("int").alias("n_variants"), F.min_by("t", F.struct("t.tree_id", "tree_hash")).alias("t"))
        return v.select(*same, "multiplicity", "n_variants", "t.*").join(self.group_table(), "group")

    def measured(self, sets: int | None = SETS) -> DataFrame:
        """``seated`` with ``variants``, arrays of (first, multiplicity, rd).

        A topology has a row for about every ``sets`` of its variants, one with None.
        """
        same = ["group", "topo_hash"]
        n = F.greatest(F.lit(1), F.ceil(F.col("n_variants") / sets)) if sets else F.lit(1)
        parts = self.seated.select(*same, n.alias("n"))
        v = self.variants.join(parts, same).withColumn("part", F.pmod(F.xxhash64("tree_hash"), F.col("n")))
        v = v.groupBy(*same, "part").agg(F.array_sort(F.collect_list(F.struct("first", "multiplicity", "rd"))).alias("variants"))
        return self.seated.join(v.drop("part"), same)

    @property
    def stored(self) -> DataFrame:
        """``topologies`` with all ``variants`` of each in one row, to look at."""
        return self.placed.drop("slots")

    @property
    def placed(self) -> DataFrame:
        """``stored`` with ``slots``."""
        return self.measured(None)

    def slots(self, names: Sequence[str]) -> np.ndarray:
        """Leaf of each global id in a tree of these leaf names, -1 if absent."""
        return _slots(self._slot_map(), len(self.taxa), names)

    def _slot_map(self) -> dict[str, list[int]]:
        single = len(self.taxa) - sum(self.paralogs.values())
        out = {t: [i] for i, t in enumerate(self.taxa[:single])}
        return out | {g: self.slot_ids(g) for g in self.paralogs}

    @cached_property
    def seated(self) -> DataFrame:
        """``topologies`` with ``slots``: the leaf of each global id, -1 if absent."""
        where, n = self._slot_map(), len(self.taxa)
        df = self.topologies
        schema = T.StructType([*df.schema.fields, T.StructField("slots", _INT)])

        def run(batches):
            at = df_names.index("names")
            for b in batches:
                slots = pa.array([_slots(where, n, x).tolist() for x in b.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, slots], names=[*df_names, "slots"])

        df_names = df.columns
        return df.mapInArrow(run, schema).persist()

    def tree_taxa(self) -> DataFrame:
        """``(tree_id, gid, leaf_id)`` of the taxa present in each stored tree."""
        return self.seated.select("tree_id", F.posexplode("slots").alias("gid", "leaf_id")).where("leaf_id >= 0")

    def first(self, n: int) -> Ensemble:
        """A copy over the first ``n`` names in order, for counts, lengths and whatever else reads stored trees.

        Other leaves don't get beyond the parser, so memory is that of flat arrays of one tree
        a task. Topologies are told apart by whole trees, so counts are those of this ensemble.
        """
        if self.taxon_map:
            raise ValueError("names that stand for several copies can't be left out")
        if n < 1:
            raise ValueError("at least one name must stay")
        other = object.__new__(Ensemble)
        kept = ("spark", "taxon_map", "polytomy_strategy", "missing_length", "_source")
        other.__dict__.update({k: self.__dict__[k] for k in kept})
        # the first names of all trees are among the first of each tree that has them
        other._keep = n if self._keep is None else min(n, self._keep)
        other.trees = parse_parts(self._source, other._keep, self.polytomy_strategy, self.missing_length).persist()
        return other

    def with_seated(self, seated: DataFrame) -> Ensemble:
        """A copy with other stored trees."""
        other = object.__new__(Ensemble)
        other.__dict__.update(self.__dict__)
        other.__dict__["seated"] = seated
        return other

    def with_slots(self, slots: DataFrame) -> Ensemble:
        """A copy whose stored trees have the slots of ``(tree_id, slots)``."""
        return self.with_seated(self.seated.drop("slots").join(slots, "tree_id"))

    def quartets(self, *args: object, **kwargs: object) -> Quartets:
        """A window of the sequence over this namespace."""
        return Quartets(self.taxa, *args, **kwargs)

    def random_quartets(self, count: int, seed: object = None) -> Quartets:
        """Random quartets of this namespace."""
        return Quartets.random(self.taxa, count, seed)

    def qed(self, topology: DataFrame, group_pairs: Sequence | None = None) -> DataFrame:
        """See :func:`tetraclade.operators.qed.qed`."""
        from .qed import qed

        return qed(topology, self.groups, group_pairs)

    def resolve_paralogs(self, quartets: Quartets, max_iter: int = 100) -> tuple:
        """See :func:`tetraclade.operators.paralog.resolve`."""
        from .paralog import resolve

        return resolve(self, quartets, max_iter)

    def quartet_topology(self, window: Quartets, steiner: bool = False, strategy: str = "auto") -> DataFrame:
        """See :func:`tetraclade.operators.topology.quartet_topology`."""
        from .topology import quartet_topology

        return quartet_topology(self, window, steiner, strategy)

    def branch_distance(self, a: str | int, b: str | int) -> DataFrame:
        """See :func:`tetraclade.operators.trees.branch_distance`."""
        from .trees import branch_distance

        return branch_distance(self, a, b)

    def gid(self, name: str | int) -> int:
        """Global id of a name; KeyError if unknown. Ids pass."""
        if isinstance(name, str):
            if name not in self.taxa:
                raise KeyError(name)
            return self.taxa.index(name)
        return int(name)

    def unpersist(self) -> None:
        """Free what is cached."""
        self.trees.unpersist()
        if "seated" in self.__dict__:
            self.seated.unpersist()


def _slots(where: dict[str, list[int]], n: int, names: Sequence[str]) -> np.ndarray:
    out = np.full(n, -1, np.int32)
    used: dict[str, int] = {}
    for leaf, name in enumerate(names):
        k = used.get(name, 0)
        used[name] = k + 1
        ids = where.get(name, ())
        if k < len(ids):
            out[ids[k]] = leaf
    return out
