"""Quartet analytics for ensembles of phylogenetic trees on Apache Spark."""

from .functions.quartets import Quartets, jaccard_similarity, validate_quartet
from .operators.consensus import ConsensusGraph
from .operators.ensemble import Ensemble
from .operators.paralog import OptimizationResult, apply_swap, counts_delta, evaluate_swap, optimize, resolve
from .operators.qed import quartet_qed
from .operators.stats import log_statistics
from .operators.topology import quartet_topology, topology_wide
from .operators.trees import tree_splits
from .plans.planner import available_strategies, current_strategy, quiet, silent_benchmark, suppress_logger, suppress_warnings, use_strategy
from .sources.newick import Tree, format_newick, parse, validate_newick
from .sources.readers import NewickFile, normalize_input, read_lines, read_trees
from .streaming.counts import streaming_counts, tree_topologies

__all__ = [
    "ConsensusGraph", "Ensemble", "NewickFile", "OptimizationResult", "Quartets", "Tree", "apply_swap", "available_strategies", "counts_delta",
    "current_strategy", "evaluate_swap", "format_newick", "jaccard_similarity", "log_statistics", "normalize_input", "optimize", "parse", "quartet_qed",
    "quartet_topology", "quiet", "read_lines", "read_trees", "resolve", "silent_benchmark", "streaming_counts", "suppress_logger", "suppress_warnings",
    "topology_wide", "tree_splits", "tree_topologies", "use_strategy", "validate_newick", "validate_quartet",
]
