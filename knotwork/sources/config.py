"""Settings: option names, INI files, command lines.

Option names (spelling included) and default values are fixed values.

Options are given on a command line or in an INI file of ``key=value`` lines with ``#``
comments; the command line wins. Unknown keys of a file are ignored with a warning.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field, fields

log = logging.getLogger("knotwork")


def _option(name: str, default, help_: str):
    kind = {"default_factory": default} if callable(default) else {"default": default}
    return field(**kind, metadata={"option": name, "help": help_})


@dataclass
class Settings:
    """All settings with the values of the strong preset."""

    graph: str = _option("graph", "", "graph file")
    config: str = _option("config", "", "INI file")
    logging: bool = _option("enable-logging", False, "print progress instead of the edits")
    verbose: bool = _option("verbose", False, "print statistics")
    result_line: bool = _option("print-result-line", False, "print the RESULT line")
    write_solution: bool = _option("write-to-file", False, "write the clusters to <graph>.sol")
    read_solution: bool = _option("read-from-file", False, "start from <graph>.sol")
    csv: bool = _option("csv", False, "print file,edits,seconds")
    seed: int = _option("seed", 0, "seed of all randomness")
    repetitions: int = _option("num-repititions", 1000, "most restarts")
    fruitless: int = _option("num-fruitless-repititions", 20, "most restarts without a gain")
    seconds: float = _option("time-limit", 590.0, "stop after so many seconds")
    use_evolution: bool = _option("r-use-evo", True, "run the pool evolution")
    use_localized: bool = _option("r-use-localized-evo", True, "run the localized evolution")
    use_lp: bool = _option("r-use-lp-refiner", False, "run label propagation first")
    use_boundary_fm: bool = _option("r-use-boundary-fm-refiner", False, "run boundary FM first")
    use_localized_fm: bool = _option("r-use-localized-fm-refiner", False, "run localized FM first")
    evo_detailed: bool = _option("r-evo-enable-detailed-output", False, "print every step")
    evo_seconds: float = _option("r-evo-time-limit", 120.0, "seconds of the pool evolution; steps decide")
    pool: int = _option("r-evo-pool-size", 1, "states in the pool")
    evo_steps: int = _option("r-evo-steps", 1000, "steps of the pool evolution")
    first_rounds: int = _option("r-evo-initial-lp-iterations", 100, "label propagation of first states")
    first_swap_rounds: int = _option("r-evo-initial-node-swapper-iterations", 20, "swapping of first states")
    intensify_rounds: int = _option("r-evo-intensivate-lp-iterations", 25, "label propagation when intensifying")
    mutate_rounds: int = _option("r-evo-lp-iterations-after-mutate", 50, "label propagation after a mutation")
    remove_rounds: int = _option("r-evo-clique-remover-iterations", 10, "rounds of removing clusters")
    split_rounds: int = _option("r-evo-clique-splitter-iterations", 10, "rounds of splitting clusters")
    swap_rounds: int = _option("r-evo-node-swapper-iterations", 5, "rounds of swapping")
    swap_largest: int = _option("r-evo-node-swapper-max-cluster-size", 32, "largest cluster to swap into")
    evo_random_order: bool = _option("r-evo-lp-use-random-node-ordering", False, "shuffle nodes in the evolution")
    all_mutations_after: int = _option("r-evo-enable-all-mutations-after-step", 500, "step that enables all mutations")
    mutations: str = _option("r-evo-enabled-mutations", "00111", "bits of the enabled mutations")
    large_cluster: int = _option("r-evo-large-clique-threshold", 3, "nodes of a large cluster")
    min_cluster_isolation: float = _option("r-evo-min-clique-isolation-prob", 0.01, "least probability")
    max_cluster_isolation: float = _option("r-evo-max-clique-isolation-prob", 0.1, "largest probability")
    min_neighbor_isolation: float = _option("r-evo-min-neighbor-clique-isolation-prob", 0.0001, "least probability")
    max_neighbor_isolation: float = _option("r-evo-max-neighbor-clique-isolation-prob", 0.01, "largest probability")
    min_node_isolation: float = _option("r-evo-min-node-isolation-prob", 0.01, "least probability")
    max_node_isolation: float = _option("r-evo-max-node-isolation-prob", 0.25, "largest probability")
    min_node_move: float = _option("r-evo-min-node-move-prob", 0.01, "least probability")
    max_node_move: float = _option("r-evo-max-node-move-prob", 0.25, "largest probability")
    min_split: float = _option("r-evo-min-clique-split-mutation-prob", 0.01, "least probability")
    max_split: float = _option("r-evo-max-clique-split-mutation-prob", 0.25, "largest probability")
    min_test: float = _option("r-evo-min-test-mutation-prob", 0.01, "least probability")
    max_test: float = _option("r-evo-max-test-mutation-prob", 0.05, "largest probability")
    local_steps: int = _option("r-localized-evo-steps", 1_000_000, "steps of the localized evolution")
    local_rounds: int = _option("r-localized-evo-lp-iterations", 5, "label propagation around mutated nodes")
    local_least: int = _option("r-localized-evo-min-mutations-nodes", 1, "fewest mutated nodes")
    local_most: int = _option("r-localized-evo-max-mutations-nodes", 5, "most mutated nodes")
    local_adjacent: float = _option("r-localized-evo-choose-adjacent-mutation-node-prob", 0.75, "probability of walking on")
    local_distance: int = _option("r-localized-evo-max-distance-to-mutation-node", 1, "reach of the repair")
    local_degree: int = _option("r-localized-evo-degree-sampling-threshold", 1024, "degree above which neighbours are sampled")
    lp_rounds: int = _option("r-maximum-lp-iterations", 1000, "most rounds")
    lp_shuffle: bool = _option("r-random-shuffle-each-round", False, "shuffle nodes each round")
    lp_order: str = _option("r-lp-node-ordering", "none", "none, random, degree_increasing or degree_decreasing")
    lp_least: int = _option("r-lp-min-improvement", 5, "least gain in a window")
    lp_map_degree: int = _option("r-lp-rating-map-degree-threshold", 16, "physical choice; Spark decides")
    lp_target_distance: int = _option("r-lp-min-target-edit-distance", 25, "distance to a target that doubles rounds")
    lp_window: int = _option("r-lp-early-exit-window", 100, "rounds of a window")
    fm_rounds: int = _option("r-maximum-fm-iterations", 10, "most passes")
    fm_least: int = _option("r-fm-min-improvement", 5, "least gain in a window")
    fm_window: int = _option("r-fm-early-exit-window", 5, "passes of a window")
    fm_fruitless: float = _option("r-fm-fraction-fruitless-moves", 0.1, "fraction of nodes to move without a gain")
    fm_seeds: int = _option("r-fm-seed-nodes", 5, "seed nodes of localized FM")
    #: Starts of the portfolio, at most, and their seconds; steps of a burst of the pool, and of
    #: localized steps for each; edges of a special instance; replicas of a restart that run at once.
    first_tries: int = 100
    first_seconds: float = 10.0
    burst: int = 10
    local_per_step: int = 20
    special_edges: int = 1_000_000
    #: Whether the whole graph is a special instance; None leaves that to each component.
    special: bool | None = None
    at_once: int = 4

    #: Options that are read and checked, and change nothing.
    IDLE = ("lp_map_degree", "min_test", "max_test")

    def __post_init__(self):
        if self.lp_order not in ("none", "random", "degree_increasing", "degree_decreasing"):
            raise ValueError(f"unknown node order {self.lp_order!r}")
        for name in self.IDLE:
            if getattr(self, name) != type(self).__dataclass_fields__[name].default:
                log.warning("option %s has no effect", type(self).__dataclass_fields__[name].metadata["option"])
        if len(self.mutations) != 5 or set(self.mutations) - {"0", "1"}:
            raise ValueError("enabled mutations are five bits")

    @property
    def mutation_p(self) -> list[tuple[float, float]]:
        """Least and largest probability of each mutation."""
        return [
            (self.min_cluster_isolation, self.max_cluster_isolation), (self.min_neighbor_isolation, self.max_neighbor_isolation),
            (self.min_node_isolation, self.max_node_isolation), (self.min_node_move, self.max_node_move), (self.min_split, self.max_split),
        ]

    @classmethod
    def fast(cls) -> "Settings":
        """The fast preset: label propagation only, one restart."""
        return cls(repetitions=1, fruitless=10, use_lp=True, use_evolution=False, use_localized=False)

    def for_size(self, n: int, m: int) -> "Settings":
        """Settings tuned to a graph's size."""
        out = Settings(**self.__dict__)
        if m > 1_000_000:
            out.evo_seconds *= 1.5
        if n < 10_000:
            out.local_steps = -(-out.local_steps // 100)
        if n > 50_000:
            out.evo_steps = out.local_steps = 2**62
        return out


_BY_OPTION = {f.metadata["option"]: f for f in fields(Settings) if "option" in f.metadata}


def _value(f, text: str):
    if isinstance(f.default, bool):
        if str(text).lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{text!r} is not true or false")
        return str(text).lower() in ("true", "1")
    return type(f.default)(text)


def read_ini(lines) -> dict:
    """Settings of an INI file's lines, by field name."""
    out = {}
    for line in lines:
        line = line.split("#", 1)[0].strip()
        if not line or line.startswith("["):
            continue
        key, _, text = (x.strip() for x in line.partition("="))
        if key not in _BY_OPTION:
            log.warning("unknown option %s", key)
            continue
        out[_BY_OPTION[key].name] = _value(_BY_OPTION[key], text)
    return out


def parse(args: list[str]) -> Settings:
    """Settings of a command line, over those of its INI file if it names one."""
    parser = argparse.ArgumentParser(prog="knotwork")
    for name, f in _BY_OPTION.items():
        parser.add_argument(f"--{name}", help=f.metadata["help"], default=None)
    given = {k: v for k, v in vars(parser.parse_args(args)).items() if v is not None}
    by_name = {f.metadata["option"].replace("-", "_"): f for f in _BY_OPTION.values()}
    own = {by_name[k].name: _value(by_name[k], v) for k, v in given.items()}
    base = {}
    if own.get("config"):
        with open(own["config"]) as f:
            base = read_ini(f)
    return Settings(**(base | own))
