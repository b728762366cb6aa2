"""Command line: ``python -m knotwork exact|heuristic --graph FILE [options]`` prints the edit list.

With ``--enable-logging=true`` it prints objectives instead; ``--print-result-line=true`` and
``--csv=true`` print one line each, ``--write-to-file=true`` writes ``<graph>.sol`` and
``--read-from-file=true`` starts the heuristic from it.
"""

from __future__ import annotations

import logging
import sys
import time

from pyspark.sql import SparkSession

from knotwork.operators import cost
from knotwork.plans.solve import Clusterer
from knotwork.sources import files
from knotwork.sources.config import parse
from knotwork.storage import cut

log = logging.getLogger("knotwork")


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """Run a solver on a graph file; returns the number of edits."""
    if not args or args[0] not in ("exact", "heuristic"):
        raise SystemExit(__doc__)
    cfg = parse(args[1:])
    if cfg.logging or cfg.verbose:
        logging.basicConfig(level=logging.INFO, format="%(message)s")
    spark = spark or SparkSession.builder.appName("knotwork").getOrCreate()
    began, timings = time.time(), {}

    def lap(name: str) -> None:
        timings[name] = time.time() - began - sum(timings.values())

    nodes, edges = files.read_gr(spark, cfg.graph)
    solver = Clusterer(edges, nodes)
    lap("import")
    if args[0] == "exact":
        result = cut(solver.exact(seed=cfg.seed, seconds=cfg.seconds if any(a.startswith("--time-limit") for a in args) else None))
        if result.where("not proved").limit(1).count():
            log.warning("some components are not proved optimal")
    else:
        start = files.read_solution(spark, f"{cfg.graph}.sol") if cfg.read_solution else None
        result = solver.restarts(cfg, start=start)
    lap("solve")
    assign = cut(solver.assignment(result))
    # checks that every node has one cluster before anything is printed
    row = cost.verify(solver.edges, nodes, assign).first()
    if not row["ok"]:
        raise RuntimeError(f"the clustering does not cover the graph: {row}")
    totals = cost.objectives(solver.edges, assign.join(solver.edges.selectExpr("explode(array(u, v)) as node").distinct(), "node", "left_semi")).first()
    lap("verify")
    seconds = time.time() - began
    if cfg.logging:
        log.info("clusters %d, insertions %d, deletions %d, edits %d", totals["clusters"], totals["insertions"], totals["deletions"], totals["edits"])
    else:
        for r in files.edit_lines(solver.edits(result)).orderBy("u", "v").toLocalIterator():
            print(r.line)
    if cfg.result_line:
        print(files.result_line(cfg.graph, nodes.count(), solver.edges.count(), cfg.seed, seconds, totals["insertions"], totals["deletions"], timings))
    if cfg.csv:
        print(files.csv_line(cfg.graph, totals["edits"], seconds))
    if cfg.write_solution:
        files.write_solution(assign, f"{cfg.graph}.sol")
    return int(totals["edits"])


if __name__ == "__main__":
    main(sys.argv[1:])
