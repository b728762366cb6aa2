"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from knotwork import catalog, catalog_solvers

DATA = "/root/testdata/sf0.001"
CHECKED = [
    "graph_edges_emb", "graph_edges_part", "degrees", "degree_stats", "p3_count_per_pair", "triangle_count", "icf_icp", "twins", "kernel_candidates", "components",
    "cluster_table", "edit_list_modular", "move_ratings", "lp_round_1", "contract_twins", "heavy_edge_single", "special_instance", "hop_distances", "scan_graph_file", "scan_solution", "edit_sink",
    "exact_cost_dense", "exact_edits", "lower_bounds", "heuristic_portfolio", "heuristic_restarts", "refine_boundary_fm", "mutations",
    "set_moves_dissolve", "set_moves_merge", "set_moves_split", "set_moves_swap", "heavy_pairs_of_twins", "core_numbers", "region_round", "bounded_reach",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(df, cols):
    def value(x):
        if x is None or str(x) in ("nan", "<NA>", "None"):
            return None
        return x if isinstance(x, (str, bool)) else round(float(x), 6)

    return sorted((tuple(value(x) for x in r) for r in df[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and plain(got, cols) == plain(want, cols)


def test_known_optimum(spark):
    costs = {x.comp: x.cost for x in catalog.queries()["exact_assignment"](spark, DATA).collect()}
    assert sum(costs.values()) == 15 and len(costs) == 46 and sum(c > 0 for c in costs.values()) == 13
    assert catalog_solvers.minimum_edits(spark, DATA).count() == 15
    dense = catalog.queries()["exact_cost_dense"](spark, DATA)
    assert dense.agg({"cost": "sum"}).first()[0] == 53 and dense.where("not proved").count() == 0


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) == set(catalog.queries())
