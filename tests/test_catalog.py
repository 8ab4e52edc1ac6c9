"""Every catalogue query with SQL equals it on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()
#: One or more per family; STRATANET_ALL=1 runs every query that has SQL.
SAMPLE = """s5_eligible_layer_columns s11_append_skip_duplicates s12_remove_duplicates_last
s13_store_round_trip p1_parse_term p4_load_long_panel p10_selection_counts p14_daily_returns
p19_canonical_term m1_pearson_sparse m2_spearman_sparse m3_kendall_pairs
m4_distance_correlation_pairs m5_chatterjee_xi_pairs m6_conditional_quantile m7_shrinkage_pairs
g11_layer_edge_metrics g13_degree g14_degree_histogram h2_components h3_clustering h8_degree_mixing
w1_expanding_windows w2_window_pairs w3_multiplex_evolution f2_ns_fit f6_residual_cube
f9_afns_adjustment f15_pooled_volatility c7_jaccard_overlap r1_residual_network
w2_stepped_pairs single_network_degree w9_skipped_issuers""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("STRATANET_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[name])
    want = table([c[0] for c in rel.description], rel.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
