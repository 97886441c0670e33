"""Queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from codeweft import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ("label_flags", "logical_neighbours", "degree_stats", "impact_summary", "kind_filter_prod", "rel_map", "resolve_symbols", "neighbors", "bfs_both_2", "convention_canonical", "components", "knn_self_top4", "hybrid_rrf", "eval_metrics", "edge_load_dangling", "resolve_one", "similar_symbol", "source_lines", "file_imports", "shortest_path_len", "bridged_route")


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cells = lambda df: sorted([tuple(None if x != x else round(x, 6) if isinstance(x, float) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)], key=str)
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)
