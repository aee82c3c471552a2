"""Registered queries of the library against their SQL, at the smallest scale."""

import os

import pytest

from pixelrel.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages labels".split()
#: One query for each kind of block. PIXELREL_ALL=1 runs all of them; at sf0.01 all are held against their SQL outside of the tests.
CHOSEN = """stretch_params_linked stretch_paired mask_margin patch_quality defect_counts robust_sigma match_shape crop_extract components place_greedy
spline_roundtrip pairs_ir pairs_su crop_rejects shape_rejects split_exact leakage incremental_pending format_pref composite_listing best_so_far
topk_two_stage noise_schedule drawn_noise pretext_chains dare_ties task_cosine task_arithmetic lambda_grid lambda_merge without_prefix paired_dataset
split_manifest patch_sink library_stamps mask_files tiff_files preview_files manifest_files required_keys preview_indices combo_names""".split()
CHOSEN = sorted(catalog.SQL) if os.environ.get("PIXELREL_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or v != v else float(round(v, 6)) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    ours, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, found.fetchall())
    assert len(ours) == len(theirs) and all(close(a, b) for r, s in zip(ours, theirs) for a, b in zip(r, s))


def close(a, b):
    return a == b if isinstance(a, (str, bool, type(None))) else abs(a - b) <= 2e-6
