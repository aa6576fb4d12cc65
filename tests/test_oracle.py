"""Vector queries against their SQL in DuckDB, on the smallest data."""

import duckdb
import numpy as np
import pytest

from veclode import queries

DATA = "/root/testdata/sf0.001"
#: A part of the queries; the driver compares all.
NAMES = ["knn_l2_scaled", "knn_ip_scaled", "knn_cosine", "calib_sq4u_l2", "calib_chunk_sq8", "encode_e5m2", "encode_sq6", "flat_sq8_l2", "flat_sq4ua_l2", "flat_sq8p_ip", "refine_sq1_ip", "pack_sq6", "decode_sq8", "kmeans_residual", "pq_adc_l2", "medoid", "reachable", "beam_exhaustive", "hnsw_levels", "prune_occluded", "linked_back", "refine_pq8_l2", "calib_perdim_sq4", "hnsw_ip_checked"]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(np.asarray(x).tolist() for x in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    f, sql = queries.entries()[name]
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    assert rows(f(spark, DATA).toPandas()) == rows(c.sql(sql).df())
