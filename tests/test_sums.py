"""Sums of k-means against the engine that runs its SQL."""

import duckdb
import numpy as np
import pandas as pd

from veclode.operators import kmeans


def test_sums_are_cast_like_the_sql_casts_them(spark):
    x = np.random.default_rng(4).normal(size=(100, 64)) - 2
    b = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, v array<double>")
    got = kmeans.lloyd(b, np.zeros((1, 1, 64)), 1)[0, 0]
    grid = kmeans.unit(b)
    s = pd.DataFrame({"j": np.tile(np.arange(64), 100), "s": np.floor(x * grid + 0.5).astype(np.int64).ravel()})
    want = duckdb.sql(f"select j, sum(s)::DOUBLE / {grid!r}::DOUBLE / 100::DOUBLE as c from s group by j order by j").df()["c"].to_numpy()
    assert s.s.groupby(s.j).sum().abs().max() > 2**53 and (got == want).all()
