"""Every track query that has SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pytest

from trackspark.plans import queries as q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows(df):
    # Half of the last digit either way: sums of floats depend on their order.
    plain = lambda v: None if v is None or v != v else round(v, 3) + 0.0 if isinstance(v, float) else str(v)
    return sorted(([plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    ours, theirs = q.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(q.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and u == pytest.approx(v, abs=0.0021)), (x, y)


def test_without_sql():
    """Queries that SQL can't express are tested elsewhere; this list changes with them."""
    assert set(q.QUERIES) - set(q.ORACLES) == {"boosted_trees", "convex_hull", "generated_tracks", "helicity_smoothed", "pairwise_trees", "pca_scores", "searched_trees"}


def test_rows_of_queries_without_sql(spark):
    hull = q.QUERIES["convex_hull"](spark, FOLDER).toPandas()
    assert (hull.convex_hull_volume.dropna() > 0).any()
    scores = q.QUERIES["pca_scores"](spark, FOLDER).toPandas().filter(like="PC")
    assert np.allclose(np.triu(scores.cov().to_numpy(), 1), 0, atol=1e-5)
    smooth = q.QUERIES["helicity_smoothed"](spark, FOLDER).toPandas()
    assert (smooth.mean_curvature.dropna() >= 0).all() and len(smooth)
