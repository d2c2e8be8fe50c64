import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillmark.session import local_session, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", shuffle_partitions=4)
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if x is None or str(x) in ("nan", "<NA>", "NaT"):
        return None
    return round(float(x), 7) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="session")
def same():
    def check(spark_df, sql, con):
        ours, theirs = spark_df.toPandas(), con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)
        a, b = rows(ours), rows(theirs)
        assert a == b
        return len(a)

    return check
