import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from coreloom import session

    found = session.build("local[4]", partitions=4, memory="3g")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


def oracle(sql: str, sf_dir: str):
    """Rows of a DuckDB query over the tables of a folder."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con.execute(sql).df()


def same(a, b) -> None:
    import pandas as pd

    def norm(x):
        x = x[sorted(x.columns)].copy()
        for c in x.columns:
            if x[c].dtype == object:
                x[c] = x[c].map(lambda v: None if v is None or v is pd.NA else str(v))
        return x.sort_values(list(x.columns), ignore_index=True)

    assert sorted(a.columns) == sorted(b.columns)
    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False, rtol=1e-9, atol=2e-6)
