"""Queries against their SQL in DuckDB, on the smallest tables; the driver does the same for all of them on larger ones."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from evidence_jobs import queries as own
from evidence_jobs.queries.views import TABLES

SF = "/root/testdata/sf0.001"
NAMES = [n for n in own.oracle_sql() if n.startswith(("fn", "prj", "src", "snk", "job01", "job02", "job07", "job08", "agg12", "agg14", "jn20", "srt", "win01", "win02", "win11", "agg0", "agg13", "agg18", "agg2", "jn01", "jn02", "jn05", "jn07", "jn09", "jn12", "jn13", "flt01", "flt02"))]
SLOW = {"agg05_complaint_stats", "agg06_bucket_stats", "agg07_merge_stats", "agg08_best_bucket", "agg09_answer", "agg25_evidence_summary", "srt03_ranked", "prj13_evidence_rows", "agg26_dossier", "agg24_known_gaps", "agg23_same_summary", "agg17_number_names"}


def canonical(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and np.isnan(x):
            return None
        if isinstance(x, (float, np.floating)):
            return round(float(x), 6)
        return int(x) if isinstance(x, (int, np.integer, bool, np.bool_)) else str(x)

    rows = [tuple(cell(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_same_rows(spark, duck, name):
    got, want = own.queries()[name](spark, SF).toPandas(), duck.sql(own.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
