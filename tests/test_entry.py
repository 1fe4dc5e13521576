import importlib
import numbers

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Every twin of this part; those of the text queries are tested beside them.
TWINS = {n: text for n, text in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}
#: Twins on scored pairs of series share one long plan, so every fifth of them stands for the others.
PAIRED = [n for n, text in TWINS.items() if "full_prof as" in text]
NAMES = [n for n in TWINS if n not in PAIRED] + PAIRED[::5]


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, base, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), base.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(map(plain, v))
        if v is None or pd.isna(v):
            return None
        return round(float(v), 9) + 0.0 if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) else v

    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)


def test_imports_need_no_session():
    importlib.reload(importlib.import_module("seriesmill.plans.catalogue"))
