"""Each query against its SQL over the smallest tables."""

import pandas as pd
import pytest

from quarry.plans import retrieval, text
from tests.conftest import DATA

QUERIES, SQL = text.QUERIES | retrieval.QUERIES, text.SQL | retrieval.SQL


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda x: "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", retrieval.FOLDS)
def test_folds_return_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
