"""Every query of the catalogue with SQL gives the SQL's rows."""

import os
import random

import duckdb
import pandas as pd
import pytest

from dossierflow.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(6)
        elif df[c].dtype.kind == "M" or len(df) and hasattr(df[c].iloc[0], "year"):
            df[c] = pd.to_datetime(df[c]).astype(str)
    return sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in catalogue.ORACLE_SQL:
        assert rows(got) == rows(duck.sql(catalogue.ORACLE_SQL[name]).df())


def test_grounded_benchmark_finds_all_pairs(spark, tmp_path):
    """Against brute force over all pairs: whole, shuffled, altered and middle quotations, repeats, short items."""
    draw = random.Random(4)
    word = lambda: f"w{int(draw.random() ** 2 * 400)}x"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 6, 7, 12, 13, 20, 25, 30, 40, 60] * 3)] + [(90, "abc"), (91, "again again again again again again tail"), (92, None)]
    docs = []
    for _, t in items:
        w = (t or "").split()
        for change in (0, 1, 2, 5):
            own = list(w)
            for at in draw.sample(range(len(w)), min(change, len(w))):
                own[at] = "altered"
            docs += [[word() for _ in range(9)] + own + [word()], draw.sample(own, len(own)), ["altered", *own[1:]], own[len(own) // 4 :]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(9998, "xabcd"), (9999, None)]

    def grounded(q, s):
        words, held = [w for w in q.split() if len(w) > 1], set(s.split())
        return len(q) >= 4 and (q in s or len(words) >= 6 and sum(w in held for w in words) / len(words) >= 0.92)

    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((j, i) for i, q in items for j, s in docs if q and s and grounded(q, s))
    assert sorted(map(tuple, catalogue.QUERIES["grounded_benchmark"](spark, str(tmp_path)).collect())) == want
