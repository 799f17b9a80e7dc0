"""Every registered query against its SQL twin, on the smallest tables."""

import glob
import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from plumbline.plans.catalogue import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = sql.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0


def test_chunks_are_slices(spark):
    from plumbline.operators.texts import chunks

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cut = chunks(docs, "doc_id", "text", by_line=True).join(docs.selectExpr("doc_id as id", "text as whole"), "id")
    assert cut.filter("text <> substring(whole, char_start + 1, char_end - char_start)").count() == 0


def test_corpus_subpackage_is_optional():
    """Nothing outside plumbline.llm imports it."""
    paths = sorted(ROOT.glob("plumbline/**/*.py"))
    assert len(paths) > 10
    for path in (str(p.relative_to(ROOT)) for p in paths):
        if not path.startswith("plumbline/llm/"):
            assert "plumbline.llm" not in (ROOT / path).read_text(), path
