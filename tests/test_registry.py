import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from rubicost import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 7)
    if hasattr(x, "as_tuple"):
        return round(float(x), 7)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    sql = registry.ORACLES.get(name)
    if sql is None:
        assert got
        return
    rel = duck.execute(sql)
    names = [c[0] for c in rel.description]
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: repr([plain(r[c]) for c in sorted(names)])
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_import_needs_no_session_and_no_optional_part():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.entry and e.queries() and not any(k.startswith('op1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
