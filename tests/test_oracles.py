"""Every registered query of the library against its oracle SQL in DuckDB, on the same files."""

import duckdb
import pytest

from meridia.plans import catalogue
from meridia.plans.bindings import TABLES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain_items(duck):
    """Elements counted by a parser that works on the whole page text."""
    import re

    from meridia.sources import readers

    out = {}
    for page, html in duck.sql("SELECT page_id, html FROM pages").fetchall():
        parser = readers._Cards()
        parser.feed(html or "")
        for tag, text in parser.items:
            assert text == re.sub(r"\s+", " ", text).strip() and text
            n, chars = out.get((page, tag), (0, 0))
            out[page, tag] = n + 1, chars + len(text)
    return [(c, n, p, t) for (p, t), (n, c) in out.items()]


def plain_streams(duck):
    import hashlib

    import numpy as np

    word = int.from_bytes(hashlib.sha256(b"growth").digest()[:8], "big")
    u = np.random.Generator(np.random.PCG64(np.random.SeedSequence([42, word]))).random(100).tolist()
    return [(i, x, x) for i, x in enumerate(u)]


PLAIN = {"src18_html_items": plain_items, "sim01_seeded_streams": plain_streams}


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in names]).collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        want_rows = PLAIN[name](duck)  # a query without SQL needs a plain version here
        assert ordered(rows) == ordered(want_rows) and rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == names
    kinds = dict(zip(want.columns, map(str, want.types)))
    for c, k in df.dtypes:
        assert TYPES.get(k, k) == kinds[c], c
    assert ordered(rows) == ordered(want.select(*[f'"{c}"' for c in names]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
