from __future__ import annotations

import datetime
import decimal
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomcrawl.session import local_session

    s = local_session(4, 4, **{"spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    if not SMALL.exists():
        pytest.skip("test tables are not here")
    return str(SMALL)


def plain(v):
    """A value in a form that is alike for both engines."""
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_sql(spark, small):
    """Compare a query with its SQL over the small tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def check(query, sql):
        df = query(spark, small)
        names = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
        cursor = con.execute(sql)
        columns = [x[0] for x in cursor.description]
        assert names == sorted(columns)
        want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]

    return check
