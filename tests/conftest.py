import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def compare(spark, name: str, sf: str = "sf0.01"):
    """The difference between a query and its DuckDB equivalent, as multisets of rows, columns by name."""
    import duckdb

    import __spark_entry__ as entry

    folder = f"{DATA}/{sf}"
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    assert sorted(d[0] for d in want.description) == columns, (name, columns, [d[0] for d in want.description])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x.isoformat(" ") if hasattr(x, "isoformat") else str(x) if isinstance(x, (list, dict)) else x
    a = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    b = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    return a, b
