import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from moraine.session import local_session

    return local_session(8)


@pytest.fixture(scope="session")
def same():
    """Compare a query with its SQL on a folder of tables."""
    import glob
    import math
    import os
    from collections import Counter

    import duckdb

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def check(spark, name, folder=f"{TESTDATA}/sf0.001"):
        import __spark_entry__ as entry

        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        df = entry.queries()[name](spark, folder)
        result = con.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
        at = sorted(range(len(columns)), key=columns.__getitem__)
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())

    return check
