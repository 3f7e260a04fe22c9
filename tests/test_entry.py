import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_imports_without_the_training_data_operators(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={"PATH": "/usr/bin:/bin"})


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["nearest_centroid", "auc_ovr", "laplacian", "event_segments", "bootstrap_ci", "leaderboard"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = e.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    want = con.execute(e.oracle_sql()[name])
    order = [[d[0] for d in want.description].index(c) for c in cols]
    held = lambda rows: sorted(repr([round(v, 7) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)
    assert held(map(tuple, got.select(*cols).collect())) == held([r[i] for i in order] for r in want.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    if DATA.exists():
        rows = e.entry(spark).collect()
        assert len(rows) == 5 and {"fold", "n", "accuracy", "kappa"} == set(rows[0].asDict())
