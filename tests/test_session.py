"""Staging and the driver contract."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT
from helpers import rows
from tidemark import session


def test_stage_reads_back_and_can_be_dropped(spark, tmp_path):
    df = session.stage(spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    assert rows(df, "k") == [(1, "a"), (2, None)]
    assert session.checkpoint_root(spark) in df.inputFiles()[0]
    assert session.drop_staged(spark) >= 1 and session.drop_staged(spark) == 0


def test_staging_deletes_what_it_holds(spark):
    outer = session.stage(spark.range(3))
    with session.staging(spark):
        inner = session.stage(spark.range(5)).inputFiles()[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(inner)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert outer.count() == 3


def test_functions_ship_to_workers_that_cannot_import_the_package(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from tidemark.session import get_spark\nfrom tidemark.shipping import ship_package\n"
            "from tidemark.functions.slots import FOLD_SCHEMA, fold_slots\n"
            "s = get_spark('ship', 'local[1]', **{'spark.ui.enabled': 'false'})\nship_package(s)\n"
            "d = s.sql(\"SELECT 'c' AS config_id, 1 AS max_positions, DATE'2024-01-01' AS date, 1 AS place, \"\n"
            "          \"'A' AS ticker, 1 AS seq, 1D AS price, 1D AS k, true AS has_bar, DATE'2024-01-02' AS exit_date, \"\n"
            "          \"1D AS exit_price, 'x' AS exit_reason\")\n"
            "print(d.groupBy('config_id').applyInPandas(fold_slots, FOLD_SCHEMA).count(), 'rows')\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "2 rows" in done.stdout, done.stderr[-2000:]


def test_folder_comes_from_the_session(spark):
    assert session.checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_every_query_has_a_known_name():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 100


@pytest.mark.parametrize("name", ["sma", "asof_tolerance", "upsert_bars", "extract_sections", "position_counts"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)

    def norm(r):
        return tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r)
    assert sorted(map(norm, got.select(*cols).collect()), key=str) == sorted(map(norm, cur.fetchall()), key=str)
