import os
import subprocess
import sys
import textwrap

from rankloom.llm.common import Scratch, map_rows, pick


def test_a_session_without_a_shared_folder(tmp_path):
    """In a process of its own without Spark's default settings, as the tests' session names a folder."""
    code = """
        from rankloom.llm import simhash
        from rankloom.llm.common import Scratch
        from rankloom.session import local_session
        from rankloom.storage import clear, cut, shared_dir

        spark = local_session("t", 2, 2)
        at = shared_dir(spark)
        assert at == shared_dir(spark) and at.startswith("file:") and Scratch(spark, "a").root.startswith(at)
        docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in simhash.digest(docs).collect()) == [(1, 1), (2, 1), (3, 3)]
        assert cut(docs).count() == 3
        clear(spark)
        assert cut(docs).count() == 3
        print("fine")
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert "fine" in out.stdout, out.stderr[-2000:]


def test_tables_columns_and_places(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "`a.b` int, text string, `x y` double")
    assert Scratch(spark, "t").table(df, "t").collect() == df.collect()
    assert [tuple(r) for r in pick(df, "x y", "TEXT").collect()] == [(2.0, "a")]
    assert map_rows(df, lambda batches: batches, df.schema).collect() == df.collect()
