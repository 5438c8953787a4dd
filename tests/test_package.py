"""The package reaches Python workers that don't have it on their path."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_get_the_package(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        import tessera
        from tessera.operators import resolution
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
        tessera.ship(spark)
        tessera.ship(spark)
        spans = spark.createDataFrame([(1, "the slag of it")], "span_id int, visible_text string")
        names = spark.createDataFrame([("slag", "material", "slag")], "alias_norm string, entity_type string, alias string")
        print("found", resolution.dictionary_mentions(spans, names).count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 1" in done.stdout, done.stderr[-2000:]
