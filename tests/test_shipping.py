"""Python workers must not need this package on their path."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_functions_travel_with_their_code(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {ROOT!r})
            from pyspark.sql import SparkSession
            spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
            from molweave.operators import corrupt as K
            df = spark.createDataFrame([(1, [5, 6, 3])], "k int, input_ids array<int>")
            c = K.ngram_candidates(df.select(df.input_ids.alias("ids")))
            print("RESULT", K.corrupt_sequences(df, c, "k", 1, p=1.0).first().masked_input)
            """
        )
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "RESULT [4, 4, 3]" in out.stdout, out.stderr[-2000:]
