"""Every query on workers that cannot import this package: whatever their functions need travels with them."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from tests.compare import local_session
spark = local_session("4")
spark.sparkContext.setLogLevel("OFF")

def importable(rows):
    import importlib.util
    yield importlib.util.find_spec("siltbed") is not None

assert spark.sparkContext.range(0, 1, 1, 1).mapPartitions(importable).collect() == [False]
from siltbed.llm.queries import QUERIES
import corpus_pipeline
for name, query in {{**QUERIES, "pipeline": corpus_pipeline.run}}.items():
    try:
        print(name, "rows", len(query(spark, "/root/testdata/sf0.001").collect()), flush=True)
    except Exception as error:
        print(name, "failed", [line for line in str(error).splitlines() if "Error" in line][-1:], flush=True)
print("all done")
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    repo = str(Path(__file__).parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=900, env=env)
    assert "all done" in done.stdout, done.stdout[-3000:] + done.stderr[-3000:]
    assert "failed" not in done.stdout, done.stdout
