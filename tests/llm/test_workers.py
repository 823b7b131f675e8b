"""Queries with Python functions where only the driver can import the package."""

import os
import subprocess
import sys
from pathlib import Path

from .conftest import BASE

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from govlattice.llm.queries import QUERIES
from govlattice.session import build_session

spark = build_session("alone", "local[4]", **{{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false"}})
seen = spark.range(4).mapInPandas(
    lambda parts: (p.assign(found=__import__("importlib.util").util.find_spec("govlattice") is not None) for p in parts),
    "id bigint, found boolean")
assert not any(r["found"] for r in seen.collect())
for name in ("op1_token_files", "op7_simhash_bk_trees", "op10_suffix_array_dedup", "op13_refined_whitening"):
    assert QUERIES[name](spark, {base!r}).count()
print("all queries ran")
"""


def test_workers_do_not_need_the_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != Path(repo)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(paths)}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo, base=BASE)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert "all queries ran" in done.stdout, done.stderr[-3000:]
