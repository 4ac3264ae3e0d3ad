"""bench.py prints one JSON line in the shape the driver records."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_REPS="1",
               BENCH_QUERIES="preview,blank_counts", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    rec = json.loads(lines[0])
    assert rec["unit"] == "sec" and set(rec["queries"]) == {"preview", "blank_counts"}
    assert rec["value"] == round(sum(rec["queries"].values()), 3) or abs(rec["value"] - sum(rec["queries"].values())) < 0.01
    assert rec["sf"] == 0.001 and isinstance(rec["metric"], str)
