"""bench.py prints one JSON line with the driver's fields."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_RUNS="1",
               BENCH_QUERIES="label_counts,summary_two_outlets")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600, check=True).stdout.strip().splitlines()
    d = json.loads(out[-1])
    assert d["unit"] == "sec" and d["metric"] and set(d["queries"]) == {"label_counts", "summary_two_outlets"}
    assert d["value"] > 0 and d["sf"] == "0.001"
