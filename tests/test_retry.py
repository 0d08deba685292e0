import json
import os
import subprocess
import sys


def test_results_survive_task_retries():
    here = os.path.dirname(os.path.abspath(__file__))
    proc = subprocess.run([sys.executable, os.path.join(here, "retry_job.py")], capture_output=True,
                          text=True, timeout=900, cwd=os.path.dirname(here))
    line = [x for x in proc.stdout.splitlines() if x.startswith("{")]
    assert line, proc.stderr[-2000:]
    res = json.loads(line[-1])
    assert res["n"] > 0
    assert res["same"]
