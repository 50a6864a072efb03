"""Stage timings of registered queries from Spark's event log (no UI, no REST server).

Usage: python tools/stage_times.py [sf_dir] name [name ...]

Runs each query twice (cold, warm) with the event log written to a fresh scratch folder
(``mktemp``-style) and prints, for the warm run, every stage with its task count and duration.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _events(folder: str):
    for f in sorted(glob.glob(f"{folder}/**/*", recursive=True)):
        if os.path.isdir(f) or "appstatus" in f:
            continue
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        for line in raw.decode().splitlines():
            yield json.loads(line)


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    from riskframe.plans.queries import REGISTRY
    from riskframe.session import get_spark
    spark = get_spark(**{"spark.eventLog.enabled": "true", "spark.eventLog.dir": folder})
    marks = []
    for name in args:
        for run in ("cold", "warm"):
            t0 = time.time()
            REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
            marks.append((name, run, t0 * 1000, time.time() * 1000))
            print(f"{name} {run}: {marks[-1][3] - marks[-1][2]:.0f} ms")
    spark.stop()
    stages = []
    for e in _events(folder):
        if e["Event"] == "SparkListenerStageCompleted":
            s = e["Stage Info"]
            stages.append((s["Submission Time"], s["Completion Time"], s["Stage ID"], s["Number of Tasks"], s["Stage Name"]))
    for name, run, start, end in marks:
        if run != "warm":
            continue
        print(f"\n{name} (warm): stage, tasks, ms")
        for sub, comp, sid, tasks, sname in sorted(stages):
            if start <= sub <= end:
                print(f"  {sid:5d} {tasks:4d} {comp - sub:7d}  {sname[:60]}")


if __name__ == "__main__":
    main()
