"""Run a streaming job once over everything available, then stop.

    python -m meridian.streaming --data <events dir> --job sessionize --out <shared folder>/sessions

Each run resumes from the job's checkpoint under ``spark.checkpoint.dir``
(``streams/<job>/checkpoint``), so scheduling the command repeatedly processes
only newly arrived files.  ``ingest`` writes a versioned table whose state holds
the high watermark of the last finished run, from which the next one starts.  Every job appends: windows and sessions are written
once, when the watermark has passed them (the last ones with later data).
"""

from __future__ import annotations

import argparse
import sys

from ..session import build_session
from . import jobs

JOBS = {
    "dedupe": (lambda s, a: jobs.dedupe(s), "append"),
    "daily_kpis": (lambda s, a: jobs.daily_kpis(s), "append"),
    "trailing_active": (lambda s, a: jobs.trailing_active(s), "append"),
    "sessionize": (lambda s, a: jobs.sessionize(s), "append"),
}


def main(argv=None) -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--data", required=True, help="directory receiving events*.parquet files")
    ap.add_argument("--job", required=True, choices=sorted([*JOBS, "ingest"]))
    ap.add_argument("--out", required=True)
    ap.add_argument("--synced-at", default="1970-01-01 00:00:00")
    a = ap.parse_args(argv)
    spark = build_session()
    if a.job == "ingest":
        jobs.run_ingest(spark, a.data, a.out, a.synced_at)
        return 0
    build, mode = JOBS[a.job]
    q = jobs.start(build(jobs.event_stream(spark, a.data), a), a.job, mode=mode, sink="parquet", path=a.out)
    q.awaitTermination()
    return 0 if q.exception() is None else 1


if __name__ == "__main__":
    sys.exit(main())
