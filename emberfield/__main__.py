"""``python -m emberfield STEP FOLDER OUT`` for the steps of :mod:`emberfield.plans.run`.

    land LANDING RAW        typed raw tables from landed pages
    build RAW RESULTS       roll-ups, base table, feature table, their metrics
    overview RAW RESULTS    row counts, file sizes, a sample, the rate summary
    statistics RAW OUT      long statistics table
    report RAW OUT          tables behind the report pages
    study RESULTS OUT       regression tables
    sample RESULTS OUT      first rows of the feature table
"""

from __future__ import annotations

import argparse
import sys

from emberfield import constants as K
from emberfield.plans import run
from emberfield.session import build_session

STEPS = {"land": run.land, "build": run.build, "overview": run.write_overview, "statistics": run.statistics,
         "report": run.report, "study": run.study, "sample": run.export_sample}


def options(arguments: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="emberfield", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--years", type=int, nargs="+", default=list(K.SNAPSHOT_YEARS), help="snapshots to land or build")
    parser.add_argument("--datasets", nargs="+", help="data sets to land, all by default")
    parser.add_argument("--lines", action="store_true", help="landed pages hold one record a line, which several tasks can read")
    return parser.parse_args(arguments)


def main(arguments: list[str]) -> int:
    o = options(arguments)
    more = {}
    if o.step in ("land", "build"):
        more["years"] = o.years
    if o.step == "land":
        more |= {"lines": o.lines} | ({"datasets": o.datasets} if o.datasets else {})
    spark = build_session()
    STEPS[o.step](spark, o.folder, o.out, **more)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
