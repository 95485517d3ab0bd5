"""Command line check: python tests/check.py [--sf 0.01] [name ...]"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
sys.path.insert(0, os.path.dirname(__file__))

import warnings
warnings.filterwarnings("ignore")

import traceback
from compare import compare, connect
from tidemark.plans import registry
from tidemark.session import get_session


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    folder = f"/root/testdata/sf{sf}"
    if "--modules" in args:
        i = args.index("--modules")
        registry.MODULES = tuple(args[i + 1].split(","))
        del args[i:i + 2]
    registry.load_all()
    spark = get_session("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = []
    for name, fn in registry.QUERIES.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            ok, took, note = compare(spark, name, fn, registry.ORACLES.get(name), folder, con)
        except Exception as exc:
            ok, took, note = False, 0.0, "".join(traceback.format_exception_only(exc))[:1200]
        print({True: "ok  ", False: "BAD ", None: "rows"}[ok], f"{took:6.2f}s", name, note, flush=True)
        if ok is False:
            bad.append(name)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
