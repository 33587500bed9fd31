"""python -m quillon [NAME] [--dir DIR] [--rows N] [--explain]: lists the queries, or shows one's rows or plan."""

from __future__ import annotations

import argparse
import os

from quillon.plans import registry
from quillon.session import local_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="quillon", description=__doc__)
    parser.add_argument("name", nargs="?")
    parser.add_argument("--dir", default=os.environ.get("QUILLON_DIR"), help="folder of the tables' Parquet files; QUILLON_DIR by default")
    parser.add_argument("--rows", type=int, default=20)
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args()
    if args.name is None:
        print("\n".join(sorted(registry.queries())))
        return
    if not args.dir:
        parser.error("--dir, or QUILLON_DIR, must name the folder of the tables")
    spark = local_session()
    df = registry.queries()[args.name](spark, args.dir)
    if args.explain:
        df.explain("formatted")
    else:
        df.show(args.rows, truncate=60)


if __name__ == "__main__":
    main()
