"""Command line: python -m quadloom SOURCE TARGET --max-zoom N [options]. SOURCE and TARGET are paths that Spark reads and writes."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from quadloom.plans.build import TilerOptions, build_tiles, export_mbtiles


def parse(args: list[str] | None = None) -> tuple[TilerOptions, str | None]:
    p = argparse.ArgumentParser(prog="quadloom", description="Builds a Web-Mercator tile pyramid.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--mbtiles", help="also export to this file")
    for f in dataclasses.fields(TilerOptions)[2:]:
        flag = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        elif f.default is dataclasses.MISSING or isinstance(f.default, int):
            p.add_argument(flag, type=int, required=f.default is dataclasses.MISSING, default=None if f.default is dataclasses.MISSING else f.default)
        else:
            p.add_argument(flag, default=f.default)
    found = vars(p.parse_args(args))
    mbtiles = found.pop("mbtiles")
    return TilerOptions(**found), mbtiles


def main() -> None:
    options, mbtiles = parse()
    spark = SparkSession.builder.appName("quadloom").getOrCreate()
    build_tiles(spark, options)["limits"].orderBy("z").show(40, False)
    if mbtiles:
        export_mbtiles(spark, options.target, mbtiles)


if __name__ == "__main__":
    main()
