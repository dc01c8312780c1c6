"""Command line: ``python -m lumaframe list|children|stats|preview|convert PATH ...``; exit code 1 if nothing came of it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lumaframe.api import FORMATS, Library


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lumaframe")
    parser.add_argument("what", choices=["list", "walk", "children", "stats", "preview", "convert"])
    parser.add_argument("path")
    parser.add_argument("--uuid")
    parser.add_argument("--out", default=".")
    parser.add_argument("--format", default="ome-tiff", choices=sorted(FORMATS))
    parser.add_argument("--height", type=int, default=256)
    parser.add_argument("--threshold", type=int, default=3192)
    parser.add_argument("--other-out", help="a second folder for the result")
    parser.add_argument("--with-metadata", action="store_true")
    parser.add_argument("--with-xml", action="store_true")
    parser.add_argument("--seek", action=argparse.BooleanOptionalAction, default=None, help="open files where they are mounted and read headers only")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    library = Library(spark, args.path, args.seek)
    if args.what == "convert":
        result = library.convert(args.uuid, args.out, args.format, args.threshold, other_folder=args.other_out, with_metadata=args.with_metadata, with_xml=args.with_xml)
        print(result)
        return int(result == "[]")
    if args.what == "preview":
        rows = library.previews(args.height)
        rows = rows.where(rows["uuid"] == args.uuid) if args.uuid else rows
        names = []
        for r in rows.toLocalIterator():  # one small picture at a time
            names.append(f"{args.out}/{r.uuid}_h{r.height}.png")
            with open(names[-1], "wb") as file:
                file.write(r.png)
        print(json.dumps(names))
        return int(not names)
    rows = {"list": library.list_images, "walk": library.every_image, "children": lambda: library.children(args.uuid), "stats": library.stats}[args.what]()
    found = 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
        found += 1
    return int(not found)


if __name__ == "__main__":
    sys.exit(main())
