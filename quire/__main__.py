"""``python -m quire``: convert PDF files from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__


class Once(argparse.Action):
    """An option that may be given once only."""

    def __call__(self, parser, namespace, values, option_string=None):
        if getattr(namespace, self.dest) is not None:
            parser.error(f"{option_string} stands twice")
        setattr(namespace, self.dest, values)


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quire", description="Converts PDF files to EPUB.", allow_abbrev=False)
    parser.add_argument("--version", action="version", version=f"quire {__version__}")
    parser.add_argument("--headless", action="store_true", help="accepted for scripts; there is no other way of running")
    parser.add_argument("--cover", action=Once, metavar="IMAGE", help="a JPEG or PNG file for the cover; otherwise it is found on the first pages or drawn")
    parser.add_argument("--lang", action=Once, metavar="CODE", help="language of the books (pt)")
    parser.add_argument("source", metavar="PDF", help="a PDF file or a folder of them")
    parser.add_argument("target", nargs="?", help="folder for the EPUB files (that of the source)")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    found = arguments(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession

    from .plans.convert import convert_folder

    path = Path(found.source)
    target = found.target or str(path if path.is_dir() else path.parent)
    cover = None
    if found.cover is not None:
        try:
            cover = Path(found.cover).read_bytes()
        except OSError as e:
            print(f"cover: {e}; looking for one in the PDF", file=sys.stderr)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    rows = convert_folder(spark, found.source, target, cover, lang=found.lang or "pt").collect()  # a line of the report each
    for r in rows:
        print(f"{r['path']}: {r['error']}" if r["error"] else f"{r['path']}: {r['title']}, {r['pages']} pages, {r['images']} images, {r['chapters']} chapters: {target}/{r['epub']}")
    if not rows:
        print(f"no PDF files in {found.source}", file=sys.stderr)
    return 0 if rows and not any(r["error"] for r in rows) else 1


if __name__ == "__main__":
    sys.exit(main())
