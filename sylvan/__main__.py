"""``python -m sylvan STYLESHEET XML [-o FILE] [-p NAME=VALUE]... [-f] [-v]``: transforms one file, or every file that a path pattern names."""

from __future__ import annotations

import argparse
import sys
from contextlib import nullcontext
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sylvan.api import Transformer, pretty


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sylvan")
    p.add_argument("stylesheet")
    p.add_argument("xml")
    p.add_argument("-o", "--output")
    p.add_argument("-p", "--param", action="append", default=[])
    p.add_argument("-f", "--format", action="store_true")
    p.add_argument("-v", "--version", action="version", version="1")
    a = p.parse_args(args)
    try:
        t = Transformer(loader=lambda href, base: Path(href if Path(href).is_absolute() or not base else Path(base).parent / href).read_text()).import_stylesheet(Path(a.stylesheet).read_text(), a.stylesheet)
        for pair in a.param:
            name, _, value = pair.partition("=")
            t.set_parameter(None, name, value)
    except (OSError, ValueError, TypeError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    files = spark.read.text(a.xml, wholetext=True).withColumn("doc_id", F.monotonically_increasing_id())
    failed = False
    with open(a.output, "w") if a.output else nullcontext(sys.stdout) as out:
        for r in t.transform(files, "value").orderBy("doc_id").toLocalIterator():
            if r.error:
                print(r.error, file=sys.stderr)
                failed = True
            else:
                out.write((pretty(r.xml) if a.format else r.xml) + "\n")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
