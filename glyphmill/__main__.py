"""Command line: ``python -m glyphmill transliterate|slugify|normalize|pipeline|demojize [text ...]``; without text, lines of stdin."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import native, udfs
from .plans.presets import list_profiles


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="glyphmill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transliterate", aliases=["t"])
    t.add_argument("--lang")
    t.add_argument("--errors", default="replace")
    t.add_argument("--strict-iso9", action="store_true")
    t.add_argument("--gost7034", action="store_true")
    t.add_argument("--target")
    s = sub.add_parser("slugify", aliases=["s"])
    s.add_argument("--lang")
    s.add_argument("--separator", default="-")
    s.add_argument("--max-length", type=int, default=0)
    n = sub.add_parser("normalize", aliases=["n"])
    n.add_argument("--form", default="NFC")
    p = sub.add_parser("pipeline", aliases=["p"])
    p.add_argument("--profile", choices=list_profiles(), required=True)
    d = sub.add_parser("demojize", aliases=["d"])
    d.add_argument("--strip-modifiers", action="store_true")
    for each in (t, s, n, p, d):
        each.add_argument("text", nargs="*")
    a = top.parse_args(args)
    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    lines = a.text or [x.rstrip("\n") for x in sys.stdin]
    col = {
        "t": lambda c: udfs.transliterate(c, target=a.target) if a.target else udfs.transliterate(c, lang=a.lang, errors=a.errors, strict_iso9=a.strict_iso9, gost7034=a.gost7034),
        "s": lambda c: udfs.slugify(c, lang=a.lang, separator=a.separator, max_length=a.max_length),
        "n": lambda c: native.normalize(c, a.form),
        "p": lambda c: udfs.apply_pipeline(c, a.profile),
        "d": lambda c: udfs.demojize(c, a.strip_modifiers),
    }[a.command[0]](F.col("line"))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k long, line string")
    for row in rows.select("k", col.alias("out")).orderBy("k").toLocalIterator():
        print(row["out"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
