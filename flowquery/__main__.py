"""``python -m flowquery``: flow files or captures in, JSON lines out.

The options of a capture are ``key=value`` words (``config.Options``); the query is put together as by ``FlowQuery``.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquery import capture, config, extend
from flowquery.pipeline import FlowQuery
from flowquery.sinks import anonymous
from flowquery.sinks import jsonl as sink
from flowquery.sources import jsonl, subnets


def arguments(words: Sequence[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="flowquery", description="Query network-flow files and captures.")
    p.add_argument("input", nargs="+", help="flow files (JSON lines, plain, .gz or .bz2) or captures")
    p.add_argument("--option", action="append", default=[], help="key=value of a capture (bidir=1, tls=1, bpf=...)")
    p.add_argument("--where", help="a predicate, as tcp=*,dp~80")
    p.add_argument("--extension", action="append", default=[], help="a Python file that registers predicates, processors or features")
    p.add_argument("--keep", action="append", default=[], help="a registered predicate, as name or name:text")
    p.add_argument("--process", action="append", default=[], help="a registered processor")
    p.add_argument("--stitch", action="store_true", help="join both directions of a conversation")
    p.add_argument("--select", help="a template of the fields to keep")
    p.add_argument("--normalize", help="a template of the fields to blank")
    p.add_argument("--groupby", default="", help="fields, comma-separated")
    p.add_argument("--dist", action="store_true", help="distinct rows with their counts")
    p.add_argument("--sum", default="", help="fields to sum, comma-separated")
    p.add_argument("--anon-leaves", default="sa,da", help="keys whose addresses are coded, with --anon-nets")
    p.add_argument("--anon-nets", help="a subnet list: addresses inside are written as codes, at any depth")
    p.add_argument("--anon-key", default="", help="16, 24 or 32 characters")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--output", help="a folder for the result; else it is printed")
    return p.parse_args(words)


def load(spark: SparkSession, paths: Sequence[str], options: config.Options) -> DataFrame:
    """Flow records of flow files and of captures, which each file's first bytes tell."""
    captures, others = capture.captures_among(spark, paths)
    if not others:
        return capture.records(spark, captures, options)
    flows = jsonl.read_typed(spark, *others)
    return capture.records(spark, captures, options).unionByName(flows, allowMissingColumns=True) if captures else flows


def query(flows: DataFrame, args: argparse.Namespace) -> DataFrame:
    q = FlowQuery(flows)
    for name in ("where", "select", "normalize"):
        if value := getattr(args, name):
            q = getattr(q, name)(value)
    q = q.keep(*args.keep).process(*args.process)
    q = q.stitch() if args.stitch else q
    q = q.groupby(*args.groupby.split(",")) if args.groupby else q
    q = q.dist() if args.dist else q
    return (q.sum(*args.sum.split(",")) if args.sum else q).run()


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if words is None else words)
    for path in args.extension:
        extend.load(path)
    spark = spark or SparkSession.builder.appName("flowquery").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = query(load(spark, args.input, config.parse(args.option)), args)
    coded = None
    if args.anon_nets:
        code = anonymous.address_code(subnets.read(spark, args.anon_nets), args.anon_key)
        coded = lambda lines: anonymous.rewrite(lines, args.anon_leaves.split(","), code)
    if args.output:
        sink.write(found, args.output, change=coded)
    else:
        lines = sink.lines(_readable(found), args.pretty)
        for row in (coded(lines) if coded else lines).toLocalIterator():  # a partition at a time
            print(row.value)
    return 0


def _readable(df: DataFrame) -> DataFrame:
    """Bytes as hex digits."""
    return df.withColumns({c: F.lower(F.hex(c)) for c, kind in df.dtypes if kind == "binary"})


if __name__ == "__main__":
    raise SystemExit(main())
