"""python -m quillon CORPUS [PROGRAM]: run a program and print its rows, or read statements from the terminal."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .corpus import Corpus
from .session import Session
from .sources import conllu, jsonl, ptb, vrt

READERS = {"conllu": conllu.read, "vrt": vrt.read, "jsonl": jsonl.read, "psd": ptb.read}


def show(session: Session, program: str, as_json: bool) -> None:
    try:
        df = session.run(program)
    except ValueError as e:
        print(f"error: {e}")
        return
    if df is None:
        return
    for row in df.limit(int(session.settings["group_limit"]) or 1000).toLocalIterator():
        print(row.asDict(recursive=True) if as_json else "\t".join("" if x is None else str(x) for x in row))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("corpus")
    p.add_argument("program", nargs="?")
    p.add_argument("--load", metavar="FILE", help="read a .conllu, .vrt, .jsonl or .psd file, or JSON lines from standard input (-), into CORPUS first")
    p.add_argument("--dialect", default="native")
    p.add_argument("--json", action="store_true")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.load == "-":
        jsonl.read_stream(spark, sys.stdin.buffer, f"{args.corpus}-events").save(args.corpus)
    elif args.load:
        READERS[args.load.rpartition(".")[2]](spark, args.load).save(args.corpus)
    session = Session(Corpus.open(spark, args.corpus), args.dialect)
    for pair in args.set:
        session.set(*pair.split("=", 1))
    if args.program:
        show(session, args.program, args.json)
        return
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        if line in ("quit", "exit"):
            return
        if line:
            show(session, line, args.json)


if __name__ == "__main__":
    main()
