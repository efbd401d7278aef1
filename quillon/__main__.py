"""The command line: ``python -m quillon --path FOLDER --dim N --op put|del|search ...``; without
``--op``, commands are read line by line (``put ID F,F,F``, ``del ID``, ``search F,F,F K``, ``help``, ``exit``)."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.functions.vectors import neighbor_line
from quillon.plans.engine import Collection, Engine
from quillon.schema import EngineError

#: Neighbours that a search without a number gives, and the dimension.
NEIGHBORS, DIM = 10, 3
USAGE = {"put": "usage: put <id> <f,f,f>", "del": "usage: del <id>", "search": "usage: search <f,f,f> <k>"}


def vector(text: str, dim: int) -> list[float]:
    try:
        out = [float(x) for x in text.split(",")]
    except ValueError as e:
        raise EngineError(f"bad vector {text!r}: {e}") from e
    if len(out) != dim:
        raise EngineError(f"vector has dim {len(out)}, collection has {dim}")
    return out


def whole(text: str, what: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise EngineError(f"bad {what} {text!r}") from e


def done(c: Collection, op: str, i: str, vec: str, k: str) -> list[str]:
    """The lines that a command prints: a write's log number, or the neighbours by rank."""
    if op == "put":
        return [f"ok index={c.upsert([(whole(i, 'id'), vector(vec, c.dim))])}"]
    if op == "del":
        return [f"ok index={c.delete([whole(i, 'id')], missing='ignore')}"]
    if op == "search":
        found = c.query(vector(vec, c.dim), whole(k, "k"))
        rows = found.orderBy("distance", "id").select(neighbor_line(F.col("id"), F.col("distance")).alias("line")).collect()  # k rows
        return [r["line"] for r in rows] or ["ok neighbors=0"]
    raise EngineError(f"unknown --op {op!r} (want put, del, or search)")


def typed(c: Collection, line: str) -> list[str] | None:
    """What a typed command prints; None ends the session."""
    fields = line.split()
    if not fields:
        return []
    op, *rest = fields
    if op in ("exit", "quit"):
        return None
    if op == "help":
        return list(USAGE.values())
    if op not in USAGE:
        return [f"unknown command {op!r}; type help"]
    if len(rest) != (1 if op == "del" else 2):
        return [USAGE[op]]
    vec, k = rest if op == "search" else (rest[-1], "")
    try:
        return done(c, op, rest[0], vec, k)
    except EngineError as e:
        return [str(e)]


def main(args: list[str], spark: SparkSession | None = None, lines: Iterable[str] = sys.stdin, out=print) -> int:
    p = argparse.ArgumentParser(prog="quillon")
    p.add_argument("--path", required=True)
    p.add_argument("--dim", type=int, default=DIM)
    p.add_argument("--metric", default="l2")
    p.add_argument("--op")
    p.add_argument("--id", default="")
    p.add_argument("--vec", default="")
    p.add_argument("--k", default=str(NEIGHBORS))
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    c = Engine(spark).open_collection("cli", a.dim, a.metric, path=a.path)
    if a.op:
        try:
            found = done(c, a.op, a.id, a.vec, a.k)
        except EngineError as e:
            out(f"error: {e}")
            return 1
        for line in found:
            out(line)
        return 0
    for line in lines:
        if (found := typed(c, line)) is None:
            break
        for x in found:
            out(x)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
