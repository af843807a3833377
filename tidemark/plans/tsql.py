"""SQL with time-series calls, rewritten to Spark SQL.

TIME_BUCKET('1h', time), FIRST(value, time), LAST(value, time), DELTA(value, time), RATE(value, time) and NOW(). Times are
nanoseconds; intervals in arithmetic with them ('24h' behind INTERVAL) become nanoseconds too. Quoted text is left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import QueryError
from tidemark.plans.promql import duration

CALL = re.compile(r"\b(TIME_BUCKET|FIRST|LAST|DELTA|RATE|NOW)\s*\(", re.IGNORECASE)
INTERVAL = re.compile(r"\bINTERVAL\s+'(\d+(?:\.\d+)?(?:ms|[smhdw]))'", re.IGNORECASE)
QUOTED = re.compile(r"'(?:[^']|'')*'")


def arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket opens before ``at``, and the place behind it."""
    depth, start, out, i = 1, at, [], at
    while i < len(text):
        if text[i] == "'":
            i = QUOTED.match(text, i).end()
            continue
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if not depth:
                if text[start:i].strip():
                    out.append(text[start:i].strip())
                return out, i + 1
        elif text[i] == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    raise QueryError("a bracket is not closed")


def rewrite(sql: str, now: int) -> str:
    sql = INTERVAL.sub(lambda m: f"{duration(m[1])}L", sql)
    out, at = [], 0
    while m := CALL.search(sql, at):
        quoted = next((q for q in QUOTED.finditer(sql) if q.start() < m.start() < q.end()), None)
        if quoted:
            out.append(sql[at : quoted.end()])
            at = quoted.end()
            continue
        out.append(sql[at : m.start()])
        args, at = arguments(sql, m.end())
        args = [rewrite(a, now) for a in args]
        out.append(call(m[1].upper(), args, now))
    return "".join([*out, sql[at:]])


def call(name: str, args: list[str], now: int) -> str:
    if name == "NOW" and not args:
        return f"{now}L"
    if len(args) != 2:
        raise QueryError(f"{name} takes two arguments")
    a, b = args
    if name == "TIME_BUCKET":
        width = duration(a.strip("'"))
        return f"({b} - pmod({b}, {width}L))"
    first, last = f"min_by({a}, {b})", f"max_by({a}, {b})"
    if name == "FIRST":
        return first
    if name == "LAST":
        return last
    if name == "DELTA":
        return f"({last} - {first})"
    samples = f"array_sort(collect_list(struct({b} AS t, CAST({a} AS DOUBLE) AS v)))"
    steps = f"zip_with(slice({samples}, 1, greatest(count(*) - 1, 0)), slice({samples}, 2, greatest(count(*) - 1, 0)), (p, q) -> if(q.v >= p.v, q.v - p.v, q.v))"
    return f"(aggregate({steps}, CAST(0 AS DOUBLE), (s, x) -> s + x) / nullif((max({b}) - min({b})) / 1e9, 0))"


def query(spark: SparkSession, sql: str, now: int, **tables: DataFrame) -> DataFrame:
    """Run ``sql`` over the named tables; ``now`` is the time that NOW() gives."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(rewrite(sql, now))
