"""A metrics query language: text to a DataFrame plan.

    sum by (user_id) (rate(login{user_id=~"1.*"}[5m])) > 0.5

Selectors with =, !=, =~, !~ matchers and ``offset``. Range functions: rate, irate, increase, delta, and avg, sum, min, max,
count, first, last, stddev, stdvar ``_over_time``, quantile_over_time(q, ...). Functions of a vector: abs, ceil, floor,
round, sqrt, exp, ln, log2, log10, sgn, clamp_min, clamp_max; vector(number). Aggregations with by / without: sum, avg, min,
max, count, group, stddev, stdvar, topk, bottomk, quantile. Operators, loosest first: or; and, unless; comparisons (which
filter, or give 0 and 1 with ``bool``); + -; * / %; ^; with on / ignoring and group_left / group_right between vectors.
Numbers follow IEEE: a division by zero is an infinity or NaN.

sum_over_time adds in order of the points' lsn, or of time where they have none. An instant selector takes the last sample
of at most five minutes. rate and increase follow counter resets and do not
extrapolate to the window's edges. Where several series on the "one" side match, the query fails when it runs. ``evaluate``
returns (metric, labels_key, step, value), a row for each series and evaluation time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import QueryError
from tidemark.model import SECOND, labels_key
from tidemark.operators.series_ops import at_steps, label_matches

UNITS = {"ms": 10**6, "s": SECOND, "m": 60 * SECOND, "h": 3_600 * SECOND, "d": 86_400 * SECOND, "w": 7 * 86_400 * SECOND}
LOOKBACK = 5 * UNITS["m"]
AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop, "group": lambda x: F.max(F.lit(1.0))}
#: Aggregations that take a number first.
RANKED = {"topk", "bottomk", "quantile"}
OVER_TIME = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "stddev": F.stddev_pop, "stdvar": F.var_pop}
RANGE = {"rate", "irate", "increase", "delta", *(f"{x}_over_time" for x in (*OVER_TIME, "first", "last", "quantile"))}
INF, NAN = float("inf"), float("nan")


def logarithm(log) -> object:
    return lambda x: F.when(x > 0, log(x)).when(x == 0, -INF).otherwise(NAN)


def divided(a: Column, b: Column) -> Column:
    """As IEEE has it, whatever the session says of a division by zero."""
    nothing = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b != 0, F.try_divide(a, b)).otherwise(nothing)


def whole(f) -> object:
    """Beyond 2^52 every double is whole, or no number."""
    return lambda x: F.when(F.abs(x) < float(1 << 52), f(x).cast("double")).otherwise(x)


FUNCTIONS = {
    "abs": F.abs, "ceil": whole(F.ceil), "floor": whole(F.floor), "round": whole(lambda x: F.floor(x + 0.5)), "sqrt": F.sqrt,
    "exp": F.exp, "ln": logarithm(F.ln), "log2": logarithm(F.log2), "log10": logarithm(F.log10), "sgn": F.signum, "clamp_min": F.greatest, "clamp_max": F.least,
}
ARITHMETIC = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divided,
    "%": lambda a, b: F.when(b != 0, F.try_mod(a, b)).otherwise(NAN), "^": F.pow,
}
TESTS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
SETS = {"and", "or", "unless"}
TOKEN = re.compile(r'\s*(?:(\d+(?:\.\d+)?(?:ms|[smhdw])(?:\d+(?:ms|[smhdw]))*)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')|([A-Za-z_:][\w:.]*)|(=~|!~|!=|==|>=|<=|[-+*/%^(){}\[\],=<>]))')


@dataclass(frozen=True)
class Select:
    metric: str | None
    matchers: tuple
    window: int = 0
    offset: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    over: Select
    number: float = 0.0


@dataclass(frozen=True)
class Map:
    name: str
    over: object
    number: float | None = None


@dataclass(frozen=True)
class Group:
    name: str
    mode: str
    labels: tuple
    over: object
    number: float = 0.0


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    bool_: bool = False
    match: str | None = None  # on, ignoring
    labels: tuple = ()
    many: str | None = None  # group_left, group_right
    include: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise QueryError(f"cannot read {text[at : at + 20]!r}")
        kind = ("duration", "number", "string", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return [*out, ("end", "")]


def duration(text: str) -> int:
    return int(sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw])", text)))


class Parser:
    LEVELS = (("or",), ("and", "unless"), ("==", "!=", ">", "<", ">=", "<="), ("+", "-"), ("*", "/", "%"), ("^",))

    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self) -> str:
        return self.tokens[self.at][1]

    def take(self, *wanted: str) -> str:
        kind, text = self.tokens[self.at]
        if wanted and text not in wanted and kind not in wanted:
            raise QueryError(f"expected {' or '.join(wanted)}, found {text or 'the end'!r}")
        self.at += 1
        return text

    def parse(self):
        found = self.binary(0)
        if self.tokens[self.at][0] != "end":
            raise QueryError(f"unexpected {self.peek()!r}")
        return found

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.tokens[self.at][0] in ("sign", "name") and self.peek() in self.LEVELS[level]:
            op = self.take()
            bool_, match, labels, many, include = False, None, (), None, ()
            if self.peek() == "bool":
                if op not in TESTS:
                    raise QueryError("bool goes with a comparison")
                self.take()
                bool_ = True
            if self.peek() in ("on", "ignoring"):
                match, labels = self.take(), self.label_list()
                if self.peek() in ("group_left", "group_right"):
                    many = self.take()
                    include = self.label_list() if self.peek() == "(" else ()
            # A power binds to the right, everything else to the left.
            left = Binary(op, left, self.binary(level if op == "^" else level + 1), bool_, match, labels, many, include)
        return left

    def number(self) -> float:
        found = folded(self.binary(0))
        if not isinstance(found, float):
            raise QueryError("expected a number")
        return found

    def unary(self):
        if self.peek() in ("-", "+"):
            sign, found = self.take(), self.binary(len(self.LEVELS) - 1)  # a power binds more than a sign
            return Binary("*", -1.0, found) if sign == "-" else found
        if self.tokens[self.at][0] == "number":
            return float(self.take())
        if self.peek() == "(":
            self.take()
            found = self.binary(0)
            self.take(")")
            return found
        if self.peek() == "{":
            return self.selector(None)
        name = self.take("name")
        if name.lower() in ("inf", "nan") and self.peek() != "(":
            return float(name)
        if name in AGGREGATES or name in RANKED:
            if self.peek() in ("(", "by", "without"):
                return self.group(name)
        if self.peek() != "(":
            return self.selector(name)
        self.take()
        if name == "vector":
            found = Map(name, None, self.number())
        elif name in FUNCTIONS:
            over = self.binary(0)
            number = None
            if name.startswith("clamp"):
                self.take(",")
                number = self.number()
            found = Map(name, over, number)
        elif name in RANGE:
            number = 0.0
            if name == "quantile_over_time":
                number = self.number()
                self.take(",")
            over = self.selector(None if self.peek() == "{" else self.take("name"))
            if not over.window:
                raise QueryError(f"{name} needs a range, as in [5m]")
            found = Call(name, over, number)
        else:
            raise QueryError(f"unknown function {name}")
        self.take(")")
        return found

    def group(self, name: str) -> Group:
        mode, labels = "by", ()
        if self.peek() != "(":
            mode, labels = self.take(), self.label_list()
        self.take("(")
        number = 0.0
        if name in RANKED:
            number = self.number()
            self.take(",")
        over = self.binary(0)
        self.take(")")
        if self.peek() in ("by", "without"):
            mode, labels = self.take(), self.label_list()
        return Group(name, mode, labels, over, number)

    def label_list(self) -> tuple:
        self.take("(")
        out = []
        while self.peek() != ")":
            out.append(self.take("name"))
            if self.peek() == ",":
                self.take()
        self.take(")")
        return tuple(out)

    def selector(self, metric: str | None) -> Select:
        matchers, window, offset = [], 0, 0
        if self.peek() == "{":
            self.take()
            while self.peek() != "}":
                label, op, value = self.take("name"), self.take("=", "!=", "=~", "!~"), self.take("string")
                matchers.append((label, op, re.sub(r"\\(.)", r"\1", value[1:-1]) if op in ("=", "!=") else value[1:-1]))
                if self.peek() == ",":
                    self.take()
            self.take("}")
        if self.peek() == "[":
            self.take()
            window = duration(self.take("duration"))
            self.take("]")
        if self.peek() == "offset":
            self.take()
            offset = duration(self.take("duration"))
        return Select(metric, tuple(matchers), window, offset)


def folded(node):
    """An expression of numbers alone as its value."""
    if isinstance(node, Binary):
        a, b = folded(node.left), folded(node.right)
        if isinstance(a, float) and isinstance(b, float):
            return arithmetic(node, a, b)
    return node


def arithmetic(node: Binary, a: float, b: float) -> float:
    import math

    if node.op in TESTS:
        if not node.bool_:
            raise QueryError("a comparison of two numbers needs bool")
        return float({"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[node.op])
    if node.op in SETS:
        raise QueryError(f"{node.op} goes between vectors")
    if node.op == "/":
        return a / b if b else (math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a))
    if node.op == "%":
        return math.fmod(a, b) if b else math.nan
    return {"+": a + b, "-": a - b, "*": a * b, "^": a**b if node.op == "^" else 0.0}[node.op]


def only(labels: Column, names: tuple, keep: bool) -> Column:
    """The map with these names alone, or without them."""
    if not names:
        return F.map_filter(labels, lambda k, _: F.lit(not keep))
    return F.map_filter(labels, lambda k, _: k.isin(list(names)) if keep else ~k.isin(list(names)))


class Plan:
    COLUMNS = ("metric", "labels", "labels_key", "step", "value")

    def __init__(self, points: DataFrame, start: int, end: int, step: int):
        self.points, self.start, self.end, self.step = points, start, end, step

    def selected(self, s: Select) -> DataFrame:
        found = self.points
        if s.metric is not None:
            found = found.where(F.col("metric") == s.metric)
        for name, op, value in s.matchers:
            target = F.create_map(F.lit("__name__"), F.col("metric")) if name == "__name__" else F.col("labels")
            found = found.where(label_matches(target, name, op, value))
        found = found.withColumn("timestamp", F.col("timestamp") + s.offset) if s.offset else found
        return found.withColumn("labels_key", labels_key(F.col("labels")))

    def at(self, rows: DataFrame, window: int) -> DataFrame:
        return at_steps(rows, self.start, self.end, self.step, window)

    def vector(self, node) -> DataFrame:
        """(metric, labels, labels_key, step, value)"""
        node = folded(node)
        if isinstance(node, float) or isinstance(node, Map) and node.name == "vector":
            number = node if isinstance(node, float) else node.number
            steps = self.points.sparkSession.range((self.end - self.start) // self.step + 1)
            none = F.create_map().cast("map<string,string>")
            return steps.select(F.lit("").alias("metric"), none.alias("labels"), F.lit("").alias("labels_key"), (F.col("id") * self.step + self.start).alias("step"), F.lit(number).alias("value"))
        if isinstance(node, Select):
            if node.window:
                raise QueryError("a range needs a function")
            return self.grouped(self.at(self.selected(node), LOOKBACK), F.max_by("value", "timestamp"))
        if isinstance(node, Call):
            return self.call(node)
        if isinstance(node, Map):
            f, more = FUNCTIONS[node.name], [F.lit(node.number)] if node.number is not None else []
            return self.vector(node.over).withColumn("value", f(F.col("value"), *more)).withColumn("metric", F.lit(""))
        if isinstance(node, Group):
            return self.group(node)
        if isinstance(node, Binary):
            return self.combine(node)
        raise QueryError("this is no vector")

    @staticmethod
    def grouped(rows: DataFrame, value) -> DataFrame:
        return rows.groupBy("metric", "labels_key", "step").agg(value.alias("value"), F.any_value("labels").alias("labels"))

    def group(self, node: Group) -> DataFrame:
        inner = self.vector(node.over)
        labels = only(F.col("labels"), node.labels, node.mode == "by")
        if node.name in ("topk", "bottomk"):
            value = F.col("value")
            best = F.when(F.isnan(value), 1).otherwise(0), value.desc() if node.name == "topk" else value.asc(), F.col("metric"), F.col("labels_key")
            w = Window.partitionBy("step", "of").orderBy(*best)
            ranked = inner.withColumn("of", labels_key(labels)).withColumn("rank", F.row_number().over(w))
            return ranked.where(F.col("rank") <= int(node.number)).select(*self.COLUMNS)
        value = F.percentile("value", F.lit(node.number)) if node.name == "quantile" else AGGREGATES[node.name]("value")
        inner = inner.withColumn("labels", labels).withColumn("labels_key", labels_key(F.col("labels"))).withColumn("metric", F.lit(""))
        return self.grouped(inner, value.cast("double"))

    def call(self, node: Call) -> DataFrame:
        rows, window = self.selected(node.over), node.over.window
        kind = node.name.removesuffix("_over_time")
        seconds = lambda nanos: nanos / F.lit(float(SECOND))
        if node.name in ("rate", "irate", "increase"):
            # What a sample adds to the one before it, once for each sample; a step counts it if it holds both.
            w = Window.partitionBy("metric", "labels_key").orderBy("timestamp")
            before = F.lag("value").over(w)
            grown = F.when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
            rows = rows.withColumn("since", F.lag("timestamp").over(w)).withColumn("grown", F.when(before.isNotNull(), grown))
            inside = F.col("since") > F.col("step") - window
            found = F.sum(F.when(inside, F.col("grown")))
            if node.name == "rate":
                found = found / seconds(F.max("timestamp") - F.min("timestamp"))
            elif node.name == "irate":
                latest = F.max_by(F.when(inside, F.struct("grown", (F.col("timestamp") - F.col("since")).alias("took"))), "timestamp")
                found = latest["grown"] / seconds(latest["took"])
            value = F.when(F.count(F.lit(1)) >= 2, found)
        elif node.name == "delta":
            value = F.when(F.count(F.lit(1)) >= 2, F.max_by("value", "timestamp") - F.min_by("value", "timestamp"))
        elif kind == "quantile":
            value = F.percentile("value", F.lit(node.number))
        elif kind == "sum":
            return self.in_sequence(rows, window)
        elif kind in OVER_TIME:
            value = OVER_TIME[kind]("value").cast("double")
        else:
            value = (F.max_by if kind == "last" else F.min_by)("value", "timestamp")
        return self.grouped(self.at(rows, window), value).where("value is not null").withColumn("metric", F.lit(""))

    def in_sequence(self, rows: DataFrame, window: int) -> DataFrame:
        """The windows' sums, added up in order of lsn (without one, of time): partial sums differ in the last bit with how the
        rows lie in files and tasks, which floor, a comparison or topk makes a whole step. Points are dealt out by series and
        block, which is as many steps as a window has, before the steps are: a point is shuffled twice at most, and a long
        series is no single task. What a window holds is sorted, which spills, and not gathered."""
        n = max(window // self.step, 1)
        wide, behind = n * self.step, (n - 1) * self.step
        latest = self.start + behind + (self.end - self.start) // wide * wide
        # A block is named by its last step; its points are those of a window that reaches back from there over all its steps.
        rows = at_steps(rows, self.start + behind, latest, wide, window + behind).withColumnRenamed("step", "block")
        rows = self.at(rows.repartition("metric", "labels_key", "block"), window).where((F.col("step") <= F.col("block")) & (F.col("step") > F.col("block") - wide))
        keys = "metric", "labels_key", "block", "step"
        w = Window.partitionBy(*keys).orderBy(*[c for c in ("lsn", "timestamp", "value") if c in rows.columns]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = rows.withColumn("total", F.sum("value").over(w)).groupBy(*keys).agg(F.any_value("total").alias("value"), F.any_value("labels").alias("labels"))
        return found.where("value is not null").drop("block").withColumn("metric", F.lit(""))

    @staticmethod
    def matched(node: Binary, rows: DataFrame) -> DataFrame:
        """``rows`` with the labels they are matched by."""
        if node.match is None:
            return rows.withColumn("by", F.col("labels_key"))
        return rows.withColumn("by", labels_key(only(F.col("labels"), node.labels, node.match == "on")))

    def combine(self, node: Binary) -> DataFrame:
        left, right = folded(node.left), folded(node.right)
        numbers = isinstance(left, float), isinstance(right, float)
        if node.op in SETS:
            if any(numbers):
                raise QueryError(f"{node.op} goes between vectors")
            rows, others = self.matched(node, self.vector(left)), self.matched(node, self.vector(right))
            if node.op == "or":
                more = others.join(rows.select("by", "step"), ["by", "step"], "left_anti")
                return rows.select(*self.COLUMNS).unionByName(more.select(*self.COLUMNS))
            return rows.join(others.select("by", "step"), ["by", "step"], "left_semi" if node.op == "and" else "left_anti").select(*self.COLUMNS)
        if any(numbers):
            rows = self.vector(right if numbers[0] else left)
            value = F.col("value")
            return self.computed(node, rows, *((F.lit(left), value) if numbers[0] else (value, F.lit(right))))
        # The "one" side is the right one, unless group_right says otherwise.
        swap = node.many == "group_right"
        rows, others = (self.matched(node, self.vector(x)) for x in ((right, left) if swap else (left, right)))
        several = F.raise_error(F.lit("several series match on the side that must have one"))
        others = others.groupBy("by", "step").agg(F.when(F.count(F.lit(1)) > 1, several.cast("double")).otherwise(F.any_value("value")).alias("other"), F.any_value("labels").alias("theirs"))
        rows = rows.join(others, ["by", "step"])
        if node.many:
            if node.include:
                rows = rows.withColumn("labels", F.map_concat(only(F.col("labels"), node.include, False), only(F.col("theirs"), node.include, True)))
        elif node.match:
            rows = rows.withColumn("labels", only(F.col("labels"), node.labels, node.match == "on"))
            alone = rows.groupBy("by", "step").agg(F.when(F.count(F.lit(1)) > 1, several.cast("double")).otherwise(F.any_value("value")).alias("value"), *[F.any_value(c).alias(c) for c in ("metric", "labels", "other")])
            rows = alone
        rows = rows.withColumn("labels_key", labels_key(F.col("labels")))
        a, b = F.col("value"), F.col("other")
        return self.computed(node, rows, *((b, a) if swap else (a, b)))

    def computed(self, node: Binary, rows: DataFrame, a: Column, b: Column) -> DataFrame:
        if node.op not in TESTS:
            rows = rows.withColumn("value", ARITHMETIC[node.op](a, b)).withColumn("metric", F.lit(""))
        elif node.bool_:
            rows = rows.withColumn("value", TESTS[node.op](a, b).cast("double")).withColumn("metric", F.lit(""))
        else:
            rows = rows.where(TESTS[node.op](a, b))
        return rows.select(*self.COLUMNS)


def evaluate(points: DataFrame, query: str, start: int, end: int, step: int) -> DataFrame:
    """(metric, labels_key, step, value) at start, start + step, ... up to end, of points(metric, labels, timestamp, value)."""
    return Plan(points, start, end, step).vector(Parser(query).parse()).select("metric", "labels_key", "step", "value")
