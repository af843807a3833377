"""Text formats to points: line protocol and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators that no backslash stands before.
UNESCAPED = {",": r"(?<!\\),", "=": r"(?<!\\)=", " ": r"(?<!\\) "}


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([,= \\])", "$1")


def pairs(text: Column) -> Column:
    """``a=1,b=2`` as an array of struct(k, v)."""
    return F.transform(F.split(text, UNESCAPED[","]), lambda x: F.struct(unescape(F.split(x, UNESCAPED["="], 2)[0]).alias("k"), F.split(x, UNESCAPED["="], 2)[1].alias("v")))


#: A line: name and tags, fields (where blanks may stand in quotes), and a time or none. Runs are possessive: no pattern
#: goes back, and none nests with the length of a line.
LINE = r'^\s*((?:[^\\ ]++|\\.)++) +((?:[^ "\\]++|\\.|"(?:[^"\\]++|\\.)*+")++)(?: +(-?\d+))?\s*$'
FIELD = r'((?:[^,=\\]++|\\.)++)=("(?:[^"\\]++|\\.)*+"|[^,"]++)(?:,|$)'
TRUE, FALSE = ("t", "T", "true", "True", "TRUE"), ("f", "F", "false", "False", "FALSE")


def line_protocol(lines: DataFrame, column: str = "line", now: int | None = None) -> DataFrame:
    """``name,tag=v,... field=1.5,other=2i timestamp`` as a row for each field: metric ``name`` for a field named value, else
    ``name.field``. Numbers may end in i or u, booleans are 1 and 0, and quoted text, which no point can hold, gives no row.
    A line without a time has ``now`` (nanoseconds; unless given, that of the query). Lines that do not parse give no row."""
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, LINE, i)
    clock = F.lit(now) if now is not None else F.unix_micros(F.current_timestamp()) * 1000
    time = F.when(part(3) == "", clock).otherwise(part(3).try_cast("long"))
    rows = lines.where(line.rlike(LINE)).select(F.split(part(1), UNESCAPED[","], 2).alias("head"), part(2).alias("fields"), time.alias("timestamp"))
    labels = F.when(F.size("head") > 1, F.map_from_entries(pairs(F.col("head")[1]))).otherwise(F.create_map().cast("map<string,string>"))
    labels = F.transform_values(labels, lambda _, v: unescape(v))
    each = F.arrays_zip(F.regexp_extract_all("fields", F.lit(FIELD), F.lit(1)).alias("k"), F.regexp_extract_all("fields", F.lit(FIELD), F.lit(2)).alias("v"))
    rows = rows.select(unescape(F.col("head")[0]).alias("name"), labels.alias("labels"), F.explode(each).alias("field"), "timestamp")
    key, text = unescape(F.col("field.k")), F.col("field.v")
    metric = F.when(key == "value", F.col("name")).otherwise(F.concat("name", F.lit("."), key))
    number = F.when(text.rlike(r"^[-+]?[0-9.]"), F.regexp_replace(text, "[iu]$", "").try_cast("double"))
    value = F.when(text.isin(*TRUE), 1.0).when(text.isin(*FALSE), 0.0).otherwise(number)
    return rows.select(metric.alias("metric"), "labels", "timestamp", value.alias("value")).where("value is not null and timestamp is not null")


def json_points(rows: DataFrame, column: str = "body") -> DataFrame:
    """``{"metric", "tags": {}, "fields": {}, "timestamp"}`` as a row for each field, named as in ``line_protocol``."""
    kind = "metric string, tags map<string,string>, fields map<string,double>, timestamp bigint"
    found = rows.select(F.from_json(column, kind).alias("x")).where("x.metric is not null and x.timestamp is not null")
    found = found.select("x.metric", F.coalesce("x.tags", F.create_map().cast("map<string,string>")).alias("labels"), "x.timestamp", F.explode("x.fields").alias("field", "value"))
    metric = F.when(F.col("field") == "value", F.col("metric")).otherwise(F.concat("metric", F.lit("."), F.col("field")))
    return found.where("value is not null").select(metric.alias("metric"), "labels", "timestamp", "value")
