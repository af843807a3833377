"""Connected components of a graph held in a table; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked, map_rows, save

#: Edges that one task unites; its memory holds twice as many ids at most.
TASK_EDGES = 300_000


def unite(batches):
    """Edges (a, b) of a task to (a, b) with b the smallest id that a reaches within the task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root[top]) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    for i in range(0, len(ids), 50_000):
        part = ids[i : i + 50_000]
        yield {"a": part, "b": [find(x) for x in part]}


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id reaches, for every id of ``edges`` (a, b).

    Tasks unite what they hold of the edges. Where that is all of them, it is the result; else labels go round: an id takes
    the smallest label around it, and then its label's label, so chains halve every round. Each round is a written table."""
    edges = save(edges.select("a", "b").where("a <> b"), "cc-edges")
    tasks = max(1, -(-edges.count() // TASK_EDGES))
    stars = save(map_rows(edges.repartition(tasks), "a long, b long", unite), "cc-stars")
    if tasks == 1:
        return stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    ways = stars.select(F.col("a").alias("id"), F.col("b").alias("other")).where("id <> other")
    ways = save(ways.unionByName(ways.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "cc-ways")
    labels = save(ways.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")), "cc-labels")
    while True:
        small = checked(labels)
        around = ways.join(small.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("m"))
        lower = save(labels.join(around, "id").select("id", F.least("label", "m").alias("next"), "label"), "cc-round")
        jump = checked(lower.select(F.col("id").alias("next"), F.col("next").alias("far")))
        labels = save(lower.join(jump, "next").select("id", F.least("next", "far").alias("label"), F.col("label").alias("before")), "cc-labels")
        if labels.where("label <> before").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.drop("before")
