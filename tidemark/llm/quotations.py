"""Chat formatting by quotation linking.

Quote levels are the marks (>) that a line begins with. Runs of lines at one level are quoted passages; what they say,
normalised (lower case, one space between words), is hashed and joined to the passages that earlier messages of the
conversation wrote themselves: whole messages and paragraphs, and for passages that match neither, single lines and
sentences, so a quote that was shortened or wrapped anew is found by any sentence that it has whole. A message replies to the
message that wrote the first-level passage it quotes (the one with most words; else that of the deepest level found).
Replies point backwards, so they form trees: (root_turn, place) orders a conversation, ``place`` being the position of the
message in its thread, depth first, with every reply behind its original and before that message's next sibling. Texts
come out without quotes, and without a line that announces one ("On ... wrote:", only where a quote follows).

Only DataFrame functions are used. Passages of the same words in one conversation are reduced to the first turn that
wrote them before the join, and threads are ordered by pointers that double their reach each round, so a conversation, a
message or a sentence in it that holds a third of all rows stays linear and in no single task.

Defined cases: a null or empty text quotes nothing and stays empty; texts of any length are read whole; of repeated rows
each is given out with the same links; equal passages belong to the earliest turn; a quote that no earlier turn wrote links
to nothing; rows without a conv_id or turn are given out by themselves, linked with nothing; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, checked, save, table, text_or_empty

QUOTE = r"^[ \t]*>"
MARKS = r"^(?:[ \t]*>)+"
#: A line that only announces the quote behind it. Java takes more than a line feed for a line's end unless told not to (d).
INTRO = r"(?md)^On [^\n]* wrote:[ \t\r]*\n((?:[ \t]*\n)*[ \t]*>)"


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def said(text: Column) -> Column:
    """Words in lower case with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def sentences(words: Column) -> Column:
    """Of normalised text: what ends with . ! or ? before a space."""
    return F.split(F.regexp_replace(words, r"([.!?]) ", "$1\n"), "\n")


def print_of(words: Column) -> Column:
    return F.sha2(words, 256)


def without_quotes(text: Column) -> Column:
    lines = F.filter(F.split(F.regexp_replace(text, INTRO, "$1"), "\n"), lambda x: ~x.rlike(QUOTE))
    return F.when(text.rlike("(?md)" + QUOTE), F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"\A[ \n]+|[ \n]+\z", "")).otherwise(text)


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, passage, level, words, n_words): runs of lines at one level, with ``single`` false, and their lines and
    sentences. Blank quoted lines end a run."""
    own = ["conv_id", "turn", "row"]
    lines = messages.where(F.col("text").rlike("(?md)" + QUOTE)).select(*own, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("words", said(F.regexp_replace("line", MARKS, "")))
    # A window holds the lines of one message.
    ordered = Window.partitionBy(*own).orderBy("at")
    starts = (F.col("level") != F.lag("level", 1, 0).over(ordered)) | (F.col("words") == "") | (F.lag("words", 1, "").over(ordered) == "")
    lines = lines.withColumn("starts", F.when(starts, 1).otherwise(0)).withColumn("passage", F.sum("starts").over(ordered))
    lines = lines.where("level > 0 and words <> ''")
    runs = lines.groupBy(*own, "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x"))
    runs = runs.select("conv_id", "turn", "passage", "level", F.array_join(F.col("x.words"), " ").alias("words"), F.lit(False).alias("single"))
    single = lines.select("conv_id", "turn", "passage", "level", "words", F.lit(True).alias("single"))
    parts = runs.select("conv_id", "turn", "passage", "level", F.explode(sentences(F.col("words"))).alias("words"), F.lit(True).alias("single"))
    return runs.unionByName(single).unionByName(parts).withColumn("n_words", F.size(F.split("words", " ")))


def written_passages(messages: DataFrame) -> DataFrame:
    """(conv_id, print, first_turn): what messages wrote themselves, each with the first turn that did."""
    own = without_quotes(F.col("text"))
    paragraphs = F.transform(F.split(own, r"\n[ \t]*\n"), said)
    lines = F.transform(F.split(own, "\n"), said)
    units = F.concat(F.array(said(own)), paragraphs, lines, F.flatten(F.transform(paragraphs, sentences)))
    parts = messages.select("conv_id", "turn", F.explode(F.array_distinct(units)).alias("words")).where("words <> ''")
    return parts.select("conv_id", "turn", print_of(F.col("words")).alias("print")).groupBy("conv_id", "print").agg(F.min("turn").alias("first_turn"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_quotes, n_linked, max_level) of the messages that quote."""
    quotes = save(quoted_passages(messages).withColumn("print", print_of(F.col("words"))), "quotes")
    prints = checked(save(quotes.select("conv_id", "print").distinct(), "quote-prints"))
    # Only passages that somebody quotes are kept of those that were written.
    written = written_passages(messages.join(checked(save(quotes.select("conv_id").distinct(), "quote-convs")), "conv_id", "left_semi"))
    written = written.join(prints, ["conv_id", "print"], "left_semi")
    hits = quotes.join(checked(save(written, "quote-written")), ["conv_id", "print"], "left")
    hits = hits.withColumn("first_turn", F.when(F.col("first_turn") < F.col("turn"), F.col("first_turn")))
    # One row for each passage: the run itself if it is known, else its longest known line.
    best = F.max(F.when(F.col("first_turn").isNotNull(), F.struct((~F.col("single")).alias("run"), "n_words", (-F.col("first_turn")).alias("neg"))))
    passages = hits.groupBy("conv_id", "turn", "passage", "level").agg(best.alias("best"))
    # First level before deeper ones, then the passage with most words, then the latest turn.
    choice = F.max(F.when(F.col("best").isNotNull(), F.struct((-F.col("level")).alias("a"), F.col("best.n_words").alias("b"), (-F.col("best.neg")).alias("reply_to"))))
    return passages.groupBy("conv_id", "turn").agg(
        choice.alias("choice"), F.count(F.lit(1)).alias("n_quotes"), F.count("best").alias("n_linked"), F.max("level").cast("long").alias("max_level")
    ).select("conv_id", "turn", F.col("choice.reply_to").alias("reply_to"), "n_quotes", "n_linked", "max_level")


def follow(at: DataFrame, step: str, label: str) -> DataFrame:
    """Rows (conv_id, turn, <step>, far) with <step> the last turn of the chain that <step> leads along, and ``far`` the
    number of steps to it, null where there is none: each round takes the steps of the turn that was reached, so a chain is
    done in as many rounds as its length has binary digits. ``at``: (conv_id, turn, <step>), null at a chain's end."""
    at = save(at.withColumn("far", F.when(F.col(step).isNull(), 0).otherwise(1).cast("long")).withColumn("last", F.coalesce(step, "turn")), label)
    at = at.drop(step).withColumnRenamed("last", step)
    while True:
        there = at.select("conv_id", F.col("turn").alias(step), F.col(step).alias("next"), F.col("far").alias("more"))
        moved = save(at.join(checked(there), ["conv_id", step]).select("conv_id", "turn", F.col("next").alias(step), (F.col("far") + F.col("more")).alias("far"), (F.col("more") > 0).alias("moved")), label)
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def next_siblings(children: DataFrame) -> DataFrame:
    """(conv_id, parent, turn, sibling): the next turn with the same parent. Neighbours in a sorted table, whose partitions
    are cut by all of the key, so the replies to one message need not be in one task."""
    order = ["conv_id", "parent", "turn"]
    laid = save(children.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "quote-laid")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = laid.select("part", *order, F.lead(F.struct(*order)).over(inside).alias("next"))
    # Behind a partition's last row comes the first one of the next partition: a row for each partition.
    firsts = laid.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    rows = rows.join(checked(save(firsts, "quote-firsts")), "part").withColumn("next", F.coalesce("next", "after"))
    same = (F.col("next.conv_id") == F.col("conv_id")) & (F.col("next.parent") == F.col("parent"))
    return rows.select(*order, F.when(same, F.col("next.turn")).alias("sibling"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, place) of every message that replies or is replied to."""
    children = save(links.where("reply_to is not null and conv_id is not null and turn is not null").select("conv_id", "turn", F.col("reply_to").alias("parent")), "quote-children")
    if children.isEmpty():
        return children.select("conv_id", "turn", F.col("parent").alias("root_turn"), F.col("parent").alias("place"))
    parents = children.groupBy("conv_id", F.col("parent").alias("turn")).agg(F.min("turn").cast("long").alias("child"))
    nodes = parents.join(children, ["conv_id", "turn"], "full_outer").join(next_siblings(children).drop("parent"), ["conv_id", "turn"], "left")
    nodes = save(nodes.select("conv_id", "turn", "parent", "child", "sibling"), "quote-nodes")
    root = follow(nodes.select("conv_id", "turn", "parent"), "parent", "quote-roots").select("conv_id", "turn", F.col("parent").alias("root_turn"))
    # Behind a message come its first reply, or else the next sibling of the nearest one above it that has one.
    up = follow(nodes.select("conv_id", "turn", F.when(F.col("sibling").isNull(), F.col("parent")).alias("up")), "up", "quote-up").select("conv_id", "turn", "up")
    behind = nodes.select("conv_id", F.col("turn").alias("up"), F.col("sibling").alias("beside"))
    order = nodes.join(checked(save(up, "quote-ups")), ["conv_id", "turn"]).join(checked(save(behind, "quote-behind")), ["conv_id", "up"])
    order = follow(order.select("conv_id", "turn", F.coalesce("child", "beside").alias("after")), "after", "quote-order").select("conv_id", "turn", "far")
    found = save(root.join(checked(save(order, "quote-far")), ["conv_id", "turn"]), "quote-found")
    first = found.where("turn = root_turn").select("conv_id", "root_turn", F.col("far").alias("whole"))
    return found.join(checked(save(first, "quote-first")), ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", (F.col("whole") - F.col("far")).alias("place"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every message without quotes, with the turn it replies to, the turn its thread starts at, its place in it, and quote
    counts."""
    messages = conversations.select("conv_id", "turn", "role", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    with Scratch() as scratch:
        links = save(link_quotes(messages), "quote-links")
        tree = save(threads(links), "quote-tree")
        scratch.keep(links, tree)
    rows = messages.join(checked(links), ["conv_id", "turn"], "left").join(checked(tree), ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "conv_id", "turn", "role", without_quotes(F.col("text")).alias("text"), "reply_to", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("place", zero).alias("place"),
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("max_level", zero).alias("max_level"),
    )


def built(messages: DataFrame) -> DataFrame:
    """The conversations in reading order: messages of ``format_conversations`` sorted over all partitions."""
    return messages.orderBy("conv_id", "root_turn", "place")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), o AS (
  SELECT *, CASE WHEN regexp_matches(t, '(?m)^[ \t]*>') THEN regexp_replace(regexp_replace(array_to_string(list_filter(
      string_split(regexp_replace(t, '(?m)^On [^\n]* wrote:[ \t\r]*\n((?:[ \t]*\n)*[ \t]*>)', '\1', 'g'), chr(10)),
      lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g') ELSE t END AS own FROM m
), x AS (
  SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM m WHERE regexp_matches(t, '(?m)^[ \t]*>')
), l AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS lvl,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[ \t]*>)+', '')), '\s+', ' ', 'g')) AS words FROM x
), s AS (
  SELECT *, lvl <> lag(lvl, 1, 0) OVER w OR words = '' OR lag(words, 1, '') OVER w = '' AS starts FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)
), p AS (
  SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY place) AS passage FROM s
), u AS (
  SELECT conv_id, turn, passage, lvl, string_agg(words, ' ' ORDER BY place) AS words FROM p WHERE lvl > 0 AND words <> '' GROUP BY conv_id, turn, passage, lvl
), q AS (
  SELECT *, true AS run FROM u
  UNION ALL SELECT conv_id, turn, passage, lvl, words, false FROM p WHERE lvl > 0 AND words <> ''
  UNION ALL SELECT conv_id, turn, passage, lvl, unnest(string_split(regexp_replace(words, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))), false FROM u
), wr AS (
  SELECT conv_id, turn, unnest(list_concat([own], string_split_regex(own, '\n[ \t]*\n'), string_split(own, chr(10)))) AS part FROM o
  UNION ALL SELECT conv_id, turn, unnest(string_split(regexp_replace(trim(regexp_replace(lower(part), '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))
  FROM (SELECT conv_id, turn, unnest(string_split_regex(own, '\n[ \t]*\n')) AS part FROM o)
), wn AS (
  SELECT conv_id, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS words, min(turn) AS first_turn FROM wr GROUP BY ALL
), h AS (
  SELECT q.*, len(string_split(q.words, ' ')) AS n_words, CASE WHEN first_turn < turn THEN first_turn END AS first_turn
  FROM q LEFT JOIN wn ON wn.conv_id = q.conv_id AND wn.words = q.words AND wn.words <> ''
), g AS (
  SELECT conv_id, turn, passage, lvl, max(CASE WHEN first_turn IS NOT NULL THEN {'a': run, 'b': n_words, 'c': -first_turn} END) AS best FROM h GROUP BY ALL
), k AS (
  SELECT conv_id, turn, max(CASE WHEN best IS NOT NULL THEN {'a': -lvl, 'b': best.b, 'c': -best.c} END).c AS reply_to,
         count(*) AS n_quotes, count(best) AS n_linked, max(lvl) AS max_level FROM g GROUP BY ALL
), e AS (SELECT conv_id, turn, reply_to FROM k WHERE reply_to IS NOT NULL
), t AS (
  SELECT DISTINCT conv_id, reply_to AS turn, reply_to AS root_turn, [reply_to] AS path FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.conv_id = e.conv_id AND f.turn = e.reply_to)
  UNION ALL SELECT e.conv_id, e.turn, t.root_turn, list_append(t.path, e.turn) FROM t JOIN e ON e.conv_id = t.conv_id AND e.reply_to = t.turn
), y AS (SELECT conv_id, turn, root_turn, row_number() OVER (PARTITION BY conv_id, root_turn ORDER BY path) - 1 AS place FROM t)
SELECT o.conv_id, o.turn, role, own AS text, reply_to, coalesce(root_turn, o.turn) AS root_turn, coalesce(place, 0) AS place, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level
FROM o LEFT JOIN k ON k.conv_id = o.conv_id AND k.turn = o.turn LEFT JOIN y ON y.conv_id = o.conv_id AND y.turn = o.turn
"""
