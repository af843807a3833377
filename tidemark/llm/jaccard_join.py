"""Similarity join of documents on word shingles: exact Jaccard components by T-occurrence search.

1. Rows of the same text are one class, named by the digest of the text; one row of it goes on.
2. A document can only link if enough of its shingles occur elsewhere. Shingles are gathered by hash range, as packed
   arrays pre-aggregated for a block of documents; each document gets back how many of its own another one has, and
   those below the least possible overlap are done.
3. Survivors of equal shingle sets become one node. The same exchange among the nodes tells each shingle's number of
   nodes; that sorts a set's shingles, the rarest first, and sets aside those that nobody else has (only their number
   counts from here on). Two linked nodes share a shingle of their prefixes, the rarest so many that the overlap cannot
   do without all of them. Nodes that share one are candidates, and candidates form components.
4. In a component a T-occurrence search finds the links (DivideSkip): a query's short inverted lists are merged by a heap,
   the long ones are only probed by binary search for the nodes that the short ones left, with the overlap that the two
   sizes need. A component beyond one task is dealt into blocks that also hold some of its nodes as pivots; what is then
   still apart from its main group is searched against every block that its size can link with.

Links inside a component are united where they are found: a group of thousands of near copies costs a row each.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer words
than a shingle is one shingle; texts of any length are read whole; repeated rows share the result of their text; a row
without a doc_id takes part like any other, but names a component only by the ids of others (component_id is null where
nothing in it has an id); rows of one doc_id with different texts are different documents; an empty table gives an empty
result; other columns are ignored. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, checked, fits, importable, map_rows, save, stay, table, text_or_empty, worker_done, worker_setup
from tidemark.llm.components import components

#: Shingles of a block of documents, and of a hash range; documents of a block.
BLOCK_SHINGLES = 800_000
RANGE_SHINGLES = 1_000_000
BLOCK_DOCS = 60_000
#: Shingles that one search holds, and nodes that each block of a larger component also gets as pivots.
SEARCH_SHINGLES = 1_000_000
PIVOTS = 16
#: Weight of the longest list in the number of long ones that DivideSkip sets apart.
MU = 0.01
#: What a row is to a search: one of the nodes to link with each other, or a side of a crosswise search.
WITHIN, BLOCK, APART = 0, 1, 2


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(data: bytes, k: int, hashes: WordHashes):
    """Distinct shingles of a text in UTF-8, as sorted 64-bit hashes."""
    import numpy as np

    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ w[i : n - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def need(percent: int, n):
    """Least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def digest_of() -> Column:
    return F.unhex(F.sha2(text_or_empty().cast("binary"), 256))


def in_ranges(h, ranges: int):
    """Bounds of the hash ranges in the sorted hashes ``h``."""
    import numpy as np

    step = (1 << 64) // ranges + 1
    return np.r_[np.searchsorted(h, np.array([min(i * step, (1 << 64) - 1) for i in range(ranges)], np.uint64)), len(h)]


def block_name(made: int) -> int:
    """The same number for the same block when a task runs again."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + made


def grouped(df: DataFrame, by: str, work, schema: str) -> DataFrame:
    """``work(frame)`` for each value of ``by``, in workers that keep nothing from one task to the next."""

    def run(frame):
        worker_setup()
        try:
            return work(frame)
        finally:
            worker_done()

    importable(df.sparkSession)
    return df.groupBy(by).applyInPandas(run, schema)


def support(docs: DataFrame, k: int, ranges: int) -> DataFrame:
    """(digest, n, shared): a document's number of shingles, and of those that another document has too (never too few)."""
    import numpy as np

    sent = "part long, block long, shingle binary, doc binary, keys binary"

    def gather(batches):
        hashes, made = WordHashes(), 0
        keys, sets, held = [], [], 0

        def block():
            nonlocal made
            made += 1
            name = block_name(made)
            sizes = np.array([len(s) for s in sets])
            h, d = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            at = np.argsort(h, kind="stable")
            h, d = h[at], d[at]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[first, len(h)])
            # Shared within the block: counted here. 65535 marks that no count needs to come back.
            here = np.bincount(d[np.repeat(times > 1, times)], minlength=len(sets))
            one = np.where(times > 1, 65535, d[first]).astype(np.uint16)
            h = h[first]
            out = {"part": [-1 - name % ranges], "block": [name], "shingle": [sizes.astype(np.int64).tobytes()], "doc": [here.astype(np.int64).tobytes()], "keys": [b"".join(keys)]}
            bounds = in_ranges(h, ranges)
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[r], bounds[r + 1]
                out["part"].append(r)
                out["block"].append(name)
                out["shingle"].append((h[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                out["doc"].append(one[a:b].tobytes())
                out["keys"].append(None)
            keys.clear()
            sets.clear()
            return out

        for batch in batches:
            for key, data in zip(batch["digest"], batch["data"]):
                keys.append(key)
                sets.append(shingles(data, k, hashes))
                held += len(sets[-1])
                if held >= BLOCK_SHINGLES or len(keys) >= BLOCK_DOCS:
                    yield block()
                    held = 0
        if keys:
            yield block()

    def count(frame):
        import pandas as pd

        if frame["part"].iat[0] < 0:  # blocks' own figures
            return frame.drop(columns="part")
        parts = [np.frombuffer(x, np.uint32) for x in frame["shingle"]]
        h = np.concatenate(parts)
        at = np.argsort(h, kind="stable")
        same = h[at][1:] == h[at][:-1]
        shared = np.zeros(len(h), bool)
        shared[at[1:][same]] = True
        shared[at[:-1][same]] = True
        rows, a = [], 0
        for block, doc, p in zip(frame["block"], frame["doc"], parts):
            d = np.frombuffer(doc, np.uint16)[shared[a : a + len(p)]]
            a += len(p)
            d, n = np.unique(d[d != 65535], return_counts=True)
            if len(d):
                rows.append((block, d.astype(np.uint16).tobytes(), n.astype(np.int32).tobytes(), None))
        return pd.DataFrame(rows, columns=["block", "shingle", "doc", "keys"])

    def add(frame):
        import pandas as pd

        own = frame[frame["keys"].notna()].iloc[0]
        shared = np.frombuffer(own["doc"], np.int64).copy()
        for d, n in frame.loc[frame["keys"].isna(), ["shingle", "doc"]].itertuples(index=False):
            shared[np.frombuffer(d, np.uint16)] += np.frombuffer(n, np.int32)
        keys = own["keys"]
        return pd.DataFrame({"digest": [keys[i : i + 32] for i in range(0, len(keys), 32)], "n": np.frombuffer(own["shingle"], np.int64), "shared": shared})

    counts = grouped(map_rows(docs, sent, gather), "part", count, "block long, shingle binary, doc binary, keys binary")
    return grouped(counts, "block", add, "digest binary, n long, shared long")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(digest, n, set_key, shingles): shingles as an array of signed 64-bit numbers, and a digest of them."""

    def work(batches):
        import hashlib

        import numpy as np

        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(x, k, hashes) for x in batch.pop("data")]
            yield batch | {"n": [len(s) for s in sets], "set_key": [hashlib.sha256(s.tobytes()).digest() for s in sets], "shingles": [s.view(np.int64) for s in sets]}

    return map_rows(docs, "digest binary, n long, set_key binary, shingles array<long>", work)


def ordered_sets(sets: DataFrame, ranges: int, percent: int) -> DataFrame:
    """(node, n, head, m, shingles) of the nodes that can link: their m shingles that others have too, the rarest first
    (all nodes sort by the same order), of which the first ``head`` are the prefix."""
    import numpy as np

    def gather(batches):
        made, nodes, sizes, held_sets, held = 0, [], [], [], 0

        def block():
            nonlocal made
            made += 1
            name = block_name(made)
            lengths = np.array([len(s) for s in held_sets])
            h, d = np.concatenate(held_sets).view(np.uint64), np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)
            at = np.argsort(h, kind="stable")
            h, d = h[at], d[at]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            times = np.diff(np.r_[first, len(h)])
            own = np.array([nodes, sizes], np.int64)
            out = {"part": [-1 - name % ranges], "block": [name], "first": [h.tobytes()], "second": [d.tobytes()], "own": [own.tobytes()]}
            bounds, names = in_ranges(h[first], ranges), h[first]
            for r in np.flatnonzero(np.diff(bounds)).tolist():
                a, b = bounds[r], bounds[r + 1]
                out["part"].append(r)
                out["block"].append(name)
                out["first"].append(names[a:b].tobytes())
                out["second"].append(np.minimum(times[a:b], 65535).astype(np.uint16).tobytes())
                out["own"].append(None)
            nodes.clear()
            sizes.clear()
            held_sets.clear()
            return out

        for batch in batches:
            for node, n, s in zip(batch["node"], batch["n"], batch["shingles"]):
                nodes.append(node)
                sizes.append(n)
                held_sets.append(np.asarray(s, np.int64))
                held += n
                if held >= BLOCK_SHINGLES or len(nodes) >= BLOCK_DOCS:
                    yield block()
                    held = 0
        if nodes:
            yield block()

    def count(frame):
        import pandas as pd

        if frame["part"].iat[0] < 0:  # blocks' own figures
            return frame
        parts = [np.frombuffer(x, np.uint64) for x in frame["first"]]
        h, where = np.unique(np.concatenate(parts), return_inverse=True)
        times = np.bincount(where, weights=np.concatenate([np.frombuffer(x, np.uint16) for x in frame["second"]]))
        times = np.minimum(times, (1 << 32) - 1).astype(np.uint32)[where]
        ends = np.cumsum([len(p) for p in parts])
        replies = [times[b - len(p) : b].tobytes() for p, b in zip(parts, ends)]
        return pd.DataFrame({"part": frame["part"], "block": frame["block"], "first": None, "second": replies, "own": None})

    def order(frame):
        import pandas as pd

        mine = frame[frame["own"].notna()].iloc[0]
        replies = frame[frame["own"].isna()].sort_values("part")["second"]
        nodes, sizes = np.frombuffer(mine["own"], np.int64).reshape(2, -1)
        h, d = np.frombuffer(mine["first"], np.uint64), np.frombuffer(mine["second"], np.uint16)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        often = np.repeat(np.concatenate([np.frombuffer(x, np.uint32) for x in replies]), np.diff(np.r_[first, len(h)]))
        some = often > 1
        h, d, often = h[some], d[some], often[some]
        at = np.lexsort((h, often, d))
        h, d = h[at].view(np.int64), d[at]
        ends = np.searchsorted(d, np.arange(len(nodes)), side="right")
        starts = np.r_[0, ends[:-1]]
        rows = []
        for node, n, a, b in zip(nodes.tolist(), sizes.tolist(), starts.tolist(), ends.tolist()):
            spare = b - a - need(percent, n)  # shingles that the least overlap can do without
            if spare >= 0:
                rows.append((node, n, spare + 1, b - a, h[a:b]))
        return pd.DataFrame(rows, columns=["node", "n", "head", "m", "shingles"])

    sent = "part long, block long, first binary, second binary, own binary"
    counts = grouped(map_rows(sets, sent, gather), "part", count, sent)
    return grouped(counts, "block", order, "node long, n long, head long, m long, shingles array<long>")


def heap_merge(lists) -> dict[int, int]:
    """How many of the sorted lists hold each number."""
    import heapq

    found: dict[int, int] = {}
    last, times = -1, 0
    for x in heapq.merge(*lists):
        if x == last:
            times += 1
        else:
            found[last] = times
            last, times = x, 1
    found[last] = times
    found.pop(-1)
    return found


def search(sets, sizes, percent: int, others=None, other_sizes=None):
    """Links among sets (sorted arrays): yields positions (a, b) of linked sets that are not yet united. With ``others``,
    links between one of ``sets`` and one of ``others`` only, whose positions go on behind those of ``sets``. ``sizes`` are
    those of the whole sets; shingles that no two sets share may be missing from the arrays.

    A T-occurrence search for every set (DivideSkip): of its inverted lists the longest are set apart, fewer than the least
    overlap T; the others are merged by a heap, and those that stay in the running are probed for in the long lists."""
    import math

    import numpy as np

    held = sets if others is None else others
    shift, n = (0, len(sets)) if others is None else (len(sets), len(others))
    far = np.asarray(sizes if others is None else other_sizes)
    tokens, docs = np.concatenate(held), np.repeat(np.arange(n), [len(s) for s in held])
    at = np.argsort(tokens, kind="stable")  # postings of a list stay in order of the sets
    tokens, docs = tokens[at], docs[at]
    if not len(tokens):
        return
    start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    names, stops = tokens[start], np.r_[start[1:], len(tokens)]
    keys = np.repeat(np.arange(len(start)), stops - start) * n + docs  # ascending: a list and a set in it, as one number
    root = list(range(shift + n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, s in enumerate(sets):
        if not len(s):
            continue
        size = int(sizes[q])
        own = np.minimum(np.searchsorted(names, s), len(names) - 1)
        own = own[names[own] == s]
        begin, stop = start[own], stops[own]
        if others is None:  # only sets behind the query
            begin = np.searchsorted(keys, own * n + q, side="right")
        some = stop > begin
        own, begin, stop = own[some], begin[some], stop[some]
        least = need(percent, size)
        if len(own) < least:
            continue
        order = np.argsort(stop - begin, kind="stable")
        longest = int((stop - begin).max())
        apart = min(least - 1, int(least / (MU * math.log2(longest + 1) + 1)))
        short, long = order[: len(order) - apart], order[len(order) - apart :]
        merged = heap_merge([docs[a:b].tolist() for a, b in zip(begin[short], stop[short])])
        mine = find(q)
        hits = [x for x, c in merged.items() if c >= least - apart and find(x + shift) != mine]
        if not hits:
            continue
        hits, count = np.array(hits), np.array([merged[x] for x in hits])
        required = -(-percent * (size + far[hits]) // (100 + percent))
        keep = count + apart >= required
        hits, required, count = hits[keep], required[keep], count[keep]
        # Some at a time: many hits times many lists would not be a small table.
        for i in range(0, len(hits), 1_000):
            some, total = hits[i : i + 1_000], count[i : i + 1_000]
            if apart:
                wanted = (own[long][:, None] * n + some[None, :]).ravel()
                spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                total = total + (keys[spot] == wanted).reshape(apart, len(some)).sum(axis=0)
            for x in some[total >= required[i : i + 1_000]]:
                a, b = find(q), find(int(x) + shift)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    yield q, int(x) + shift


def links_of(frame, percent: int) -> list[tuple[int, int]]:
    """(a, b) nodes that link, of those that one search holds; ``side`` tells the two that are searched
    crosswise."""
    import numpy as np

    frame = frame.drop_duplicates(["node", "side"])
    sides = [g for _, g in frame.groupby("side")]
    parts = [([int(x) for x in g["node"]], [np.asarray(x, np.int64) for x in g["shingles"]], g["n"].to_numpy()) for g in sides]
    if len(parts) == 1:
        names, sets, sizes = parts[0]
        return [(names[a], names[b]) for a, b in search(sets, sizes, percent)] if frame["side"].iat[0] == WITHIN else []
    (block, block_sets, block_sizes), (names, sets, sizes) = parts
    all_ = names + block
    return [(all_[a], all_[b]) for a, b in search(sets, sizes, percent, block_sets, block_sizes)]


def link(sets: DataFrame, candidates: DataFrame, percent: int, most: int, pivots: int) -> DataFrame:
    """(id, component) of all nodes that link with another one. ``candidates``: (id, component); ``most``: shingles that
    one search may hold."""
    import math

    import pandas as pd

    sized = candidates.select(F.col("id").alias("node"), F.col("component").alias("comp")).join(sets.select("node", "n", "m"), "node")
    sized = save(sized, "join-sized")
    loads = checked(save(sized.groupBy("comp").agg(F.sum("m").alias("load"), F.count(F.lit(1)).alias("docs")), "join-loads"))
    blocks = F.ceil(F.col("load") / most).cast("long")
    placed = save(sized.join(loads, "comp").withColumn("blocks", blocks).drop("load"), "join-placed")
    groups = max(16, 2 * (placed.agg(F.sum("m")).first()[0] or 0) // most)
    texts = sets.select("node", "n", "shingles")
    rows = texts.join(checked(placed.drop("n", "m")), "node")

    def solve(frame):
        found = []
        for _, part in frame.groupby("group", sort=False):
            if len(part) > 1:
                found += links_of(part, percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    def dealt(df: DataFrame, task: Column, group: Column, side: int) -> DataFrame:
        return df.select(task.alias("task"), group.alias("group"), "node", "n", F.lit(side).alias("side"), "shingles")

    # Small components: many in a task. Large ones: a block a task, with the pivots of the component.
    whole = dealt(rows.where("blocks = 1"), F.pmod(F.xxhash64("comp"), F.lit(groups)), F.col("comp").cast("string"), WITHIN)
    big = save(placed.where("blocks > 1"), "join-big")
    if big.isEmpty():
        return components(save(grouped(whole, "task", solve, "a long, b long"), "join-edges"))
    large = rows.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # Pivots: about ``pivots`` nodes of each component, by a threshold that its size sets.
    copies = large.where(F.pmod(F.xxhash64("node", F.lit(7)), F.col("docs")) < pivots)
    copies = copies.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    name = F.concat_ws("-", F.lit("b"), "comp", "block")
    parts = dealt(large, F.xxhash64(name), name, WITHIN).unionByName(dealt(copies, F.xxhash64(name), name, WITHIN))
    edges = save(grouped(whole.unionByName(parts), "task", solve, "a long, b long"), "join-edges")

    # What the pivots did not unite. A link between two labels has an end outside the component's main label, and the other
    # end in the same or the next band of sizes.
    labels = checked(save(components(edges).withColumnRenamed("id", "node"), "join-labels"))
    width = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9
    marked = big.join(labels, "node", "left").select("node", "comp", "m", F.floor(F.log("n") / width).cast("long").alias("band"), F.coalesce("component", "node").alias("label"))
    marked = save(marked, "join-marked")
    main = marked.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    marked = save(marked.join(checked(save(main.where("labels > 1").drop("labels"), "join-main")), "comp"), "join-marked")
    apart = marked.where("label <> main")
    chunks = apart.groupBy("comp").agg(F.ceil(F.sum("m") / most).cast("long").alias("chunks"))
    bands = marked.groupBy("comp", "band").agg(F.ceil(F.sum("m") / most).cast("long").alias("blocks"))
    bands = checked(save(bands.join(chunks, "comp"), "join-bands"))
    block = marked.join(bands, ["comp", "band"]).select("node", "comp", "band", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    near = apart.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    near = near.join(bands, ["comp", "band"]).select("node", "comp", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).alias("chunk"))
    name = F.concat_ws("-", "comp", "band", "block", "chunk")
    cross = [dealt(texts.join(checked(save(x, "join-cross")), "node"), F.xxhash64(name), name, i) for i, x in ((BLOCK, block), (APART, near))]
    rest = save(grouped(cross[0].unionByName(cross[1]), "task", solve, "a long, b long"), "join-rest")
    return components(edges.unionByName(rest))


def document_classes(docs: DataFrame, k: int, percent: int, search_shingles: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Two saved tables: (doc_id, digest) of every row; and (digest, first_id, rows, n, component) of every text, where
    ``component`` is the number of the group it belongs to, null for a text that is alone."""
    with Scratch() as scratch:
        doc_id = F.col("doc_id").cast("long").alias("doc_id")
        prints = save(docs.select(doc_id, digest_of().alias("digest"), F.octet_length(text_or_empty()).cast("long").alias("bytes")), "join-prints")
        ranges = max(64, (prints.agg(F.sum("bytes")).first()[0] or 0) // 5 // RANGE_SHINGLES)
        classes = save(prints.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "join-classes")
        several = save(classes.where("rows > 1").select("digest", "first_id", F.lit(True).alias("known")), "join-several")
        texts = docs.select(doc_id, digest_of().alias("digest"), text_or_empty().cast("binary").alias("data"))
        # One row of each text (more where rows share an id as well: they only count for each other in the next step).
        ones = texts.join(checked(several), "digest", "left").where(F.col("known").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "data")
        if not fits(several):
            ones = save(ones, "join-ones")  # blocks go by the order of rows, which a shuffle does not repeat

        sizes = save(support(ones, k, ranges), "join-support")
        alive = sizes.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent)).select("digest").distinct()
        alive = checked(save(alive, "join-alive"))
        sets = save(shingle_sets(ones.join(alive, "digest", "left_semi"), k), "join-sets")
        nodes = sets.groupBy("set_key").agg(F.min("digest").alias("digest")).withColumn("node", F.monotonically_increasing_id())
        nodes = save(nodes, "join-nodes")
        names = nodes.select("digest", "node")
        reps = sets.join(checked(names), "digest").select("node", "n", "shingles")
        if not fits(names) or sets.count() > sets.select("digest").distinct().count():
            reps = save(reps.dropDuplicates(["node"]), "join-reps")
        reps = save(ordered_sets(reps, ranges, percent), "join-ordered")
        # A node's prefix; nodes that share one of its shingles hang on the smallest of them.
        heads = save(reps.select("node", F.explode(F.slice("shingles", F.lit(1), F.col("head").cast("int"))).alias("shingle")), "join-heads")
        firsts = heads.groupBy("shingle").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("shingle", "a")
        stars = save(heads.join(checked(save(firsts, "join-firsts")), "shingle").select("a", F.col("node").alias("b")).distinct(), "join-stars")
        linked = save(link(reps, save(components(stars), "join-candidates"), percent, search_shingles, pivots), "join-linked")

        named = sets.select("digest", "set_key").distinct().join(checked(nodes.select("set_key", "node")), "set_key")
        named = named.join(checked(linked.withColumnRenamed("id", "node")), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
        named = checked(save(named, "join-named"))
        own = sizes.groupBy("digest").agg(F.max("n").alias("n"))
        found = save(classes.join(own, "digest").join(named, "digest", "left"), "join-found")
        scratch.keep(prints, found)
    return prints, found


def join_components(docs: DataFrame, k: int = 5, percent: int = 80, search_shingles: int = SEARCH_SHINGLES, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that is reached by links."""
    with Scratch() as scratch:
        prints, classes = document_classes(docs, k, percent, search_shingles, pivots)
        result = save(named(classes), "join-result")
        scratch.keep(prints, result)
    # Texts of a single row that link with nothing are most of them, so this is joined by shuffling where it is large.
    rows = prints.join(checked(result), "digest")
    alone = F.col("n_shingles") == 0
    return rows.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("least", "first_id", "doc_id")).alias("component_id"))


def named(classes: DataFrame) -> DataFrame:
    """(digest, n_shingles, first_id, least): ``least`` is the smallest doc_id of the text's component, null without one."""
    firsts = checked(save(classes.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least")), "join-least"))
    return classes.join(firsts, "component", "left").select("digest", F.col("n").alias("n_shingles"), "first_id", "least")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the row with the smallest doc_id (one without
    an id only where none has one, then by the text's digest), and one row where that is repeated. A text without words
    links with nothing, so all rows of such texts stay."""
    with Scratch() as scratch:
        prints, classes = document_classes(docs, k, percent, SEARCH_SHINGLES, PIVOTS)
        classes = classes.where("n > 0")
        group = F.coalesce(F.col("component").cast("string"), F.hex("digest"))
        best = F.struct(F.col("first_id").isNull().alias("nameless"), F.col("first_id"), F.col("digest"))
        some = classes.where("component is not null or rows > 1").withColumn("group", group)
        kept = save(some.groupBy("group").agg(F.min(best).alias("best")).select(F.col("best.digest").alias("digest"), F.lit(True).alias("keep")), "join-kept")
        verdicts = some.join(checked(kept), "digest", "left").where("rows > 1 or keep is null")
        verdicts = save(verdicts.select(F.col("digest").alias("key"), F.coalesce("keep", F.lit(False)).alias("keep"), F.col("first_id").alias("doc_id"), F.lit(None).cast("long").alias("n_chars")), "join-verdicts")
        held = verdicts.where("keep").select(F.col("key").alias("digest"), F.col("doc_id").alias("first_id"))
        twins = prints.join(checked(held), "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("digest").count().where("count > 1")
        twins = save(twins.select(F.col("digest").alias("key")), "join-twins")
        scratch.keep(verdicts, twins)
    return stay(docs, digest_of(), verdicts, twins)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), k=4, percent=85)


#: Every pair that shares a shingle; for small tables only.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                                      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE reach.a = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
