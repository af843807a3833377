"""Scoring by prediction by partial matching over bytes, beside a unigram base line.

A context trie of bytes (contexts of up to ``ORDER`` bytes) is trained on the texts outside the held-out fold: counts of
every (context, next byte) are gathered over all of them. A byte is coded in the longest context that training has seen;
where it is new there, an escape (method C: as likely as the context has distinct bytes) leads to the next shorter one,
and bytes of the longer context are excluded from the shorter one's counts. Since the bytes of a context are among those
of its suffix, all that exclusion needs is two numbers for each context, so whole batches are scored by table look-ups.

A trie of at most ``SHARD_GRAMS`` entries goes to the workers whole. A larger one is dealt into shards by the last two bytes
of the context (by the last three where two have too many entries), and scoring takes the same two passes over the texts
however many shards there are: the first asks, for every block of documents, each shard for the block's distinct grams; the
shards answer, one at a time in a worker; the second looks the answers up. So no worker holds more than one bounded shard or
one block. Blocks are rows of a file by their numbers, so they are the same in both passes, whatever the splits.

The base line's common words are looked up in a bounded broadcast table; the others, which by then are rare, are joined
with the counts by the word.

Texts are taken with A-Z in lower case; an end symbol closes each. Defined cases: a null or empty text is the end symbol
alone; texts of any length are scored whole; repeated rows are scored each; a row without a doc_id is not learned from and
counts as held out; with no training text every byte costs the same; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, checked, filesystem, located, map_rows, read_columns, resident, save, table, text_or_empty

ORDER = 5  # a gram takes six bytes, which leaves two of a 64-bit number for the text
START, END = 0xFE, 0xFF  # bytes that no text in UTF-8 has
SYMBOLS = 255  # 256 bytes less the start mark; the end mark is one of them
SHARD_GRAMS = 3_000_000
COMMON_WORDS = 250_000
#: Documents of a block.
BLOCK_ROWS = 2_000
#: Bytes that are turned into numbers at once, and entries that a counting task holds before it passes them on.
BLOCK = 1 << 19
HELD = 1_600_000
END_WORD = b""  # the end token; no word is empty


def fold(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def grams_of(texts: list[bytes], order: int = ORDER):
    """(gram, text number) of every position of the texts: the context's bytes and the byte, as one number."""
    import numpy as np

    pad = bytes([START]) * order
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\xff")), np.uint8).astype(np.uint64)
    gram = data[order:].copy()
    for back in range(1, order + 1):
        gram |= data[order - back : len(data) - back] << np.uint64(8 * back)
    sizes = np.array([len(t) + 1 for t in texts])
    number = np.repeat(np.arange(len(texts)), sizes + order)[order:]
    keep = np.ones(len(gram), bool)
    starts = np.cumsum(sizes + order)[:-1] - order  # where the pads of the following texts begin
    for back in range(order):
        keep[starts + back] = False
    return gram[keep], number[keep].astype(np.uint64)


def blocks(texts: list[bytes], most: int = BLOCK):
    """Slices of a list, each of about ``most`` bytes (one text at least)."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def count_grams(train: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts of ``train`` (column data), pre-aggregated in each task."""

    def work(batches):
        import numpy as np

        held: list = []

        def total():
            keys = np.concatenate([k for k, _ in held])
            at = np.argsort(keys, kind="stable")
            keys, n = keys[at], np.concatenate([n for _, n in held])[at]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        for batch in batches:
            batch["data"] = [x.lower() for x in batch["data"]]  # of bytes: A-Z alone
            for a, b in blocks(batch["data"]):
                held.append(np.unique(grams_of(batch["data"][a:b], order)[0], return_counts=True))
                if sum(len(k) for k, _ in held) > HELD:
                    held[:] = [total()]
                    if len(held[0][0]) > HELD // 2:
                        yield {"gram": held[0][0].astype(np.int64), "n": held[0][1]}
                        held.clear()
        if held:
            keys, n = total()
            yield {"gram": keys.astype(np.int64), "n": n}

    return map_rows(train.select("data"), "gram long, n long", work).groupBy("gram").agg(F.sum("n").alias("n"))


class Trie:
    """Sorted tables of one shard: for each order the (context, byte) keys with their counts, and for each context its
    total, its number of bytes, and both of its suffix without the bytes that the context has."""

    def __init__(self, grams, counts, low_grams, low_counts, order: int = ORDER, middle=None):
        """``low``: entries of contexts of up to one byte, of the whole trie. ``middle``: (grams, counts) of contexts of two
        bytes where the shard has only a part of theirs."""
        import numpy as np

        self.order = order
        self.levels = []
        for k in range(order + 1):
            keys, n = (low_grams, low_counts) if k < 2 else middle if k == 2 and middle is not None else (grams, counts)
            keys = keys.astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)
            keys, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(keys)) if len(keys) else np.zeros(0)
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(keys) else n
            distinct = np.diff(np.r_[first, len(keys)]).astype(float)
            if k and len(keys):
                lower = self.levels[k - 1]
                mask = np.uint64((1 << 8 * k) - 1)
                seen = lower["n"][np.searchsorted(lower["keys"], keys & mask)]
                at = np.searchsorted(lower["contexts"], contexts & (mask >> np.uint64(8)))
                rest_total = lower["total"][at] - np.add.reduceat(seen, first)
                rest_distinct = lower["distinct"][at] - distinct
            else:
                rest_total = rest_distinct = np.zeros(len(contexts))
            self.levels.append({"keys": keys, "n": n, "contexts": contexts, "total": total, "distinct": distinct, "rest_total": rest_total, "rest_distinct": rest_distinct})

    def log10(self, grams):
        """Of the last byte of each gram, given those before it."""
        import numpy as np

        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        rest_total = rest_distinct = np.full(len(grams), -1.0)  # below 0: no longer context was seen
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            if not len(todo) or not len(level["keys"]):
                continue
            key = grams[todo] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = key >> np.uint64(8)
            at = np.minimum(np.searchsorted(level["contexts"], context), len(level["contexts"]) - 1)
            known = level["contexts"][at] == context
            new = rest_total < 0
            total = np.where(new, level["total"][at], rest_total)
            distinct = np.where(new, level["distinct"][at], rest_distinct)
            place = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            found = known & (level["keys"][place] == key)
            out[todo[found]] += np.log10(level["n"][place[found]] / (total + distinct)[found])
            escaped = known & ~found & (distinct > 0)
            out[todo[escaped]] += np.log10(distinct[escaped] / (total + distinct)[escaped])
            left = ~found
            rest_total = np.where(known, level["rest_total"][at], rest_total)[left]
            rest_distinct = np.where(known, level["rest_distinct"][at], rest_distinct)[left]
            todo = todo[left]
        root = self.levels[0]["distinct"]
        out[todo] -= np.log10(SYMBOLS - (root[0] if len(root) else 0))
        return out


def deal(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of keys that hold at most ``most`` entries each (one key at least). ``sizes``: (key, entries)."""
    out, low, held = [], 0, 0
    for key, n in sorted(sizes):
        if held and held + n > most:
            out.append((low, key))
            low, held = key, 0
        held += n
    return [*out, (low, 1 << 24)]


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) with the end token, pre-aggregated in each task."""

    def work(batches):
        from collections import Counter

        held: Counter = Counter()
        for batch in batches:
            for data in batch["data"]:
                held.update(data.lower().split())
                held[END_WORD] += 1
                if len(held) > HELD // 3:
                    yield {"word": list(held.keys()), "n": list(held.values())}
                    held.clear()
        yield {"word": list(held.keys()), "n": list(held.values())}

    return map_rows(train.select("data"), "word binary, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def common_from(counts: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` words; a power of two."""
    power = F.floor(F.log2("n")).cast("int")
    by_power = sorted(((r["power"], r["words"]) for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    held, least = 0, 62
    for p, words in by_power:
        held += words
        if held > most:
            break
        least = p
    return 1 << least


def known_words(files: list[str], ends: int) -> dict[bytes, int]:
    """The common words' counts. The end token is always among them."""
    word, n = read_columns(files, "word", "n") if files else ([], [])
    return {w: int(c) for w, c in zip(word, n)} | {END_WORD: ends}


def trie_of(files: list[str], low, order: int, middle=None) -> Trie:
    """A shard's trie."""
    import numpy as np

    grams, n = read_columns(files, "gram", "n") if files else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Trie(grams, n, *low, order, middle)


def pack(numbers) -> bytes:
    import zstandard

    return zstandard.compress(numbers.tobytes(), 1)


def unpack(data: bytes, kind):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.decompress(data), kind)


class Answers:
    """The answered grams of a block, read from the saved answers: files by the blocks that they hold."""

    def __init__(self, files: list[tuple[str, str, str]]):
        self.files, self.block = files, None

    def of(self, block: str):
        """(grams in ascending order, their log10)"""
        import numpy as np
        import pyarrow.parquet as pq

        if block != self.block:
            grams, logs = [np.zeros(0, np.uint64)], [np.zeros(0)]
            for file, first, last in self.files:
                if first <= block <= last:
                    fs, path = filesystem(file)
                    found = pq.read_table(path, filesystem=fs, columns=["grams", "logs"], filters=[("block", "==", block)], partitioning=None)
                    grams += [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in found.column("grams").to_pylist()]
                    logs += [unpack(x, np.float64) for x in found.column("logs").to_pylist()]
            held, at = np.unique(np.concatenate(grams), return_index=True)
            self.block, self.held, self.logs = block, held, np.concatenate(logs)[at]
        return self.held, self.logs


def distinct_grams(texts: list[bytes], order: int):
    """Ascending distinct grams of texts, a bounded number of bytes at a time."""
    import numpy as np

    found = np.zeros(0, np.uint64)
    for a, b in blocks(texts):
        found = np.union1d(found, grams_of(texts[a:b], order)[0])
    return found


def scores_of(texts: list[bytes], order: int, log10):
    """The sum of ``log10`` (of ascending distinct grams) over the grams of each text."""
    import numpy as np

    scores = np.zeros(len(texts))
    for a, b in blocks(texts):
        for c in range(a, b, 1 << 16):
            some = texts[c : min(b, c + (1 << 16))]
            gram, text = grams_of(some, order)
            both = np.sort(gram << np.uint64(16) | text)
            gram, text = both >> np.uint64(16), both & np.uint64(0xFFFF)
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            each = np.repeat(log10(gram[first]), np.diff(np.r_[first, len(gram)]))
            scores[c : c + len(some)] += np.bincount(text.astype(np.int64), weights=each, minlength=len(some))
    return scores


def asked(rows: DataFrame, grams: DataFrame, low, order: int, shard_grams: int) -> list[tuple[str, str, str]]:
    """Let the shards answer for the grams of all blocks of ``rows`` (block, data): the files of the saved answers, with the
    first and last block of each."""
    import numpy as np

    # Of a context its last byte is the highest here, so ranges of three bytes hold whole ranges of two.
    key = F.expr("shiftleft(shiftright(gram, 8) & 255, 16) + shiftleft(shiftright(gram, 16) & 255, 8) + (shiftright(gram, 24) & 255)").cast("int")
    sizes = save(grams.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")), "ppm-sizes")
    pairs = {r["pair"]: r["n"] for r in sizes.groupBy(F.shiftright("key", 8).alias("pair")).agg(F.sum("n").alias("n")).collect()}  # 65,536 rows at most
    large = sorted(p for p, n in pairs.items() if n > shard_grams)  # fewer than entries / shard_grams
    parts = sizes.where(F.shiftright("key", 8).isin(large)).collect() if large else []  # 256 rows of each
    bounds = deal([(p << 8, n) for p, n in pairs.items() if n <= shard_grams] + [(r["key"], r["n"]) for r in parts], shard_grams)
    starts = np.array([a for a, _ in bounds])
    # A pair whose entries lie in several shards: they all need its own counts, of contexts of two bytes.
    middle = grams.where(F.shiftright(key, 8).isin(large)).groupBy((F.col("gram").bitwiseAND(0xFFFFFF)).alias("gram")).agg(F.sum("n").alias("n")).collect() if large else []  # 256 rows of each
    middle = np.array([r["gram"] for r in middle], np.int64), np.array([r["n"] for r in middle], np.int64)

    shard = F.size(F.filter(F.array(*[F.lit(int(a)) for a in starts]), lambda a: a <= F.col("key"))) - 1
    by_key = checked(save(sizes.select("key", shard.alias("shard")), "ppm-keys"))
    dealt = grams.withColumn("key", key).join(by_key, "key").select("gram", "n", "shard")
    files: dict[int, list[str]] = {}
    for f in save(dealt.repartition(len(bounds), "shard"), "ppm-shards", by="shard").inputFiles():
        files.setdefault(int(f.split("/shard=")[1].split("/")[0]), []).append(f)

    def ask(batches):
        def request(block, texts):
            found = distinct_grams(texts, order)
            key = ((found >> np.uint64(8)) & np.uint64(255)) << np.uint64(16) | ((found >> np.uint64(16)) & np.uint64(255)) << np.uint64(8) | (found >> np.uint64(24)) & np.uint64(255)
            shard = np.searchsorted(starts, key.astype(np.int64), side="right") - 1
            out = {"shard": np.unique(shard).tolist()}
            out["block"] = [block] * len(out["shard"])
            out["grams"] = [pack(np.diff(found[shard == i], prepend=np.uint64(0))) for i in out["shard"]]
            return out

        block, texts = None, []
        for batch in batches:
            for name, data in zip(batch["block"], batch["data"]):
                if name != block and texts:
                    yield request(block, texts)
                    texts = []
                block = name
                texts.append(data.lower())
        if texts:
            yield request(block, texts)

    def answer(batches):
        for batch in batches:
            logs = []
            for shard, data in zip(batch["shard"], batch["grams"]):
                own = files.get(shard, [])
                split = [p for p in large if bounds[shard][0] >> 8 <= p <= (bounds[shard][1] - 1) >> 8]
                held = np.isin(((middle[0] >> 8) & 255) << 8 | (middle[0] >> 16) & 255, split)

                def made(own=own, held=held, split=split):
                    if not split:
                        return trie_of(own, low, order)
                    # Besides the split pairs a shard may hold whole ones.
                    grams, n = read_columns(own, "gram", "n") if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    whole = ~np.isin(((grams >> 8) & 255) << 8 | (grams >> 16) & 255, split)
                    return Trie(grams, n, *low, order, (np.r_[grams[whole], middle[0][held]], np.r_[n[whole], middle[1][held]]))

                model = resident(("ppm-shard", shard, *own), made)
                logs.append(pack(model.log10(np.cumsum(unpack(data, np.uint64), dtype=np.uint64))))
            yield {"block": batch["block"], "grams": batch["grams"], "logs": logs}

    requests = map_rows(rows.select("block", "data"), "shard int, block string, grams binary", ask)
    # Some hundred blocks of a shard in a partition, shard after shard; a worker reads them one by one.
    chunk = F.pmod(F.xxhash64("block"), F.lit(max(8, rows.count() // (64 * BLOCK_ROWS))))
    laid = requests.repartition("shard", chunk).sortWithinPartitions("shard")
    answers = map_rows(laid, "block string, grams binary, logs binary", answer, keeps=True)
    answers = save(answers.repartitionByRange("block").sortWithinPartitions("block"), "ppm-answers", options={"parquet.block.size": str(8 << 20)})
    spans = answers.groupBy(F.input_file_name().alias("file")).agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    return sorted((r["file"], r["lo"], r["hi"]) for r in spans.collect())  # a row for each file


def score(
    docs: DataFrame, held_out: Column, order: int = ORDER, shard_grams: int = SHARD_GRAMS, common_words: int = COMMON_WORDS
) -> DataFrame:
    """Train on the rows outside ``held_out``, score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 1 <= order <= 5:
        raise ValueError("order must be 1 to 5")
    with Scratch() as scratch:
        rows = located(docs).select(
            "doc_id", F.coalesce(held_out, F.lit(True)).alias("held_out"), text_or_empty().cast("binary").alias("data"),
            F.concat_ws("#", "file", F.expr(f"at div {BLOCK_ROWS}")).alias("block"),
        )
        train = rows.where("not held_out")

        grams = save(count_grams(train, order), "ppm-grams")
        # The driver sees counts and 65,536 pairs of bytes at most; workers read their shard from the shared folder.
        low = grams.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toPandas()  # 65,536 rows at most
        low = low["gram"].to_numpy(), low["n"].to_numpy()
        whole = order < 2 or grams.count() <= shard_grams
        files = grams.inputFiles() if whole else []
        answers = [] if whole else asked(rows, grams, low, order, shard_grams)

        counts = save(count_words(train), "lm-words")
        stats = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
        tokens, distinct = int(stats["n"] or 0), int(stats["v"])
        least = common_from(counts, common_words)
        common = save(counts.where((F.col("n") >= least) & (F.octet_length("word") > 0)).coalesce(1), "lm-common").inputFiles()  # ``common_words`` rows at most
        ends = counts.where(F.octet_length("word") == 0).first()
        ends = int(ends["n"]) if ends else 0
        floor = tokens + distinct + 1

        def rate(batches):
            import math
            from collections import Counter
            from itertools import groupby

            import numpy as np

            model, known = resident(("lm", *files, *common), lambda: (trie_of(files, low, order) if whole else None, known_words(common, ends)))
            answered, logs = Answers(answers), {}

            def looked_up(block):
                held, values = answered.of(block)

                def log10(grams):
                    at = np.minimum(np.searchsorted(held, grams), len(held) - 1)
                    if not np.array_equal(held[at], grams):
                        raise ValueError(f"block {block} has grams that nobody asked for")
                    return values[at]

                return log10

            for batch in batches:
                data = [x.lower() for x in batch["data"]]
                if whole:
                    scores = scores_of(data, order, model.log10)
                else:
                    runs = [(block, [i for i, _ in run]) for block, run in groupby(enumerate(batch["block"]), lambda x: x[1])]
                    scores = np.concatenate([scores_of([data[i] for i in at], order, looked_up(block)) for block, at in runs])
                out = {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores}
                out |= {k: [] for k in ("n_tokens", "n_known", "base", "rare", "times")}
                for text in data:
                    found = Counter(text.split())
                    found[END_WORD] += 1
                    base, n_known, rare = 0.0, 0, {}
                    for word, times in found.items():
                        c = known.get(word)
                        if c is None:
                            rare[word] = times
                            continue
                        value = logs.get(c)
                        if value is None:
                            value = logs[c] = math.log10((c + 1) / floor)
                        base += times * value
                        n_known += times if c else 0
                    out["n_tokens"].append(sum(found.values()))
                    out["n_known"].append(n_known)
                    out["base"].append(base)
                    out["rare"].append(list(rare))
                    out["times"].append(list(rare.values()))
                yield out

        schema = "doc_id long, held_out boolean, score double, n_tokens long, n_known long, base double, rare array<binary>, times array<long>"
        scored = map_rows(rows.select("doc_id", "held_out", "data", "block"), schema, rate, keeps=True)
        first = save(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
        scratch.keep(counts, first)
    total = first.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score")
    # Words that are not common: at most ``least`` of each in training, so no key of this join is hot.
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    rare = rare.join(counts.where((F.col("n") < least) & (F.octet_length("word") > 0)), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(floor)))).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    return total.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score",
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)
