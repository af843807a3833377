"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are runs of letters in lower case (words are split at what ASCII has beside letters before they are lowered), and all
terms of the labelled examples make the vocabulary: a term that no example
has adds to no dot product and scales all cosines of its text alike. Document frequencies are counted over all documents.
A term's inverse document frequency is weighted by how far it goes with the label among the examples: times one plus
``RELEVANCE`` times the size of the correlation (phi, 0 to 1, with Yates's correction) of its presence and the label. Phi
does not grow with the sample, and no term is left out; ``RELEVANCE`` 0 is plain TF-IDF.
The labelled examples lie in an inverted index in blocks of like texts. Lists of rare terms hold postings; lists of frequent
ones hold a weight for each example, with the largest of every block. A query adds up its rare terms, looks into the blocks
of the highest bounds, and then into those alone whose bound reaches the last neighbour found so far, so its neighbours are
exact. They vote, weighted by their distance; an isotonic curve over the sample's own votes (each example left out of its
own neighbours) turns votes into probabilities. Nearest are a thirtieth of the examples (of few examples a quarter, 32 at
most): labels are noisy, and a share keeps the vote alike at every size of the sample.

The classifier is fitted on at most ``SAMPLE`` labelled rows, drawn by a hash of the id; all else covers all rows.

Defined cases: a null or empty text, and one without a term of the examples, has no neighbours and gets the rate of such
examples; texts of any length are read whole; equal cosines go to the example drawn first; repeated rows are scored each;
where labels of one document differ, it is toxic; where texts of one labelled document differ, the smallest is the example;
a row without a doc_id is scored like any other and counts as held out, for nothing can be learned from it; without labels
every score is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, filter_rows, map_rows, read_columns, resident, save, table, text_or_empty

SAMPLE = 5_000
BLOCK = 128
#: A list is frequent that holds more than this share of the examples.
FREQUENT = 1 / 20
#: Queries that are searched together.
BATCH = 250
#: Vocabulary terms whose counts travel in one row.
CHUNK = 10_000
RELEVANCE = 30.0
#: Added to a distance before its inverse weighs the vote.
NEAR = 0.1
EVIDENCE = 5
#: Cosines are rounded to nine digits before they are ranked, so that the order of additions does not matter.
DIGITS = 9


def phi(toxic_with, clean_with, toxic: float, clean: float):
    """Size of the correlation of a term's presence and the label, by the examples with the term and all examples."""
    import numpy as np

    a, b, n = toxic_with, clean_with, toxic + clean
    apart = np.maximum(np.abs(a * (clean - b) - b * (toxic - a)) - n / 2, 0)
    under = (a + b) * (n - a - b) * toxic * clean
    return np.where(under > 0, apart / np.sqrt(np.where(under > 0, under, 1)), 0.0)


def neighbours(examples: int) -> int:
    return max(1, examples // 30, min(32, examples // 4))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


class Words:
    """Terms of texts, in UTF-8. What ASCII has beside letters separates words; a word with other characters goes through a
    pattern for letters, and is remembered for a while."""

    TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
    ODD = bytes(range(128))

    def __init__(self, most: int = 20_000):
        import re

        self.letters, self.most = re.compile(r"[^\W\d_]+").findall, most
        self.known: dict[bytes, tuple[bytes, ...]] = {}

    def split(self, word: bytes) -> tuple[bytes, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.most:
                self.known.clear()
            found = self.known[word] = tuple(x.encode() for x in self.letters(word.decode().lower()))
        return found

    def count(self, text: str) -> dict[bytes, int]:
        """How often each term occurs."""
        from collections import Counter

        found = Counter(text.encode().translate(self.TABLE).split())
        if not text.isascii():
            for word in [w for w in found if not w.isascii()]:
                times, terms = found[word], self.split(word)
                if terms != (word,):
                    del found[word]
                    for term in terms:
                        found[term] += times
        return found


def draw_examples(docs: DataFrame, labels: DataFrame, learn: Column, most: int = SAMPLE) -> DataFrame:
    """At most ``most`` labelled documents, saved: (doc_id, toxic, draw, words, times), ``draw`` being the hash they go by.
    Words are joined by blanks, times packed as 32-bit numbers."""
    import numpy as np

    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    one = one.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("draw", F.xxhash64("doc_id"))
    drawn = save(one.orderBy("draw", "doc_id").limit(most), "tox-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))

    def work(batches):
        words = Words()
        for batch in batches:
            found = [words.count(text) for text in batch.pop("text")]
            yield batch | {"words": [b" ".join(c) for c in found], "times": [np.array(list(c.values()), np.int32).tobytes() for c in found]}

    return save(map_rows(texts, "doc_id long, toxic int, draw long, words binary, times binary", work), "tox-examples")


class Examples:
    """The saved examples in the order they were drawn in, and the vocabulary: term to number, in the order of the terms."""

    def __init__(self, files: list[str]):
        import numpy as np

        doc_id, toxic, draw, words, times = read_columns(files, "doc_id", "toxic", "draw", "words", "times") if files else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((doc_id, draw))
        self.doc_ids = doc_id[order].tolist()
        self.toxic = (toxic[order] > 0).astype(float)
        known: dict[bytes, int] = {}
        found = [np.array([known.setdefault(w, len(known)) for w in words[i].split()], np.int64) for i in order]
        rank = np.empty(len(known), np.int64)
        for number, w in enumerate(sorted(known)):
            rank[known[w]], known[w] = number, number
        self.vocabulary, self.vectors = known, []
        for i, terms in zip(order, found):
            terms, at = rank[terms], np.argsort(rank[terms])
            self.vectors.append((terms[at], np.frombuffer(times[i], np.int32)[at].astype(float)))

    def vector(self, counts: dict[bytes, int]):
        """(terms, times) of the vocabulary's words among ``counts``, as arrays, by term."""
        import numpy as np

        number = self.vocabulary.get
        terms = np.array([number(w, -1) for w in counts], np.int64)
        times = np.fromiter(counts.values(), float, len(counts))
        at = np.argsort(terms)
        at = at[np.searchsorted(terms[at], 0) :]
        return terms[at], times[at]


def document_frequencies(docs: DataFrame, examples: list[str]) -> DataFrame:
    """Saved (chunk, counts): the number of documents with each term of the vocabulary, packed as 64-bit numbers for
    ``CHUNK`` terms a row; chunk -1 is the number of documents. A task sends a row for each chunk."""
    import numpy as np

    def work(batches):
        known = resident(("tox-words", *examples), lambda: Examples(examples).vocabulary)
        words, rows = Words(), 0
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            rows += len(batch["text"])
            seen: list[int] = []
            for text in batch["text"]:
                seen.extend(map(known.__getitem__, known.keys() & words.count(text).keys()))
            counts += np.bincount(seen, minlength=len(counts)) if seen else 0
        chunks = list(range(0, len(known), CHUNK))
        yield {"chunk": [-1, *(a // CHUNK for a in chunks)], "counts": [np.array([rows]).tobytes(), *(counts[a : a + CHUNK].tobytes() for a in chunks)]}

    def total(frame):
        import pandas as pd

        sums = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [sums.tobytes()]})

    sent = map_rows(docs.select(text_or_empty().alias("text")), "chunk long, counts binary", work, keeps=True)
    return save(sent.groupBy("chunk").applyInPandas(total, "chunk long, counts binary"), "tox-frequencies")


def spans(starts, sizes):
    """The numbers starts[i] to starts[i] + sizes[i], one range after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class BlockMaxIndex:
    """Examples (terms, times) by term; weights are of unit length for each example."""

    def __init__(self, examples: list, idf, block: int = BLOCK, frequent: float = FREQUENT):
        import numpy as np

        self.idf, self.block, self.size = idf, block, len(examples)
        self.blocks = -(-len(examples) // block)
        # Like texts lie side by side: examples go by the word they use most.
        most_used = [int(t[np.argmax(n)]) if len(t) else -1 for t, n in examples]
        self.number = np.argsort(np.array(most_used, np.int64), kind="stable")
        laid = [examples[i] for i in self.number]
        one = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        terms = one([t for t, _ in laid], np.int64)
        weights = one([self.weigh(t, n) for t, n in laid], float)
        ids = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in laid])
        lists = np.bincount(terms, minlength=len(idf))
        often = np.flatnonzero(lists > frequent * self.size)
        self.place = np.full(len(idf), -1, np.int64)
        self.place[often] = np.arange(len(often))
        row = self.place[terms]
        self.dense = np.zeros((len(often), self.blocks * block))
        self.dense[row[row >= 0], ids[row >= 0]] = weights[row >= 0]
        self.most = self.dense.reshape(len(often), self.blocks, block).max(axis=2) if self.dense.size else np.zeros((len(often), self.blocks))
        terms, ids, weights = terms[row < 0], ids[row < 0], weights[row < 0]
        at = np.argsort(terms, kind="stable")
        self.ids, self.weights = ids[at], weights[at]
        # Postings of a rare term t: starts[t] to starts[t + 1].
        self.starts = np.r_[0, np.cumsum(np.bincount(terms, minlength=len(idf)))].astype(np.int64)

    def weigh(self, terms, times):
        import numpy as np

        w = (1 + np.log(times)) * self.idf[terms]
        length = np.sqrt((w * w).sum())
        return w / length if length > 0 else w

    def nearest(self, queries: list, k: int):
        """For each (terms, times): the numbers and cosines of the ``k`` nearest examples, the nearest first; only examples
        whose cosine is above zero."""
        for i in range(0, len(queries), BATCH):
            yield from self.batch(queries[i : i + BATCH], k)

    def batch(self, queries: list, k: int):
        import numpy as np

        if not self.size:
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
            return
        width = self.blocks * self.block
        dots = np.zeros((len(queries), width))
        often = np.zeros((len(queries), len(self.dense)))
        for q, (terms, times) in enumerate(queries):
            weights = self.weigh(terms, times)
            place = self.place[terms]
            often[q, place[place >= 0]] = weights[place >= 0]
            terms, weights = terms[place < 0], weights[place < 0]
            sizes = self.starts[terms + 1] - self.starts[terms]
            part = spans(self.starts[terms], sizes)
            dots[q] = np.bincount(self.ids[part], weights=np.repeat(weights, sizes) * self.weights[part], minlength=width)
        by_block = dots.reshape(len(queries), self.blocks, self.block)
        bound = often @ self.most + by_block.max(axis=2)
        done = np.zeros(bound.shape, bool)

        def look(wanted):
            for b in np.flatnonzero(wanted.any(axis=0)):
                some = np.flatnonzero(wanted[:, b])
                by_block[some, b] += often[some] @ self.dense[:, b * self.block : (b + 1) * self.block]
            done[wanted] = True

        # The blocks of the highest bounds first: as many as hold twice the neighbours.
        first = min(self.blocks, -(-2 * k // self.block))
        wanted = np.zeros(bound.shape, bool)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        np.put_along_axis(wanted, best, True, axis=1)
        look(wanted)
        last = np.zeros(len(queries))  # the kth best so far
        if first < self.blocks:
            known = np.take_along_axis(by_block, best[:, :, None], axis=1).reshape(len(queries), -1)
            at = known.shape[1] - k
            last = np.partition(known, at, axis=1)[:, at] - 2 * 10.0**-DIGITS
            look(~done & (bound >= last[:, None]))
            by_block[~done] = 0.0
        for row, least in zip(dots[:, : self.size], last):
            found = np.flatnonzero(row >= least)
            values, number = np.round(row[found], DIGITS), self.number[found]
            least = max(np.partition(values, len(values) - k)[len(values) - k], 10.0**-DIGITS) if k < len(values) else 10.0**-DIGITS
            some = np.flatnonzero(values >= least * (1 - 1e-12))
            top = some[np.lexsort((number[some], -values[some]))[:k]]
            yield number[top], values[top]


class Model:
    """What a worker needs to vote on texts."""

    def __init__(self, examples: list[str], frequencies: list[str], own: bool = False):
        """``own``: the examples' own vectors are kept, for ``own_votes``."""
        import numpy as np

        self.examples, self.words = Examples(examples), Words()
        chunk, counts = read_columns(frequencies, "chunk", "counts")
        parts = {int(c): np.frombuffer(x, np.int64) for c, x in zip(chunk, counts)}
        documents = int(parts.pop(-1, np.zeros(1))[0])
        seen = np.concatenate([parts[c] for c in sorted(parts)]) if parts else np.zeros(0)
        toxic, terms = self.examples.toxic, [t for t, _ in self.examples.vectors]
        count = lambda some: np.bincount(np.concatenate([np.zeros(0, np.int64), *some]), minlength=len(seen)).astype(float)
        bad, good = count([t for t, y in zip(terms, toxic) if y]), count([t for t, y in zip(terms, toxic) if not y])
        relevance = phi(bad, good, float(toxic.sum()), float(len(toxic) - toxic.sum()))
        self.index = BlockMaxIndex(self.examples.vectors, (np.log((1 + documents) / (1 + seen)) + 1) * (1 + RELEVANCE * relevance))
        self.k = neighbours(self.index.size)
        if not own:
            self.examples.vectors = None
        self.prior = float(self.examples.toxic.mean()) if self.index.size else 0.0

    def vote(self, ids, cosines) -> float:
        """Share of toxic neighbours, each weighted by the inverse of its distance; one vote at the prior rate is added. -1
        without neighbours."""
        if not len(ids):
            return -1.0
        weights = 1 / (1 - cosines + NEAR)
        return float((weights @ self.examples.toxic[ids] + self.prior) / (weights.sum() + 1))

    def votes(self, texts: list[str]):
        """(vote, neighbours, cosines) of each text; of the neighbours the nearest few."""
        names = self.examples.doc_ids
        vectors = [self.examples.vector(self.words.count(text)) for text in texts]
        for ids, cosines in self.index.nearest(vectors, self.k):
            yield self.vote(ids, cosines), [names[i] for i in ids[:EVIDENCE]], cosines[:EVIDENCE].tolist()

    def own_votes(self):
        """(vote, toxic) of every example, itself left out of its neighbours."""
        import numpy as np

        for i, (ids, cosines) in enumerate(self.index.nearest(self.examples.vectors, self.k + 1)):
            keep = np.flatnonzero(ids != i)[: self.k]
            yield self.vote(ids[keep], cosines[keep]), int(self.examples.toxic[i])


def model_of(examples: list[str], frequencies: list[str], own: bool = False) -> Model:
    return resident(("tox-model", own, *examples, *frequencies), lambda: Model(examples, frequencies, own))


def isotonic(votes: list[float], labels: list[int]) -> tuple[list[float], list[float]]:
    """Pooled adjacent violators: ascending votes and the rates that they stand for; rates are drawn to the middle by one
    example of each label."""
    pools: list[list[float]] = []
    for v, y in sorted(zip(votes, labels)):
        if pools and pools[-1][0] == v:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([v, float(y), 1.0])
    merged: list[list[float]] = []
    for v, y, n in pools:
        merged.append([v, y, n, v])
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] >= merged[-1][1] * merged[-2][2]:
            _, y2, n2, last = merged.pop()
            merged[-1] = [merged[-1][0], merged[-1][1] + y2, merged[-1][2] + n2, last]
    xs, ys = [], []
    for first, y, n, last in merged:
        rate = (y + 1) / (n + 2) if n > 2 else y / n
        for x in dict.fromkeys((first, last)):
            xs.append(x)
            ys.append(max(rate, ys[-1] if ys else 0.0))
    return xs, ys


class Curve:
    """Votes to probabilities, fitted on (vote, toxic) pairs. Examples without neighbours have a rate of their own."""

    def __init__(self, known: list[tuple[float, int]]):
        alone = [y for v, y in known if v < 0]
        prior = sum(y for _, y in known) / len(known) if known else 0.0
        self.xs, self.ys = isotonic([v for v, _ in known if v >= 0], [y for v, y in known if v >= 0])
        self.lonely = (sum(alone) + prior) / (len(alone) + 1)

    def __call__(self, votes):
        import numpy as np

        votes = np.asarray(votes, float)
        scores = np.interp(votes, self.xs, self.ys) if self.xs else np.full(len(votes), self.lonely)
        return np.clip(np.where(votes < 0, self.lonely, scores), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[list[str], list[str], Curve]:
    """The files of the examples and of the document frequencies, and the curve."""
    spark = docs.sparkSession
    with Scratch() as scratch:
        drawn = draw_examples(docs, labels, learn, sample)
        examples = drawn.inputFiles()
        counted = document_frequencies(docs, examples)
        frequencies = counted.inputFiles()
        scratch.keep(drawn, counted)

    def work(batches):
        for _ in batches:
            pairs = list(model_of(examples, frequencies, own=True).own_votes())
            yield {"vote": [v for v, _ in pairs], "toxic": [y for _, y in pairs]}

    pairs = map_rows(spark.range(1, numPartitions=1), "vote double, toxic int", work, keeps=True)
    return examples, frequencies, Curve([(r["vote"], r["toxic"]) for r in pairs.collect()])  # ``sample`` pairs at most


def score(docs: DataFrame, labels: DataFrame, learn: Column, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours and cosines (the evidence) of every row."""
    examples, frequencies, curve = fit(docs, labels, learn, sample)

    def rate(batches):
        model = model_of(examples, frequencies)
        for batch in batches:
            votes, near, cosines = zip(*model.votes(batch.pop("text"))) if batch["doc_id"] else ((), (), ())
            yield batch | {"score": curve(votes), "neighbours": near, "cosines": cosines}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    scored = map_rows(rows, "doc_id long, neighbours array<long>, cosines array<double>, score double", rate, keeps=True)
    held_out = F.coalesce(held_out, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; each row goes by its own text."""
    examples, frequencies, curve = fit(docs, labels, fold(F.col("doc_id")) != 0)

    def clean(texts):
        votes = [v for v, _, _ in model_of(examples, frequencies).votes([t or "" for t in texts])]
        return (curve(votes) < 0.5).tolist()

    return filter_rows(docs, "text", clean, keeps=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id")) == 0
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)
