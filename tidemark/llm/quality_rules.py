"""Quality rules by compression bands.

A text is compressed as a whole and in fixed chunks; ratios outside the limits for its length mark it as repetitive (too
high) or incompressible (too low). A few plain counts go first and reject texts that are short or say the same words again.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a text of any length is read
whole; repeated rows, rows of one doc_id and rows without one are measured each, by their own text; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filter_rows, map_rows, table, text_or_empty

SYMBOLS = b"#*$%&|<>"

#: Bytes of text below which a band holds, lowest and highest ratio of a whole text. Prose of any length
#: compresses by its letters alone to about 1.3; longer texts repeat more of their words and so compress further.
BANDS = (
    (512, 1.10, 3.2),
    (2_048, 1.20, 3.6),
    (8_192, 1.40, 4.2),
    (32_768, 1.50, 5.0),
    (float("inf"), 1.60, 6.5),
)


@dataclass(frozen=True)
class Limits:
    bands: tuple = BANDS
    chunk: int = 2_048
    chunk_low: float = 1.10
    #: Lowest ratios where nine bytes of ten are ASCII: of a whole text of 2 to 8 KB or a full chunk, and of a short last
    #: chunk. Base64 has 1.29 and 1.25, the least prose of the given tables 1.89 and 1.75.
    ascii_low: float = 1.50
    ascii_short_low: float = 1.45
    chunk_high: float = 6.0
    bad_chunks: float = 1 / 3
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), dtype=np.int64, count=n)
    if n < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # too many words for three ids in one number: number the pairs first
        _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
        keys = pairs[:-1].astype(np.int64) * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = data.split()
    joined = b"".join(words)
    continuation = bytes(range(0x80, 0xC0))
    chars = len(joined) if joined.isascii() else len(joined.translate(None, continuation))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


NOT_ASCII = bytes(range(0x80, 0x100))


def mostly_ascii(data: bytes) -> bool:
    return data.isascii() or 10 * len(data.translate(None, NOT_ASCII)) >= 9 * len(data)


def verdict(data: bytes, compress, limits: Limits) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunks out of their limits, and whether the text passes."""
    whole = len(data) / len(compress(data))
    low, high = next((a, b) for most, a, b in limits.bands if len(data) < most)
    if 2_048 <= len(data) < 8_192 and mostly_ascii(data):
        low = max(low, limits.ascii_low)
    starts = [i for i in range(0, len(data), limits.chunk) if i == 0 or len(data) - i >= limits.chunk // 2]
    if len(starts) == 1:
        return whole, 0.0, low <= whole <= high
    bad = 0
    for i, end in zip(starts, [*starts[1:], len(data)]):  # a short tail belongs to the chunk before it
        part = data[i:end]
        least = limits.chunk_low
        if mostly_ascii(part):
            least = max(least, limits.ascii_low if len(part) >= limits.chunk else limits.ascii_short_low)
        bad += not least <= len(part) / len(compress(part)) <= limits.chunk_high
    share = bad / len(starts)
    return whole, share, low <= whole <= high and share <= limits.bad_chunks


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
)


def judge(texts: list[bytes], limits: Limits):
    """The counts, ``base_failed``, ``kept`` and the figures behind the verdict of each text."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=limits.level).compress
    for data in texts:
        counts = base_counts(data)
        failed = counts[0] < limits.min_words or 100 * counts[4] > limits.repeat_percent * counts[0]
        ratio, share, passes = verdict(data, compress, limits) if data else (None, 0.0, False)
        yield *counts, failed, passes and not failed, ratio, share


def measure(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document: the counts, ``base_failed``, ``kept``, and the figures behind the verdict."""
    names = [x.strip().split()[0] for x in SCHEMA.split(",")][1:]

    def work(batches):
        for batch in batches:
            rows = list(judge(batch["data"], limits))
            yield {"doc_id": batch["doc_id"]} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("data")), SCHEMA, work)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; each row goes by its own text."""
    kept = SCHEMA.split(", ").index("kept boolean") - 1
    return filter_rows(docs, "text", lambda texts: [r[kept] for r in judge([(t or "").encode() for t in texts], limits)])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))
