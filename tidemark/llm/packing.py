"""Packing token ids into sequences of a fixed length by minimum bin slack.

Documents are tokenised, and cut into full windows and one remainder each. A full window is a sequence by itself. The
remainders are dealt evenly into groups of bounded size; in a group only the count of every length matters. Each window
starts with the longest remainder left; a bitset subset-sum over the counts of the other lengths finds the multiset that
comes closest to the capacity, the counts are traced back through the stages of the bitset, and the pattern is used as
often as the counts allow.

Defined cases: a null or empty text is the end id alone; documents of any length are cut, none is shortened; repeated
rows, rows of one doc_id and rows without one are packed each; ties go to the longer length, then the smaller doc_id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, map_rows, resident, save, table, text_or_empty

CAPACITY = 2_048
END_ID = 1
#: Remainders in a group: 200,000 rows of a few numbers, 20 MB.
GROUP_ROWS = 200_000
#: Words with their ids in each of the two generations that a worker remembers (about 200 bytes each).
CACHE_WORDS = 600_000
#: Texts that are taken apart together.
STEP = 1_000

PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of whole texts through ids of their words, as little-endian unsigned 32-bit numbers.

    The tokenizer's split never spans white space and its normaliser works within a word, so a text's ids are those of
    its words one after another. Texts with separators that Python, but not the tokenizer, counts as white space go
    through the tokenizer whole."""

    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: The one letter whose lower case is not a letter alone.
    TWO = "\u0130"
    #: The letter whose lower case depends on its place, and the first letter behind the scripts that have long been settled.
    SIGMA, YOUNG = "\u03a3", "\u0530"
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Memory(most)
        # Letters of old scripts, composed and in lower case already, need no more than to be told apart by blanks.
        from tokenizers import pre_tokenizers

        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.encode_special_tokens = True
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # A run of letters (or of anything else) ends with a token of this suffix, and no other token has it.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size()
        self.ends = [bool(suffix) and self.tokenizer.id_to_token(i).endswith(suffix) for i in range(size)]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        import array
        import sys

        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def learn(self, words: list[str]) -> None:
        """Bring the ids of all ``words`` into the memory. Marks behind a letter or digit are a run of their own, so a word and
        the same word before a comma are encoded once (unless that letter is taken apart into a letter and a mark)."""
        from unicodedata import is_normalized

        missing = self.known.missing(words)
        known, marks = self.known.new, self.MARKS
        letters, others, rest, cut = {}, {}, {}, []  # as ordered sets
        for word in missing:
            stem = word
            if not word.isalpha():
                stem = word.rstrip(marks)
                if stem != word and stem and stem[-1].isalnum() and len(stem[-1].lower()) == 1 and is_normalized("NFC", stem[-1]):
                    tail = word[len(stem) :]
                    cut.append((word, stem, tail))
                    if tail not in known:
                        rest[tail] = None
                    if stem in known:
                        continue
                else:
                    stem = word
            if not stem.isalpha() or self.TWO in stem:
                rest[stem] = None
            elif stem.isascii() or max(stem) < self.YOUNG and self.SIGMA not in stem:
                letters[stem] = None
            else:
                others[stem] = None
        rest = list(rest)
        for words, old in ((list(letters), True), (list(others), False)):
            for i in range(0, len(words), 10_000):
                part = words[i : i + 10_000]
                if not self.learn_letters(part, old):
                    rest += part
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for word, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = self.pack(x.ids)
        for word, stem, tail in cut:
            known[word] = known[stem] + known[tail]

    def learn_letters(self, words: list[str], old: bool) -> bool:
        """Encode words of letters (``old``: of old scripts) as one text, which costs half; its ids are cut behind the tokens
        that end a run. False if these are not as many as the words, so that some word is no single run to the tokenizer."""
        from unicodedata import is_normalized

        text, tokenizer = " ".join(words), self.tokenizer
        if old and is_normalized("NFC", text):
            text, tokenizer = text.lower(), self.plain
        (found,) = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = found.ids
        stops = [i for i, end in enumerate(map(self.ends.__getitem__, ids), 1) if end]
        if len(stops) != len(words):
            return False
        data, start, known = self.pack(ids), 0, self.known.new
        for word, stop in zip(words, stops):
            known[word] = data[start : 4 * stop]
            start = 4 * stop
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Words are numbered, each number's ids laid out once, and the texts' ids gathered from there."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = {i for i, t in enumerate(texts) if any(c in t for c in self.ODD)}
        split = pc.utf8_split_whitespace(pa.array(["" if i in odd else t for i, t in enumerate(texts)], pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        self.learn(words)
        ids = list(map(self.known.new.__getitem__, words))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[number]
        ends = np.cumsum(lengths)
        found = flat[np.repeat(starts[number] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][split.offsets.to_numpy()]
        out = [found[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for i in odd:
            out[i] = self.pack(self.tokenizer.encode(texts[i], add_special_tokens=False).ids)
        return out


def ids_of(path: str, memory: int) -> WordIds:
    """A worker's ids, with what it remembers, serve its next tasks."""
    return resident(("word-ids", path, memory), lambda: WordIds(path, memory))


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, memory: int = CACHE_WORDS) -> DataFrame:
    """Pieces of every document: full windows first, then the remainder. ``memory``: words that a worker remembers, twice."""

    def work(batches):
        import zlib

        ids, names = ids_of(path, memory), [x.split()[0] for x in PIECES.split(", ")]
        end = WordIds.pack([END_ID])
        for batch in batches:
            for at in range(0, len(batch["text"]), STEP):
                rows, doc_ids = batch["row"][at : at + STEP], batch["doc_id"][at : at + STEP]
                out = {n: [] for n in names}
                for row, doc_id, data in zip(rows, doc_ids, ids.encode(batch["text"][at : at + STEP])):
                    data += end
                    total = len(data) // 4
                    for start in range(0, total, capacity):
                        part = data[4 * start : 4 * (start + capacity)]
                        for n, v in zip(names, (row, doc_id, start, len(part) // 4, zlib.crc32(part), total)):
                            out[n].append(v)
                yield out

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text")
    )
    return map_rows(rows, PIECES, work, keeps=True)


def fill(counts: dict[int, int], capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """The multiset within ``counts`` whose sum is the largest of at most ``capacity``: its sum, and (length, times)."""
    mask = (1 << (capacity + 1)) - 1
    reach, stages = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        # Whole powers of two and a rest: every number of copies up to the count can be made of these.
        left, step = min(counts[length], capacity // length), 1
        while left:
            times = min(step, left)
            stages.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            step *= 2
        if reach >> capacity & 1:
            break
    total = best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, times, before in reversed(stages):
        if best >= length * times and not before >> best & 1:
            used[length] = used.get(length, 0) + times
            best -= length * times
    return total, sorted(used.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int):
    """Yields (pattern, windows): the (length, times) of a window, and how many windows in a row it fills."""
    counts = dict(counts)
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        if not counts[seed]:
            del counts[seed]
        _, used = fill(counts, capacity - seed)
        pattern: dict[int, int] = {seed: 1}
        for length, times in used:
            pattern[length] = pattern.get(length, 0) + times
        counts[seed] = counts.get(seed, 0) + 1
        windows = min(counts[length] // times for length, times in pattern.items())
        for length, times in pattern.items():
            counts[length] -= times * windows
            if not counts[length]:
                del counts[length]
        yield sorted(pattern.items(), reverse=True), windows


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sequences of a saved table of pieces. Groups are dealt by a hash of the row, never by a document's property."""
    spark = pieces.sparkSession
    rest = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    # A full window needs no partner: it keeps its own number, in the range above those of the groups.
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    def pack_group(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["length", "doc_id", "row", "start"], kind="stable").reset_index(drop=True)
        lengths, first, number = np.unique(frame["length"].to_numpy(), return_index=True, return_counts=True)
        at = {int(x): int(i) for x, i in zip(lengths, first)}
        counts = {int(x): int(n) for x, n in zip(lengths, number)}
        sequence, offset, made = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64), 0
        for pattern, windows in patterns(counts, capacity):
            place = 0
            for length, times in pattern:
                for _ in range(times):
                    rows = slice(at[length], at[length] + windows)
                    sequence[rows] = np.arange(made, made + windows)
                    offset[rows] = place
                    at[length] += windows
                    place += length
            made += windows
        frame["sequence_id"] = sequence + (int(key[0]) << 32)
        frame["offset"] = offset
        return pd.DataFrame(frame[[x.split()[0] for x in PACKED.split(", ")]])

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return full.unionByName(dealt.groupBy("group").applyInPandas(pack_group, PACKED))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, memory: int = CACHE_WORDS) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(save(cut(docs, path, capacity, memory), "pieces"), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
