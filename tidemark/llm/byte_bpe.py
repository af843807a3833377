"""Byte-level BPE by tree reduction.

The ids of a piece are the reduction of the ids of its halves. Two neighbours are joined by encoding a window across
their boundary again; the window grows on a side until the token outside and the first token inside are what the two
would become on their own. A sequence in which every neighbouring pair is the encoding of the pair's bytes is the
encoding of the whole, so from there on nothing outside can change. Decoding concatenates bytes up the same tree.

Texts are first split where non-space meets white space. No match of the pattern crosses such a place, so the ids of a
text are those of its parts, and parts that come again are remembered (within a bound).

Defined cases: a null or empty text has no ids; texts of any length are encoded whole; strings of special tokens are
ordinary text; repeated rows, rows of one doc_id and rows without one are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memory, map_rows, resident, table, text_or_empty

#: White space of the pattern's \s, which is Unicode's property; Python's own has four separators more.
SPACE = "\t-\r \x85\xa0  -     　"
#: Entries that each memory of a worker may hold.
MEMORY = 500_000


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], memory: int = MEMORY):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.memory = memory
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Encoding of a window: merge the neighbours of the lowest rank, the leftmost first."""
        known = self.windows.get(data)
        if known is not None:
            return known
        ranks, n = self.ranks, len(data)
        ends = list(range(1, n + 1)) + [n]  # ends[i]: where the part that starts at i ends; 0 if none starts there
        starts = list(range(-1, n))  # starts[i]: start of the part before the one at i
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or not ends[j] or ranks.get(data[i : ends[j]]) != rank:
                continue
            end = ends[j]
            ends[i], ends[j] = end, 0
            if end < n:
                starts[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (before := starts[i]) >= 0 and (r := ranks.get(data[before:end])) is not None:
                heapq.heappush(heap, (r, before))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        if n <= 64:
            if len(self.windows) > self.memory:
                self.windows.clear()
            self.windows[data] = tuple(out)
        return tuple(out)

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes are encoded as these two tokens."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > self.memory:
                self.pairs.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == (left, right)
            self.pairs[left, right] = known
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        if self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.tokens.__getitem__, a[len(a) - i :] + b[:j])))
            left = i >= len(a) or self.stable(a[len(a) - i - 1], window[0])
            right = j >= len(b) or self.stable(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + list(window) + b[j:]
            i = i if left else min(2 * i, len(a))
            j = j if right else min(2 * j, len(b))

    def reduce(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        middle = len(data) // 2
        return self.join(self.reduce(data[:middle]), self.reduce(data[middle:]))

    def decode(self, ids) -> bytes:
        if len(ids) <= 1024:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class TextEncoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers."""

    SPACED = re.compile(r"\s\s")
    PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY):
        import regex

        self.bpe = TreeBPE(ranks, memory)
        exact = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.split = regex.compile(exact).findall
        self.memory = memory
        self.pieces: dict[str, bytes] = {}
        self.spaced = Memory(memory)

    def part(self, text: str) -> bytes:
        out = []
        for piece in self.split(text):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = array("I", self.bpe.reduce(piece.encode())).tobytes()
                if len(piece) <= 64:
                    if len(self.pieces) > self.memory:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.SPACED.search(text):
            return b"".join(map(self.part, self.PARTS.findall(text)))
        # Single spaces only: what follows each is one part, with its space.
        first, *rest = text.split(" ")
        missing = self.spaced.missing(set(rest))
        known = self.spaced.new
        for word in missing:
            known[word] = self.part(" " + word)
        return self.part(first) + b"".join(map(known.__getitem__, rest))


def load_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder_of(ranks_path: str, pattern: str) -> TextEncoder:
    """A worker's encoder, with what it remembers, serves its next tasks."""
    return resident(("byte-bpe", ranks_path, pattern), lambda: TextEncoder(load_ranks(ranks_path), pattern))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Digests of ids and of decoded bytes; with ``keep_ids`` also ``ids`` (little-endian) as binary."""
    schema = SCHEMA + (", ids binary" if keep_ids else "")

    def work(batches):
        import hashlib
        import sys

        encoder = encoder_of(ranks_path, pattern)
        for batch in batches:
            out = {x.split()[0]: [] for x in schema.split(", ")}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = encoder.encode(text)
                ids = array("I", data)
                if sys.byteorder == "big":
                    (swapped := array("I", data)).byteswap()
                    data = swapped.tobytes()
                row = (doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(encoder.bpe.decode(ids)).hexdigest(), data)
                for values, v in zip(out.values(), row):
                    values.append(v)
            yield out

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), schema, work, keeps=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
