"""A lossless bit codec for blocks of (timestamp, value), after Pelkonen et al., "Gorilla: A Fast, Scalable, In-Memory Time
Series Database" (VLDB 2015): differences of differences for timestamps, exclusive or for values.

Beyond the paper, a difference that does not fit 32 bits is written with 64, so gaps of any width come back. Parquet is what
the store uses; this is for blocks that leave it."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from tidemark.errors import CorruptFile
from tidemark.workdir import importable

#: Control bits with their length, and payload bits, for differences of differences: from low to high.
BUCKETS = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b11110, 5, 32), (0b11111, 5, 64))
MASK = (1 << 64) - 1
BLOCK = "n long, times binary, bits binary"


class Writer:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, width: int) -> None:
        if width:
            self.parts.append(format(value & ((1 << width) - 1), f"0{width}b"))

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


class Reader:
    def __init__(self, data: bytes) -> None:
        self.text, self.at = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else "", 0

    def take(self, width: int) -> int:
        if self.at + width > len(self.text):
            raise CorruptFile("a block ends too early")
        self.at += width
        return int(self.text[self.at - width : self.at], 2) if width else 0

    def ones(self, most: int) -> int:
        """Leading ones, at most ``most``; the zero behind fewer of them is taken too."""
        n = 0
        while n < most and self.take(1):
            n += 1
        return n


def signed(value: int, width: int) -> int:
    return value - (1 << width) if value >> (width - 1) else value


def encode_times(times: list[int]) -> bytes:
    out, before, delta = Writer(), 0, 0
    for i, t in enumerate(times):
        if i == 0:
            out.put(t, 64)
        else:
            dod = (t - before) - delta
            delta = t - before
            if dod == 0:
                out.put(0, 1)
            else:
                control, length, width = next((b for b in BUCKETS if -(1 << (b[2] - 1)) <= dod < 1 << (b[2] - 1)), BUCKETS[-1])
                out.put(control, length)
                out.put(dod, width)
        before = t
    return out.bytes()


def decode_times(data: bytes, n: int) -> list[int]:
    bits, out, delta = Reader(data), [], 0
    for i in range(n):
        if i == 0:
            out.append(signed(bits.take(64), 64))
            continue
        kind = bits.ones(5)
        if kind:
            width = BUCKETS[kind - 1][2]
            delta += signed(bits.take(width), width)
            delta = signed(delta & MASK, 64)  # 64 bits of a difference stand for it modulo 2^64
        out.append(signed((out[-1] + delta) & MASK, 64))
    return out


def encode_values(values: list[float]) -> bytes:
    out, before, lead, length = Writer(), 0, 65, 0
    for i, v in enumerate(values):
        (bits,) = struct.unpack("<Q", struct.pack("<d", v))
        x = bits ^ before
        if i == 0:
            out.put(bits, 64)
        elif x == 0:
            out.put(0, 1)
        else:
            first, last = min(64 - x.bit_length(), 31), (x & -x).bit_length() - 1
            if lead <= first and 64 - lead - length <= last:  # fits the window of the one before
                out.put(0b10, 2)
            else:
                lead, length = first, 64 - first - last
                out.put(0b11, 2)
                out.put(lead, 5)
                out.put(length - 1, 6)
            out.put(x >> (64 - lead - length), length)
        before = bits
    return out.bytes()


def decode_values(data: bytes, n: int) -> list[float]:
    bits, out, before, lead, length = Reader(data), [], 0, 0, 0
    for i in range(n):
        if i == 0:
            before = bits.take(64)
        elif bits.take(1):
            if bits.take(1):
                lead, length = bits.take(5), bits.take(6) + 1
            if not length or lead + length > 64:
                raise CorruptFile("a block names a window that cannot be")
            before ^= bits.take(length) << (64 - lead - length)
        out.append(struct.unpack("<d", struct.pack("<Q", before))[0])
    return out


def compress(points: DataFrame, *by: str) -> DataFrame:
    """A row for each block, with its points in order of time. ``by`` must bound a block, as a series in a partition does."""
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)

    names = [*by, "n", "times", "bits"]

    def pack(frames):
        import pandas as pd

        def block(key, times, values):
            return *key, len(times), encode_times(times), encode_values(values)

        key, times, values = None, [], []
        for frame in frames:
            out = []
            for *own, t, v in frame.itertuples(index=False, name=None):
                if own != key:
                    if times:
                        out.append(block(key, times, values))
                    key, times, values = own, [], []
                times.append(t)
                values.append(v)
            yield pd.DataFrame(out, columns=names)
        if times:
            yield pd.DataFrame([block(key, times, values)], columns=names)

    importable(points.sparkSession)
    # A block's points come one after another, so a task holds one block at a time.
    laid = points.select(*by, "timestamp", "value").repartition(*by).sortWithinPartitions(*by, "timestamp")
    return laid.mapInPandas(pack, f"{schema}, {BLOCK}")


def decompress(blocks: DataFrame, *by: str) -> DataFrame:
    schema = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in by)

    def unpack(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for *key, n, times, bits in frame.itertuples(index=False, name=None):
                out += [(*key, t, v) for t, v in zip(decode_times(times, n), decode_values(bits, n))]
            yield pd.DataFrame(out, columns=[*by, "timestamp", "value"])

    importable(blocks.sparkSession)
    return blocks.select(*by, "n", "times", "bits").mapInPandas(unpack, f"{schema}, timestamp long, value double")
