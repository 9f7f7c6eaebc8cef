"""Word lists of blocks of text: packed, merged by shards of a hash, and answered to the blocks."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

#: Bits of a word's hash that can choose its shard.
HASH_BITS = 16


class Numbers(dict):
    """Words to numbers from ``start`` on, in order of their first use."""

    def __init__(self, start: int):
        super().__init__()
        self.start = start

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + self.start
        return n


def packed(values: np.ndarray) -> bytes:
    """Numbers, byte by byte of their places and compressed: the high bytes of small numbers cost next to nothing."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=3).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def squeezed(words: Sequence[bytes]) -> bytes:
    """Words (without blanks) in one compressed text."""
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def words_of(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b" ") if raw else []


def ranked(numbers: Numbers, used: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words by falling use, and the table from their numbers to these ranks (numbers below the start stay)."""
    order = np.argsort(-used[numbers.start:], kind="stable")
    table = np.arange(len(used), dtype=np.int32)
    table[numbers.start + order] = np.arange(len(order), dtype=np.int32) + numbers.start
    words = [*numbers]
    return [words[i] for i in order.tolist()], table


def hashes(words: Sequence[bytes], salt: str = "") -> np.ndarray:
    base = zlib.crc32(salt.encode("utf-8", "surrogatepass"))
    return np.fromiter((zlib.crc32(w, base) & 0xFFFF for w in words), np.uint16, len(words))


def by_shard(hashed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a word list in order of shard, the shards that occur, and where each begins (with the end)."""
    shard = hashed >> np.uint16(HASH_BITS - bits) if bits else np.zeros(len(hashed), np.uint16)
    order = np.argsort(shard, kind="stable")
    found, starts = np.unique(shard[order], return_index=True)
    return order, found, np.append(starts, len(order))


def pieces(blocks: DataFrame, bits: int) -> DataFrame:
    """``(shard, block, lang, words, counts)`` of ``blocks(block, lang, words, counts, hashes)``: each block's words by shard."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, lang, words, counts, hashed in zip(*(pdf[c] for c in ("block", "lang", "words", "counts", "hashes"))):
                listed, n = words_of(words), unpacked(counts, "<i8")
                order, found, starts = by_shard(unpacked(hashed, "<u2"), bits)
                rows = [order[a:b] for a, b in zip(starts, starts[1:])]
                yield pd.DataFrame({"shard": found.astype(np.int64), "block": block, "lang": lang,
                                    "words": [squeezed([listed[i] for i in r.tolist()]) for r in rows], "counts": [packed(n[r]) for r in rows]})

    return blocks.select("block", "lang", "words", "counts", "hashes").mapInPandas(cut, "shard long, block long, lang string, words binary, counts binary")


def merged(parts: DataFrame, tell: Callable, kind: str) -> DataFrame:
    """Answers ``(block, shard, data)``, and with null block rows ``(shard, id, lang, word, f)`` of each shard.

    A shard sums its words over all blocks; ``tell(shard, totals)`` gives, for ``{(lang, word): count}``, a value for each and
    the rows. A block gets the values of its words in the order of its piece, as numbers of ``kind``.
    """

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        totals: dict[tuple, int] = {}
        read = [(lang, words_of(w), unpacked(c, "<i8").tolist()) for lang, w, c in zip(pdf["lang"], pdf["words"], pdf["counts"])]
        for lang, words, counts in read:
            for w, n in zip(words, counts):
                totals[lang, w] = totals.get((lang, w), 0) + n
        values, rows = tell(key[0], totals)
        out = [(int(b), key[0], packed(np.array([values[lang, w] for w in words], kind)), None, None, None, None) for b, (lang, words, _) in zip(pdf["block"], read)]
        out += [(None, key[0], None, *r) for r in rows]
        frame = pd.DataFrame(out, columns=["block", "shard", "data", "id", "lang", "word", "f"])
        return frame.astype({"block": "Int64", "id": "Int64", "f": "Int64"})

    return parts.groupBy("shard").applyInPandas(merge, "block long, shard long, data binary, id long, lang string, word string, f long")


def answers(replies: DataFrame, name: str = "told") -> DataFrame:
    """``(block, told)``: what all shards told a block."""
    return replies.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias(name))


def heard(told: list, hashed: np.ndarray, bits: int, kind: str) -> np.ndarray:
    """The values of a block's words in their order, from the shards' answers."""
    order, found, starts = by_shard(hashed, bits)
    at = {int(s): order[a:b] for s, a, b in zip(found, starts, starts[1:])}
    out = np.zeros(len(hashed), kind)
    for t in told:
        out[at[t["shard"]]] = unpacked(t["data"], kind)
    return out
