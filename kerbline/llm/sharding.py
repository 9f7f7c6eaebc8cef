"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kerbline.llm.common import column, free_name, numbered

ROUNDS = 6
_MASK64 = (1 << 64) - 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply) of ``x`` with a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [((seed & _MASK64) * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) & _MASK64 for i in range(ROUNDS)]


def _half_bits(rows: int) -> int:
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def permuted(number: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """Place of each row number after the shuffle, both in ``[0, rows)``.

    A balanced Feistel network permutes the next even power of two; a place outside the range is fed in again (cycle
    walking, at most four steps on average) until it falls inside, which leaves a permutation of the range.
    """
    half = _half_bits(rows)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(number).astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            left, right = out[walking] >> bits, out[walking] & mask
            for key in _keys(seed):
                left, right = right, left ^ (_mix(right, key) & mask)
            out[walking] = (left << bits) | right
            walking = walking[out[walking] >= np.uint64(rows)]
    return out.astype(np.int64)


def original(place: np.ndarray, rows: int, seed: int) -> np.ndarray:
    """The row number that :func:`permuted` sends to each place."""
    half = _half_bits(rows)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(place).astype(np.uint64)
    walking = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walking):
            left, right = out[walking] >> bits, out[walking] & mask
            for key in reversed(_keys(seed)):
                left, right = right ^ (_mix(left, key) & mask), left
            out[walking] = (left << bits) | right
            walking = walking[out[walking] >= np.uint64(rows)]
    return out.astype(np.int64)


def locate(number: int, rows: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number, without looking at any data."""
    place = int(permuted(np.array([number]), rows, seed)[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int) -> int:
    """The row number that lies in a slot of a shard."""
    return int(original(np.array([slot * shards + shard]), rows, seed)[0])


def shard(df: DataFrame, shards: int, seed: int, order: list[str], names: tuple[str, str, str] = ("row_number", "shard", "slot")) -> DataFrame:
    """``df`` with its global row number, its shard in ``[0, shards)`` and its slot, gapless from 0 in every shard.

    Row numbers follow the columns ``order`` (nulls first); rows alike in all of them are interchangeable, so pass columns
    that tell rows apart. Shard counts are at most one apart, whatever the data: a hot key or a third of the rows being
    copies moves nothing. An empty table gives no rows. Only the columns of ``df`` are shuffled, once: pass narrow rows
    and join the texts by key when files are written.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} exist already; pass other names")
    ranked = numbered(df, order, "shard-rows", names[0])
    rows = ranked.count()

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), rows, seed))

    at = free_name(ranked, "place")
    return (ranked.withColumn(at, place(column(names[0])))
            .withColumn(names[1], (column(at) % shards).cast("int"))
            .withColumn(names[2], F.expr(f"`{at}` div {shards}")).drop(at))
