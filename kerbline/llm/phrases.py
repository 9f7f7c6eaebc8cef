"""Phrase collocations: n-grams counted in counting quotient filters, merged across shards."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from kerbline.llm import vocabulary
from kerbline.llm.common import column, partitions
from kerbline.llm.vocabulary import Numbers, packed, unpacked
from kerbline.session import forget, written

#: Words of a block: what one task codes and sorts at a time. A single longer text makes a longer block.
BLOCK_WORDS = 2_000_000
#: n-grams that a shard of the merge is planned for.
SHARD_GRAMS = 2_000_000
#: What parts texts into pieces; tabs become spaces. ``bytes.split`` then parts pieces into words.
_PARTS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_MUL1, _MUL2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEYS = [np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(1, 5)]


def blocks(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """``(block, lang, n, words, counts, hashes, stream)``: texts of a language as ranks in the block's own word list, 0 between pieces."""
    schema = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("stream", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[int]]] = {}
        task, made, size = TaskContext.get().partitionId() << 32, 0, 0

        def cut(name: str) -> pa.RecordBatch:
            nonlocal made, size
            numbers, stream = held.pop(name)
            values = np.array(stream, np.int32)
            size -= len(values)
            made += 1
            used = np.bincount(values, minlength=len(numbers) + 1)
            words, table = vocabulary.ranked(numbers, used)
            counts = -np.sort(-used[1:])
            row = [task + made - 1, name, int(counts.sum()), vocabulary.squeezed(words), packed(counts), packed(vocabulary.hashes(words, name)), packed(table[values])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                name = names[i].as_py()
                if name not in held:
                    held[name] = (Numbers(1), [])
                numbers, stream = held[name]
                before = len(stream)
                for piece in texts[i].as_py().encode("utf-8", "surrogatepass").lower().translate(_PARTS).split(b"\n"):
                    if words := piece.split():
                        stream += map(numbers.__getitem__, words)
                        stream.append(0)
                size += len(stream) - before
                if len(stream) >= BLOCK_WORDS:
                    yield cut(name)
                elif size >= 2 * BLOCK_WORDS:
                    for n in [*held]:
                        yield cut(n)
        for n in [*held]:
            if held[n][1]:
                yield cut(n)

    rows = docs.select(F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(column(text), F.lit("")).alias("text"))
    return rows.mapInArrow(code, "block long, lang string, n long, words binary, counts binary, hashes binary, stream binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def _salt(lanes: list[np.ndarray]) -> np.ndarray | np.uint64:
    out = np.uint64(0)
    for lane in reversed(lanes):
        out = _mixed(lane ^ out) + _STEP
    return out


def permuted(ids: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Word-id n-grams (2 to 5 columns of ids under ``2 ** width``) as lanes of 64 bits, the first one permuted.

    The first two ids are the halves of a Feistel network over ``2 * width`` bits, keyed by a hash of the other ids, which stay
    as they are, two a lane. Its result stands in the high bits: they are spread evenly whatever the words, the bits below
    are zero and never stored. :func:`unpermuted` gives the ids back.
    """
    rest = [(ids[i] << np.uint64(32)) | ids[i + 1] if i + 1 < len(ids) else ids[i] for i in range(2, len(ids), 2)]
    salt, left, right = _salt(rest), ids[0], ids[1]
    for k in _KEYS:
        left, right = right, left ^ (_mixed(right + salt + k) >> np.uint64(64 - width))
    return [((left << np.uint64(width)) | right) << np.uint64(64 - 2 * width) if width < 32 else (left << np.uint64(32)) | right, *rest]


def unpermuted(lanes: list[np.ndarray], words: int, width: int) -> list[np.ndarray]:
    value, salt = lanes[0] >> np.uint64(64 - 2 * width), _salt(lanes[1:])
    left, right = value >> np.uint64(width), value & np.uint64((1 << width) - 1)
    for k in reversed(_KEYS):
        left, right = right ^ (_mixed(left + salt + k) >> np.uint64(64 - width)), left
    out = [left, right]
    for i, lane in enumerate(lanes[1:], 1):
        out += [lane >> np.uint64(32), lane & np.uint64(0xFFFFFFFF)] if 2 * i + 1 < words else [lane]
    return out


def counted(lanes: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct n-grams in order of their lanes, their counts, and for each input row the place of its n-gram."""
    order = np.argsort(lanes[0], kind="stable")
    same = lanes[0][order]
    new = np.ones(len(order), bool)
    new[1:] = same[1:] != same[:-1]
    for lane in lanes[1:]:
        v = lane[order]
        if np.any(~new[1:] & (v[1:] != v[:-1])):
            # Two n-grams share the first lane: only then the others decide on the order.
            order = np.lexsort(lanes[::-1])
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in lanes])
            break
    starts = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    weights = np.diff(np.append(starts, len(order))) if weights is None else np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]
    return [lane[order][starts] for lane in lanes], weights, place


def written_filter(lanes: list[np.ndarray], counts: np.ndarray, low: int, span: int, bits: int, width: int = 32) -> bytes:
    """A counting quotient filter of sorted n-grams whose quotients (high ``bits`` of the first lane) lie in ``low`` to ``low + span``.

    It holds how many remainders each quotient has, the remainders without the quotient's bytes and the bytes that ids of
    ``width`` bits leave empty, the other lanes, and counters of one byte, with the few larger ones apart.
    """
    cut, rest, n = 8 - -(-2 * width // 8), 8 - bits // 8, len(counts)
    runs = np.bincount((lanes[0] >> np.uint64(64 - bits)).astype(np.int64) - low, minlength=span).astype(np.int32)
    large = np.flatnonzero(counts >= 255)
    parts = [packed(runs), lanes[0].view(np.uint8).reshape(-1, 8)[:, cut:rest].tobytes(), packed(np.minimum(counts, 255).astype(np.uint8)),
             packed(large.astype(np.int64)), packed(counts[large].astype(np.int64)), *[packed(x) for x in lanes[1:]]]
    return struct.pack(f"<qqqqq{len(parts)}q", n, low, bits, cut, len(parts), *map(len, parts)) + b"".join(parts)


def read_filter(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, low, bits, cut, many = struct.unpack_from("<qqqqq", data)
    sizes = struct.unpack_from(f"<{many}q", data, 40)
    ends = np.cumsum([40 + 8 * many, *sizes]).tolist()
    parts = [data[a:b] for a, b in zip(ends, ends[1:])]
    runs, rest = unpacked(parts[0], "<i4"), 8 - bits // 8
    bytes_ = np.zeros((n, 8), np.uint8)
    bytes_[:, cut:rest] = np.frombuffer(parts[1], np.uint8).reshape(n, rest - cut)
    first = bytes_.view(np.uint64).ravel() | (np.repeat(np.arange(low, low + len(runs), dtype=np.uint64), runs) << np.uint64(64 - bits))
    counts = unpacked(parts[2], "u1").astype(np.int64)
    counts[unpacked(parts[3], "<i8")] = unpacked(parts[4], "<i8")
    return [first, *[unpacked(p, "<u8") for p in parts[5:]]], counts


def _runs(ids: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """The words of every stretch of two or more neighbouring ``starts`` of n-grams of ``words`` words, 0 between stretches."""
    on = np.zeros(len(ids) + 1, bool)
    on[starts] = True
    first = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
    last = np.flatnonzero(on & ~np.concatenate([on[1:], [False]]))
    long = last > first
    first, size = first[long], (last - first)[long] + words + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    out = ids[np.minimum(np.repeat(first, size) + at, len(ids) - 1)]
    out[ends - 1] = 0
    return out


def _grams(ids: np.ndarray, words: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the n-grams of a stream of ids (0 parts it), and their lanes."""
    n = max(len(ids) - words + 1, 0)
    whole = np.ones(n, bool)
    for i in range(words):
        whole &= ids[i:i + n] > 0
    starts = np.flatnonzero(whole)
    return starts, permuted([ids[starts + i].astype(np.uint64) for i in range(words)], width)


def _coded(blocks: DataFrame, replies: DataFrame, bits: int) -> DataFrame:
    """``(block, ids, stream)``: the stream in ranks of the block's frequent words, and their ids; other words part it."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for stream, hashed, told in zip(pdf["stream"], pdf["hashes"], pdf["told"]):
                ids = vocabulary.heard(told, unpacked(hashed, "<u2"), bits, "<u4")
                ranks = np.concatenate([[0], np.where(ids > 0, np.cumsum(ids > 0), 0)]).astype(np.int32)
                local = ranks[unpacked(stream, "<i4")]
                out.append((packed(ids[ids > 0]), packed(_runs(local, np.flatnonzero(local), 1))))
            yield pd.DataFrame(out, columns=["ids", "stream"]).assign(block=pdf["block"].to_numpy())[["block", "ids", "stream"]]

    return blocks.select("block", "stream", "hashes").join(vocabulary.answers(replies), "block").mapInPandas(code, "block long, ids binary, stream binary")


def _global(ids: bytes, stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    local = unpacked(stream, "<i4")
    return local, np.concatenate([np.zeros(1, np.uint32), unpacked(ids, "<u4")])[local]


def _filters(streams: DataFrame, words: int, bits: int, quotient: int, width: int) -> DataFrame:
    """``(shard, block, filter)``: the n-grams of each block in sorted filters, one for each shard's range of quotients."""
    span = 1 << (quotient - bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, ids, stream in zip(pdf["block"], pdf["ids"], pdf["stream"]):
                _, lanes = _grams(_global(ids, stream)[1], words, width)
                lanes, n, _ = counted(lanes)
                shard = (lanes[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(n), np.int64)
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                out = [(shard[a], block, written_filter([x[a:b] for x in lanes], n[a:b], int(shard[a]) * span, span, quotient, width))
                       for a, b in zip(cuts, np.append(cuts[1:], len(n)))]
                yield pd.DataFrame(out, columns=["shard", "block", "filter"])

    return streams.mapInPandas(count, "shard long, block long, filter binary")


def _merged(filters: DataFrame, least: int, quotient: int, width: int) -> DataFrame:
    """``(block, shard, data)``: for each filter one bit an n-gram that is frequent, and per shard (block null) the merged filter of these."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        read = [read_filter(f) for f in pdf["filter"]]
        lanes, n, place = counted([np.concatenate(x) for x in zip(*[r[0] for r in read])], np.concatenate([r[1] for r in read]))
        often = n >= least
        flags = np.split(often[place], np.cumsum([len(r[1]) for r in read])[:-1])
        keep = [lane[often] for lane in lanes]
        quotients = (keep[0] >> np.uint64(64 - quotient)).astype(np.int64)
        low = int(quotients[0]) if len(quotients) else 0
        out = [(b, key[0], np.packbits(f).tobytes()) for b, f in zip(pdf["block"], flags) if f.any()]
        if often.any():
            out.append((None, key[0], written_filter(keep, n[often], low, int(quotients[-1]) - low + 1, quotient, width)))
        frame = pd.DataFrame(out, columns=["block", "shard", "data"])
        return frame.assign(block=frame["block"].astype("Int64"))

    return filters.groupBy("shard").applyInPandas(merge, "block long, shard long, data binary")


def _narrowed(streams: DataFrame, replies: DataFrame, words: int, bits: int, width: int) -> DataFrame:
    """The stretches of each stream in which n-grams of ``words`` words that follow each other are frequent."""

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, stream, told in zip(pdf["ids"], pdf["stream"], pdf["told"]):
                local, coded = _global(ids, stream)
                starts, lanes = _grams(coded, words, width)
                lanes, n, place = counted(lanes)
                shard = (lanes[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(n), np.int64)
                often = np.zeros(len(n), bool)
                for t in told:
                    a, b = np.searchsorted(shard, [t["shard"], t["shard"] + 1])
                    often[a:b] = np.unpackbits(np.frombuffer(t["data"], np.uint8), count=b - a).astype(bool)
                out.append(packed(_runs(local, starts[often[place]], words)))
            yield pd.DataFrame({"block": pdf["block"].to_numpy(), "ids": pdf["ids"].to_numpy(), "stream": out})

    return streams.join(vocabulary.answers(replies), "block").mapInPandas(narrow, "block long, ids binary, stream binary")


def frequent(docs: DataFrame, least: int, longest: int = 5, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``phrases(ids, f)`` of 1 to ``longest`` words that occur ``least`` times or more, ``words(id, lang, word)``, ``langs(lang, n)``.

    Ids are of words of a language, so an n-gram of ids belongs to one; shards of the words' hashes give them out. Every order is counted exactly over all texts: a block's
    n-grams become a sorted filter, cut by ranges of quotients into shards; a shard merges the filters of all blocks and answers
    each with one bit an n-gram. The next order looks only where both of its shorter n-grams are frequent, which loses none.
    """
    base = written(blocks(docs, lang, text), "phrase-blocks")
    langs = written(base.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-langs")
    total = langs.agg(F.sum("n")).first()[0] or 0
    bits = max(partitions(docs) - 1, total // SHARD_GRAMS).bit_length()
    word_bits = min(bits, vocabulary.HASH_BITS)

    def number(shard: int, totals: dict) -> tuple[dict, list]:
        often = sorted(k for k, n in totals.items() if n >= least)
        ids = dict.fromkeys(totals, 0) | {k: (i << word_bits) + shard + 1 for i, k in enumerate(often)}
        if often and ids[often[-1]] >= 1 << 32:
            raise ValueError("a word's id does not fit in 32 bits: too many frequent words")
        return ids, [(ids[k], k[0], k[1].decode("utf-8", "surrogatepass"), totals[k]) for k in often]

    told = written(vocabulary.merged(vocabulary.pieces(base, word_bits), number, "<u4"), "phrase-words")
    words = told.filter("block is null").select("id", "lang", "word", "f")
    width = max(8, int(words.agg(F.max("id")).first()[0] or 0).bit_length())
    # Quotients fill whole bytes.
    quotient = max(16, -(-bits // 8) * 8)
    width = max(width, quotient // 2)
    streams = written(_coded(base, told, word_bits), "phrase-streams")
    forget(base)
    found = [words.select(F.array("id").alias("ids"), "f")]
    for n in range(2, longest + 1):
        merged = written(_merged(_filters(streams, n, bits, quotient, width), least, quotient, width), f"phrase-merged{n}")
        found.append(_listed(merged.filter("block is null"), n, width))
        if n < longest:
            narrower = written(_narrowed(streams, merged, n, bits, width), "phrase-streams")
            forget(streams)
            streams = narrower
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return written(out, "phrase-counts"), words.select("id", "lang", "word"), langs


def _listed(filters: DataFrame, words: int, width: int) -> DataFrame:
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["data"]:
                lanes, n = read_filter(data)
                ids = np.stack(unpermuted(lanes, words, width), axis=1).astype(np.int64)
                yield pd.DataFrame({"ids": list(ids), "f": n})

    return filters.select("data").mapInPandas(decode, "ids array<long>, f long")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``longest`` words.

    A-Z are lower-cased, texts part at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks into words. Null text is empty, null
    language ``und``, an empty table has no phrases. ``a`` counts a phrase within pieces, overlaps included, ``n`` all words of its
    language. Of all cuts into two parts, counted ``l`` and ``r``, the one with the lowest ``floor(1000 * a * n / (l * r))``
    counts, then the earliest. A phrase goes if a longer one that holds it has ``inside`` hundredths of its count. Order: score, ``a``,
    then phrase (bytes). Products are decimals of 38 digits, so exact, or an error.
    """
    phrases, words, langs = frequent(docs, least, longest, lang, text)
    many = phrases.filter(F.size("ids") > 1)
    cuts = many.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    cuts = cuts.join(phrases.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(phrases.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    sized = words.select("id", "lang").join(langs, "lang")
    cuts = cuts.withColumn("id", F.col("ids")[0]).join(sized, "id")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    parts = [F.slice("ids", F.lit(i), F.lit(n)) for n in range(2, longest) for i in range(1, longest - n + 2)]
    fits = [F.when(F.size("ids") >= max(n + 1, i + n - 1), p) for p, (n, i) in zip(parts, [(n, i) for n in range(2, longest) for i in range(1, longest - n + 2)])]
    holders = many.select("f", F.explode(F.array_compact(F.array(*fits))).alias("ids")).groupBy("ids").agg(F.max("f").alias("held")) if fits else None
    if holders is not None:
        scored = scored.join(holders, "ids", "left").filter(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * inside))
    scored = scored.select("ids", "lang", "a", "n", "cut.score", "cut.l", "cut.r")
    # Only those that may be listed, ties included, get their words.
    by_score: list[Column] = [F.col("score").desc(), F.col("a").desc()]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*by_score))).filter(F.col("place") <= top).drop("place")
    near = written(near, "phrase-first")
    spelled = (near.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("ids")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "phrase"))
    listed = near.join(spelled, "ids").withColumn("rank", place).filter(F.col("rank") <= top)
    return listed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
