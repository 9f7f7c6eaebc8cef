"""Language-model scores by logistic context mixing: bit predictors from hashed byte contexts, gated weights, a refined end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kerbline.llm import vocabulary
from kerbline.llm.common import column, partitions
from kerbline.llm.vocabulary import Numbers, packed, unpacked
from kerbline.session import written

#: Bytes of context of the longest predictor; a byte and its contexts are one key of ``ORDER + 1`` bytes.
ORDER = 5
#: Bytes of text of a block: what asks for its keys together and meets the answers in one task.
BLOCK_BYTES = 32_000_000
CHUNK_BYTES = 1_000_000
#: Keys and words of all blocks that one slot or shard is planned for.
SLOT_KEYS = 1_000_000
SHARD_WORDS = 200_000
#: Tokens of a text after which the gates learn.
GATE_TOKENS = 64
#: Where a text's gates begin: a share of 18 % for whole words.
GATE_START = -1.5
SPACE, END = b" ", b"\n"
_PAD = END * ORDER
#: Prior counts of a bit for the predictors of 0 to 5 bytes of context.
_PRIOR = np.array([0.5, 0.5, 0.4, 0.4, 0.3, 0.3])
_COUNT_SETS, _BIT_SETS = 7 * (ORDER + 2), 8 * (ORDER + 2)
_STEPS = 33
_SPAN = 8.0


def normal(words: list[bytes]) -> bytes:
    """What is scored: each word and a space, then the end; contexts before the first byte are ends."""
    return SPACE.join([*words, END])


def keys_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of each text the ``ORDER`` bytes before it and itself, as one whole number."""
    whole = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pairs = (whole[:-1].astype(np.int64) << 8) | whole[1:]
    out = (((pairs[:-4] << 16) | pairs[2:-2]) << 16) | pairs[4:]
    keep = np.ones(len(out), bool)
    # Windows that end in the padding of the next text.
    ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
    keep[(ends[:, None] + np.arange(ORDER)).ravel()] = False
    return out[keep]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, np.int64), *[p[0] for p in parts]])
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, weights=np.concatenate([np.empty(0), *[p[1] for p in parts]]), minlength=len(found)).astype(np.int64)


_BLOCK_SQL = ("block long, ids array<string>, learns array<boolean>, sizes binary, stream binary, lang string, words binary, counts binary, hashes binary, "
              "keys binary, key_counts binary, n_words long, n_keys long")


def blocks(docs: DataFrame, key: str, text: str, learns: str) -> DataFrame:
    """Texts as ranks in a block's own word list, and the block's words and keys, each with its count in texts that teach."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.string())), ("learns", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("stream", pa.binary()), ("lang", pa.string()),
                        ("words", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary()), ("keys", pa.binary()), ("key_counts", pa.binary()), ("n_words", pa.int64()), ("n_keys", pa.int64())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, size = TaskContext.get().partitionId() << 32, 0, 0
        numbers, ids, flags, streams = Numbers(0), [], [], []
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        held = {True: 0, False: 0}
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def count() -> None:
            for teach, texts in waiting.items():
                if texts:
                    found, n = np.unique(keys_of(texts), return_counts=True)
                    parts.append((found, n if teach else np.zeros(len(found), np.int64)))
                    texts.clear()
                held[teach] = 0
            if len(parts) > 16:
                parts[:] = [_merged(parts)]

        def cut() -> pa.RecordBatch:
            nonlocal made, size
            count()
            keys, n = _merged(parts)
            stream = np.concatenate(streams)
            words, table = vocabulary.ranked(numbers, np.bincount(stream, minlength=len(numbers)))
            taught = np.concatenate([np.empty(0, np.int32), *[s for s, f in zip(streams, flags) if f]])
            counts = np.bincount(table[taught], minlength=len(words))[:len(words)]
            out = [base + made, ids[:], flags[:], packed(np.array([len(s) for s in streams], np.int64)), packed(table[stream]), "", vocabulary.squeezed(words), packed(counts),
                   packed(vocabulary.hashes(words)), packed(np.diff(keys, prepend=0)), packed(n), len(words), len(keys)]
            made, size = made + 1, 0
            for x in (numbers, ids, flags, streams, parts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                words = (batch.column(2)[i].as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                teach = bool(batch.column(1)[i].as_py())
                ids.append(batch.column(0)[i].as_py())
                flags.append(teach)
                streams.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                waiting[teach].append(normal(words))
                held[teach] += len(waiting[teach][-1])
                size += len(waiting[teach][-1])
                if held[teach] >= CHUNK_BYTES or len(waiting[teach]) >= 4096:
                    count()
                if size >= BLOCK_BYTES:
                    yield cut()
        if ids:
            yield cut()

    return docs.select(column(key).cast("string"), column(learns), column(text)).mapInArrow(code, _BLOCK_SQL)


def _by_slot(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of keys in order of slot, the slots that occur, and where each begins: a slot has all keys of its three context bytes."""
    mixed = ((keys >> 8) & 0xFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
    order = np.argsort(slot, kind="stable")
    found, starts = np.unique(slot[order], return_index=True)
    return order, found, np.append(starts, len(order))


def _key_pieces(base: DataFrame, bits: int) -> DataFrame:
    """``(slot, block, keys, counts)``: each block's keys by slot, ascending."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, keys, counts in zip(pdf["block"], pdf["keys"], pdf["key_counts"]):
                keys, n = np.cumsum(unpacked(keys, "<i8")), unpacked(counts, "<i8")
                order, found, starts = _by_slot(keys, bits)
                rows = [order[a:b] for a, b in zip(starts, starts[1:])]
                yield pd.DataFrame({"slot": found.astype(np.int64), "block": block, "keys": [packed(np.diff(keys[r], prepend=0)) for r in rows], "counts": [packed(n[r]) for r in rows]})

    return base.select("block", "keys", "key_counts").mapInPandas(cut, "slot long, block long, keys binary, counts binary")


def paths(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked (context, byte): how often its context was followed by a byte with the same 0, 1, ... 8 high bits.

    ``keys`` are sorted, context then byte. Shape (9, asked)."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty((9, len(asked)), np.int64)
    for bits in range(9):
        low = (asked >> (8 - bits)) << (8 - bits)
        out[bits] = sums[np.searchsorted(keys, low + (1 << (8 - bits)))] - sums[np.searchsorted(keys, low)]
    return out


def _summed(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys & ((1 << 8 * width) - 1), return_inverse=True)
    return found, np.bincount(place, weights=counts, minlength=len(found)).astype(np.int64)


def slot_paths(keys: np.ndarray, n: np.ndarray, two_bytes: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts along the path of each key of a slot, for contexts of 0 to 5 bytes. Shape (6, 9, keys).

    A slot has all keys whose three context bytes hash to it, so that longer contexts are whole within it. ``pairs`` are all
    (byte, byte) counts, at most 65,536; those for two bytes of context (9, keys) come from outside.
    """
    singles = _summed(*pairs, 1)
    out = [paths(*singles, keys & 0xFF), paths(*pairs, keys & 0xFFFF), two_bytes]
    seen = n > 0
    for width in range(4, ORDER + 2):
        own = _summed(keys[seen], n[seen], width)
        out.append(paths(*own, keys & ((1 << 8 * width) - 1)))
    return np.stack(out)


def inputs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the bit that came, one for each context length, and the two sets of weights that the counts choose.

    ``counts`` (6, 9, m) gives logits (6, 8, m); a context without a count says nothing (0). One set goes by the longest context
    seen and how often, the other by the bit's place and the number of contexts seen.
    """
    here, bit = counts[:, :8].astype(np.float64), counts[:, 1:].astype(np.float64)
    prior = _PRIOR[:, None, None]
    logit = np.where(here > 0, np.log((bit + prior) / (here - bit + prior)), 0.0)
    seen = here > 0
    top = np.where(seen.any(axis=0), ORDER - np.argmax(seen[::-1], axis=0), -1)
    often = np.take_along_axis(here, np.maximum(top, 0)[None], 0)[0]
    by_count = (top + 1) * 7 + np.minimum(6, np.log2(np.maximum(often, 1)).astype(np.int64))
    return logit, by_count, np.arange(8)[:, None] * (ORDER + 2) + seen.sum(axis=0)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def learned(keys: np.ndarray, n: np.ndarray, counts: np.ndarray, batch: int = 256, rate: float = 0.3) -> pd.DataFrame:
    """Weights of a slot after one online pass over its keys in an order by hash: ``(kind, place, seen, w0 .. w5)``.

    A key counts as often as it occurs, and is predicted from all other occurrences: its own is taken off every count.
    """
    some = n > 0
    counts, n = counts[:, :, some] - 1, n[some].astype(np.float64)
    order = np.argsort(keys[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    sets = (_COUNT_SETS, _BIT_SETS)
    weights = [np.full((k, ORDER + 1), 0.3) for k in sets]
    seen = [np.zeros(k) for k in sets]
    for turn, at in enumerate(np.split(order, np.arange(batch, len(order), batch))):
        logit, *chosen = inputs(counts[:, :, at])
        mass = np.broadcast_to(n[at], logit.shape[1:]).ravel()
        x = logit.reshape(ORDER + 1, -1)
        step = rate / math.sqrt(1 + turn / 16)
        for w, s, g in zip(weights, seen, chosen):
            g = g.ravel()
            left = (1 - _squash((w[g].T * x).sum(axis=0))) * mass
            total = np.bincount(g, weights=mass, minlength=len(w))
            for i in range(ORDER + 1):
                w[:, i] += step * np.bincount(g, weights=left * x[i], minlength=len(w)) / np.maximum(total, 1)
            s += total
    rows = [(kind, place, s[place], *w[place]) for kind, (w, s) in enumerate(zip(weights, seen)) for place in np.flatnonzero(s)]
    return pd.DataFrame(rows, columns=["kind", "place", "seen", *[f"w{i}" for i in range(ORDER + 1)]])


def _mixed(counts: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Logit of the bit that came: the mean of what both sets of weights say. Shape (8, m)."""
    logit, *chosen = inputs(counts)
    return np.clip(sum((np.moveaxis(w[g], -1, 0) * logit).sum(axis=0) for w, g in zip(weights, chosen)) / 2, -_SPAN * 2, _SPAN * 2)


def _steps(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower of the two neighbouring steps of the refinement table, and how far a logit is from it to the next."""
    at = (np.clip(logit, -_SPAN, _SPAN) + _SPAN) * ((_STEPS - 1) / (2 * _SPAN))
    low = np.minimum(at.astype(np.int64), _STEPS - 2)
    return low, at - low


def tallied(n: np.ndarray, counts: np.ndarray, weights: list[np.ndarray]) -> pd.DataFrame:
    """``(place, hits)``: how often the bit that came had a logit near each step, by the bit's place."""
    some = n > 0
    low, part = _steps(_mixed(counts[:, :, some] - 1, weights))
    place = np.arange(8)[:, None] * _STEPS + low
    n = np.broadcast_to(n[some].astype(np.float64), low.shape)
    hits = np.bincount(place.ravel(), weights=((1 - part) * n).ravel(), minlength=8 * _STEPS) + np.bincount(place.ravel() + 1, weights=(part * n).ravel(), minlength=8 * _STEPS)
    return pd.DataFrame({"place": np.arange(8 * _STEPS), "hits": hits})


def refinement(hits: np.ndarray) -> np.ndarray:
    """Probability of the bit at each step: hits there against hits at the opposite step, which are its misses. Shape (8, steps)."""
    hits = hits.reshape(8, _STEPS)
    prior = _squash(np.linspace(-_SPAN, _SPAN, _STEPS)) * 4
    return (hits + prior) / (hits + hits[:, ::-1] + 4)


def cost(counts: np.ndarray, weights: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Bits of each key's byte after its context: both the mixed and the refined probability sum to one over a bit's two values."""
    logit = _mixed(counts, weights)
    low, part = _steps(logit)
    row = np.arange(8)[:, None]
    refined = table[row, low] * (1 - part) + table[row, low + 1] * part
    return -np.log2((_squash(logit) + refined) / 2).sum(axis=0)


def gated(spelled: np.ndarray, whole: np.ndarray, sizes: np.ndarray, rate: float = 2.0) -> np.ndarray:
    """Bits of each text by an online mix of two predictors of tokens: the spelled byte by byte one and the whole-word one.

    Both arrays have bits a token, text after text of ``sizes`` tokens, infinite where the whole-word predictor knows no such
    word. The share of the latter is the logistic of a gate's weight, one gate after known and one after unknown words. Every
    :data:`GATE_TOKENS` tokens of a text its gates learn by a step along their mean gradient. The share before a token depends
    on earlier ones only, so the mix is a probability. All texts go side by side, longest first.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    known = np.isfinite(whole)
    after = np.concatenate([[True], known[:-1]]).astype(np.int64)
    after[np.cumsum(sizes) - sizes] = 1
    weights, bits = np.full((len(sizes), 2), GATE_START), np.zeros(len(sizes))
    steps = np.arange(GATE_TOKENS)
    for at in range(0, int(left[0]) if len(left) else 0, GATE_TOKENS):
        live = int(np.searchsorted(-left, -at))
        inside = steps + at < left[:live, None]
        place = np.where(inside, starts[:live, None] + at + steps, 0)
        b, u, k, g = spelled[place], whole[place], known[place], after[place]
        share = _squash(np.take_along_axis(weights[:live], g, 1))
        # Both probabilities as multiples of the whole-word one, where there is one.
        mixed = np.where(k, share + (1 - share) * np.exp2(np.where(k, u - b, 0)), 1 - share)
        bits[:live] += np.where(inside, np.where(k, u, b) - np.log2(mixed), 0).sum(axis=1)
        gradient = np.where(inside, np.where(k, share / mixed, 0) - share, 0)
        for gate in (0, 1):
            own = inside & (g == gate)
            weights[:live, gate] += rate * (gradient * own).sum(axis=1) / np.maximum(own.sum(axis=1), 1)
    out = np.empty(len(sizes))
    out[order] = bits
    return out


def _row_counts(row: dict, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, n = unpacked(row["keys"], "<i8"), unpacked(row["n"], "<i8")
    return keys, n, slot_paths(keys, n, unpacked(row["low"], "<i8").reshape(9, -1), pairs)


def _fitted(model: DataFrame, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights, the mean of what the slots learn online, and the table that refines what they mix: a few hundred numbers."""
    fields = [f"w{i}" for i in range(ORDER + 1)]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield learned(*_row_counts(row, pairs))

    taught = model.mapInPandas(learn, "kind long, place long, seen double, " + ", ".join(f"{f} double" for f in fields))
    means = taught.groupBy("kind", "place").agg(*[(F.sum(F.col(f) * F.col("seen")) / F.sum("seen")).alias(f) for f in fields]).collect()
    weights = [np.full((k, ORDER + 1), 0.3) for k in (_COUNT_SETS, _BIT_SETS)]
    for r in means:
        # Sums of doubles depend on the order in their last digits only; rounded, reruns agree.
        weights[r["kind"]][r["place"]] = [round(r[f], 6) for f in fields]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield tallied(*_row_counts(row, pairs)[1:], weights)

    hits = np.zeros(8 * _STEPS)
    for r in model.mapInPandas(tally, "place long, hits double").groupBy("place").agg(F.sum("hits").alias("hits")).collect():
        hits[r["place"]] = round(r["hits"], 3)
    return weights, refinement(hits)


def _model(parts: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """``(slot, keys, n, low)``, a row per slot: its keys, their counts, and the counts after two bytes of context; all pairs of bytes."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, n = _merged([(np.cumsum(unpacked(k, "<i8")), unpacked(c, "<i8")) for k, c in zip(pdf["keys"], pdf["counts"])])
        return pd.DataFrame({"slot": [key[0]], "keys": [packed(keys)], "n": [packed(n)]})

    slots = written(parts.groupBy("slot").applyInPandas(merge, "slot long, keys binary, n binary"), "lm-slots")

    def threes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for slot, keys, n in zip(pdf["slot"], pdf["keys"], pdf["n"]):
                found, sums = _summed(unpacked(keys, "<i8"), unpacked(n, "<i8"), 3)
                yield pd.DataFrame({"slot": slot, "three": found, "n": sums})

    # A slot's keys have few endings of three bytes; there are at most 2 ** 24 of them in all.
    asked = written(slots.mapInPandas(threes, "slot long, three long, n long"), "lm-threes")
    three = written(asked.groupBy("three").agg(F.sum("n").alias("n")), "lm-three")
    two = three.filter("n > 0").groupBy(F.expr("three & 65535L").alias("two")).agg(F.sum("n").alias("n")).orderBy("two").collect()
    pairs = (np.array([r["two"] for r in two], np.int64), np.array([r["n"] for r in two], np.int64))

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("three")
        t, seen = pdf["three"].to_numpy(), (pdf["n"] > 0).to_numpy()
        return pd.DataFrame({"three": t, **{f"l{i}": v for i, v in enumerate(paths(t[seen], pdf["n"].to_numpy()[seen], t))}})

    fields = [f"l{i}" for i in range(9)]
    low = three.withColumn("group", F.expr("pmod(xxhash64(shiftright(three, 8)), 256)")).groupBy("group").applyInPandas(lower, "three long, " + ", ".join(f"{f} long" for f in fields))
    told = asked.select(F.col("slot").alias("home"), "three").join(low, "three")

    def attach(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("three")
        at = np.searchsorted(told["three"].to_numpy(), unpacked(own["keys"].iloc[0], "<i8") & 0xFFFFFF)
        return pd.DataFrame({"slot": own["slot"], "keys": own["keys"], "n": own["n"], "low": [packed(told[fields].to_numpy().T[:, at].ravel())]})

    model = slots.groupBy("slot").cogroup(told.groupBy("home")).applyInPandas(attach, "slot long, keys binary, n binary, low binary")
    return written(model, "lm-model"), pairs


class _Finder:
    """Places of keys in a sorted list, by a table of hashes; the few that lost their place to another go by search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, int(len(keys) * 4).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(asked)]
        lost = np.flatnonzero(self.keys[at] != asked)
        if len(lost):
            at[lost] = np.minimum(np.searchsorted(self.keys, asked[lost]), len(self.keys) - 1)
            if (self.keys[at[lost]] != asked[lost]).any():
                raise RuntimeError("a block's texts hold keys that it did not ask for")
        return at


def score(docs: DataFrame, learns: str, key: str = "doc_id", text: str = "text", mixer: tuple[list[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(key, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)``, one row per row of ``docs``.

    Texts (null: empty) are lower-cased (A-Z) and parted at ASCII blanks into words; a text's tokens are its words and one
    end. Rows whose boolean column ``learns`` is true teach. ``base_score`` sums ``log10((c + 0.1) / (N + 0.1 * (V + 1)))``
    over tokens. ``score`` is log10 of the probability that the model gives the words, parted by spaces, and the end: each bit of
    each byte is predicted from how often it came in all teaching texts after the last 0 to 5 bytes, these predictions are mixed
    in the logistic domain by weights that two gates choose, and a table refines the mix. What that gives for a token is mixed
    with the count of the whole word (nothing, if it was not taught) by a share that adapts along the text. The counts are exact and of all teaching
    texts, so they grow with them; ``mixer`` gives weights and table learned elsewhere. Without teaching texts every bit is as likely as the other. Copies of a row score alike. A null
    key is kept; an empty table gives no rows.
    """
    base = written(blocks(docs, key, text, learns), "lm-blocks")
    size = base.agg(F.sum("n_words"), F.sum("n_keys"), F.sum(F.size(F.filter("learns", lambda x: x)))).first()
    least, ends = partitions(docs) - 1, size[2] or 0
    word_bits = min(max(least, (size[0] or 0) // SHARD_WORDS).bit_length(), vocabulary.HASH_BITS)
    key_bits = max(least, (size[1] or 0) // SLOT_KEYS).bit_length()

    def total(shard: int, totals: dict) -> tuple[dict, list]:
        seen = [n for n in totals.values() if n > 0]
        return totals, [(len(seen), None, None, sum(seen))]

    told_words = written(vocabulary.merged(vocabulary.pieces(base, word_bits), total, "<i8"), "lm-words")
    some = told_words.filter("block is null").agg(F.sum("f"), F.sum("id")).first()
    tokens, distinct = (some[0] or 0) + ends, (some[1] or 0) + (ends > 0)

    parts = _key_pieces(base, key_bits)
    model, pairs = _model(parts)
    weights, table = mixer or _fitted(model, pairs)

    def price(parts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        keys, _, counts = _row_counts(model.iloc[0].to_dict(), pairs)
        bits = np.concatenate([cost(c, weights, table) for c in np.array_split(counts, max(1, len(keys) // 50_000), axis=2)]).astype(np.float32)
        return pd.DataFrame({"block": parts["block"], "shard": parts["slot"], "data": [packed(bits[np.searchsorted(keys, np.cumsum(unpacked(k, "<i8")))]) for k in parts["keys"]]})

    told_keys = (parts.select(F.col("slot"), "block", "keys").groupBy("slot").cogroup(model.select(F.col("slot").alias("home"), "keys", "n", "low").groupBy("home"))
                 .applyInPandas(price, "block long, shard long, data binary"))
    floor = math.log10(tokens + 0.1 * (distinct + 1))
    fields = ("id", "learns", "n_tokens", "n_known", "base_score", "score", "bytes")

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                keys = np.cumsum(unpacked(row["keys"], "<i8"))
                order, found, starts = _by_slot(keys, key_bits)
                at = {int(s): order[a:b] for s, a, b in zip(found, starts, starts[1:])}
                bits = np.full(len(keys), np.nan, np.float32)
                for t in row["priced"]:
                    bits[at[t["shard"]]] = unpacked(t["data"], "<f4")
                known = vocabulary.heard(row["told"] if row["told"] is not None else [], unpacked(row["hashes"], "<u2"), word_bits, "<i8")
                spelled = vocabulary.words_of(row["words"])
                lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
                find, gain, end_gain = _Finder(keys), np.log10(known + 0.1) - floor, math.log10(ends + 0.1) - floor
                whole = np.where(known > 0, -gain * math.log2(10), math.inf)
                end_whole = -end_gain * math.log2(10) if ends else math.inf
                sizes, stream = unpacked(row["sizes"], "<i8"), unpacked(row["stream"], "<i4")
                ends_at = np.cumsum(sizes)
                heavy = np.concatenate([[0], np.cumsum(lengths[stream])])[ends_at] + np.arange(1, len(sizes) + 1)
                # Texts go on together, about a megabyte at a time.
                cuts = np.flatnonzero(np.diff(heavy // CHUNK_BYTES, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(sizes))):
                    own = [stream[ends_at[i] - sizes[i]:ends_at[i]] for i in range(a, b)]
                    paid = bits[find(keys_of([normal([spelled[j] for j in s.tolist()]) for s in own]))].astype(np.float64)
                    length = np.concatenate([np.append(lengths[s], 1) for s in own])
                    first = np.cumsum(length) - length
                    each = sizes[a:b] + 1
                    begin = np.cumsum(each) - each
                    token_bits = np.add.reduceat(paid, first)
                    # Without teaching texts there is no whole-word predictor to mix with.
                    total_bits = gated(token_bits, np.concatenate([np.append(whole[s], end_whole) for s in own]), each) if tokens else np.add.reduceat(token_bits, begin)
                    yield pd.DataFrame(dict(zip(fields, (
                        list(row["ids"][a:b]), list(row["learns"][a:b]), each, [int((known[s] > 0).sum()) + int(ends > 0) for s in own],
                        [float(gain[s].sum()) + end_gain for s in own], -total_bits * math.log10(2), np.add.reduceat(length, begin)))))

    told = base.select("block", "ids", "learns", "sizes", "stream", "words", "hashes", "keys").join(vocabulary.answers(told_keys, "priced"), "block").join(vocabulary.answers(told_words), "block", "left")
    rated = told.mapInPandas(rate, "id string, learns boolean, n_tokens long, n_known long, base_score double, score double, bytes long")
    return rated.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("learns").alias(learns), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                        "base_score", "score", (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))
