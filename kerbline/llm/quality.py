"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and perplexity limits by language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.common import column, free_name
from kerbline.session import written

#: Units are UTF-16 code units, so that four of them are one exact 64-bit key.
ORDER = 4
START, END = 2, 3
FRAME_ROWS = 64
#: Rows of a file that ask for their 4-grams together and meet them in one task.
BLOCK_ROWS = 8192
_MASKS = {3: (1 << 48) - 1, 2: (1 << 32) - 1, 1: (1 << 16) - 1}
_FRAME = pa.schema([("block", pa.int64()), ("frame", pa.int64()), ("places", pa.list_(pa.int64())), ("ids", pa.list_(pa.string())),
                    ("langs", pa.list_(pa.string())), ("lens", pa.list_(pa.int64())), ("texts", pa.binary())])
_FRAME_SQL = "block long, frame long, places array<long>, ids array<string>, langs array<string>, lens array<long>, texts binary"
_SCORE = pa.schema([("id", pa.string()), ("lang", pa.string()), ("text_hash", pa.int64()), ("units", pa.int64()), ("bits", pa.float64()), ("blank", pa.bool_())])
_BLANKS = b" \t\n\r\x0b\x0c"


def grams(text: bytes) -> np.ndarray:
    """Every 4-gram of a UTF-8 text as int64 keys: one for each code unit and one for the end, after three start marks."""
    u = np.frombuffer(text.decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    u = np.concatenate([np.full(3, START, np.uint64), u, np.full(1, END, np.uint64)])
    return ((u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]).view(np.int64)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a Parquet table as it lies in its files, else a written copy of that kind.

    The passes name a row by its file and its number in the file, which do not depend on how Spark cuts files into tasks.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if plain and "row_index" in docs.select(docs.metadataColumn("_metadata").alias("m")).schema["m"].dataType.names else written(docs, "quality-docs")


def _frames(docs: DataFrame, key: str, lang: str, text: str | None) -> DataFrame:
    """Frames of 64 rows of a file, in blocks of :data:`BLOCK_ROWS`; texts packed and compressed, or left out.

    A frame that two tasks share comes in two parts; ``places`` has the rows' places in the frame.
    """
    meta = docs.metadataColumn("_metadata")
    rows = docs.select(column(key).cast("string").alias("id"), column(lang).cast("string").alias("lang"), meta["file_path"].alias("path"), meta["row_index"].alias("row"),
                       *([column(text).alias("text")] if text else []))
    rows = rows.withColumn("block", F.xxhash64("path", F.expr(f"row div {BLOCK_ROWS}"))).drop("path")

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        held: list[tuple] = []

        def cut() -> pa.RecordBatch:
            raw = [None if h[4] is None else h[4].encode("utf-8", "surrogatepass") for h in held]
            out = [[held[0][0]], [held[0][1] // FRAME_ROWS], [[h[1] % FRAME_ROWS for h in held]], [[h[2] for h in held]], [[h[3] for h in held]],
                   [[-1 if r is None else len(r) for r in raw]], [pack.compress(b"".join(r or b"" for r in raw)) if text else b""]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _FRAME)], schema=_FRAME)

        for batch in batches:
            c = batch.to_pydict()
            for row in zip(c["block"], c["row"], c["id"], c["lang"], c["text"] if text else [None] * batch.num_rows):
                if held and (held[0][0] != row[0] or held[0][1] // FRAME_ROWS != row[1] // FRAME_ROWS):
                    yield cut()
                held.append(row)
        if held:
            yield cut()

    return rows.mapInArrow(frame, _FRAME_SQL)


def _texts(lens: list[int], packed: bytes) -> Iterator[bytes | None]:
    raw, at = zstandard.ZstdDecompressor().decompress(packed) if len(packed) else b"", 0
    for n in lens:
        yield None if n < 0 else raw[at:at + n]
        at += max(int(n), 0)


def block_grams(docs: DataFrame, trusted: DataFrame, key: str, lang: str, text: str) -> DataFrame:
    """``(block, gram, n)``: each 4-gram of a block once or a few times, and how often trusted documents of it have it.

    Which documents of a frame are trusted comes as one 64-bit mask per frame, joined by frame; Spark ships that table
    (24 bytes per 64 documents) whole if it is small and shuffles if not. Texts are counted where they are read.
    """
    ids = (_frames(docs, key, lang, None).select("block", "frame", F.explode(F.arrays_zip("places", "ids")).alias("x"))
           .select("block", "frame", F.col("x.places").cast("int").alias("at"), F.col("x.ids").alias("id")))
    masks = written(ids.join(trusted.select(column(key).cast("string").alias("id")).distinct(), "id").groupBy("block", "frame")
                    .agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")), "quality-masks")
    framed = _frames(docs, key, lang, text).join(masks, ["block", "frame"], "left").select("block", "places", "lens", "texts", F.coalesce("mask", F.lit(0)).alias("mask"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []
        other: list[np.ndarray] = []
        block, size = None, 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate([*kept, np.empty(0, np.int64)]), return_counts=True)
            rest = np.setdiff1d(np.concatenate([*other, np.empty(0, np.int64)]), keys)
            kept.clear(), other.clear()
            return pd.DataFrame({"block": np.full(len(keys) + len(rest), block, np.int64), "gram": np.concatenate([keys, rest]),
                                 "n": np.concatenate([n, np.zeros(len(rest), np.int64)])})

        for pdf in batches:
            for b, places, lens, texts, mask in zip(pdf["block"], pdf["places"], pdf["lens"], pdf["texts"], pdf["mask"].tolist()):
                if size and (b != block or size > 4_000_000):
                    yield flush()
                    size = 0
                block = b
                for i, t in zip(map(int, places), _texts(lens, texts)):
                    if t is not None:
                        g = grams(t)
                        (kept if mask >> i & 1 else other).append(g)
                        size += len(g)
        if size:
            yield flush()

    return framed.mapInPandas(count, "block long, gram long, n long")


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from how many grams have counts 1 to 4; at most the count.

    Where a table cannot tell (none of a count, or nothing left to take off), half the count is taken off: some mass always
    goes to what was not seen, so that no unit has probability zero."""
    row = counts.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()
    y = row[0] / (row[0] + 2 * row[1]) if row[0] else 0.0
    told = [i - (i + 1) * y * row[i] / row[i - 1] if row[0] and row[i - 1] and row[i] else 0.0 for i in (1, 2, 3)]
    return [min(d, float(i)) if d > 0 else i / 2 for i, d in enumerate(told, 1)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def log_probabilities(asked: DataFrame) -> DataFrame:
    """``(gram, bits)`` for ``asked(gram, n)``: minus log2 of the model's probability of the last unit after the first three.

    ``n`` counts a 4-gram in trusted text (0: not seen there). Lower orders count how many different units come before, from
    the 4-grams themselves. All counts are joined by gram, sharded by Spark; tables of single units have 65,536 rows at
    most and are broadcast. Without trusted text every unit is as likely as any other.
    """
    tables = {ORDER: written(asked.filter("n > 0").select("gram", "n"), "quality-order4")}
    for order in (3, 2, 1):
        low = tables[order + 1].groupBy(F.expr(f"gram & {_MASKS[order]}L").alias("gram")).agg(F.count("*").alias("n"))
        tables[order] = written(low, f"quality-order{order}")
    out = asked.select("gram")
    units = tables[1].count() + 1
    out = out.withColumn("p", F.lit(1.0 / units))
    for order in (1, 2, 3, ORDER):
        d = _discounts(tables[order])
        held = [F.count_if(F.col("n") == 1) * F.lit(d[0]), F.count_if(F.col("n") == 2) * F.lit(d[1]), F.count_if(F.col("n") >= 3) * F.lit(d[2])]
        suffix = F.col("gram") if order == ORDER else F.expr(f"gram & {_MASKS[order]}L")
        seen = tables[order].select(F.col("gram").alias("seen"), (F.col("n") - F.least(F.col("n"), _discount(d))).alias("left"))
        total = tables[order].groupBy(F.expr("shiftrightunsigned(gram, 16)").alias("context")).agg(F.sum("n").alias("total"), sum(held[1:], held[0]).alias("shared"))
        small = F.broadcast if order == 1 else lambda x: x
        few = F.broadcast if order <= 2 else lambda x: x
        out = (out.withColumn("suffix", suffix).withColumn("before", F.expr("shiftrightunsigned(suffix, 16)"))
               .join(small(seen), F.col("suffix") == F.col("seen"), "left").join(few(total), F.col("before") == F.col("context"), "left")
               .select("gram", F.when(F.col("total").isNull(), F.col("p"))
                       .otherwise((F.coalesce("left", F.lit(0.0)) + F.col("shared") * F.col("p")) / F.col("total")).alias("p")))
    return out.select("gram", (-F.log2("p")).cast("float").alias("bits"))


def score(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``(key, lang, text_hash, units, bits, blank)``, one row per row of ``docs``: 4-grams of its text, their bits under the model.

    The model counts every text of ``docs`` whose key is in ``trusted``, whole. Each block of rows asks for its own
    4-grams once, gets their bits by joins, and meets its texts again in one task: what a task holds is bounded by the
    block, and the shuffled texts are compressed. Rows are known by file and row number, so that every pass has the same blocks
    however its tasks are cut; a 4-gram without an answer is an error. Null text has 0 units. ``text_hash`` is Spark's ``xxhash64`` of the text.
    """
    docs = scanned(docs)
    asked = written(block_grams(docs, trusted, key, lang, text).groupBy("block", "gram").agg(F.sum("n").alias("n")), "quality-asked")
    model = written(log_probabilities(written(asked.groupBy("gram").agg(F.sum("n").alias("n")), "quality-grams")), "quality-bits")
    answers = asked.select("block", "gram").join(model, "gram")

    def rate(frames: pa.Table, answers: pa.Table) -> pa.Table:
        known, cost = answers.column("gram").to_numpy(), answers.column("bits").to_numpy().astype(np.float64)
        order = np.argsort(known)
        known, cost = known[order], cost[order]
        out: dict[str, list] = {f.name: [] for f in _SCORE}
        for batch in frames.to_batches(max_chunksize=64):
            c = batch.to_pydict()
            for ids, langs, lens, texts in zip(c["ids"], c["langs"], c["lens"], c["texts"]):
                out["id"] += ids
                out["lang"] += langs
                for t in _texts(lens, texts):
                    g = grams(t) if t is not None else np.empty(0, np.int64)
                    digest = xxhash.xxh64_intdigest(t, 42) if t is not None else 42
                    out["text_hash"].append(digest - (1 << 64) if digest >> 63 else digest)
                    out["units"].append(len(g))
                    at = np.searchsorted(known, g)
                    if len(g) and (not len(known) or at.max() == len(known) or not np.array_equal(known[at], g)):
                        raise RuntimeError("a block's texts hold 4-grams that it did not ask for")
                    out["bits"].append(float(cost[at].sum()) if len(g) else 0.0)
                    out["blank"].append(t is None or not t.strip(_BLANKS))
        return pa.Table.from_pydict(out, schema=_SCORE)

    framed = _frames(docs, key, lang, text).groupBy("block")
    rated = framed.cogroup(answers.groupBy("block")).applyInArrow(rate, "id string, lang string, text_hash long, units long, bits double, blank boolean")
    return rated.select(F.col("id").cast(docs.schema[key].dataType).alias(key), F.col("lang").alias(lang), "text_hash", "units", "bits", "blank")


def classify(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text",
             quantile: float = 0.995, prior_units: int = 32, prior_texts: int = 32) -> DataFrame:
    """``(key, lang, text_hash, units, perplexity, smoothed_bits, limit_bits, kept)``, one row per row of ``docs``.

    Four of five trusted documents (by a hash of their key) train the model, the fifth sets the limits: in each language
    the ``quantile`` of their bits per unit, drawn toward the language's median by ``prior_units`` units of it, so that a
    text of one word is not judged by its few units. A language's median and limit (null is one) are its own at every size,
    drawn toward those of all languages together by ``prior_texts`` texts of them, so that few texts move them little and no
    count switches them; without any such document the limit is null and every text with words is kept. Null texts and texts
    of blanks alone are never kept; their perplexity is null. Copies of a row get the same result each.
    """
    held = F.crc32(column(key).cast("string")) % 5 == 0
    trusted = trusted.select(column(key)).filter(column(key).isNotNull()).distinct()
    rows = written(score(docs, trusted.filter(~held), key, lang, text), "quality-scores").withColumn("per_unit", F.expr("try_divide(bits, units)"))
    judges = rows.filter(~F.col("blank")).join(trusted.filter(held), key)
    everywhere = judges.agg(F.percentile_approx("per_unit", 0.5, 10_000).alias("median")).first()

    def drawn(frame: DataFrame, value: str, share: float, pooled: float | None, name: str) -> DataFrame:
        own = frame.groupBy(F.col(lang).alias("l")).agg(F.percentile_approx(value, share, 10_000).alias("own"), F.count("*").alias("n"))
        return own.select("l", ((F.col("own") * F.col("n") + F.lit(pooled).cast("double") * prior_texts) / (F.col("n") + prior_texts)).alias(name))

    middle = written(drawn(judges, "per_unit", 0.5, everywhere["median"], "median"), "quality-medians")

    def smooth(frame: DataFrame) -> DataFrame:
        median = F.coalesce("median", F.lit(everywhere["median"]).cast("double"), F.lit(0.0))
        return (frame.join(middle, column(lang).eqNullSafe(F.col("l")), "left").drop("l")
                .withColumn("smoothed_bits", (F.col("bits") + median * prior_units) / (F.col("units") + prior_units)).drop("median"))

    smoothed = smooth(judges)
    whole = smoothed.agg(F.percentile_approx("smoothed_bits", quantile, 10_000).alias("limit")).first()["limit"]
    limit = written(drawn(smoothed, "smoothed_bits", quantile, whole, "limit"), "quality-limits")
    out = smooth(rows).join(limit, column(lang).eqNullSafe(F.col("l")), "left")
    bound = F.coalesce("limit", F.lit(whole).cast("double"))
    return out.select(key, lang, "text_hash", "units", F.when(~F.col("blank"), F.pow(F.lit(2.0), "per_unit")).alias("perplexity"),
                      F.when(~F.col("blank"), F.col("smoothed_bits")).alias("smoothed_bits"), bound.alias("limit_bits"),
                      (~F.col("blank") & F.coalesce(F.col("smoothed_bits") <= bound, F.lit(True))).alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", **limits: float) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, all columns and repeated rows as they were."""
    mark, k, l, h = (free_name(docs, n) for n in ("text_hash", "stay_key", "stay_lang", "stay_hash"))
    stay = classify(docs, trusted, key, lang, text, **limits).filter("kept").select(column(key).alias(k), column(lang).alias(l), F.col("text_hash").alias(h))
    return (docs.withColumn(mark, F.xxhash64(column(text)))
            .join(stay, column(key).eqNullSafe(column(k)) & column(lang).eqNullSafe(column(l)) & (column(mark) == column(h)), "left_semi").drop(mark))
