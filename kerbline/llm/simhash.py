"""SimHash near-duplicates: pigeonhole blocks of fingerprints, then Hamming distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kerbline.llm.common import WORD, column, components, free_name, partitions
from kerbline.session import written

SEED = 42
#: Runs up to this length are compared many at once.
SHORT = 24


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``words`` words, repeats included: A-Z lower-cased, words joined by one space.

    Fewer words give one shingle of all of them, no words give none. ``bytes.split`` parts at the six blanks of ASCII.
    """
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - words + 1].tolist(), (ends[words - 1:] - 1).tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(parts) - words + 1)


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit words for each hash, the first one the hash itself."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for i in range(1, lanes):
        x = h + np.uint64((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, words: int, lanes: int = 1) -> bytes:
    """``8 * lanes`` bytes, highest bit first: a bit is 1 if set in over half of the hashes. No words: all zero."""
    h = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), words)
    ones = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(_lanes(h[i:i + 4096], lanes).astype(">u8").view(np.uint8).reshape(-1, 8 * lanes), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(text: Column, words: int, lanes: int = 1) -> Column:
    """Binary column of fingerprints of whole texts; null counts as empty."""

    @F.pandas_udf("binary")
    def compute(texts: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series([fingerprint(t, words, lanes) for t in texts], dtype=object)

    return compute(text)


def _forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Index pairs at Hamming distance ``most`` or less that span each linked group of ``prints`` (rows of uint64)."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if int(np.bitwise_count(prints[0] ^ prints[1]).sum()) <= most else []
    root, links = list(range(n)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]).sum(axis=1) <= most)
        for j in near.tolist():
            a, b = find(i), find(i + 1 + j)
            if a != b:
                root[b] = a
                links.append((i, i + 1 + j))
    return links


def _nearest_forest(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """As :func:`_forest`, from the closest pairs: a group grows by its nearest row, so a far link stands only where no near ones lead."""
    n = len(prints)
    out: list[tuple[int, int]] = []
    left = np.ones(n, bool)
    gap, via = np.full(n, 1 << 30), np.zeros(n, np.int64)
    for _ in range(n):
        at = int(np.argmin(np.where(left, gap, 1 << 31)))
        if gap[at] <= most:
            out.append((int(via[at]), at))
        left[at] = False
        new = np.bitwise_count(prints ^ prints[at]).sum(axis=1, dtype=np.int64)
        closer = left & (new < gap)
        gap[closer], via[closer] = new[closer], at
    return out


def _exact_forest(prints: np.ndarray, most: int, free: list[int], whole: int = 1024) -> list[tuple[int, int]]:
    """As :func:`_forest` for one-lane fingerprints that differ in the bits ``free`` only.

    A long run is split again by the same principle: of ``most + 1`` slices of the free bits a close pair shares one, so
    each slice's values part the run into smaller ones, until they are short or no bits are left to split.
    """
    if len(prints) <= whole or len(free) <= most + 1:
        return _forest(prints, most)
    links: list[tuple[int, int]] = []
    for cut in np.array_split(np.array(free), most + 1):
        mask = np.uint64(sum(1 << int(b) for b in cut))
        key = prints[:, 0] & mask
        order = np.argsort(key, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                rest = [b for b in free if b not in set(cut.tolist())]
                links += [(int(part[a]), int(part[b])) for a, b in _exact_forest(prints[part], most, rest, whole)]
    return links


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal ``keys`` together, from batches sorted by them; runs of one row are left out in bulk."""
    held: list[pd.DataFrame] = []
    for pdf in itertools.chain(batches, [None]):
        if pdf is not None and not len(pdf):
            continue
        if held and (pdf is None or any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys)):
            whole, held = pd.concat(held, ignore_index=True), []
            if len(whole) > 1:
                yield whole
        if pdf is None:
            return
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(pdf)))
        if held and len(starts) == 1:
            held.append(pdf)
            continue
        if held:
            first = pd.concat([*held, pdf.iloc[:sizes[0]]], ignore_index=True)
            starts, sizes, held = starts[1:], sizes[1:], []
            if len(first) > 1:
                yield first
        for s, n in zip(starts[:-1].tolist(), sizes[:-1].tolist()):
            if n > 1:
                yield pdf.iloc[s:s + n]
        held = [pdf.iloc[starts[-1]:]]


def _short_links(pdf: pd.DataFrame, keys: list[str], lanes: int, most: int) -> tuple[list, list, np.ndarray]:
    """Links within the runs of up to ``SHORT`` rows of a sorted frame, and which rows lie in longer ones.

    Rows are compared with the row one, two, ... places on, all rows of the frame at once."""
    n = len(pdf)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    long = sizes[run] > SHORT
    prints = np.frombuffer(b"".join(pdf["print"]), ">u8").astype(np.uint64).reshape(-1, lanes)
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    gaps: list[np.ndarray] = []
    for lag in range(1, min(SHORT, int(sizes.max(initial=1)))):
        i = np.flatnonzero((run[lag:] == run[:-lag]) & ~long[lag:])
        if not len(i):
            break
        gap = np.bitwise_count(prints[i] ^ prints[i + lag]).sum(axis=1)
        near = gap <= most
        first.append(i[near])
        second.append(i[near] + lag)
        gaps.append(gap[near])
    a, b, gap = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, second, gaps))
    # A forest of each run, from its closest links on.
    order = np.argsort(gap, kind="stable")
    a, b = a[order], b[order]
    root: dict[int, int] = {}
    nodes = pdf["node"].to_numpy()
    out_a, out_b = [], []

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            out_a.append(nodes[i])
            out_b.append(nodes[j])
    return out_a, out_b, long


def _linked(keyed: DataFrame, lanes: int, most: int, forest: Callable[[np.ndarray, int], list[tuple[int, int]]],
            keys: tuple[str, ...] = ("tab", "key"), longest: int | None = None) -> DataFrame:
    """Links ``(a, b)``, one for each run that gives it, within the runs of ``keyed(tab int, key long, node, print binary)``: sorted, then run by run.

    Short runs are compared many at once, long ones by ``forest`` one by one. With ``longest`` a run of more rows is neither
    held nor compared: one row ``(a, b, tab, key, size)`` of it has its ``size``, which is 0 in links."""
    kind = dict(keyed.dtypes)["node"]
    keys = list(keys)
    bound = math.inf if longest is None else longest

    def whole_runs(batches: Iterator[pd.DataFrame], over: list[tuple]) -> Iterator[pd.DataFrame]:
        """Frames that end where a run ends; of a run over the bound its last row and length go to ``over``."""
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= bool(held) and held[-1][k].iloc[-1] != v[0]
            starts = np.flatnonzero(new)
            if len(starts):
                if size > bound:
                    over.append((held[-1].iloc[-1], size + int(starts[0])))
                    held, pdf, starts = [], pdf.iloc[starts[0]:], starts - starts[0]
                if held or starts[-1]:
                    yield pd.concat([*held, pdf.iloc[:starts[-1]]], ignore_index=True)
                held, size = [], 0
                pdf = pdf.iloc[starts[-1]:]
            held.append(pdf)
            size += len(pdf)
            if size > bound:
                held = [pdf.iloc[-1:]]
        if size > bound:
            over.append((held[-1].iloc[-1], size))
        elif held:
            yield pd.concat(held, ignore_index=True)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        over: list[tuple] = []
        for pdf in whole_runs(batches, over):
            a, b, long = _short_links(pdf, keys, lanes, most)
            for run in _runs(iter([pdf[long]]), keys):
                if len(run) > bound:
                    over.append((run.iloc[-1], len(run)))
                    continue
                nodes = run["node"].to_numpy()
                prints = np.frombuffer(b"".join(run["print"]), ">u8").astype(np.uint64).reshape(-1, lanes)
                for i, j in forest(prints, int(run["tab"].iloc[0])):
                    a.append(nodes[i])
                    b.append(nodes[j])
            if a:
                yield pd.DataFrame({"a": a, "b": b} if longest is None else {"a": a, "b": b, "tab": np.int32(-1), "key": np.int64(0), "size": np.int64(0)})
        if over:
            yield pd.DataFrame([(r["node"], r["node"], r["tab"], r["key"], n) for r, n in over], columns=["a", "b", "tab", "key", "size"])

    dealt = keyed.repartition(partitions(keyed), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(link, f"a {kind}, b {kind}" + ("" if longest is None else ", tab int, key long, size long"))


def block_links(prints: DataFrame, most: int, blocks: int) -> DataFrame:
    """Links ``(a, b)`` that span every group of 64-bit fingerprints within ``most`` bits; exact.

    ``prints(node long, print binary)`` holds distinct fingerprints. The bits are split into ``blocks`` blocks. Two
    fingerprints that differ in at most ``most`` bits agree in ``blocks - most`` blocks at least, so each choice of so many
    blocks is a table in which they meet. Rows that agree in a table meet in one run, where the distance is checked. A run
    holds distinct fingerprints that differ in the bits outside its blocks only, so it has at most 2 to the power of those
    (2**22 for 6 blocks and 2 bits): a bound of memory, whatever the data. Each run gives a spanning forest, never all pairs.
    """
    cuts = [list(map(int, c)) for c in np.array_split(np.arange(64), blocks)]
    tables = list(itertools.combinations(range(blocks), blocks - most))
    masks = [sum(1 << b for i in t for b in cuts[i]) for t in tables]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    frees = [[b for i in range(blocks) if i not in t for b in cuts[i]] for t in tables]
    value = F.conv(F.hex("print"), 16, -10).cast("long")
    keyed = (prints.select("node", "print", value.alias("v"))
             .select("node", "print", "v", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("tab", "mask"))
             .select("tab", F.expr("v & mask").alias("key"), "node", "print"))
    return _linked(keyed, 1, most, lambda p, tab: _exact_forest(p, most, frees[tab])).distinct()


def wide_plan(nodes: int, lanes: int, difference: float, missed: float) -> tuple[int, int]:
    """Bits of a block and number of blocks for :func:`wide_links`: runs of about four unrelated rows at any size.

    A pair's differing bits follow the binomial law of ``64 * lanes`` bits that each differ with chance ``difference``; as many
    blocks are taken as keep its chance to share none, averaged over that law, at ``missed`` or less.
    """
    total = 64 * lanes
    bits = min(60, max(10, math.ceil(math.log2(max(nodes, 2))) - 2))
    law = np.array([math.comb(total, x) * difference ** x * (1 - difference) ** (total - x) for x in range(total + 1)])
    apart = np.array([1 - math.comb(total - x, bits) / math.comb(total, bits) for x in range(total + 1)])
    count = 1
    while float(law @ apart ** count) > missed:
        count += 1
    return bits, count


def wide_links(prints: DataFrame, lanes: int, most: int, difference: float, missed: float = 0.02, chunk: int = 4096) -> DataFrame:
    """Links ``(a, b, met)`` between fingerprints of ``64 * lanes`` bits within ``most`` bits, for wide distances.

    ``met`` counts the runs that give the link, more for closer pairs.

    At distances of a seventh of all bits no split has few tables and sure blocks, so blocks are drawn from the bits by
    a fixed generator, as wide as the table's size asks for, and as many as let a pair whose bits differ with chance ``difference``
    meet in none with probability ``missed`` (:func:`wide_plan`). Every pair of a run is compared: a run of more than ``chunk`` rows
    is dealt by hash into parts of a quarter of that, and each two parts meet in a task of their own, so that none holds
    or compares more than about half a chunk. Only spanning forests leave a run or two parts.
    """
    n = prints.count()
    bits, count = wide_plan(n, lanes, difference, missed)
    rng = np.random.default_rng(20240)
    picks = np.array([rng.choice(64 * lanes, bits, replace=False) for _ in range(count)])
    weights = (np.int64(1) << np.arange(bits, dtype=np.int64))
    kind = dict(prints.dtypes)["node"]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at:at + 2000]
                unpacked = np.unpackbits(np.frombuffer(b"".join(part["print"]), np.uint8).reshape(len(part), 8 * lanes), axis=1)
                for tab, pick in enumerate(picks):
                    yield pd.DataFrame({"tab": np.full(len(part), tab, np.int32), "key": unpacked[:, pick].astype(np.int64) @ weights,
                                        "node": part["node"].to_numpy(), "print": part["print"].to_numpy()})

    def forest(p: np.ndarray, tab: int) -> list[tuple[int, int]]:
        return _nearest_forest(p, most)

    def counted(links: DataFrame) -> DataFrame:
        return links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("met"))

    keyed = prints.select("node", "print").mapInPandas(keys, f"tab int, key long, node {kind}, print binary")
    found = written(_linked(keyed, lanes, most, forest, longest=chunk), "near-runs")
    links, long = found.filter("size = 0").select("a", "b"), found.filter("size > 0")
    if long.isEmpty():
        return counted(links)
    long = long.select("tab", "key", F.expr(f"cast(ceil(size * 4 / {chunk}) as int)").alias("parts"))
    placed = keyed.join(long, ["tab", "key"]).withColumn("part", F.expr("cast(pmod(xxhash64(node, 5), parts) as int)"))
    # A part meets each other part, and its own rows meet there too.
    met = (placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).filter("other <> part")
           .select("tab", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "print"))
    return counted(links.union(_linked(met, lanes, most, forest, ("tab", "key", "low", "high"))))


def classes(rows: DataFrame, key: str, print_column: str) -> DataFrame:
    """One row per distinct fingerprint: ``(print, rep)`` with the smallest key; rows of one fingerprint meet summed."""
    return rows.groupBy(column(print_column).alias("print")).agg(F.min(column(key)).alias("rep"))


def hamming_components(docs: DataFrame, key: str, text: str, words: int = 3, most: int = 2, blocks: int = 6) -> DataFrame:
    """``(key, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints of 64 bits link at ``most`` or fewer differing bits; ``component_id`` is the smallest key that links reach.
    Null and blank texts have the fingerprint zero, which links like any other. Equal fingerprints are one class
    before any join, so copies cost nothing. Null keys are rows like others and count only if their class has no other.
    """
    prints = written(docs.select(column(key), fingerprints(column(text), words).alias("print")), "simhash-prints")
    reps = written(classes(prints, key, "print").withColumn("node", F.conv(F.hex("print"), 16, -10).cast("long")), "simhash-classes")
    found = components(block_links(reps, most, blocks), "simhash")
    joined = reps.join(found, "node", "left").select("print", "rep", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = joined.join(least, "root").select("print", "component_id")
    return prints.join(by_print, "print").select(column(key), F.lower(F.hex("print")).alias("fingerprint"), "component_id")


def bit_difference(similarity: float) -> float:
    """Share of differing bits to expect at a Jaccard similarity: the angle of two shingle sets of one size, over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shingle_sets(text: Column, words: int) -> Column:
    """Binary column of the distinct shingle hashes of whole texts, sorted, eight bytes each."""

    @F.pandas_udf("binary")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes((t or "").encode(), words)).tobytes() for t in texts], dtype=object)

    return compute(text)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows ``(a, b)`` of ``pairs`` whose shingle sets have that Jaccard similarity or more; two empty sets are alike.

    Sizes too far apart settle a pair before its sets are moved."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> bool:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            return shared >= similarity * (len(p) + len(q) - shared)

        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype=bool)

    sizes = sets.select("node", "size")
    sized = (pairs.select("a", "b").join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
             .filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")).select("a", "b"))
    left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"hashes_{c}")) for c in "ab")
    return sized.join(left, "a").join(right, "b").filter(alike("hashes_a", "hashes_b")).select("a", "b")


def confirmed(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, root)`` of the components of those ``links(a, b, met)`` that exact Jaccard similarity confirms.

    Texts are compared in three passes, since most links lie within a component that fewer of them span: first the closest
    link of each node, then the closest between each two components so far, then all that still lead from one to another.
    A link is left uncompared only where confirmed ones already join its ends.
    """
    links = written(links, "near-candidates")
    closeness = F.struct(F.col("met"), -F.xxhash64("a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "met")
    closest = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), closeness).alias("l")).select("l.a", "l.b").distinct()
    tried = written(closest, "near-tried")
    good = written(_similar(tried, sets, similarity), "near-good")
    for last in (False, True):
        roots = components(good, "near")
        apart = (links.join(tried, ["a", "b"], "left_anti")
                 .join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
                 .withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b")).filter("root_a <> root_b"))
        if not last:
            two = (F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high"))
            apart = apart.groupBy(*two).agg(F.max_by(F.struct("a", "b"), closeness).alias("l")).select("l.a", "l.b")
        next_ones = written(apart.select("a", "b"), "near-tried")
        if next_ones.isEmpty():
            return roots
        good = written(good.union(_similar(next_ones, sets, similarity)), "near-good")
        tried = tried.union(next_ones)
    return components(good, "near")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest key (then the least text hash).

    Fingerprints of ``64 * lanes`` bits over shingles of ``words`` words are candidates if they differ in no more bits than texts of
    the given similarity do, plus two and a half standard deviations; candidates link if the Jaccard similarity of their
    shingle sets is that high. Blank and null texts are alike. Repeated rows are copies, one stays. A null key comes after
    all others. Columns of any name pass through; an empty table gives no rows.
    """
    bits, p = 64 * lanes, bit_difference(similarity)
    most = int(bits * p + 2.5 * math.sqrt(bits * p * (1 - p)))
    mark, k, m = (free_name(docs, n) for n in ("text_hash", "stay_key", "stay_mark"))
    hashed = docs.withColumn(mark, F.xxhash64(F.when(column(text).rlike(WORD), column(text))))
    prints = written(hashed.select(column(key).alias("key"), column(mark).alias("node"), fingerprints(column(text), words, lanes).alias("print")), "near-prints")
    order = F.struct(F.col("key").isNull().alias("n"), F.col("key"))
    reps = written(prints.groupBy("node").agg(F.min("print").alias("print"), F.min(order).alias("first")), "near-classes")
    links = written(wide_links(reps, lanes, most, p), "near-links")
    linked = links.select(F.explode(F.array("a", "b")).alias(m)).distinct()
    texts = hashed.select(column(mark).alias("node"), column(text).alias("text")).join(linked.withColumnRenamed(m, "node"), "node", "left_semi")
    sets = texts.dropDuplicates(["node"]).select("node", shingle_sets(F.col("text"), words).alias("hashes"))
    sets = written(sets.withColumn("size", (F.octet_length("hashes") / 8).cast("long")), "near-sets")
    found = confirmed(links, sets, similarity)
    least = F.struct("first.n", "first.key", "node")
    stay = (reps.join(found, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min(least).alias("rep"))
            .select(F.col("rep.key").alias(k), F.col("rep.node").alias(m)))
    kept = hashed.join(stay, column(key).eqNullSafe(column(k)) & (column(mark) == column(m)), "left_semi")
    return kept.dropDuplicates([key, mark]).drop(mark)
