"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

A string of LENGTH bytes is read as SYMBOLS symbols of STEP bytes, so that the
suffixes at every byte are suffixes over that alphabet.  A shard's transform is
built from its own suffixes; the shards are then merged by refining their
interleave: starting from the shards in a row, each pass walks the interleave,
takes the symbols before the suffixes, and deals the entries stably by symbol,
which orders all suffixes by one symbol more.  The pass at which two neighbours
part is their longest common prefix; after SYMBOLS passes, neighbours that have
not parted are intervals of strings that occur twice or more.  Suffixes are
never sorted anew over all shards.

What reaches the transforms is narrowed exactly.  Each window of LENGTH bytes
is owned by its leftmost smallest gram (by hash), so equal windows are owned by
equal grams at equal offsets: a gram that occurs once owns nothing repeated,
and grams whose whole owned stretch is equal repeat it throughout.  Only grams
that occur in differing stretches go on, one stretch of each kind, dealt by
gram; and of these only stretches that share the SIDE bytes before or after the
gram with another, since each window holds one of the two.  A gram with more than HOT kinds would be one task's burden; its windows
are instead counted by fingerprint over all tasks, which gives the same.

Defined cases: texts are UTF-8 bytes, null is empty; matches stay within a
text; rows repeated (same id and text) are texts of their own, so that they
repeat each other; a null id stays null, and such documents are told apart by
text; no text is too long, as positions are per text; columns of other names are
left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, cut, drop_cut, spread_join, table, texts_of
from lexmill.llm.neardup import mix

LENGTH, STEP, GRAM = 400, 40, 32
#: A window holds so many bytes next to its gram on one side, at least.
SIDE = (LENGTH - GRAM) // 2
SYMBOLS = LENGTH // STEP
HOT = 4096
#: Bytes of stretches merged at once in a task, and in how many shards.
BLOCK, SHARDS = 1 << 20, 4
DOC = ["doc_id", "th"]

_BYTE = np.random.default_rng(977).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the ``size``-byte strings at each place; size is 32 or 40."""
    if data.size < size:
        return np.empty(0, np.uint64)
    h = _BYTE[data]
    eight = None
    for k in range(5):
        if k == 3:
            eight = h
        w = 1 << k
        h = h[:-w] * _ODD[k] + h[w:]
    if size == GRAM + 8:
        h = h[: data.size - size + 1] * _ODD[5] + eight[GRAM : GRAM + data.size - size + 1]
    return mix(h)


def owners(data: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram place, first, last window) of every gram that owns windows."""
    n = data.size - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    width, m = LENGTH - GRAM + 1, grams.size
    bits = np.uint64(max(20, int(m - 1).bit_length()))
    packed = (grams >> bits << bits) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = packed
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], first, np.append(first[1:], n) - 1


def anchors(texts: DataFrame) -> DataFrame:
    """For every owning gram: its hash, hashes of the stretch of its windows and of the SIDE bytes before and after it
    (0 where no owned window holds them), the text's key, first and last window, the gram's place."""

    def run(batches):
        import pyarrow.compute as pc
        import xxhash

        for batch in batches:
            ids, th = batch.column(0), batch.column(1)
            values = pc.cast(batch.column(2), pa.binary())
            rows, parts, stretch, left, right = [], [], [], [], []
            size = 0

            def out():
                flat = np.concatenate(parts, axis=1) if parts else np.empty((4, 0), np.int64)
                take = pa.array(np.repeat(np.array([r for r, _ in rows], np.int64), [k for _, k in rows]), pa.int64())
                hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (stretch, left, right)]
                return pa.RecordBatch.from_arrays([pa.array(flat[0]), *hashes, ids.take(take), th.take(take), *(pa.array(x.astype(np.int32)) for x in flat[1:])], names=["gram", "stretch", "before", "after", "doc_id", "th", "first", "last", "place"])

            for r in range(batch.num_rows):
                raw = values[r].as_py()
                if len(raw) < LENGTH:
                    continue
                data = np.frombuffer(raw, np.uint8)
                grams = gram_hashes(data, GRAM)
                place, first, last = owners(data, grams)
                rows.append((r, place.size))
                parts.append(np.stack([grams[place].view(np.int64), first, last, place]))
                stretch += [xxhash.xxh3_64_intdigest(raw[f : e + LENGTH], seed=p - f) for p, f, e in zip(place.tolist(), first.tolist(), last.tolist())]
                left += [xxhash.xxh3_64_intdigest(raw[p - SIDE : p]) | 1 if p - SIDE >= f else 0 for p, f in zip(place.tolist(), first.tolist())]
                right += [xxhash.xxh3_64_intdigest(raw[p + GRAM : p + GRAM + SIDE]) | 1 if p - SIDE <= e else 0 for p, e in zip(place.tolist(), last.tolist())]
                size += place.size
                if size > 50_000:
                    yield out()
                    rows, parts, stretch, left, right, size = [], [], [], [], [], 0
            yield out()

    return texts.select("doc_id", "th", "text").mapInArrow(run, "gram long, stretch long, before long, after long, doc_id long, th long, first int, last int, place int")


def stable_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers below 2**32, in two counting passes."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    high = (keys >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Shard:
    """Suffixes of some stretches in order, and the transform: the symbol before each suffix.

    A stretch of n bytes has places 0 to n; each of the STEP strings of symbols in it ends at one of its last STEP places,
    where the symbol is 0.  Ends come before all symbols, in order of place.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        """``symbols``: ids from 1 of all places, 0 for ends; ``sizes``: places of each stretch."""
        n = symbols.size
        places = np.arange(n)
        stops = np.repeat(np.cumsum(sizes), sizes)
        starts = stops - np.repeat(sizes, sizes)
        ends = int((symbols == 0).sum())
        rank = np.where(symbols > 0, symbols + ends, 0)
        rank[symbols == 0] = np.arange(ends)
        deep = 1
        while deep * STEP < sizes.max(initial=0):
            ahead = places + deep * STEP
            tail = np.where(ahead < stops, rank[np.minimum(ahead, n - 1)] + 1, 0)
            values, rank = np.unique((rank << 32) | tail, return_inverse=True)
            deep *= 2
            if values.size == n:
                break
        self.order = np.empty(n, np.int64)
        self.order[rank] = places
        before = self.order - STEP
        self.transform = np.where(before >= starts[self.order], symbols[np.maximum(before, 0)], 0)
        self.ends = ends


def merge(shards: list[Shard], passes: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (the shard of each suffix in the common order of the first ``passes`` symbols) and the longest common
    prefix of each entry with the one before, in symbols, ``passes`` where they have not parted."""
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [x.order.size for x in shards])
    ends = np.repeat(np.arange(len(shards), dtype=np.uint8), [x.ends for x in shards])
    n = interleave.size
    common = np.full(n, passes, np.int64)
    block = np.zeros(n, np.int64)
    before = np.empty(n, np.int64)
    for k in range(passes):
        for j, shard in enumerate(shards):
            before[interleave == j] = shard.transform
        walk = np.flatnonzero(before)
        symbol = before[walk]
        order = stable_order(symbol)
        walk, symbol = walk[order], symbol[order]
        source = block[walk]
        parted = np.ones(n, bool)
        if walk.size:
            parted[ends.size + 1 :] = (symbol[1:] != symbol[:-1]) | (source[1:] != source[:-1])
        common[parted & (common == passes)] = k
        interleave = np.concatenate((ends, interleave[walk]))
        block = np.cumsum(parted)
    return interleave, common


def repeated_places(stretches: list[bytes], shards: int = SHARDS) -> list[np.ndarray]:
    """For each stretch the places at which a string of LENGTH bytes starts that also starts at another place of any of them."""
    sizes = np.array([len(x) + 1 for x in stretches], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    hashes = np.zeros(bounds[-1], np.uint64)
    for k, x in enumerate(stretches):
        own = gram_hashes(np.frombuffer(x, np.uint8), STEP)
        hashes[bounds[k] : bounds[k] + own.size] = own | np.uint64(1)
    _, symbols = np.unique(np.concatenate((hashes, np.zeros(1, np.uint64))), return_inverse=True)
    symbols = symbols[:-1].astype(np.int64)
    cuts = np.unique(np.searchsorted(bounds, np.linspace(0, bounds[-1], shards + 1)))
    parts = [Shard(symbols[bounds[a] : bounds[b]], sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    interleave, common = merge(parts)
    same = common >= SYMBOLS
    same |= np.append(same[1:], False)
    found = np.zeros(bounds[-1], bool)
    for j, (part, a) in enumerate(zip(parts, cuts[:-1])):
        found[part.order[same[interleave == j]] + bounds[a]] = True
    return [np.flatnonzero(found[bounds[k] : bounds[k + 1]]) for k in range(len(stretches))]


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of adjacent places."""
    if not places.size:
        return []
    split = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], split + 1))].tolist(), places[np.append(split, places.size - 1)].tolist()))


def merged_windows(stretches: DataFrame) -> DataFrame:
    """doc_id, th, first, last: runs of windows of single stretches that occur elsewhere, from stretches dealt and sorted by gram."""

    def run(batches):
        held: list[tuple] = []
        size = 0

        def finish():
            out: list[tuple] = []
            for (_, single, doc, th, first, _), places in zip(held, repeated_places([x[5] for x in held])):
                if single:
                    out += [(doc, th, first + a, first + b) for a, b in runs_of(places)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "th", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and row[0] != held[-1][0]:
                    yield finish()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield finish()

    return stretches.select("gram", "single", "doc_id", "th", "first", "bytes").mapInArrow(run, "doc_id long, th long, first int, last int")


def counted_windows(stretches: DataFrame) -> DataFrame:
    """The same for grams of very many stretches: windows are counted by fingerprint."""

    def run(batches):
        for batch in batches:
            for gram, single, doc, th, first, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = gram_hashes(np.frombuffer(raw, np.uint8), STEP)
                n = len(raw) - LENGTH + 1
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for k in range(SYMBOLS):
                    one = mix(one * _ODD[0] + h[k * STEP : k * STEP + n])
                    two = mix(two + h[k * STEP : k * STEP + n] * _ODD[1])
                same = lambda v, t: pa.array(np.full(n, v), t)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), same(single, pa.bool_()), same(doc, pa.int64()), same(th, pa.int64()), pa.array(np.arange(first, first + n, dtype=np.int32))], names=["one", "two", "single", "doc_id", "th", "first"])

    windows = cut(stretches.select("gram", "single", "doc_id", "th", "first", "bytes").mapInArrow(run, "one long, two long, single boolean, doc_id long, th long, first int"))
    often = cut(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return windows.filter("single").join(often.hint("merge"), ["one", "two"]).select(*DOC, "first", F.col("first").alias("last"))


def removals(texts: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(the texts that lose something, DOC and spans): spans are sorted (start, end) of repeated windows, in bytes."""
    found = cut(anchors(texts))
    often = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    every, found = found, cut(spread_join(found, often, ["gram"]))
    drop_cut(every, often)
    kinds = cut(found.groupBy("gram", "stretch", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "first", "last", "place")).alias("rep")))
    copies = kinds.groupBy("gram", "stretch").agg(F.sum("n").alias("n")).filter("n > 1")
    whole = spread_join(found, copies, ["gram", "stretch"]).select(*DOC, "first", "last")

    def shared(side: str) -> DataFrame:
        """Sides of a gram in two kinds or more, of which one occurs once."""
        return cut(kinds.filter(f"{side} <> 0").groupBy("gram", side).agg(F.count(F.lit(1)).alias(f"{side}_kinds"), F.min("n").alias("least")).filter(f"{side}_kinds > 1 and least = 1").drop("least"))

    sided = kinds.select("gram", "before", "after", (F.col("n") == 1).alias("single"), "rep.*").join(shared("before").hint("merge"), ["gram", "before"], "left")
    sided = cut(sided.join(shared("after").hint("merge"), ["gram", "after"], "left").filter("before_kinds is not null or after_kinds is not null"))
    # Windows from `middle` on hold the bytes after the gram, those up to it the bytes before it.
    middle = F.col("place") - SIDE
    wanted = sided.select(
        "gram", "single", *DOC, F.when(F.col("before_kinds").isNull(), F.greatest("first", middle)).otherwise(F.col("first")).alias("first"), F.when(F.col("after_kinds").isNull(), F.least("last", middle)).otherwise(F.col("last")).alias("last")
    )
    crowded = cut(wanted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("gram", F.lit(True).alias("hot")))
    if crowded.isEmpty():
        wanted = wanted.withColumn("hot", F.lit(False))
    else:
        wanted = cut(wanted.join(crowded.hint("merge"), "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    whole = cut(whole)
    touched = cut(wanted.select(*DOC).unionByName(whole.select(*DOC)).distinct())
    own = cut(texts.join(touched.hint("merge"), DOC, "left_semi").dropDuplicates(DOC))
    bytes_of = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + LENGTH)
    stretches = wanted.join(own.hint("merge"), DOC).select("gram", "hot", "single", *DOC, "first", bytes_of.alias("bytes"))
    parts = [whole, merged_windows(stretches.filter("not hot").repartition("gram").sortWithinPartitions("gram"))]
    if not crowded.isEmpty():
        parts.append(counted_windows(stretches.filter("hot")))
    spans = parts[0]
    for more in parts[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")))).alias("spans"))
    return own, cut(spans)


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with those that overlap or touch made one."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, starts.size - 1)]


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept``, the bytes that stay."""
    texts = texts_of(docs, id_col, text_col).withColumns({"own_id": F.col("doc_id"), "doc_id": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})
    own, spans = removals(texts, hot)

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            out: list[list] = [[], [], [], []]
            flat = batch.column(3)
            for r, raw in enumerate(pc.cast(batch.column(2), pa.binary()).to_pylist()):
                pairs = flat[r].values
                start, end = joined(pairs.field("start").to_numpy().astype(np.int64), pairs.field("end").to_numpy().astype(np.int64))
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
                for column, value in zip(out, (len(raw) - len(kept), start.size, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "th", "n_removed", "n_spans", "sha", "kept"])

    changed = own.join(spans.hint("merge"), DOC).select(*DOC, "text", "spans").mapInArrow(run, "doc_id long, th long, n_removed long, n_spans long, sha string, kept binary")
    size, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    joined_up = texts.select(*DOC, "own_id", "text").join(changed.hint("merge"), DOC, "left")
    kept = F.coalesce("kept", F.col("text").cast("binary"))
    return joined_up.select(
        F.col("own_id").alias("doc_id"), size.alias("n_bytes"), F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("sha", F.sha2(F.col("text").cast("binary"), 256)).alias("kept_sha256"), kept.alias("kept")
    )


def shown(stripped: DataFrame) -> DataFrame:
    """The columns that are reported: also how many bytes stay and what stays as text, in which a character that was cut through is a replacement mark."""
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(strip(table(spark, sf_dir, "documents")))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """The same with a table of all strings of LENGTH bytes, for tests."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen: dict[bytes, int] = {}
    for _, raw in raws:
        for k in range(len(raw) - LENGTH + 1):
            key = hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - LENGTH + 1):
            if seen[hashlib.blake2b(raw[k : k + LENGTH], digest_size=16).digest()] > 1:
                gone[k : k + LENGTH] = b"\x01" * LENGTH
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
