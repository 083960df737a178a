"""Packing token sequences: non-negative least squares over length combinations.

A document is its ids and an end id.  Whole windows of it stand alone; what
remains, the tail, is packed.  Tails are counted by length (fewer lengths than
a window has places, so the histogram is small at any corpus size).
Combinations of a few lengths that fill a window exactly are enumerated, and
their repeat counts are solved for against the histogram by non-negative least
squares and rounded down to what there is; greedy passes pack what the rounding
left, the longest tails that fit first.  The gap that whole tails leave is
filled by those powers of two of one further tail that add up to it; that tail's
others, and tails that fit nowhere, fill windows of one power of two, or
sequences of a power of two, exactly.  So no sequence needs padding.

The plan is a function of a length and a tail's number among those of that
length; numbers come from a range sort, so no length is one task's burden.
Check sums of all pieces that a plan may ask for are made as the text is
encoded: ids are neither stored nor moved.

Defined cases: a null or empty text has the end id alone; repeated rows are
packed each.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import CHUNK, ODD, Halves, byte_letters, pieces_of
from lexmill.llm.common import cut, per_text, table, texts_of
from lexmill.llm.merges import Merges

VOCABULARY = "word_bpe_49k.json"
WINDOW, END = 4096, 2
#: Words of a text in lower case without odd characters.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u017f"
WORD = re.compile(rf"[{LETTERS}]++|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{LETTERS}0-9]++")
#: Combinations enumerated, and lengths in one.
COMBINATIONS, DEPTH = 20_000, 8
STEPS = 300


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Ids of whole texts by a tokenizer that folds case and drops blanks.

    Texts of characters on which Unicode versions agree are cut into words here, and words are merged many at once, each
    kept in a cache; other texts and those that may hold a special token go to the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw, letters = spec["model"]["vocab"], byte_letters()
        suffix = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.path = path
        self.merges = Merges([(raw[a], raw[b], raw[a + b]) for a, b in merges], max(raw.values()) + 1)
        #: Ids of bytes within a word and at its end.
        self.inner, self.last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.inner[byte], self.last[byte] = raw[letter], raw[letter + suffix]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = Halves()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are not empty."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids, ends = self.inner[data], np.cumsum(sizes) - 1
        ids[ends] = self.last[data[ends]]
        return pieces_of(*self.merges.exact(ids, sizes))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts: list[list[str] | bytes] = []
        distinct: set[str] = set()
        for text in texts:
            if ODD.search(text) or any(t in text for t in self.special):
                parts.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                parts.append(WORD.findall(text.lower()))
                distinct.update(parts[-1])
        new = self.words.missing(distinct)
        if new:
            self.words.keep(new, self.merged([w.encode() for w in new]))
        get = self.words.__getitem__
        return [x if isinstance(x, bytes) else b"".join(map(get, x)) for x in parts]

    def release(self) -> None:
        """Empty the cache."""
        self.words.empty()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bits_of(n: int) -> list[int]:
    """Exponents of the powers of two that add up to n, largest first."""
    return [b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def counted(docs: DataFrame, path: str, window: int) -> DataFrame:
    """doc_id, doc_tokens, check sums of the whole windows, the tail's length and check sum, and those of its powers of two."""

    def work():
        own, end = encoder(path), np.array([END], "<u4").tobytes()

        def apply(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for ids in own.encode(texts):
                ids += end
                n = len(ids) // 4
                blocks, tail = divmod(n, window)
                whole = [zlib.crc32(ids[4 * window * k : 4 * window * (k + 1)]) for k in range(blocks)]
                at, parts = blocks * window, []
                for b in bits_of(tail):
                    parts.append(zlib.crc32(ids[4 * at : 4 * (at + (1 << b))]))
                    at += 1 << b
                for column, value in zip(out, (n, whole, tail, zlib.crc32(ids[4 * blocks * window :]), parts), strict=True):
                    column.append(value)
            return out

        return apply

    fields = [("doc_tokens", pa.int64()), ("whole", pa.list_(pa.int64())), ("tail", pa.int32()), ("tail_crc", pa.int64()), ("parts", pa.list_(pa.int64()))]
    return per_text(texts_of(docs), work, fields, "doc_tokens long, whole array<long>, tail int, tail_crc long, parts array<long>", chunk=CHUNK, after=lambda: encoder(path).release())


NUMBERED = "doc_id long, doc_tokens long, whole array<long>, tail int, tail_crc long, parts array<long>, part int, number long, before long"


def numbered(rows: DataFrame) -> DataFrame:
    """Rows sorted by tail, with their number among their part's rows of that tail and the whole windows before them in the part."""

    def run(batches):
        from pyspark import TaskContext

        part, seen, before, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            numbers, befores = [], []
            for tail, whole in zip(batch.column("tail").to_pylist(), pa.compute.list_value_length(batch.column("whole")).to_pylist(), strict=True):
                seen = seen + 1 if tail == last else 0
                last = tail
                numbers.append(seen)
                befores.append(before)
                before += whole
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(numbers, pa.int64()), pa.array(befores, pa.int64())], names=[*batch.schema.names, "part", "number", "before"])

    import pyarrow.compute  # noqa: F401

    return cut(rows.repartitionByRange("tail", "doc_id").sortWithinPartitions("tail", "doc_id").mapInArrow(run, NUMBERED))


def combinations(counts: np.ndarray, window: int, most: int = COMBINATIONS, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Combinations of at most ``depth`` present lengths that add up to ``window``: pairs all, deeper ones enumerated from the largest length down with partners spread over the histogram."""
    lengths = np.flatnonzero(counts)
    found = {(int(window - a), int(a)) for a in lengths[lengths <= window // 2] if counts[window - a]}
    if lengths.size:
        weight = np.cumsum(counts[lengths].astype(float))
        random = np.random.default_rng(5)
        for _ in range(4 * most):
            if len(found) >= most:
                break
            left, chosen = window, []
            while left and len(chosen) < depth:
                if left < counts.size and counts[left] and (chosen or left < window) and (len(chosen) == depth - 1 or random.random() < 0.5):
                    chosen.append(left)
                    left = 0
                    break
                fits = int(np.searchsorted(lengths, left, side="right"))
                if not fits:
                    break
                a = int(lengths[min(fits - 1, np.searchsorted(weight, random.random() * weight[fits - 1], side="right"))])
                chosen.append(a)
                left -= a
            if not left:
                found.add(tuple(sorted(chosen, reverse=True)))
    return sorted(found, reverse=True)


def least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x that bring the combinations' lengths close to the histogram: projected, accelerated gradient steps."""
    index = np.array([a for c in combos for a in c], np.int64)
    owner = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    target = counts.astype(float)

    def down(x):
        gap = np.bincount(index, weights=x[owner], minlength=target.size) - target
        return np.bincount(owner, weights=gap[index], minlength=len(combos))

    # The largest eigenvalue, by a few power steps, bounds the step.
    v = np.ones(len(combos))
    for _ in range(20):
        v = np.bincount(owner, weights=np.bincount(index, weights=v[owner], minlength=target.size)[index], minlength=len(combos))
        size = np.linalg.norm(v)
        v /= size
    rate = 1 / (1.1 * size)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * down(y))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


class Plan:
    """Where the tails go: runs of repeats by length; parts of the tails that are cut fill gaps or powers of two."""

    def __init__(self, counts: np.ndarray, window: int):
        self.window, self.sequences = window, 0
        left = counts.astype(np.int64).copy()
        #: By length: first number, first sequence, offset, how many stand in one sequence, and the parts (as a sum) placed
        #: there.  Parts that add up to the length are the tail in one piece; the others go to the powers of two.
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        #: Tails of each length that stay in one piece.
        self.used = np.zeros(counts.size, np.int64)
        given = np.zeros(counts.size, np.int64)

        def give(a: int, count: int, at: int, per: int, parts: int) -> None:
            self.runs.setdefault(a, []).append((int(given[a]), self.sequences, at, per, parts))
            given[a] += count
            left[a] -= count
            if parts == a:
                self.used[a] += count

        def repeat(combo: dict[int, int], cut_tail: int = 0) -> None:
            """Fill windows with so many tails of each length, and the rest of each by parts of a further tail, as long as there are any."""
            need = dict(combo)
            if cut_tail:
                need[cut_tail] = need.get(cut_tail, 0) + 1
            fill(combo, min(int(left[a]) // m for a, m in need.items()), cut_tail)

        def fill(combo: dict[int, int], times: int, cut_tail: int = 0) -> None:
            at = 0
            for a, m in combo.items():
                give(a, times * m, at, m, a)
                at += a * m
            if cut_tail:
                give(cut_tail, times, at, 1, window - at)
            self.sequences += times

        combos = combinations(counts, window)
        if combos:
            x = least_squares(combos, counts)
            for k in np.argsort(-x, kind="stable").tolist():
                combo = {a: combos[k].count(a) for a in sorted(set(combos[k]), reverse=True)}
                if (times := min(int(x[k]), *(int(left[a]) // m for a, m in combo.items()))) > 0:
                    fill(combo, times)
        # Greedy: the longest tail left, then the longest that fit.  First those that fill a window, the last one exactly.
        for a in range(counts.size - 1, 0, -1):
            while left[a] > 0:
                combo, room = self.longest(left, a, exact=True)
                if room:
                    break
                repeat(combo)
        # Then the parts of one tail that add up to the gap; where no tail has them, the gap of one tail fewer.
        for a in range(counts.size - 1, 0, -1):
            while left[a] > 0:
                combo, room = self.longest(left, a)
                while combo and room and not (cut_tail := self.parted(left, combo, room)):
                    last = next(reversed(combo))
                    combo[last] -= 1
                    room += last
                    if not combo[last]:
                        del combo[last]
                if not combo:
                    break
                repeat(combo, cut_tail if room else 0)
        for a in np.flatnonzero(left).tolist():
            give(a, int(left[a]), 0, 1, 0)
        # Powers of two: of each exponent, a run's parts come after those of the runs before.
        self.base: dict[tuple[int, int], dict[int, int]] = {}
        self.groups = {}
        total = dict.fromkeys(range(window.bit_length() - 1), 0)
        for a in sorted(self.runs):
            starts = [r[0] for r in self.runs[a]] + [int(given[a])]
            for k, (first, _, _, _, parts) in enumerate(self.runs[a]):
                own = self.base[a, k] = {}
                for b in bits_of(a - parts):
                    own[b] = total[b]
                    total[b] += starts[k + 1] - first
        for b, n in total.items():
            room = window >> b
            whole, over = divmod(n, room)
            groups = [(0, self.sequences, room)] if whole else []
            self.sequences += whole
            at = whole * room
            for e in bits_of(over):
                groups.append((at, self.sequences, 1 << e))
                self.sequences += 1
                at += 1 << e
            self.groups[b] = groups

    def longest(self, left: np.ndarray, a: int, exact: bool = False) -> tuple[dict[int, int], int]:
        """How many tails of each length, the longest that fit, and the room that is left; of at most 2 * DEPTH lengths.

        If ``exact``, the length that fills the room comes first, and others leave at least their own length free.
        """
        combo, room = {a: 1}, self.window - a
        while room and len(combo) < 2 * DEPTH:
            top = min(room // 2 if exact else room, left.size - 1)
            free = left[: top + 1].copy()
            for x, m in combo.items():
                if x <= top:
                    free[x] -= m
            if exact and room < left.size and left[room] > combo.get(room, 0):
                b, m = room, 1
            else:
                fits = np.flatnonzero(free[1:] > 0) + 1
                if not fits.size:
                    break
                b = int(fits[-1])
                m = 1 if exact else min(int(free[b]), room // b)
            combo[b] = combo.get(b, 0) + m
            room -= b * m
        return combo, room

    def parted(self, left: np.ndarray, combo: dict[int, int], gap: int) -> int:
        """A length whose powers of two include those of ``gap``, with the fewest others; 0 if there is none."""
        free = left.copy()
        for x, m in combo.items():
            free[x] -= m
        has = np.flatnonzero(free > 0)
        has = has[(has & gap) == gap]
        return int(min(has.tolist(), key=lambda x: (x.bit_count(), x), default=0))

    def place(self, tail: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start in the tail, length, sequence, offset) of the pieces of the ``number``-th tail of that length."""
        runs = self.runs[tail]
        k = bisect_right(runs, number, key=lambda r: r[0]) - 1
        first, sequence, at, per, parts = runs[k]
        turn, slot = divmod(number - first, per)
        if parts == tail:
            return [(0, tail, sequence + turn, at + slot * tail)]
        out, start = [], 0
        for b in bits_of(tail):
            if parts >> b & 1:
                out.append((start, 1 << b, sequence + turn, at))
                at += 1 << b
            else:
                place = self.base[tail, k][b] + number - first
                begin, pool, room = next(g for g in reversed(self.groups[b]) if g[0] <= place)
                group, spot = divmod(place - begin, room)
                out.append((start, 1 << b, pool + group, spot << b))
            start += 1 << b
        return out


PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  ``window`` is a power of two."""
    # Written first: the range sort reads its input twice, to draw borders and to deal.
    rows = numbered(cut(counted(docs, path or default_path(), window)))
    # A part holds a range of tails, so this has no more rows than parts and lengths together.
    tally = rows.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("whole")).alias("whole")).orderBy("part", "tail").collect()
    counts = np.zeros(window, np.int64)
    ahead: dict[tuple[int, int], int] = {}
    whole_before: dict[int, int] = {}
    windows = 0
    for r in tally:
        ahead[r["part"], r["tail"]] = int(counts[r["tail"]])
        counts[r["tail"]] += r["n"]
        whole_before.setdefault(r["part"], windows)
        windows += r["whole"]
    counts[0] = 0
    plan = Plan(counts, window)

    def run(batches):
        schema = pa.schema(PIECES)
        for batch in batches:
            out: list[tuple] = []
            for doc, n, whole, tail, tail_crc, parts, part, number, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = plan.sequences + whole_before[part] + before
                out += [(doc, k * window, window, crc, n, first + k, 0) for k, crc in enumerate(whole)]
                if tail:
                    pieces = plan.place(tail, ahead[part, tail] + number)
                    for (start, length, sequence, at), crc in zip(pieces, parts if len(pieces) > 1 else [tail_crc], strict=True):
                        out.append((doc, len(whole) * window + start, length, crc, n, sequence, at))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
