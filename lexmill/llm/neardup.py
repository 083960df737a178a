"""Near-duplicate documents by min-max hashing.

A document's set holds the hashes of its distinct word shingles.  Under each
permutation both the smallest and the largest value are kept, so that every
evaluation serves two signature values; bands of ROWS values are the keys under
which documents meet.  Documents with equal sets are one node from the start.

Within a bucket a few centres are compared with the members that are not yet in
their component; centres are then done and leave the bucket, and the bucket
ends when its members are one component.  What the first round leaves of a
bucket is ended at once where it has BLOCK members or fewer: pairs of different
components that could be linked, each in the first bucket that they share.  So
every two documents that share a bucket are compared or found connected, while
work for a member is bounded by BLOCK.
Links are confirmed on the full sets, which are built again from the texts.

Shingles that no other candidate has bound what two sets can share: with u of n
shingles its own, a set shares n - u at most.  Documents and pairs that cannot
reach the similarity by this are left out, which loses no link and keeps a
large group of loosely similar copies from being compared pair by pair.  The
members with the fewest shingles of their own are the centres: copies link to
what they were copied from.

Defined cases: words are what blanks (space, tab to carriage return) leave
after A-Z is lower-cased; fewer words than a shingle count as one shingle; a
null or blank text has the empty set and is linked with nothing; a row is a
document, told from others by id and text, so that one id may have several
texts; a null id is one that comes before all others, and is null in
``component_id`` too; ties go to the smaller id; texts may be of any length;
columns of other names are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, cut, drop_cut, per_text, slices, spread_join, table, texts_of
from lexmill.llm.graph import components

WORDS, PERCENT = 5, 85
ROWS, BANDS = 5, 28
#: Centres of a bucket in each round after the first, and members up to which a bucket is ended at once, pair by pair.
CENTRES, BLOCK = 48, 2048
CACHE = 250_000
#: Shingles, about, that are counted at once.
DEAL = 1 << 17

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Word -> 64-bit hash, kept for up to CACHE words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


class Shingler:
    """Sets of shingle hashes from texts."""

    def __init__(self, size: int = WORDS):
        self.size, self.hashes = size, Hashes()

    def set_of(self, text: bytes) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = text.translate(_FOLD).split()
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        size = min(n, self.size)
        out = h[: n - size + 1].copy()
        for k in range(1, size):
            out *= _PRIME
            out += h[k : n - size + 1 + k]
        if n < self.size:
            out += np.uint64(n * 0xD6E8FEB86659FD93 % (1 << 64))
        return np.unique(mix(out))


def signatures(flat: np.ndarray, starts: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Band keys (documents x bands) of non-empty sets that lie one after another in ``flat``."""
    need = rows * bands
    random = np.random.default_rng(20240917)
    keys = np.zeros((starts.size, bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range((need + 1) // 2):
            a, b = random.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1), random.integers(1 << 63, dtype=np.uint64)
            v = (flat ^ b) * a
            for j, x in ((2 * k, np.minimum), (2 * k + 1, np.maximum)):
                if j < need:
                    band = j // rows
                    keys[:, band] = mix(keys[:, band] * _PRIME + x.reduceat(v, starts) + np.uint64(band + 1))
    return keys


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 x intersection >= percent x union, for sorted distinct sets that aren't empty."""
    if not a.size or not b.size or 100 * min(a.size, b.size) < percent * max(a.size, b.size):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (a.size + b.size - common)


def sketches(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """doc_id, th (Spark's hash of the text), n_shingles, set_key, bands (empty where the set is)."""

    def work():
        import hashlib

        import xxhash

        shingler = Shingler(size)

        def apply(texts: list[bytes]) -> list[list]:
            sets = [shingler.set_of(t) for t in texts]
            full = [s for s in sets if s.size]
            keys = iter(())
            if full:
                starts = np.concatenate(([0], np.cumsum([s.size for s in full])[:-1])).astype(np.int64)
                keys = iter(signatures(np.concatenate(full), starts, rows, bands).view(np.int64).tolist())
            th = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
            return [th, [s.size for s in sets], [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [next(keys) if s.size else [] for s in sets]]

        return apply

    fields = [("th", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))]
    return per_text(docs, work, fields, "th long, n_shingles long, set_key binary, bands array<long>", binary=True, chunk=1 << 22)


def own_shingles(texts: DataFrame, size: int) -> DataFrame:
    """node and u: how many of its shingles no other of the texts(node, text, n) has; n is the size of its set.

    Shingles go to the tasks that count them in packed runs, one for each of many even ranges of hashes, as single rows
    would take several times their memory.  A slice of texts sends each of its shingles once, under node -1 where two of
    its texts have it, so that a very frequent shingle is no burden for one task.
    """
    parts = (texts.agg(F.sum("n")).first()[0] or 0) // DEAL + 1
    edges = np.array([(k << 64) // parts for k in range(parts)], np.uint64)

    def deal(batches):
        shingler = Shingler(size)
        for batch in batches:
            for part in slices(batch, 1 << 22):
                sets = [shingler.set_of(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                shingles, nodes, first, alone = runs_in(np.concatenate(sets), np.repeat(part.column(0).to_numpy(), [s.size for s in sets]))
                shingles, nodes = shingles[first], np.where(alone, nodes, -1)[first]
                bounds = np.append(np.searchsorted(shingles, edges), shingles.size)
                full = np.flatnonzero(np.diff(bounds))
                offsets = pa.py_buffer((np.append(bounds[full], shingles.size) * 8).astype(np.int32))
                packed = [pa.Array.from_buffers(pa.binary(), full.size, [None, offsets, pa.py_buffer(x)]) for x in (shingles, nodes)]
                yield pa.RecordBatch.from_arrays([pa.array(full), *packed], names=["part", "shingles", "nodes"])

    def count(batches):
        held, at = [], None

        def finish():
            _, nodes, _, alone = runs_in(*(np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, t in ((0, np.uint64), (1, np.int64))))
            node, u = np.unique(nodes[alone & (nodes >= 0)], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(u.astype(np.int64))], names=["node", "u"])

        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and part != at:
                    yield finish()
                    held = []
                held.append(packed)
                at = part
        if held:
            yield finish()

    dealt = texts.select("node", "text").mapInArrow(deal, "part long, shingles binary, nodes binary")
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(count, "node long, u long")
    return cut(found.groupBy("node").agg(F.sum("u").alias("u")))


def runs_in(shingles: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both in the order of shingles; whether each is the first of its shingle, and whether it is the only one."""
    order = np.argsort(shingles, kind="stable")
    shingles, nodes = shingles[order], nodes[order]
    first = np.ones(shingles.size, bool)
    first[1:] = shingles[1:] != shingles[:-1]
    return shingles, nodes, first, first & np.append(first[1:], True)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    member = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    centre = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(member.hint("merge"), "b").join(centre.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        shingler, last, own = Shingler(size), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k in range(batch.num_rows):
                if a[k] != last:
                    last, own = a[k], shingler.set_of(batch.column(2)[k].cast(pa.binary()).as_py())
                if linked(own, shingler.set_of(batch.column(3)[k].cast(pa.binary()).as_py()), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"]) if keep else pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return both.mapInArrow(run, "a long, b long")


def keyed(texts: DataFrame) -> DataFrame:
    """``texts`` with a key of what tells documents apart: ``id``, never null, and ``th``, the text's hash."""
    return texts.withColumns({"id": F.coalesce("doc_id", F.lit(NO_ID)), "th": F.xxhash64("text")})


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row a document: doc_id, th, n_shingles, ``first`` (id, th of its component's first document; null ids as NO_ID), component_id, kept."""
    texts = texts_of(docs, id_col, text_col)
    sketched = cut(sketches(texts, size, rows, bands))
    full = sketched.filter("n_shingles > 0")
    # One node for each set; its first document stands for it.
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th"))
    nodes = full.groupBy("set_key").agg(best.alias("best"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select("set_key", "best", "n", F.transform("bands", lambda k, i: F.xxhash64(i, k)).alias("buckets")).withColumn("node", F.monotonically_increasing_id()))
    each = cut(nodes.select("node", "n", F.explode("buckets").alias("bucket")))
    crowded = cut(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut(spread_join(each, crowded, ["bucket"], "size"))
    where = nodes.select("node", "buckets")
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "n", "best.id", "best.th")
    own = cut(keyed(texts).join(wanted.hint("merge"), ["id", "th"]).dropDuplicates(["node"]).select("node", "text", "n"))

    bounded = members.join(own_shingles(own, size).hint("merge"), "node", "left").withColumn("u", F.coalesce("u", F.lit(0).cast("long")))
    bounded = cut(bounded.filter((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent))
    drop_cut(each, crowded, members)
    members = bounded

    links: list[DataFrame] = []
    tried: list[DataFrame] = []
    labels = None
    alive = members.select("bucket", "node", "n", "u", F.col("node").alias("component"))

    def possible(xn, xu, yn, yu):
        """Whether two sets can be similar enough, by their sizes and what is their own."""
        common = F.least(xn - xu, yn - yu)
        return common * 100 >= (xn + yn - common) * percent

    first = True
    while True:
        # Buckets of one component are done.
        ways = 1 if first else CENTRES
        lot = F.pmod(F.xxhash64("node"), F.lit(ways))
        picks = [F.min(F.when(lot == j, F.struct("u", "node", "n", "component"))).alias(f"c{j}") for j in range(ways)]
        state = alive.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"), *picks).filter("low < high")
        state = cut(state.select("bucket", (F.col("size") <= (0 if first else BLOCK)).alias("small"), F.filter(F.array(*(f"c{j}" for j in range(ways))), lambda c: c.isNotNull()).alias("centres")))
        met = cut(alive.join(state.filter("not small").drop("small").hint("merge"), "bucket"))
        could = lambda c: (c["component"] != F.col("component")) & possible(c["n"], c["u"], F.col("n"), F.col("u"))
        pairs = met.select("node", F.explode(F.transform(F.filter("centres", could), lambda c: c["node"])).alias("c")).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
        if not first:
            few = cut(alive.join(state.filter("small").select("bucket").hint("merge"), "bucket").join(where.hint("merge"), "node"))
            x, y = few.alias("x"), few.alias("y")
            shared = F.zip_with("x.buckets", "y.buckets", lambda p, q: p == q)
            here = F.element_at("x.buckets", F.array_position(shared, F.lit(True)).cast("int")) == F.col("x.bucket")
            able = possible(F.col("x.n"), F.col("x.u"), F.col("y.n"), F.col("y.u"))
            whole = x.join(y.hint("merge"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & able & here)
            pairs = pairs.unionByName(whole.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        pairs = pairs.distinct()
        for done in tried:
            pairs = pairs.join(done.hint("merge"), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if not pairs.isEmpty():
            tried.append(pairs)
            found = cut(confirm(pairs, own, size, percent))
            if not found.isEmpty():
                links.append(found)
                labels = cut(components(reduce(DataFrame.unionByName, links)))
        # The centres have met every member: they leave.
        gone = [alive, state, met] if first else [alive, state, met, few]
        left = met.filter(~F.exists("centres", lambda c: c["node"] == F.col("node"))).select("bucket", "node", "n", "u")
        if labels is not None:
            left = left.join(labels.hint("merge"), "node", "left").select("bucket", "node", "n", "u", F.coalesce("component", "node").alias("component"))
        else:
            left = left.withColumn("component", F.col("node"))
        alive, first = cut(left), False
        drop_cut(*gone)
        if alive.isEmpty():
            break
    named = nodes.select("set_key", "node", "best")
    if labels is not None:
        named = named.join(labels.hint("merge"), "node", "left").select("set_key", "best", F.coalesce("component", "node").alias("component"))
        firsts = named.groupBy("component").agg(F.min("best").alias("first"))
        named = named.join(firsts.hint("merge"), "component").select("set_key", "first")
    else:
        named = named.select("set_key", F.col("best").alias("first"))
    named = cut(named)
    itself = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "th")
    result = sketched.select("doc_id", "th", "n_shingles", "set_key").join(named.hint("merge"), "set_key", "left")
    result = result.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(itself).alias("first"))
    result = result.withColumn("component_id", F.when(F.col("first.id") != NO_ID, F.col("first.id")))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(rows: list[tuple[int, str | None]], size: int = WORDS, percent: int = PERCENT) -> list[tuple[int, int, int, bool]]:
    """The same for a few documents, by comparing all pairs of sets of word tuples."""
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().translate(_FOLD).split()
        sets[doc] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]


