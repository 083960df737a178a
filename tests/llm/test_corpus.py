"""Operators that compare texts or vectors with one another, against brute force."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann, graph, linedup, neardup, packing, quality, suffix

from .conftest import LINES, prose


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix_against_brute_force(docs, rows, hot):
    assert tuples(suffix.strip(docs, hot=hot), *SUFFIX) == sorted(suffix.brute_force(rows))


def test_suffix_merge_is_exact():
    """Shards merged by their transforms give what one table of all strings gives."""
    random = np.random.default_rng(3)
    base = random.integers(97, 101, 900, dtype=np.uint8).tobytes()
    stretches = [base[:700], base[100:], random.integers(97, 101, 800, dtype=np.uint8).tobytes(), base[300:750] + base[:420], b"a" * 450, b"short"]
    size = suffix.LENGTH
    count: dict[bytes, int] = {}
    for x in stretches:
        for k in range(len(x) - size + 1):
            count[x[k : k + size]] = count.get(x[k : k + size], 0) + 1
    want = [[k for k in range(len(x) - size + 1) if count[x[k : k + size]] > 1] for x in stretches]
    for shards in (1, 2, 5):
        assert [p.tolist() for p in suffix.repeated_places(stretches, shards)] == want


def test_suffix_empty_and_clashing(empty, clashing, docs):
    assert suffix.strip(empty).collect() == []
    assert tuples(suffix.strip(clashing), *SUFFIX) == tuples(suffix.strip(docs), *SUFFIX)


def test_suffix_null_ids_and_what_is_kept(spark):
    """Documents without an id are told apart by text and stay without one; removal is shown by the kept bytes."""
    text, head = prose(90, 120), "".join(f"ü{k}" for k in range(90))
    rows = [(None, text), (None, prose(91, 90)), (5, head + text), (None, None)]
    got = suffix.strip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == sorted((str(i), len((t or "").encode())) for i, t in rows)
    size = len(text.encode())
    assert sorted(r["n_removed"] for r in got) == [0, 0, size, size]
    assert {bytes(r["kept"]) for r in got} == {b"", prose(91, 90).encode(), head.encode()}


def test_suffix_cuts_through_characters(spark):
    """Two letters that end in one byte before a passage: that byte goes with it, and the halves show as replacement marks."""
    rows = [(1, "aé" + prose(92, 90)), (2, "bũ" + prose(92, 90)), (3, "clean é")]
    got = {r["doc_id"]: r for r in suffix.shown(suffix.strip(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {i: r["kept_text"] for i, r in got.items()} == {1: "a\ufffd", 2: "b\ufffd", 3: "clean é"}
    assert {i: r["n_kept"] for i, r in got.items()} == {1: 2, 2: 2, 3: 8}
    assert sorted(tuple(r)[:5] for r in got.values()) == sorted(suffix.brute_force(rows))


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def near_rows():
    """Chains of small changes, copies, loosely similar texts, short ones."""
    out = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    base = prose(40, 200).split()
    for k in range(30):
        words = list(base)
        for j in range(k // 3):
            words[(13 * j + 5) % 200] = f"changed{k}x{j}"
        out.append((10 + k, " ".join(words)))
    drift = prose(41, 300).split()
    for k in range(12):
        drift = drift[6:] + [f"new{k}n{j}" for j in range(6)]
        out.append((60 + k, " ".join(drift)))
    return out + [(100 + k, prose(300 + k, 60)) for k in range(10)]


def test_neardup_against_brute_force(spark, rows):
    distinct = {i: t for i, t in rows}
    table = [*near_rows(), *((1000 + i, t) for i, t in distinct.items())]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for percent in (85, 80):
        assert tuples(neardup.groups(docs, percent=percent), *NEAR) == sorted(neardup.brute_force(table, percent=percent))


def test_neardup_edge_cases(empty, docs, clashing):
    assert neardup.groups(empty).collect() == []
    assert tuples(neardup.groups(clashing), *NEAR) == tuples(neardup.groups(docs), *NEAR)


def shuffled_rows(spark, since=-1):
    """Rows that stages after ``since`` have written to shuffles, and the last stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    each = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(k) for k in range(stages.size()))]
    return sum(n for k, n in each if k > since), max((k for k, _ in each), default=-1)


def test_neardup_own_shingles(spark, monkeypatch):
    """Against brute force, over several parts and slices; shingles are dealt packed, not as a row each."""
    monkeypatch.setattr(neardup, "DEAL", 1 << 9)
    common = prose(50, 40)
    table = [(k, f"{prose(400 + k // 2, 200)} {common} {prose(600 + k, 150)}") for k in range(30)] + [(40, "one two"), (41, "one two three four five"), (42, common)]
    sets = {k: neardup.Shingler().set_of(t.encode()).tolist() for k, t in table}
    count = Counter(x for s in sets.values() for x in s)
    texts = spark.createDataFrame([(k, t, len(sets[k])) for k, t in table], "node long, text string, n long").repartition(3).cache()
    texts.count()
    _, last = shuffled_rows(spark)
    got = dict(map(tuple, neardup.own_shingles(texts, neardup.WORDS).collect()))
    rows, _ = shuffled_rows(spark, last)
    assert got == {k: u for k, s in sets.items() if (u := sum(count[x] == 1 for x in s))}
    assert rows < len(count) / 10


def test_neardup_tells_documents_apart_by_id_and_text(spark):
    """Null ids, one id of several texts, repeated rows."""
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(None, a), (None, b), (3, a), (4, c), (4, b), (5, c), (5, c), (6, None), (None, None)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(None, 76, None, True), (None, 76, None, True), (3, 76, None, False), (4, 76, 4, True), (4, 76, None, False), (5, 76, 4, False), (5, 76, 4, False), (6, 0, 6, True), (None, 0, None, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_text_hash_is_the_engine_s(spark, docs):
    """The hash that is made with the sketch is the one by which rows are joined."""
    made = neardup.sketches(neardup.texts_of(docs), 5, 5, 28).select("doc_id", "th").distinct()
    own = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).distinct()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, own.collect()))


def test_min_max_signature_halves_the_evaluations():
    """Minimum and maximum of one permutation both agree with the similarity as their probability."""
    random = np.random.default_rng(1)
    pool = np.unique(random.integers(1 << 63, size=1300, dtype=np.uint64))
    a, b = np.sort(pool[:1000]), np.sort(pool[150:1150])
    flat, starts = np.concatenate((a, b)), np.array([0, a.size])
    keys = neardup.signatures(flat, starts, 1, 600)
    assert abs((keys[0] == keys[1]).mean() - 850 / 1150) < 0.06


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 9), (9, 9), (50, 51)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 100 for k in range(100, 141)) and found[9] == found[7] == found[3] == 3 and found[51] == 50


def brute_lines(rows, least=linedup.MIN_WORDS):
    """Every run of lines of enough words: all but its first copy go."""
    texts = [(i, (t or "").split("\n")) for i, t in sorted({(i, t or "") for i, t in rows})]
    full = [(i, [x for x in lines if x.strip(" \t\n\v\f\r")]) for i, lines in texts]
    seen, gone = {}, [set() for _ in full]
    for n, (_, lines) in enumerate(full):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                key = tuple(lines[a:b])
                if sum(len(x.split()) for x in key) >= least:
                    if key in seen:
                        gone[n].update(range(a, b))
                    seen[key] = True
    return {(i, len(lines), len(g), sum(p - 1 not in g for p in g)) for (i, lines), g in zip(full, gone)}


def test_lines_against_all_runs(spark, docs, rows):
    few = [(i, t) for i, t in rows if i not in (13, 14)]
    more = [(30, "a b\nc d\na b c d e f g h i j k l\nx"), (31, "q\na b c d e f g h i j k l\nx\na b"), (32, "\n".join(["same line here"] * 9)), (33, "same line here\n" * 5)]
    table = spark.createDataFrame([*few, *more], "doc_id long, text string")
    done = linedup.rebuilt(table).select("_row.doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.n_runs").distinct()
    assert {tuple(r) for r in done.collect()} == brute_lines([*few, *more])


def test_line_hashes_are_independent(spark):
    """Spark hashes an argument with the hash of those before it as the seed: after the line, a constant would make the second hash follow from the first."""
    import xxhash

    hashed = lambda raw, seed: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(raw, seed=seed % (1 << 64))))[0]
    row = spark.range(1).select(F.lit("some line").alias("x")).select(*linedup.line_hashes(F.col("x")), F.xxhash64("x", F.lit(7)).alias("chained")).first()
    seven = struct.pack("<i", 7)
    assert row["chained"] == hashed(seven, row["h1"])
    assert row["h1"] == hashed(b"some line", 42) and row["h2"] == hashed(b"some line", hashed(seven, 42))


def test_lines_repeated_rows_null_ids_and_long_texts(spark):
    """Each row of a repeated document loses the same; a null id comes first; a text of very many lines is read whole."""
    long = "\n".join(prose(7000 + k % 900, 12) for k in range(1800))
    rows = [(2, LINES), (2, LINES), (None, LINES), (8, long), (9, None)]
    got = [(r["_row"]["doc_id"], r["_lines"]["n_lines"], r["_lines"]["n_removed"]) for r in linedup.rebuilt(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(2, 4, 4), (2, 4, 4), (None, 4, 0), (8, 1800, 900), (9, 0, 0)], key=str)


def test_lines_edge_cases(spark, empty, docs, clashing):
    assert linedup.strip_repeats(empty).collect() == []
    out = linedup.strip_repeats(clashing)
    assert out.columns == clashing.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert LINES in texts[10] and 12 not in texts and 1 in texts and texts[2] == ""


def test_quality_learns_and_scores(spark, docs, empty):
    good = [(k, prose(2000 + k, 60), 1) for k in range(0, 300)]
    bad = [(k, ("buy now !!! " * (5 + k % 7)) + prose(k, 3), 0) for k in range(300, 500)]
    table = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad], "doc_id long, quality int")
    x, y = quality.training(table, labels)
    model = quality.fit(x, y)
    assert 0 < len(model.rules)
    held = quality.score(table, model).join(labels, "doc_id").filter(quality.fold(F.col("doc_id")) == 0).collect()
    assert sum((r["_score"] >= quality.CUTOFF) == (r["quality"] == 1) for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["_score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, model).collect() == []


def test_quality_column_equals_model(spark, docs):
    x = np.random.default_rng(0).random((200, len(quality.STATISTICS)))
    model = quality.fit(x, (x[:, 0] + x[:, 3] > 1).astype(float))
    row = spark.createDataFrame([(x[k].tolist(),) for k in range(50)], "v array<double>").select(F.struct(*(F.col("v")[j].alias(s) for j, s in enumerate(quality.STATISTICS))).alias("_x"))
    assert np.allclose([r[0] for r in row.select(model.column()).collect()], model.scores(x[:50]))


def brute_statistics(text: str | None) -> list[float]:
    """The statistics of one text, counted in plain Python."""
    import math
    import re
    import unicodedata

    from lexmill.llm import rules

    text = text or ""
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = rules.brute_force(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = max(1, sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n")))
    w, c = max(1, n_words), max(1, word_chars)
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(unicodedata.category(x) == "Lu" for x in text)
    count = lambda p: len(re.findall(p, text))
    distinct = len(set(re.split(r"[\x20\x09-\x0D]+", text.lower())))
    return [math.log1p(n_words), word_chars / w, n_symbols / w, n_dup / lines, n_repeat / w, stutters / w, n_words / lines, count("[!?]") / w, upper / c, count("[0-9]") / c, count("[.,;:]") / w, distinct / w]


def test_quality_statistics_against_brute_force(spark, clashing, rows):
    extra = [(None, "A B b! c? 12, 3.  x\n\nA B b!"), (61, "SHOUT " * 50)]
    table = clashing.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = [[float(v) for v in r["_x"]] for r in quality.statistics(table).select("_x").collect()]
    want = [brute_statistics(t) for _, t in [*rows, *extra]]
    assert np.allclose(sorted(got), sorted(want))


def test_quality_query_cases(spark, empty, clashing):
    """Null ids are held out; columns of other names stay; an empty table gives no rows and no model."""
    ids = spark.createDataFrame([(None,), (1,)], "doc_id long")
    assert [r[0] for r in ids.select(quality.fold(F.col("doc_id"))).collect()][0] == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(*quality.training(empty, labels))
    assert quality.score(empty, model).collect() == []
    assert set(clashing.columns) < set(quality.score(clashing, model).columns)


def test_quality_without_labels():
    assert quality.fit(np.empty((0, 12)), np.empty(0)).rules == ()
    assert quality.fit(np.zeros((5, 12)), np.ones(5)).bias > 0


def test_ann_recall_and_rules(spark):
    random = np.random.default_rng(2)
    centres = random.normal(size=(12, 16))
    v = centres[random.integers(12, size=1500)] + 0.4 * random.normal(size=(1500, 16))
    rows = [(k, [float(np.float32(y)) for y in x]) for k, x in enumerate(v)]
    rows += [(1500, [0.0] * 16), (1600, None), (1700, [float("nan")] + [1.0] * 15), (1800, [None] + [1.0] * 15), (1900, [float("inf")] + [1.0] * 15), (300, rows[300][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict[int, list] = {}
    for r in ann.search(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 1500, 100))
    exact = np.array([r[1] for r in rows[:1500]])
    hits = 0
    for q, got in found.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        best = [k for k in np.lexsort((np.arange(1500), d)) if k != q][:10]
        hits += len({x for _, x, _ in got} & set(best))
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(abs(d[x] - s) < 1e-12 for _, x, s in got)
        assert [(s, x) for _, x, s in got] == sorted((s, x) for _, x, s in got)
    assert hits >= 0.9 * 10 * len(found)


def test_ann_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = ann.search(table, table.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]
    assert ann.search(table.limit(0), table.limit(0)).collect() == []


def test_ann_keeps_every_dimension(spark):
    random = np.random.default_rng(3)
    rows = [(k, [float(x) for x in random.normal(size=8 if k % 5 else 3)]) for k in range(300)] + [(900, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for r in ann.search(table, table.filter("vec_id % 100 = 0 or vec_id = 1")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in (0, 1, 100, 200):
        own = np.array(rows[q][1])
        others = [(float(np.sqrt(((np.array(v) - own) ** 2).sum())), k) for k, v in rows if k != q and len(v) == own.size]
        assert found.pop(q) == [k for _, k in sorted(others)[:10]]
    assert not found  # 900 has nothing of its dimension


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_path())
    t.no_padding()
    t.no_truncation()
    extra = [(300 + k, prose(k, 3 + k)) for k in range(80)] + [(400, "ÀÉ ñ́ <|endoftext|> İstanbul ΣΑΣ ​ x y"), (401, " 'S don't ''")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in [*rows, *extra]]
    for window in (4096, 64):
        pieces = packing.pack(table, window=window).collect()
        by_doc: dict[int, list] = {}
        sequences: dict[int, list] = {}
        for p in pieces:
            by_doc.setdefault(p["doc_id"], []).append(p)
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        for i, own in ids:
            mine = sorted(by_doc[i], key=lambda p: p["start"])
            copies = sum(j == i for j, _ in ids)
            assert sum(p["length"] for p in mine) == copies * len(own)
            for p in mine:
                part = own[p["start"] : p["start"] + p["length"]]
                assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        padded = total = 0
        for places in sequences.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at and length > 0
                at += length
            assert at <= window
            total += at
            padded += 0 if at & (at - 1) == 0 else window - at
        assert total == sum(len(x) for _, x in ids) and padded <= 0.01 * total


def test_packing_plan_fills_windows():
    counts = np.bincount(np.random.default_rng(1).integers(1, 64, 5000), minlength=64)
    counts[0] = 0
    plan = packing.Plan(counts, 64)
    filled: dict[int, int] = {}
    for a in range(1, 64):
        for k in range(int(counts[a])):
            pieces = plan.place(a, k)
            assert sum(n for _, n, _, _ in pieces) == a
            for _, n, s, _ in pieces:
                filled[s] = filled.get(s, 0) + n
    assert all(n & (n - 1) == 0 and n <= 64 for n in filled.values())
    # How many tails stay whole depends on the histogram; here most do.
    assert sum(plan.used) > 0.8 * counts.sum()


def test_packing_plan_leaves_no_gap():
    """Tails of one length, of few lengths and of all: each id has one place, and sequences are full or a power of two."""
    random = np.random.default_rng(4)
    for turn in range(60):
        window = 1 << int(random.integers(3, 8))
        counts = np.bincount(random.integers(1, window, int(random.integers(0, 200))), minlength=window)
        counts *= random.random(window) < (1.0, 0.3, 0.05)[turn % 3]
        plan = packing.Plan(counts, window)
        sequences: dict[int, list] = {}
        for a in np.flatnonzero(counts).tolist():
            for k in range(int(counts[a])):
                pieces = plan.place(a, k)
                assert [start for start, _, _, _ in pieces] == [sum(n for _, n, _, _ in pieces[:i]) for i in range(len(pieces))]
                assert [n for _, n, _, _ in pieces] in ([a], [1 << b for b in packing.bits_of(a)])
                for _, n, sequence, at in pieces:
                    sequences.setdefault(sequence, []).append((at, n))
        assert sorted(sequences) == list(range(plan.sequences))
        for places in sequences.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end += n
            assert end == window or end & (end - 1) == 0


def test_packing_plan_cuts_few_tails():
    counts = np.zeros(4096, np.int64)
    counts[5] = 10_000
    # 819 of them leave one place free, which the 1 of a cut one (4 + 1) fills.
    assert packing.Plan(counts, 4096).used[5] > 9_800
    counts = np.bincount(np.random.default_rng(5).integers(1, 4096, 30_000), minlength=4096)
    assert packing.Plan(counts, 4096).used.sum() > 0.93 * counts.sum()


def test_packing_cases(spark, clashing, docs):
    """Null ids and repeated rows are packed each; columns of other names don't matter; what the library encodes comes out."""
    rows = [(None, "one two"), (None, None), (7, "Ünïcode ÀÉ"), (7, "Ünïcode ÀÉ"), (8, "漢字 \x1c x" * 40), (9, "x" * 5000 + " y")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    library = packing.encoder(packing.default_path()).library
    want: dict = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["n"] for r in got} == want
    assert tuples(packing.pack(clashing), "doc_id", "start", "length", "ids_crc32") == tuples(packing.pack(docs), "doc_id", "start", "length", "ids_crc32")


def test_packing_empty(empty):
    assert packing.pack(empty).collect() == []
