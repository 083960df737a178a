"""Repeated runs of lines, by prefix doubling over line ids.

The corpus is a sequence of line ids (lines without a word are passed over).
Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines: each
round sorts the distinct pairs of ranks and numbers them in order, so that the
suffixes of one rank are an interval with that common prefix.  A suffix leaves
when its interval has one member, as its longest common prefix is settled.

Any run of w lines is named by the ranks of its first and last 2^a lines, 2^a
the largest power within w.  Wanted are the maximal repeated runs of at least
MIN_WORDS words: every such run is the union of the shortest runs of that many
words that start or end at each of its lines, so these are the runs looked up;
each interval's first member in order of (doc_id, text, line) stays and the
others' lines are deleted.

Defined cases: a null or blank text has no lines; rows repeated under one id
and text are one document, of which each row loses the same lines; a null id is
one that comes before all others; lines without a word stay, but a text of which
no other line is left becomes empty; runs may overlap; texts may be of any
length; columns of other names are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import NO_ID, cut, drop_cut, held, spread_join, table

MIN_WORDS = 10
SPACE = "[ \\x09-\\x0D]"
WORD = "[^ \\x09-\\x0D]+"
DOC = ["doc_id", "th"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def line_hashes(line: Column) -> tuple[Column, Column]:
    """Two hashes that tell lines apart.  The hash chains its arguments, so the constant comes first: after the line, it would add nothing to a hash of the line alone."""
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")


def lines(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, pos, h1, h2, and the lengths of the shortest runs of enough words from there on (wf) and up to there (wb)."""
    counted = texts.select(*DOC, F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("nw"))).alias("all"))
    full = counted.select(*DOC, F.filter("all", lambda x: x["nw"] > 0).alias("full"))

    def shortest(sizes):
        start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + x["nw"]).alias("sum"), (a["n"] + 1).alias("n")))
        return F.aggregate(sizes, start, step, lambda a: F.when(a["sum"] >= min_words, a["n"]))

    def entry(x, i):
        before = F.greatest(i + 2 - min_words, F.lit(1))
        return F.struct(
            *line_hashes(x["line"]), shortest(F.slice("full", i + 1, F.lit(min_words))).alias("wf"), shortest(F.reverse(F.slice("full", before, i + 2 - before))).alias("wb")
        )

    return full.select(*DOC, F.posexplode(F.transform("full", entry)).alias("pos", "e")).select(*DOC, "pos", "e.*")


def ranked(classes: DataFrame, *by: str) -> DataFrame:
    """``classes`` with ``rank``, increasing in the order of ``by``."""
    return cut(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))


def levels(suffixes: DataFrame, most: int) -> list[DataFrame]:
    """For 1, 2, 4, ... up to ``most`` lines: doc_id, th, pos, rank of the suffixes that share so long a prefix with others."""
    classes = ranked(suffixes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "h1", "h2")
    found = [cut(spread_join(suffixes.select(*DOC, "pos", "h1", "h2"), classes, ["h1", "h2"]).select(*DOC, "pos", "rank").dropDuplicates([*DOC, "pos"]))]
    reach = 1
    while 2 * reach <= most:
        last = found[-1]
        pairs = cut(last.withColumnRenamed("rank", "first").join(last.select(*DOC, (F.col("pos") - reach).alias("pos"), F.col("rank").alias("second")), [*DOC, "pos"]))
        classes = ranked(pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "first", "second")
        found.append(cut(spread_join(pairs, classes, ["first", "second"]).select(*DOC, "pos", "rank")))
        drop_cut(pairs, classes)
        reach *= 2
    return found


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th and ``runs``, an array of (pos, w): runs of lines that have an earlier copy."""
    suffixes = cut(lines(keyed(docs, id_col, text_col), min_words))
    by_level = levels(suffixes, min_words)
    forward = suffixes.filter("wf is not null").select(*DOC, "pos", F.col("wf").alias("w"))
    backward = suffixes.filter("wb is not null and wb > 1").select(*DOC, (F.col("pos") - F.col("wb") + 1).alias("pos"), F.col("wb").alias("w"))
    short = forward.filter("w = 1")
    long = cut(forward.filter("w > 1").unionByName(backward).distinct())
    named = [short.join(by_level[0], [*DOC, "pos"]).select(*DOC, "pos", "w", F.col("rank").alias("r1"), F.col("rank").alias("r2"))]
    for a, level in enumerate(by_level):
        own = long.filter(F.col("w").between(1 << a, (2 << a) - 1)).withColumn("end", F.col("pos") + F.col("w") - (1 << a))
        head = level.withColumnRenamed("rank", "r1")
        tail = level.select(*DOC, F.col("pos").alias("end"), F.col("rank").alias("r2"))
        named.append(own.join(head, [*DOC, "pos"]).join(tail, [*DOC, "end"]).select(*DOC, "pos", "w", "r1", "r2"))
    runs = named[0]
    for more in named[1:]:
        runs = runs.unionByName(more)
    runs = cut(runs)
    key = ["w", "r1", "r2"]
    firsts = cut(runs.groupBy(*key).agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = spread_join(runs, firsts, key).filter(F.struct("doc_id", "th", "pos") != F.col("first"))
    out = cut(later.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("pos", "w"))).alias("runs")))
    drop_cut(suffixes, long, runs, firsts, *by_level)
    return out


def without(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int, int]:
    """The text without its runs, and how many lines with words it had, lost, and in how many stretches."""
    gone: set[int] = set()
    for pos, w in runs:
        gone.update(range(pos, pos + w))
    out, n, left = [], 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            if n not in gone:
                out.append(line)
                left += 1
            n += 1
        else:
            out.append(line)
    stretches = sum(p - 1 not in gone for p in gone)
    return ("\n".join(out) if left or not gone else ""), n, len(gone), stretches


def rebuilt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Each row in a struct ``_row``, and a struct ``_lines`` (text, n_lines, n_removed, n_runs)."""
    later = later_copies(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("runs").alias("_runs"))
    text = F.coalesce(F.col("_text").cast("string"), F.lit(""))
    rows = held(docs, _text=text_col, _own=id_col)
    joined = rows.join(later.hint("merge"), (F.coalesce(F.col("_own").cast("long"), F.lit(NO_ID)) == F.col("_id")) & (F.xxhash64(text) == F.col("_th")), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long, n_runs long")
    def clean(texts, runs):
        import pandas as pd

        rows = [without(t, [(r["pos"], r["w"]) for r in x] if x is not None else []) for t, x in zip(texts, runs, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "n_runs"])

    return joined.withColumn("_lines", clean(text, F.col("_runs")))


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later copies of repeated runs of lines; a document of which nothing stays is dropped."""
    done = rebuilt(docs, id_col, text_col, min_words)
    changed = F.col("_lines.n_removed") > 0
    return done.filter(~(changed & (F.col("_lines.text") == ""))).select(*(F.when(changed, F.col("_lines.text")).otherwise(F.col(f"_row.`{c}`")).alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rebuilt(table(spark, sf_dir, "documents"))
    return done.select("_row.doc_id", "_lines.n_lines", "_lines.n_removed", "_lines.n_runs", F.sha2(F.col("_lines.text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM d),
l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM s),
m AS (SELECT *, len(regexp_extract_all(line, '[^ \\t\\n\\x0B\\f\\r]+')) AS nw FROM l),
p AS (SELECT doc_id, line_no, line, nw, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos,
             sum(nw) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM m WHERE nw > 0),
f AS (SELECT a.doc_id, a.pos AS first_pos, min(b.pos) AS last_pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS - 1}
      WHERE b.upto - a.upto + a.nw >= {MIN_WORDS} GROUP BY 1, 2),
g AS (SELECT b.doc_id, max(a.pos) AS first_pos, b.pos AS last_pos FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.pos BETWEEN b.pos - {MIN_WORDS - 1} AND b.pos
      WHERE b.upto - a.upto + a.nw >= {MIN_WORDS} GROUP BY 1, 3),
w AS (SELECT doc_id, first_pos, last_pos FROM f UNION SELECT doc_id, first_pos, last_pos FROM g),
t AS (SELECT w.doc_id, first_pos, last_pos, string_agg(line, chr(10) ORDER BY pos) AS content FROM w JOIN p ON w.doc_id = p.doc_id AND pos BETWEEN first_pos AND last_pos GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first_pos) AS copy FROM t),
gone AS (SELECT DISTINCT p.doc_id, p.pos, p.line_no FROM r JOIN p ON r.doc_id = p.doc_id AND p.pos BETWEEN r.first_pos AND r.last_pos WHERE copy > 1),
c AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE pos - 1 <> coalesce(before, -9)) AS n_runs
      FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY 1),
k AS (SELECT m.doc_id, count(*) FILTER (WHERE m.nw > 0) AS n_lines,
             string_agg(m.line, chr(10) ORDER BY m.line_no) FILTER (WHERE gone.pos IS NULL) AS body,
             count(*) FILTER (WHERE m.nw > 0 AND gone.pos IS NULL) AS n_left
      FROM m LEFT JOIN gone ON m.doc_id = gone.doc_id AND m.line_no = gone.line_no GROUP BY 1)
SELECT k.doc_id, k.n_lines, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_runs, 0) AS n_runs,
       sha256(CASE WHEN n_left > 0 OR c.n_removed IS NULL THEN coalesce(body, '') ELSE '' END) AS kept_sha256
FROM k LEFT JOIN c ON k.doc_id = c.doc_id
"""

