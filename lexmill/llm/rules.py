"""Quality rules with adaptive thresholds, in DataFrame and SQL functions only.

Counts come from each text; ratios of them are gathered in KLL sketches per
language and source.  Sketches are merged upwards (language, then all), so that
a small group borrows the thresholds of the next larger one.  A document is
rejected where a ratio lies beyond its group's fence: the quartile plus a
multiple of the quartiles' distance, and at least a margin that keeps ordinary
spread within.

Where a quarter of a group is bad, its far quartile is of the bad ones.  So a
fence goes no further than the larger of two others: the next wider group's, and
one from the near side, the near quartile plus a multiple of what lies between
it and the twentieth next to the end.  That holds up to three quarters of bad
ones, and a group that is unlike the wider ones as a whole keeps a fence of its
own.  All documents have no wider group: there the near side binds alone, for
ratios with both fences from the median, as either end may be the bad one.

Defined cases: a null or blank text has no words and fails the base rules; null
languages and sources are groups of their own; repeated rows are judged each;
columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import cut, held, table

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Documents a group needs for thresholds of its own.
GROUP_MIN = 200
SKETCH_K = 1024
#: ratio -> (multiple of the quartile distance, margin below, margin above); None: no fence on that side.
FENCES: dict[str, tuple[float, float | None, float]] = {
    "chars_per_word": (6.0, 1.5, 6.0),
    "symbols_per_word": (6.0, None, 0.25),
    "dup_lines_per_line": (6.0, None, 0.5),
    "stutters_per_word": (6.0, None, 0.3),
}
SPACE = "[ \\x09-\\x0D]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside further lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(hashes: Column, starts: Column) -> Column:
    """Words covered by windows that occur twice or more.

    ``starts`` holds the window hashes; they are sorted with their places, those with an equal neighbour are places of
    repeated windows, and each covers WINDOW words less what the next place covers anew.
    """
    by_hash = F.sort_array(F.transform(starts, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def equal_neighbours(p: Column) -> Column:
        last = F.size(p) - 1
        return F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == x["h"])))

    places = F.sort_array(F.transform(let(by_hash, equal_neighbours), lambda x: x["i"]))
    covered = let(places, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(starts)) < F.size(starts), covered).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``_q`` of counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    line_has_word = lambda x: F.length(F.regexp_replace(x, f"{SPACE}+", "")) > 0
    step = docs.withColumns({"_words": F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), "_lines": F.filter(F.split(text, "\n"), line_has_word)})
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    count = F.size("_hashes")
    window = F.transform(F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))))
    step = step.withColumn("_starts", F.when(count >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn(
        "_q",
        F.struct(
            count.cast("long").alias("n_words"),
            F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.size("_lines").cast("long").alias("n_lines"),
            repeated_words(F.col("_hashes"), F.col("_starts")).alias("n_repeat_words"),
            F.size(F.filter("_hashes", lambda h, i: (i > 0) & (F.get("_hashes", i - 1) == h))).cast("long").alias("n_stutters"),
        ),
    )
    # Always true; as it isn't deterministic, the optimizer leaves the counts in one projection instead of writing them out in each place that reads a field.
    return step.select(*(F.col(f"`{c}`") for c in docs.columns), F.when(F.monotonically_increasing_id() >= 0, F.col("_q")).alias("_q"))


def base_failed(q: Column) -> Column:
    return (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])


def ratios(q: Column) -> dict[str, Column]:
    words = F.greatest(q["n_words"], F.lit(1))
    return {
        "chars_per_word": q["word_chars"] / words,
        "symbols_per_word": q["n_symbols"] / words,
        "dup_lines_per_line": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
        "stutters_per_word": q["n_stutters"] / words,
    }


def fences(q: DataFrame, lang: str = "_lang", source: str = "_source") -> DataFrame:
    """Thresholds of every (language, source): low_<ratio> and high_<ratio>.

    Only documents that pass the base rules shape them.
    """
    values = q.filter(~base_failed(F.col("_q"))).select(lang, source, *(v.alias(k) for k, v in ratios(F.col("_q")).items()))
    own = values.groupBy(lang, source).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"kll_sketch_agg_double({k}, {SKETCH_K})").alias(k) for k in FENCES))
    own = cut(own)
    merged = [F.sum("n").alias("n"), *(F.expr(f"kll_merge_agg_double({k}, {SKETCH_K})").alias(k) for k in FENCES)]
    widest = limits_of(own.agg(*merged), alone=True).select(*(bounded(c, F.col(f"near_{c}")).alias(c) for c in LIMITS)).first()
    limit = {c: F.lit(widest[c]).cast("double") for c in LIMITS}
    wider = limits_of(own.groupBy(lang).agg(*merged), lang).select(F.col(lang).alias("_wider"), F.struct("n", *(bounded(c, further(c, limit[c])).alias(c) for c in LIMITS)).alias("l1"))
    levels = limits_of(own, lang, source).join(wider, F.col(lang) == F.col("_wider"))
    chosen = [F.when(F.col("n") >= GROUP_MIN, bounded(c, further(c, F.col(f"l1.{c}")))).when(F.col("l1.n") >= GROUP_MIN, F.col(f"l1.{c}")).otherwise(limit[c]).alias(c) for c in LIMITS]
    return levels.select(F.col(lang).alias("_f_lang"), F.col(source).alias("_f_source"), *chosen)


LIMITS = [f"{side}_{k}" for k in FENCES for side in ("low", "high")]


def bounded(limit: str, bound: Column) -> Column:
    """The limit, but no further out than ``bound``."""
    return (F.greatest if limit.startswith("low") else F.least)(F.col(limit), bound)


def further(limit: str, other: Column) -> Column:
    """What lies further out: the near side's limit or ``other``."""
    return (F.least if limit.startswith("low") else F.greatest)(F.col(f"near_{limit}"), other)


def limits_of(sketches: DataFrame, *by: str, alone: bool = False) -> DataFrame:
    """Group columns, n, the LIMITS that the sketches of each group give, and as near_<limit> those from the near side; ``alone``: no wider group bounds them."""
    out = []
    for k, (reach, below, above) in FENCES.items():
        at = lambda p: F.expr(f"kll_sketch_get_quantile_double({k}, {p})")  # noqa: B023, E731
        q1, q3 = at(0.25), at(0.75)
        near, end = (0.5, 0.25) if alone and below is not None else (0.25, 0.05)
        none = F.lit(None).cast("double")
        found = {
            f"low_{k}": q1 - F.greatest(reach * (q3 - q1), F.lit(below)) if below is not None else none,
            f"high_{k}": q3 + F.greatest(reach * (q3 - q1), F.lit(above)),
            f"near_low_{k}": at(1 - near) - F.greatest(2 * reach * (at(1 - end) - at(1 - near)), F.lit(below)) if below is not None else none,
            f"near_high_{k}": at(near) + F.greatest(2 * reach * (at(near) - at(end)), F.lit(above)),
        }
        out += [F.when(F.col("n") > 0, x).alias(c) for c, x in found.items()]
    return sketches.select(*by, "n", *out)


def judged(q: DataFrame, limits: DataFrame) -> DataFrame:
    """``q`` (with _q, _lang, _source) plus ``_kept``."""
    joined = q.join(limits, (F.col("_lang") == F.col("_f_lang")) & (F.col("_source") == F.col("_f_source")), "left")
    beyond = F.lit(False)
    for k, v in ratios(F.col("_q")).items():
        beyond = beyond | F.coalesce(v > F.col(f"high_{k}"), F.lit(False)) | F.coalesce(v < F.col(f"low_{k}"), F.lit(False))
    return joined.withColumn("_kept", ~base_failed(F.col("_q")) & ~beyond)


def grouped(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return measured(held(docs, _text=text_col, _lang=lang_col, _source=source_col), "_text").withColumns({"_lang": group("_lang"), "_source": group("_source")})


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns.  Rows are written with their counts, which are made once."""
    q = cut(grouped(docs, text_col, lang_col, source_col).select("_row", "_lang", "_source", "_q"))
    limits = cut(fences(q))
    return judged(q, limits).filter("_kept").select("_row.*")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: counts, base_failed, kept."""
    q = cut(grouped(docs, text_col, lang_col, source_col).select(F.col(f"_row.`{id_col}`").alias("doc_id"), "_lang", "_source", "_q"))
    return judged(q, cut(fences(q))).select("doc_id", "_q.n_words", "_q.word_chars", "_q.n_symbols", "_q.n_dup_lines", "_q.n_repeat_words", base_failed(F.col("_q")).alias("base_failed"), F.col("_kept").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Counts and base verdict of one text, for tests."""
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(WINDOW)}
    failed = len(words) < LEAST_WORDS or 100 * len(covered) > MOST_REPEATED * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed
