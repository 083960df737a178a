"""Search: fuzzy expansion, combinations, conjunction with phrases, relaxation, ranking.

One search is a small job over the dictionary (expansions) and one match of the
postings, from which the counts for the early stop and the top rows are read.
Many queries can be matched together; see ``batch``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import score as S
from lexmill.functions import text as T
from lexmill.model import TOP_K, Query

#: Combinations tried: of edit distances, and of terms for each of these.
COST_COMBOS, TERM_COMBOS = 10, 10
#: Hits after which no further combination is begun, and below which tokens are dropped.
ENOUGH, FEW = 50, 100
CRITERIA = 4


def most_distance(term: str) -> int:
    """Edit distance allowed for a term, by its bytes."""
    n = len(term.encode())
    return 0 if n <= 3 else 1 if n <= 6 else 2


def allowed(term: Column) -> Column:
    """The same for a column of terms."""
    size = F.octet_length(term)
    return F.when(size <= 3, 0).when(size <= 6, 1).otherwise(2)


def distance_is(term: Column, token: str, d: int, code: Callable[[Column], Column] = T.folded, token_code: str | None = None) -> Column:
    """Whether a dictionary term is at exactly distance d of the token.

    Tokens that start in ASCII: bytes, with the first byte equal and the length within reach.  Others: equal at 0; the
    code at distance d - 1 beyond, without the token itself.
    """
    if d == 0:
        return term == token
    if ord(token[0]) < 128:
        size = len(token.encode())
        near = (F.substring(term, 1, 1) == token[0]) & F.octet_length(term).between(size - d, size + d)
        return F.when(near, T.byte_distance(term, token, d) == d).otherwise(F.lit(False))
    own = token_code if token_code is not None else token.translate(str.maketrans(T.MARKED, T.PLAIN))
    away = F.levenshtein(code(term), F.lit(own), d - 1) == d - 1
    return T.starts_outside_ascii(term) & (term != token) & away


@dataclass(frozen=True)
class Expansion:
    field: str
    token: str
    d: int
    term: str
    df: int
    avg_doc_len: float


def near(term: Column, token: str, fuzzy: bool) -> Column:
    """A cheap condition that holds for every term that may expand a token; reads of a sorted dictionary are pruned by it."""
    if not fuzzy or not most_distance(token):
        return term == token
    if ord(token[0]) < 128:
        size, most = len(token.encode()), most_distance(token)
        return term.startswith(token[0]) & F.octet_length(term).between(size - most, size + most)
    return term >= "\u0080"


def expand(stats: DataFrame, fields: tuple[str, ...], tokens: list[str], fuzzy: bool = True, code: Callable[[Column], Column] = T.folded, sound: Callable[[str], str] | None = None) -> tuple[list[Expansion], dict[tuple[str, str], int]]:
    """The most frequent dictionary terms for each field, token and distance, and each (field, token)'s summed frequency."""
    own = lambda t: sound(t) if sound else None
    cases = [F.when(distance_is(F.col("term"), t, d, code, own(t)), F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"))) for i, t in enumerate(tokens) for d in range((most_distance(t) if fuzzy else 0) + 1)]
    reach = reduce(Column.__or__, [near(F.col("term"), t, fuzzy) for t in tokens])
    hit = stats.filter(F.col("field").isin(*fields) & reach).withColumn("m", F.filter(F.array(*cases), lambda c: c.isNotNull())).filter(F.size("m") > 0).select("field", "term", "df", "avg_doc_len", F.explode("m").alias("m"))
    ranked = hit.withColumn("r", F.row_number().over(W.partitionBy("field", "m").orderBy(F.desc("df"), "term"))).withColumn("total", F.sum("df").over(W.partitionBy("field", "m.i")))
    rows = ranked.filter(F.col("r") <= TERM_COMBOS).orderBy("field", "m.i", "m.d", "r").collect()  # at most 10 a field, token and distance
    sums = {(r["field"], tokens[r["m"]["i"]]): int(r["total"]) for r in rows}
    return [Expansion(r["field"], tokens[r["m"]["i"]], r["m"]["d"], r["term"], r["df"], r["avg_doc_len"]) for r in rows], sums


COMBO = "field_no int, field string, boost double, level int, cost_no int, combo long, slot int, term string, cost int, df long, avg_doc_len double, q long, n int, m int, slop long"


def combinations(query: Query, tokens: list[tuple[str, list[int]]], found: list[Expansion], sums: dict[tuple[str, str], int], fuzzy: bool = True, relax: bool = True) -> list[tuple]:
    """Rows of COMBO: for each field and level of relaxation the first combinations of distances, and of terms for each."""
    by: dict[tuple[str, str, int], list[Expansion]] = {}
    for e in found:
        by.setdefault((e.field, e.token, e.d), []).append(e)
    rows, combo = [], 0
    for field_no, (field, boost) in enumerate(zip(query.fields, query.boosts, strict=True)):
        left, level = list(tokens), 0
        while left:
            m = len(left)
            slop = 2 * sum(len(t.encode()) for t, _ in left) // m
            costs = itertools.product(*(range((most_distance(t) if fuzzy else 0) + 1) for t, _ in left))
            for cost_no, cost in enumerate(itertools.islice(costs, COST_COMBOS)):
                choices = [by.get((field, t, d), []) for (t, _), d in zip(left, cost, strict=True)]
                for chosen in itertools.islice(itertools.product(*choices), TERM_COMBOS):
                    for slot, (e, (_, offsets)) in enumerate(zip(chosen, left, strict=True)):
                        rows.append((field_no, field, boost, level, cost_no, combo, slot, e.term, e.d, e.df, float(e.avg_doc_len), offsets[0], len(chosen), m, slop))
                    combo += 1
            # The rarest token goes; equal ones by order in the query.
            left.remove(min(left, key=lambda t: sums.get((field, t[0]), 0)))
            level += 1
            if not relax:
                break
    return rows


def phrase_count(slots: Column, slop: Column) -> Column:
    """Places of the rarest term with every other term at its place in the query, up to ``slop`` bytes later."""
    lead, others = slots[0], F.slice(slots, 2, F.greatest(F.size(slots) - 1, F.lit(0)))

    def stands(p: Column) -> Column:
        begin = p - lead["q"]
        return F.forall(others, lambda o: F.exists(o["offsets"], lambda x: (x - o["q"]).between(begin, begin + slop)))

    return F.size(F.filter(lead["offsets"], stands))


def matches(postings: DataFrame, combos: DataFrame, n_docs: int, scorer: S.Scorer = S.bm25, keys: tuple[str, ...] = ()) -> DataFrame:
    """Hits of all combinations: keys, field_no, level, cost_no, combo, seq_id, phrase_count, score.

    A document holds a combination when all its slots met; one exchange by document and combination does the work of a
    join for each term.
    """
    where = [*keys, "field_no", "level", "cost_no", "combo", "seq_id"]
    met = postings.join(F.broadcast(combos), ["field", "term"])  # at most 100 combinations a field and level
    part = scorer(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("avg_doc_len"), n_docs)
    slot = F.struct("df", "slot", "cost", "q", "offsets", part.alias("part"))
    grouped = met.groupBy(*where).agg(F.sort_array(F.collect_list(slot)).alias("slots"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("slop").alias("slop"), F.first("boost").alias("boost"))
    grouped = grouped.filter(F.size("slots") == F.col("n")).withColumn("phrase_count", phrase_count(F.col("slots"), F.col("slop")))
    costs = F.aggregate("slots", F.lit(0), lambda a, s: a + s["cost"])
    total = F.aggregate("slots", F.lit(0.0), lambda a, s: a + s["part"] * S.phrase_factor(F.col("phrase_count"), F.col("m")) * S.cost_factor(s["cost"]))
    return grouped.select(*where, "phrase_count", (F.col("boost") * S.total_cost_factor(costs, F.col("n")) * total).alias("score"))


def kept(counts: list[tuple[int, int, int, int]], combos: list[tuple]) -> set[tuple[int, int, int]]:
    """(field_no, level, cost_no) that are begun, from (field_no, level, cost_no, hits): a combination starts while no more
    than ENOUGH hits came before it, a level while fewer than FEW did."""
    hits = {c[:3]: c[3] for c in counts}
    out: set[tuple[int, int, int]] = set()
    total = 0
    order = sorted({(r[0], r[3], r[4]) for r in combos})
    for (_, level), group in itertools.groupby(order, key=lambda c: c[:2]):
        if level and total >= FEW:
            continue
        for c in group:
            if total <= ENOUGH:
                out.add(c)
                total += hits.get(c, 0)
    return out


def ranked(best: DataFrame, query: Query, sort_columns: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """rank, seq_id, score (the first criterion), bm25: the sort keys in order, then the score; at most four criteria."""
    keys = query.sort[:CRITERIA]
    if keys:
        best = best.join(sort_columns, "seq_id", "left")
    criteria = [F.col(f"`{s.field}`").asc_nulls_last() if s.ascending else F.col(f"`{s.field}`").desc_nulls_last() for s in keys]
    if len(keys) < CRITERIA:
        criteria.append(F.col("bm25").desc())
    top = best.orderBy(*criteria, "seq_id").limit(k)
    first = F.col("bm25")
    if keys:
        value = F.col(f"`{keys[0].field}`").cast("double")
        first = -value if keys[0].ascending else value
    number = F.row_number().over(W.orderBy(*criteria, "seq_id"))  # over at most k rows
    return top.select(number.alias("rank"), "seq_id", first.alias("score"), "bm25")


def search(
    postings: Callable[[list[str]], DataFrame],
    stats: DataFrame,
    n_docs: int,
    query: Query,
    sort_columns: DataFrame | None = None,
    scorer: S.Scorer = S.bm25,
    fuzzy: bool = True,
    exhaustive: bool = False,
    relax: bool = True,
    k: int = TOP_K,
    tokenize: Callable[[str], list[tuple[str, list[int]]]] = T.query_terms,
    code: Callable[[Column], Column] = T.folded,
    sound: Callable[[str], str] | None = None,
) -> DataFrame:
    """The best documents of a query.  ``postings(terms)`` gives the postings of the terms that are asked for.

    ``exhaustive`` runs every combination whatever the hits so far; ``relax=False`` keeps all tokens.  Postings are matched
    once: hits are kept until the counts for the early stop and the top rows have been read from them.  ``code`` and
    ``sound`` give the sound of a term and of a token.
    """
    spark = stats.sparkSession
    tokens = tokenize(query.text)
    schema = "rank int, seq_id long, score double, bm25 double"
    found, sums = expand(stats, query.fields, [t for t, _ in tokens], fuzzy, code, sound) if tokens and query.fields else ([], {})
    rows = combinations(query, tokens, found, sums, fuzzy, relax)
    if not rows:
        return spark.createDataFrame([], schema)
    hits = matches(postings(sorted({r[7] for r in rows})), spark.createDataFrame(rows, COMBO), n_docs, scorer)
    best = lambda h: ranked(h.groupBy("seq_id").agg(F.max("score").alias("bm25")), query, sort_columns, k)
    if exhaustive or len({(r[0], r[3], r[4]) for r in rows}) == 1:
        return best(hits)
    hits = hits.persist()
    try:
        counts = hits.groupBy("field_no", "level", "cost_no").count().collect()
        begun = spark.createDataFrame(sorted(kept([tuple(c) for c in counts], rows)), "field_no int, level int, cost_no int")
        top = best(hits.join(F.broadcast(begun), ["field_no", "level", "cost_no"], "left_semi")).collect()  # at most k rows; a row a combination of distances
    finally:
        hits.unpersist()
    return spark.createDataFrame(top, schema)


def batch(postings: DataFrame, stats: DataFrame, n_docs: int, queries: DataFrame, field: str, scorer: S.Scorer = S.bm25, k: int = TOP_K) -> DataFrame:
    """Exact conjunctive search of many queries(query_id, text) in one plan: query_id, rank, seq_id, bm25.

    A query's rarest word names the documents that can match; these are looked up for its other words by word and document
    together, so that a common word is spread over all tasks.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    known = words.join(stats.filter(F.col("field") == field).select("term", "df", "avg_doc_len"), "term", "left")
    sizes = known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rare"))
    asked = postings.filter(F.col("field") == field).select("term", "seq_id", "tf", "doc_len").join(words.select("term").distinct(), "term", "left_semi")
    able = sizes.filter("rare.df > 0").select("query_id", "n", F.col("rare.term").alias("term")).join(asked.select("term", "seq_id"), "term").select("query_id", "n", "seq_id")
    met = able.join(known, "query_id").join(asked, ["term", "seq_id"])
    part = scorer(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("avg_doc_len"), n_docs)
    hits = met.groupBy("query_id", "seq_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("got"), F.sum(part).alias("bm25")).filter("n = got")
    # Parts come in any order, so sums of equal parts differ in their last bits: rounded, they tie and the document decides.
    order = W.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "seq_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "seq_id", "bm25")
