"""Text functions as column expressions, with Python twins for query strings."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import cut

#: One byte each; line breaks and other marks are no separators.
SEPARATORS = "[ .|,:;&]"


def pieces(text: Column) -> Column:
    """All stretches between separators, empty ones included: their lengths tell where each one stands."""
    return F.split(text, SEPARATORS, -1)


def terms(text: Column) -> Column:
    """The tokens of a text, in order."""
    return F.filter(pieces(text), lambda t: t != "")


def query_terms(text: str) -> list[tuple[str, list[int]]]:
    """Distinct tokens of a query string with their byte positions, in order of the first."""
    found: dict[str, list[int]] = {}
    at = 0
    for piece in re.split(SEPARATORS, text):
        if piece:
            found.setdefault(piece, []).append(at)
        at += len(piece.encode()) + 1
    return list(found.items())


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a token: id_col, term, offset (byte position), doc_len (bytes of the text).  Each text is cut in its place."""
    return cut.tokens(docs, id_col, text_col)


def starts_outside_ascii(term: Column) -> Column:
    """Whether the first character is not ASCII: such terms are matched by sound."""
    return F.ascii(term) > 127


def byte_string(text: Column) -> Column:
    """A string with one character for each UTF-8 byte, for distances in bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_distance(term: Column, query: str, most: int) -> Column:
    """Levenshtein distance in bytes, -1 beyond ``most``."""
    return F.levenshtein(byte_string(term), F.lit(query.encode().decode("latin-1")), most)


def without(text: Column, char: str) -> Column:
    """Remove all occurrences of a character."""
    return F.replace(text, F.lit(char), F.lit(""))


def edge_ngrams(text: Column, min_gram: int, max_gram: int) -> Column:
    """Prefixes of min_gram to max_gram - 1 characters; a shorter text is its own prefix."""
    size = F.char_length(text)
    low, high = F.least(F.lit(min_gram), size), F.least(size, F.lit(max_gram - 1))
    return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.substring(text, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


#: Letters with marks and what they sound like: a code for terms that the dictionary of sounds lacks.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def folded(term: Column) -> Column:
    """The default code of a term: marks taken off Latin letters, all else as it is."""
    return F.translate(term, MARKED, PLAIN)


def drop_stop_words(tokens_: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Tokens whose term is not in ``stop_words(term)``."""
    return tokens_.join(stop_words, "term", "left_anti")


def read_stop_words(spark, path: str) -> DataFrame:
    """One word a line."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> ''").distinct()


def stop_list(words: Iterable[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))
