"""Texts cut into tokens and postings, batch by batch, in passes that exchange nothing: whatever a text yields is found within its row.

Separators are single bytes, so texts are cut as bytes; all steps are array operations over many texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(b" .|,:;&")] = True
#: Bytes of texts that are cut at once (or one text), those whose postings are packed together, and rows that are handed on at once.
CHUNK, PACK, ROWS = 1 << 22, 1 << 24, 1 << 15


def cut(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts without nulls: each token's text (by number), the token, its byte position, and each text's bytes."""
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    word = ~SEPARATOR[data]
    # Tokens begin and end at separators and where texts do.
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~word[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(word & edge[:-1])
    edge[:-1] = ~word
    edge[bounds] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    row = np.searchsorted(bounds, starts, "right") - 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data[word])).cast(pa.string())
    return row, terms, starts - bounds[row], np.diff(bounds)


def slices(batch: pa.RecordBatch, column: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows that hold at most ``chunk`` bytes in a column of strings or bytes, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        yield batch.slice(at, till - at)
        at = till


def lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists that end at these places of the values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def runs(row: np.ndarray, terms: pa.Array, by_term: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Tokens in order of text and term (or of term and text): the order, and of each posting the first token, text, term and the terms' names."""
    found = terms.dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms, n_rows = max(len(found.dictionary), 1), int(row[-1]) + 1 if len(row) else 1
    key = code * n_rows + row if by_term else row * n_terms + code
    order = np.argsort(key, kind="stable")
    start = firsts(key[order])
    lead = order[start]
    return order, start, row[lead], code[lead], found.dictionary


def _tokens(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    row, terms, place, sizes = cut(texts)
    return [ids.take(pa.array(row)), terms, pa.array(place, pa.int64()), pa.array(sizes[row], pa.int64())]


def _postings(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    row, terms, place, sizes = cut(texts)
    order, start, text, code, names = runs(row, terms, by_term=False)
    ends = np.append(start[1:], len(order))[: len(start)]
    return [names.take(pa.array(code)), ids.take(pa.array(text)), pa.array(ends - start, pa.int64()), pa.array(sizes[text], pa.int64()), lists(ends, place[order], pa.int64())]


def coded(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers from 0 on that end at these places, each run as bytes: seven bits a byte, low ones first, the top bit where more follow."""
    width = np.ones(len(values), np.int64)
    for k in range(1, 9):
        width += values >= (1 << 7 * k)
    at = np.zeros(len(values) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    data = np.zeros(at[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        more = np.flatnonzero(width > k)
        data[at[more] + k] = (values[more] >> 7 * k & 127) | ((width[more] > k + 1) << 7)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at[np.concatenate([[0], ends])]), pa.py_buffer(data)]).cast(pa.binary())


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of such bytes, and where each row's run ends."""
    bounds = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    last = np.flatnonzero(data < 128)
    start = np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else np.zeros(0, np.int64)
    width = last - start + 1
    values = np.zeros(len(last), np.int64)
    for k in range(int(width.max(initial=0))):
        more = np.flatnonzero(width > k)
        values[more] |= (data[start[more] + k] & 127).astype(np.int64) << 7 * k
    return values, np.searchsorted(last, bounds[1:] - bounds[0], "left")


def steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before, and from 0 where a run starts."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The inverse of ``steps``."""
    total = np.cumsum(values)
    before = (total - values)[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(values))))


def _packed(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    seq, elem = (ids.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    if (np.diff(seq) < 0).any():
        by_seq = np.argsort(seq, kind="stable")
        seq, elem, texts = seq[by_seq], elem[by_seq], texts.take(pa.array(by_seq))
    row, terms, place, sizes = cut(texts)
    order, start, text, code, names = runs(row, terms, by_term=True)
    head = firsts(code)
    till = np.append(head[1:], len(start))[: len(head)]
    tf = np.append(start[1:], len(order))[: len(start)] - start
    first = seq[text[head]]
    step = steps(seq[text], head)
    step[head] = 0
    # Most rows hold no elements but the first: theirs are left out.
    many = np.maximum.reduceat(elem[text], head) > 0 if len(head) else head > 0
    size = till - head
    return [
        names.take(pa.array(code[head])),
        pa.array(first, pa.int64()),
        coded(step, till),
        coded(elem[text][np.repeat(many, size)], np.cumsum(size * many)),
        coded(tf, till),
        coded(sizes[text], till),
        coded(steps(place[order], start), np.append(start, len(order))[till]),
    ]


def _unpacked(batch: pa.RecordBatch) -> list[pa.Array]:
    (step, ends), (some, elem_ends), (tf, _), (size, _), (place, _) = (decoded(batch.column(k)) for k in range(3, 8))
    counts = np.diff(ends, prepend=0)
    each = np.repeat(np.arange(batch.num_rows), counts)
    first = batch.column(2).to_numpy(zero_copy_only=False)
    elem = np.zeros(len(tf), np.int64)
    elem[np.repeat(np.diff(elem_ends, prepend=0) > 0, counts)] = some
    token_ends = np.cumsum(tf)
    places = sums(place, token_ends - tf)
    fields, terms = (batch.column(k).take(pa.array(each)) for k in (0, 1))
    seq = first[each] + sums(step, ends - counts)
    return [fields, terms, pa.array(seq, pa.int64()), pa.array(elem, pa.int32()), pa.array(tf, pa.int64()), pa.array(size, pa.int64()), lists(token_ends, places, pa.int64())]


def _mapped(docs: DataFrame, id_col: str, text_col: str, work, fields: str, chunk: int = CHUNK) -> DataFrame:
    """``fields`` with ID as the type of the id."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).filter("_text is not null")
    out = D.StructType.fromDDL(fields.replace("ID", rows.schema["_id"].dataType.simpleString()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, chunk):
                made = pa.RecordBatch.from_arrays(work(part.column(0), part.column(1)), names=out.names)
                for at in range(0, made.num_rows, ROWS):
                    yield made.slice(at, ROWS)

    return rows.mapInArrow(run, out)


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a token: id_col, term, offset (byte position), doc_len (bytes of the text)."""
    return _mapped(docs, id_col, text_col, _tokens, "_id ID, term string, offset bigint, doc_len bigint").withColumnRenamed("_id", id_col)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a term and text: term, id_col, tf, doc_len, offsets (in order)."""
    return _mapped(docs, id_col, text_col, _postings, "term string, _id ID, tf bigint, doc_len bigint, offsets array<bigint>").withColumnRenamed("_id", id_col)


PACKED = "term string, first bigint, steps binary, elems binary, tfs binary, doc_lens binary, places binary"


def packed(rows: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """Postings of texts with a key (seq_id, elem), those of one term and slice of texts in a row of bytes, so that an exchange moves little."""
    return _mapped(rows, key_col, text_col, _packed, PACKED, PACK)


def unpacked(found: DataFrame) -> DataFrame:
    """The postings of packed rows with their field, in their order."""
    names = ["field", "term", "seq_id", "elem", "tf", "doc_len", "offsets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 7, PACK // 8):
                made = pa.RecordBatch.from_arrays(_unpacked(part), names=names)
                for at in range(0, made.num_rows, ROWS):
                    yield made.slice(at, ROWS)

    return found.select("field", *(f.split()[0] for f in PACKED.split(", "))).mapInArrow(run, "field string, term string, seq_id bigint, elem int, tf bigint, doc_len bigint, offsets array<bigint>")
