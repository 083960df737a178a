"""Byte-level BPE encoding and decoding by speculation and verification.

A word's tokens are first proposed by greedy longest match.  A sequence of
tokens is the BPE encoding of its bytes if, and only if, every two adjacent
tokens, encoded together, come out as those two tokens again; so one vectorised
check of all adjacent pairs of a batch of words decides which proposals stand.
Words with a failing pair are merged exactly, rank by rank.

Words repeat, so their ids are kept in a cache of bounded bytes for each task;
it is emptied when the task ends, as workers stay alive.

Defined cases: a null text counts as empty and has no ids; a special token's
text within a document becomes that token, as in the library's default; ids are
little-endian unsigned 32-bit integers; repeated rows are encoded each; a text
or word may be of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import per_text, table, texts_of
from lexmill.llm.merges import LONG, Merges, Trie

VOCABULARY = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of each half of a cache, and what an entry takes beside its key and value; the older half goes when the younger is full.
CACHE, ENTRY = 12 << 20, 180
#: Bytes of text that are cut up at once.
CHUNK = 1 << 22
#: The same words, faster, for texts of characters on whose classes both modules agree: ASCII, letters of Latin, some marks.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
PLAIN = re.compile(rf" ?[{LETTERS}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{LETTERS}0-9]++|\s+(?!\S)|\s+")
ODD = re.compile("[^\\x09-\\x0D\\x20-\\x7E\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2026]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Halves(dict):
    """A cache of bounded bytes: an entry that is used again moves from the older half to the younger."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}
        self.used = 0

    def missing(self, keys: set) -> list:
        """Keys without an entry; those of the older half are brought over."""
        if self.used > CACHE:
            self.older = dict(self)
            self.clear()
            self.used = 0
        absent, older = keys.difference(self), self.older
        if not older:
            return list(absent)
        back = list(absent.intersection(older))
        self.keep(back, [older[k] for k in back])
        return list(absent.difference(older))

    def keep(self, keys: list, values: list[bytes]) -> None:
        self.update(zip(keys, values, strict=True))
        self.used += ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def empty(self) -> None:
        self.clear()
        self.older = {}
        self.used = 0


def pieces_of(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Ids of words, one after another, as one binary a word."""
    raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        raw = model["vocab"]
        tokens = {bytes(letters[c] for c in t): i for t, i in raw.items()}
        self.single = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
        self.merges = Merges([(raw[a], raw[b], raw[a + b]) for a, b in merges], max(raw.values()) + 1)
        # A token that its own bytes are not merged to never comes out, so it is not proposed.
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat, new = self.merges.exact(self.single[np.frombuffer(b"".join(tokens), np.uint8)], sizes)
        own = np.fromiter(tokens.values(), np.int64, len(tokens))
        sound = (new == 1) & (flat[np.cumsum(new) - new] == own)
        self.id_of = {t: i for (t, i), s in zip(tokens.items(), sound.tolist()) if s}
        self.trie = Trie(self.id_of)
        self.longest = max(map(len, self.id_of))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: t for t, i in tokens.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_in = regex.compile(PATTERN).findall
        self.words = Halves()

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match, for a long word."""
        out, at, n, ids, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            end = min(n, at + longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and how many each has: proposals, one check of all adjacent pairs, exact merging of what fails."""
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        flat, sizes = self.trie.greedy(data, starts, np.where(lengths > LONG, 0, lengths))
        long = np.flatnonzero(lengths > LONG)
        if long.size:
            proposed = [np.array(self.propose(words[w]), np.int32) for w in long.tolist()]
            flat, sizes = put(flat, sizes, long, np.concatenate(proposed), np.array([p.size for p in proposed]))
        owner = np.repeat(np.arange(lengths.size), sizes)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        keys, place = np.unique((flat[at].astype(np.int64) << 32) | flat[at + 1], return_inverse=True)
        good = self.merges.compatible(keys >> 32, keys & 0xFFFFFFFF)
        failed = np.unique(owner[at[~good[place]]])
        if failed.size:
            n = lengths[failed]
            inside = np.repeat(starts[failed] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            flat, sizes = put(flat, sizes, failed, *self.merges.exact(self.single[data[inside]], n))
        return flat, sizes

    def cut(self, text: str) -> list[str]:
        """The words of a text; a special token is one."""
        cut = self.cut_special
        if cut and cut.search(text):
            return [w for piece in cut.split(text) for w in ([piece] if piece in self.special else self.cut(piece))]
        return self.words_in(text) if ODD.search(text) else PLAIN.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        parts = [self.cut(t) for t in texts]
        distinct: set[str] = set()
        for words in parts:
            distinct.update(words)
        new = self.words.missing(distinct)
        special = [w for w in new if w in self.special] if self.special else []
        if special:
            self.words.keep(special, [self.special[w].to_bytes(4, "little") for w in special])
            new = [w for w in new if w not in self.special]
        if new:
            self.words.keep(new, pieces_of(*self.encode_words([w.encode() for w in new])))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in parts]

    def release(self) -> None:
        """Empty the cache."""
        self.words.empty()

    def decode_bytes(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for, as UTF-8 with invalid parts replaced."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def put(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' ids, one after another, and their numbers, with those of the words ``rows`` (in order) replaced."""
    total = sizes.copy()
    total[rows] = counts
    fresh = np.zeros(sizes.size, bool)
    fresh[rows] = True
    out, which = np.empty(int(total.sum()), np.int32), np.repeat(fresh, total)
    out[which] = ids
    out[~which] = flat[~np.repeat(fresh, sizes)]
    return out, total


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ``ids``: binary, little-endian unsigned 32-bit."""
    path = path or default_path()

    def work():
        return lambda texts: [codec(path).encode(texts)]

    return per_text(texts_of(docs, id_col, text_col), work, [("ids", pa.binary())], "ids binary", chunk=CHUNK, after=lambda: codec(path).release())


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``."""
    path = path or default_path()

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode_bytes(x or b"").decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number and hash of its ids and the hash of their decoding, in one pass."""
    path = path or default_path()

    def work():
        own = codec(path)

        def apply(texts: list[str]) -> list[list]:
            ids = own.encode(texts)
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(own.decode_bytes(x)).hexdigest() for x in ids]]

        return apply

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return per_text(texts_of(docs), work, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", chunk=CHUNK, after=lambda: codec(path).release())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


