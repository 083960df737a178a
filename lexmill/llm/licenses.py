"""Licence scans: a positional index of rare licence words.

Every licence word gets an inverse document frequency counted over the whole
corpus.  A file's words are looked up in an index of the rarest words of each
template with their places there; postings that agree on the relative position
(template start in the file) vote for an alignment; an alignment that gathers
enough of its template's weight and, looked at last, holds the mandatory key
phrase gives a label.  The rarest words are as many as weigh more than an
alignment may miss, so every alignment with enough weight has a vote; a file
with none of them is done after that look-up.  Base phrases are posted under
their rarest word in the same way.

Templates are short licences' notices clause by clause, so that a clause that
was changed, or broken by words between, leaves the others' places intact.

Defined cases: a null or empty text has no words, no labels and score 0; places
of base phrases may overlap; repeated rows are scanned each, whatever
their ids, which may be null; texts may be of any length; columns of other names
are left out.  ``score`` is the
largest share of a verified template's weight that one alignment matches.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import per_text, table, texts_of

#: phrase -> label; the base of every result.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, mandatory key phrase, template words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "except in compliance with the license", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "gnu general public license", "under the terms of the gnu general public license"),
    ("gpl", "gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license", "made available under the terms of the eclipse public license which accompanies this distribution"),
    ("isc", "permission to use copy modify and or distribute", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "cc by", "licensed under cc by 4 0"),
    ("cc0", "cc0 1 0", "this work is dedicated to the public domain under cc0 1 0 universal"),
    # Further clauses of the full notices, those that other licences do not share.
    ("mit", "this permission notice shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache", "specific language governing permissions and limitations under the license", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "may be used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "copy of the gnu general public license along with", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "copy of the gnu lesser general public license along with", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl", "copy of the gnu affero general public license along with", "you should have received a copy of the gnu affero general public license along with this program"),
    ("mpl", "copy of the mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "this permission notice appear in all copies", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("boost", "obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("zlib", "in no event will the authors be held liable for any damages", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("artistic", "artistic license", "this library is free software you can redistribute it and or modify it under the terms of the artistic license"),
    ("cc0", "waived all copyright and related or neighboring rights", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
)

#: Lower-cases A-Z and makes every byte outside [a-z0-9] and above 0x7F a blank; as UTF-8 is treated bytewise, each other character stays whole.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

LEAST_SHARE = 0.6
#: Slack for sums of weights.
EPSILON = 1e-9


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


VOCABULARY = frozenset(w for _, _, t in TEMPLATES for w in t.encode().split())


def document_frequencies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[dict[bytes, int], int]:
    """Documents that hold each licence word, and all documents; the vocabulary bounds what comes to the driver."""
    import pyarrow.compute as pc

    def count(batches):
        found: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for text in pc.cast(batch.column(1), pa.binary()).to_pylist():
                for w in VOCABULARY.intersection(words_of(text)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": ["", *(w.decode() for w in found)], "n": pa.array([rows, *found.values()], pa.int64())})

    counts = texts_of(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in counts.collect()}
    return found, found.pop(b"", 0)


class Index:
    """Template postings by word, with weights from document frequencies."""

    def __init__(self, frequencies: dict[bytes, int], rows: int):
        self.idf = {w: math.log(1 + (rows + 0.5) / (frequencies.get(w, 0) + 0.5)) for w in VOCABULARY}
        #: Of each word, the templates among whose rarest words it is, with its places there.
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.total: list[float] = []
        self.reach: list[float] = []
        self.templates = [text.encode().split() for _, _, text in TEMPLATES]
        for t, words in enumerate(self.templates):
            self.total.append(sum(self.idf[w] for w in words))
            reach = 0.0
            for w in sorted(set(words), key=lambda w: (-self.idf[w], w)):
                if reach > (1 - LEAST_SHARE) * self.total[t] + EPSILON:
                    break
                places = [at for at, x in enumerate(words) if x == w]
                self.postings[w] += [(t, at) for at in places]
                reach += self.idf[w] * len(places)
            self.reach.append(reach)
        self.keys = [b" " + key.encode() + b" " for _, key, _ in TEMPLATES]
        self.sizes = [len(text.split()) for _, _, text in TEMPLATES]
        #: Of the rarest word of each base phrase, its place there, the phrase and its label.
        self.bases: dict[bytes, list[tuple[int, list[bytes], str]]] = defaultdict(list)
        for text, label in PHRASES.items():
            phrase = text.encode().split()
            place = max(range(len(phrase)), key=lambda k: (self.idf[phrase[k]], -k))
            self.bases[phrase[place]].append((place, phrase, label))
        self.entries = frozenset(self.postings) | frozenset(self.bases)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        words = words_of(text)
        present = self.entries.intersection(words)
        if not present:
            return len(words), 0, None, None, "", "", 0.0
        votes: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        starts, base = [], set()
        for at, w in enumerate(words):
            if w in present:
                for t, place in self.postings.get(w, ()):
                    votes[t][at - place] += self.idf[w]
                for place, phrase, label in self.bases.get(w, ()):
                    begin = at - place
                    if begin >= 0 and words[begin : begin + len(phrase)] == phrase:
                        starts.append(begin)
                        base.add(label)
        labels, score = set(base), 0.0
        for t in sorted(votes):
            size, key, template, total = self.sizes[t], self.keys[t], self.templates[t], self.total[t]
            rest, best = total - self.reach[t], 0.0
            for begin, vote in sorted(votes[t].items(), key=lambda x: (-x[1], x[0])):
                # The most that this alignment, or one with fewer votes, can match.
                most = (vote + rest) / total + EPSILON
                if most < LEAST_SHARE or most <= best + 2 * EPSILON:
                    break
                share = sum(self.idf[w] for k, w in enumerate(template) if 0 <= begin + k < len(words) and words[begin + k] == w) / total
                # The key phrase is verified last, within the alignment's place.
                if share >= LEAST_SHARE and share > best and key in b" " + b" ".join(words[max(0, begin) : max(0, begin + size)]) + b" ":
                    best = share
            if best >= LEAST_SHARE:
                labels.add(TEMPLATES[t][0])
                score = max(score, min(1.0, best))
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: word count, base places and labels, labels of the method and their score."""
    frequencies, rows = document_frequencies(docs, text_col, id_col)

    def work():
        index = Index(frequencies, rows)
        return lambda texts: list(zip(*map(index.scan, texts), strict=True))

    return per_text(texts_of(docs, id_col, text_col), work, FIELDS, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", binary=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def brute_force(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    """The base part by trying every place, for tests."""
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        want = phrase.split()
        for at in range(len(words)):
            if words[at : at + len(want)] == want:
                starts.append(at)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
