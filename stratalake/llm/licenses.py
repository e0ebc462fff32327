"""Fuzzy search for licence notices in whole texts.

A text is reduced to its words: A-Z lower-cased, every run of other ASCII bytes
a single separator.  A place of a notice is as many words as it has, each within
one edit of the notice's word where that has LONG_WORD letters or more, else
equal to it, and with one edit for every EDIT_LETTERS letters of the notice in
all: names such as "mit" are never stretched and short notices never blurred.

A notice of k allowed edits is split into k + 1 pieces; a place within k edits
of the notice holds at least one piece unchanged (pigeonhole), so an exact
search for the pieces finds every candidate: the words that begin where the
piece says the notice does, give or take the edits.  The regex library's
bounded-error matching then verifies each candidate and counts its edits.
Exact occurrences are the candidates with no edits, found through the same
pieces.

Defined results: a null or empty text has no words, no places and no labels;
all places count, whether they overlap, stand side by side or have edits;
repeated rows are scanned each on its own; an empty table gives an empty one;
other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textkit as T
from .cluster import arrow, pick


LONG_WORD, EDIT_LETTERS = 6, 15
#: Bytes that one edit moves what follows it by, at most.
EDIT_BYTES = 4


@dataclass(frozen=True)
class Notice:
    """Words of a notice and its label; base notices also count exact places."""

    phrase: str
    label: str
    base: bool = False

    @property
    def edits(self) -> int:
        return len(self.phrase) // EDIT_LETTERS

    @property
    def words(self) -> list[str]:
        return self.phrase.split(" ")

    @property
    def pieces(self) -> list[bytes]:
        text, n = self.phrase.encode(), self.edits + 1
        cuts = [round(i * len(text) / n) for i in range(n + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @property
    def pattern(self) -> str:
        return " ".join(f"(?:{regex.escape(w)}){{e<=1}}" if self.edits and len(w) >= LONG_WORD else regex.escape(w) for w in self.words)


# Wording of the notices looked for.
NOTICES = (
    Notice("mit license", "mit", True),
    Notice("apache license", "apache", True),
    Notice("general public license", "gpl", True),
    Notice("mit licence", "mit"),
    Notice("apache licence", "apache"),
    Notice("permission is hereby granted free of charge", "mit"),
    Notice("licensed under the apache license version 2 0", "apache"),
    Notice("this program is free software you can redistribute it", "gpl"),
    Notice("lesser general public license", "lgpl"),
    Notice("affero general public license", "agpl"),
    Notice("mozilla public license", "mpl"),
    Notice("redistribution and use in source and binary forms", "bsd"),
    Notice("bsd license", "bsd"),
    Notice("isc license", "isc"),
    Notice("eclipse public license", "epl"),
    Notice("boost software license", "boost"),
    Notice("creative commons attribution", "cc-by"),
    Notice("creative commons attribution noncommercial", "cc-by-nc"),
    Notice("released into the public domain", "public-domain"),
    Notice("all rights reserved", "all-rights-reserved"),
)

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,phrase:string,word_start:long,word_end:long,edits:int>>"


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words as one buffer ` w1 w2 ... ` with a newline after each row; the place of each word in it; row bounds among the words."""
    starts, ends = T.runs(T.NAME_BYTES[data], offsets)
    bounds = T.row_bounds(starts, offsets)
    lengths = ends - starts
    rows = len(offsets) - 1
    # Every word takes its bytes and a blank behind it; every row two bytes more: a newline and a blank.
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=places[1:])
    row = T.row_of(bounds)
    words_at = places[:-1] + 2 * row + 2
    out = np.full(int(places[-1]) + 2 * rows + 2, 32, np.uint8)
    out[places[bounds] + 2 * np.arange(rows + 1)] = 10
    inside = T.NAME_BYTES[data]
    shift = np.repeat(words_at - starts, lengths)
    out[np.flatnonzero(inside) + shift] = T.LOWER[data[inside]]
    return out.tobytes(), words_at, bounds


@dataclass
class Scanner:
    notices: Sequence[Notice] = NOTICES
    patterns: list = field(init=False)

    def __post_init__(self):
        self.patterns = [regex.compile(n.pattern, regex.BESTMATCH) for n in self.notices]

        @lru_cache(maxsize=4096)
        def verified(which: int, words: bytes) -> int:
            """The edits that make the words the notice; -1 where they are too many."""
            found = self.patterns[which].fullmatch(words.decode())
            edits = sum(found.fuzzy_counts) if found else -1
            return edits if edits <= self.notices[which].edits else -1

        self.verified = verified

    def __getstate__(self):
        return {"notices": self.notices}

    def __setstate__(self, state):
        self.notices = state["notices"]
        self.__post_init__()

    def candidates(self, which: int, buffer: bytes, words_at: np.ndarray) -> np.ndarray:
        """Indices of the words at which the notice may begin, by its exact pieces."""
        notice, starts, done = self.notices[which], [], 0
        for piece in notice.pieces:
            at = buffer.find(piece)
            while at >= 0:
                starts.append(at - done)
                at = buffer.find(piece, at + 1)
            done += len(piece)
        starts, reach = np.unique(np.array(starts, np.int64)), EDIT_BYTES * notice.edits
        first, behind = np.searchsorted(words_at, starts - reach), np.searchsorted(words_at, starts + reach, "right")
        return np.unique(np.concatenate([np.arange(a, b) for a, b in zip(first, behind, strict=True)])) if len(starts) else starts

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """For each row the values of SCHEMA."""
        buffer, words_at, bounds = normalise(data, offsets)
        ends = np.append(words_at, len(buffer))
        places: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        for which, notice in enumerate(self.notices):
            size = len(notice.words)
            found = self.candidates(which, buffer, words_at)
            rows = np.searchsorted(bounds, found, "right") - 1
            for first, row in zip(found.tolist(), rows.tolist(), strict=True):
                if first + size > bounds[row + 1]:
                    continue
                words = buffer[words_at[first] : ends[first + size]].rstrip(b" \n")
                edits = self.verified(which, words) if len(words) <= len(notice.phrase) + EDIT_BYTES * notice.edits else -1
                if edits >= 0:
                    places[row].append((which, first - int(bounds[row]), first - int(bounds[row]) + size, edits))
        out = []
        for row, found in enumerate(places):
            found.sort(key=lambda m: (m[1], m[2], m[0]))
            exact = [m for m in found if self.notices[m[0]].base and m[3] == 0]
            score = max((1 - m[3] / len(self.notices[m[0]].phrase) for m in found), default=0.0)
            out.append(
                (
                    int(bounds[row + 1] - bounds[row]),
                    len(exact),
                    min((m[1] for m in exact), default=None),
                    max((m[1] for m in exact), default=None),
                    ",".join(sorted({self.notices[m[0]].label for m in exact})),
                    ",".join(sorted({self.notices[m[0]].label for m in found})),
                    float(score),
                    [{"label": self.notices[w].label, "phrase": self.notices[w].phrase, "word_start": a, "word_end": b, "edits": e} for w, a, b, e in found],
                )
            )
        return out


def scan_licenses(docs: DataFrame, notices: Sequence[Notice] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and SCHEMA.

    n_base, first_word and last_word tell of exact places of base notices;
    labels are those of all matches; score is the best match's share of
    unchanged characters, 0 without a match.
    """
    narrow, scanner = pick(docs, doc_id=id_col, text=text_col), Scanner(tuple(notices))
    kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    match = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("word_start", pa.int64()), ("word_end", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in T.slices(batches, "text"):
            columns = list(zip(*scanner.scan(data, offsets), strict=True))
            arrays = [pa.array(c, kind) for c, kind in zip(columns, [k for _, k in kinds] + [match], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[n for n, _ in kinds], "matches"])

    return narrow.transform(arrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
