"""Suffix-array dedup of long repeats: bucket-pointer refinement over all texts.

Every byte covered by a string of `length` bytes that also starts earlier (in a
document of smaller id, or earlier in the same one) is removed.

Suffixes are put into buckets by a q-gram, and buckets are refined by sorting on
the bucket identifiers of later offsets, as in sorting suffixes by bucket
pointers, but only as deep as `length` and only where something can repeat:

1. Of the q-grams in each string of `length` bytes the one with the smallest
   fingerprint is its anchor, the leftmost of several; equal strings have equal
   anchors at equal places.  The anchor is the initial bucket.  About one
   position in forty is an anchor, and buckets are dealt to tasks.  Where a task
   has the same neighbourhood of an anchor more than once, only the earliest
   goes on; the strings of the others are repeats already.
2. A bucket with one member is finished.  For the others, the bytes around the
   anchor, of all strings that it stands for, are fetched, and the bucket is
   refined once by what stands beside the anchor: strings with most of their
   bytes before it by these, the others by those behind it.  Refined buckets are
   dealt anew, so a phrase that many texts share is not one task's work.
3. There, bucket identifiers are ranks.  Every position begins with that of its
   q-gram; each round sorts the positions of the buckets with several members by
   their own identifier and the one a depth further on, which doubles the depth,
   and the ranks that result are the identifiers that the next round looks up at
   both places (`refine`).  At depth `length` a bucket holds equal strings, the
   earliest first.

Equal texts are one text from the first step on; a task sends equal
neighbourhoods once.  So a passage that very many documents share meets as
often as there are tasks, not documents.

Defined results: a null or empty text is empty and loses nothing; so does any
text shorter than `length`; copies of a text lose everything but the one with
the smallest id; rows of equal id and text count as one document and each get
its result; null ids come last, and among equal ids the text's digest decides;
an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from . import textkit as T
from .cluster import arrow, checkpoint, free_name, hot_keys, join_skewed, partitions, pick

GRAM = 24
NO_ID = np.iinfo(np.int64).max
SLOTS = 1 << 20
ROW = "target int, kind int, packed binary"
NARROW, ANCHORS, REPEATED, TEXTS, SLICES, SPANS = range(6)
#: Bytes of neighbourhoods refined at a time, and of texts or entries collected before they are sent.
REFINE_BYTES, SEND_BYTES, SEND_ROWS = 2 << 20, 4 << 20, 300_000
_PLACE = np.uint64(0xFFFFFF)


def _row(kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in parts], pa.int32()), pa.array([kind] * len(parts), pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["target", "kind", "packed"]
    )


def _dealt(kind: int, target: np.ndarray, count: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return _row(kind, [(k, K.pack(*held)) for k, held in K.split_by(target, count, *arrays)])


def _by_doc(keys: np.ndarray, count: int) -> np.ndarray:
    return (T.mix(keys.view(np.uint64)) % T.U64(count)).astype(np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (T.mix(keys.view(np.uint64) ^ T.U64(0x9FB21C651E98DF25)) % T.U64(SLOTS)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, bucket, first, strings, around): for each anchor the strings of `length` bytes, from `first` on, that it stands for, and the fingerprint of them all."""
    n, width = len(data), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    prints = T.Fingerprints(data)
    grams = prints.grams(GRAM)
    ranked = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(ranked) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[width - 1 : width - 1 + n - length + 1])
    valid = np.zeros(n + 1, np.int64)  # starts of strings that end in their own row
    lengths = np.diff(offsets)
    full = lengths >= length
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[1:][full] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[: n - length + 1]) > 0)
    if not len(starts):
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    place = (least[starts] & _PLACE).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, strings = starts[begins], np.diff(np.append(begins, len(starts)))
    return place[begins], grams[place[begins]], first, strings, prints.of(first, first + strings - 1 + length)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(keys, missing, digests, shas, data, offsets) by slices of the texts."""
    for batch, data, offsets in T.slices(batches, "text"):
        ids = batch.column(0)
        missing = ~np.asarray(ids.is_valid())
        keys = np.where(missing, NO_ID, np.asarray(ids.fill_null(0)).astype(np.int64))
        shas = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets, offsets[1:], strict=False)]
        digests = np.array([int.from_bytes(s[:8], "big") for s in shas], np.uint64)
        yield keys, missing, digests, shas, data, offsets


def earliest(bucket, keys, digests, place, before, strings, around) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors with equal neighbourhoods: indices of the earliest ones, and of those that repeat them; of equal texts only one counts."""
    order = np.lexsort((place, digests, keys, strings, around, bucket))
    group = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (bucket, around, strings)], axis=0)])
    which = np.cumsum(group) - 1
    text = np.lexsort((np.arange(len(order)), place[order], digests[order], which))
    same = [x[text][1:] == x[text][:-1] for x in (which, digests[order], place[order])]
    distinct = np.ones(len(order), bool)
    distinct[text[1:][np.all(same, axis=0)]] = False
    return order[group], order[distinct & ~group]


def _find_anchors(count: int, length: int):
    step = T.SLICE_BYTES

    def run(batches):
        held: list[list[np.ndarray]] = []

        def sent():
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            first, again = earliest(*arrays)
            bucket, keys, digests, place, before, strings = (x[first] for x in arrays[:6])
            yield _dealt(ANCHORS, (bucket % T.U64(count)).astype(np.int64), count, bucket, keys, digests, place, before, strings)
            if len(again):
                _, keys, digests, place, before, strings = (x[again] for x in arrays[:6])
                columns = _merged_by_doc(keys, digests, place - before, place - before + strings - 1 + length)
                yield _dealt(SPANS, _by_doc(columns[0], count), count, *columns)

        for keys, missing, digests, shas, data, offsets in _pieces(batches):
            raw = np.frombuffer(b"".join(shas), np.uint8)
            yield _row(NARROW, [(int(_by_doc(keys[:1], count)[0]), K.pack(keys, missing, np.diff(offsets), digests, raw))])
            heads: dict[bytes, int] = {}
            for row, sha in enumerate(shas):
                if sha not in heads or keys[row] < keys[heads[sha]]:
                    heads[sha] = row
            lead = np.zeros(len(shas), bool)
            lead[list(heads.values())] = True
            if len(data) <= 4 * step:
                windows = [(0, data, offsets)]
            else:  # one very long text, in pieces that overlap by a string less a byte
                windows = [(a, data[a : a + step + length - 1], np.array([0, min(len(data) - a, step + length - 1)])) for a in range(0, len(data) - length + 1, step)]
            for base, part, bounds in windows:
                place, bucket, begin, strings, around = anchors(part, bounds, length)
                row = np.searchsorted(offsets, place + base, "right") - 1
                keep = lead[row]
                place, bucket, begin, strings, around, row = (x[keep] for x in (place, bucket, begin, strings, around, row))
                if len(place):
                    own = place + base - offsets[row]
                    held.append([bucket, keys[row], digests[row], own, (place - begin).astype(np.int32), strings.astype(np.int32), around])
            if sum(len(h[0]) for h in held) > SEND_ROWS:
                yield from sent()
        if held:
            yield from sent()

    return run


def _meet(count: int):
    def run(batches):
        held = []
        for kind, packed in K.rows_of(batches, "kind", "packed"):
            if kind != ANCHORS:
                yield _row(kind, [(0, packed)])
            else:
                held.append(K.unpack(packed))
        if not held:
            return
        bucket, keys, digests, place, before, strings = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        # Equal texts: one row for each place in the text, that of the smallest id.
        first = place - before
        text = T.mix(digests + T.mix(first.astype(np.uint64)))
        order = np.lexsort((keys, text, bucket))
        bucket, text = bucket[order], text[order]
        new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        distinct = new_bucket | np.concatenate([[True], text[1:] != text[:-1]])
        which = np.cumsum(new_bucket) - 1
        several = np.bincount(which[distinct])[which] > 1
        take = order[distinct & several]
        if len(take):
            yield _dealt(REPEATED, _by_doc(keys[take], count), count, keys[take], digests[take], (place - before)[take], before[take], strings[take])

    return run


def _send_texts(count: int, wanted: np.ndarray):
    """The texts whose document may be wanted; false hits do no harm."""

    def run(batches):
        parts: list[tuple] = []

        def sent():
            keys, digests = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.uint64)
            target, out = _by_doc(keys, count), []
            for k in np.unique(target):
                own = np.flatnonzero(target == k)
                texts = [parts[i][2] for i in own]
                out.append((int(k), K.pack(keys[own], digests[own], np.array([len(t) for t in texts], np.int64), np.concatenate(texts))))
            parts.clear()
            return _row(TEXTS, out)

        size = 0
        for keys, _, digests, _, data, offsets in _pieces(batches):
            for row in np.flatnonzero(wanted[_slots(keys)] & (np.diff(offsets) > 0)):
                parts.append((keys[row], digests[row], data[offsets[row] : offsets[row + 1]]))
                size += len(parts[-1][2])
            if size > SEND_BYTES:
                yield sent()
                size = 0
        if parts:
            yield sent()

    return run


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans first:last, joined where they meet or overlap."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    begins = np.concatenate([[True], first[1:] > last[:-1]]) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(begins)
    return first[at], last[np.append(at[1:], len(first)) - 1] if len(at) else last[:0]


def _merged_by_doc(keys, digests, first, last) -> tuple[np.ndarray, ...]:
    """Spans of many documents, joined in each."""
    order = np.lexsort((first, digests, keys))
    keys, digests, first, last = keys[order], digests[order], first[order], last[order]
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])])) if len(keys) else np.zeros(0, int)
    lane = np.zeros(len(keys), np.int64)
    lane[edge] = 1
    lane = np.cumsum(lane) * (int(last.max()) + 2 if len(last) else 0)
    a, b = merge_spans(first + lane, last + lane)
    at = np.searchsorted(first + lane, a)
    return keys[at], digests[at], first[at], first[at] + (b - a)


def sides(raw: bytes, first: int, before: int, strings: int, length: int) -> list[tuple[int, int, int]]:
    """(first, strings, refined bucket) of an anchor's strings: those that hold `reach` bytes before the anchor, then the others, which hold as many behind it."""
    reach, place = (length - GRAM) // 2, first + before
    here = min(strings, max(0, before - reach + 1))
    found = [(first, here, b"<", place - reach, place + GRAM)] if here else []
    found += [(first + here, strings - here, b">", place, place + GRAM + reach)] if here < strings else []
    return [(a, n, int.from_bytes(hashlib.blake2b(raw[x:y], digest_size=8, key=side).digest(), "big")) for a, n, side, x, y in found]


def _cut(count: int, length: int):
    """Texts and their repeated anchors meet: the neighbourhoods, each once a task; the others are repeats already."""

    def run(batches):
        repeated, texts = [], []
        for kind, packed in K.rows_of(batches, "kind", "packed"):
            (repeated if kind == REPEATED else texts).append(packed)
        if not repeated or not texts:
            return
        keys, digests, first, before, strings = (np.concatenate(x) for x in zip(*map(K.unpack, repeated), strict=True))
        order = np.lexsort((first, digests, keys))
        keys, digests, first, before, strings = (x[order] for x in (keys, digests, first, before, strings))
        edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])]))
        where = {(int(keys[a]), int(digests[a])): (a, b) for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)}
        known: set[tuple] = set()
        spans: list[tuple[int, int, int, int]] = []

        def sent():
            held = list(fresh.values())
            fresh.clear()
            sizes = np.array([len(h[5]) for h in held], np.int64)
            hashed = np.array([h[4] for h in held], np.uint64)
            out = []
            target = (hashed % T.U64(count)).astype(np.int64)
            for k in np.unique(target):
                own = np.flatnonzero(target == k)
                columns = [np.array([held[i][c] for i in own], kind) for c, kind in enumerate((np.int64, np.uint64, np.int64, np.int64, np.uint64))]
                out.append((int(k), K.pack(*columns, sizes[own], np.frombuffer(b"".join(held[i][5] for i in own), np.uint8))))
            return _row(SLICES, out)

        # Documents in order, so that the first to show a neighbourhood is its earliest in this task.
        opened = []
        for packed in texts:
            own_keys, own_digests, sizes, data = K.unpack(packed)
            at = np.concatenate([[0], np.cumsum(sizes)])
            opened += [(int(k), int(d), data[a:b]) for k, d, a, b in zip(own_keys, own_digests, at, at[1:], strict=False) if (int(k), int(d)) in where]
        opened.sort(key=lambda x: x[:2])
        fresh: dict[int, tuple] = {}
        size, done = 0, None
        for key, digest, data in opened:
            if (key, digest) == done:
                continue  # a repeated row
            done = (key, digest)
            a, b = where[done]
            raw = data.tobytes()
            for i in range(a, b):
                for begin, more, bucket in sides(raw, int(first[i]), int(before[i]), int(strings[i]), length):
                    piece = raw[begin : begin + more + length - 1]
                    mark = (bucket, hashlib.blake2b(piece, digest_size=16).digest(), more)
                    if mark in known:
                        spans.append((key, digest, begin, begin + more + length - 1))
                    else:
                        known.add(mark)
                        fresh[len(fresh)] = (key, digest, begin, more, bucket, piece)
                        size += len(piece)
            if size > SEND_BYTES:
                yield sent()
                size = 0
        if fresh:
            yield sent()
        if spans:
            columns = _merged_by_doc(np.array([s[0] for s in spans], np.int64), np.array([s[1] for s in spans], np.uint64), np.array([s[2] for s in spans], np.int64), np.array([s[3] for s in spans], np.int64))
            yield _dealt(SPANS, _by_doc(columns[0], count), count, *columns)

    return run


def depths(length: int) -> list[tuple[int, int]]:
    """(depth, step) of the rounds: buckets of `depth` bytes are refined by those `step` further on, down to `length`."""
    out, depth = [], GRAM
    while depth < length:
        out.append((depth, min(depth, length - depth)))
        depth += out[-1][1]
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of keys in their order, from 0, and which of them occur more than once."""
    order = np.argsort(keys)
    ordered = keys[order]
    begins = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(order) else np.zeros(0, bool)
    rank = np.cumsum(begins) - 1
    out = np.empty(len(order), np.int64)
    out[order] = rank
    return out, np.bincount(rank, minlength=1)[out] > 1 if len(order) else begins


def refine(keys, digests, first, strings, data, at, length: int) -> tuple[np.ndarray, ...]:
    """Slices in order of (key, digest, first) -> (slice index, first, last) of the strings that occur earlier.

    `bucket` holds the identifier of every position at the depth reached, -1
    where nothing of that depth begins or the bucket has one member; a string
    that runs into such a position can't repeat.
    """
    sizes = strings + length - 1
    ends = np.repeat(at + sizes, sizes)
    place = np.arange(len(data))
    bucket = np.full(len(data), -1, np.int64)
    live = place[place + GRAM <= ends]
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = T.Fingerprints(data).grams(GRAM)[live]
    rank, several = _ranked(grams)
    live = live[several]
    bucket[live] = rank[several]
    for depth, step in depths(length):
        live = live[live + depth + step <= ends[live]]
        live = live[bucket[live + step] >= 0]
        rank, several = _ranked(bucket[live] * len(data) + bucket[live + step])  # ranks are below len(data)
        bucket = np.full(len(data), -1, np.int64)
        live = live[several]
        bucket[live] = rank[several]
    # What is left are strings with equals; of each bucket the first stays.
    order = np.argsort(bucket[live] * len(data) + live)
    own = bucket[live[order]]
    later = np.zeros(len(data) + 1, bool)
    later[live[order][1:][own[1:] == own[:-1]]] = True
    which = np.repeat(np.arange(len(strings)), sizes)
    begins = later[:-1] & np.concatenate([[True], ~later[:-2] | (which[1:] != which[:-1])])
    lasts = later[:-1] & np.concatenate([~later[1:-1] | (which[1:] != which[:-1]), [True]])
    a, b = np.flatnonzero(begins), np.flatnonzero(lasts)
    return which[a], first[which[a]] + a - at[which[a]], first[which[a]] + b - at[which[a]] + length


def _refine(count: int, length: int):
    def run(batches):
        held = []
        for kind, packed in K.rows_of(batches, "kind", "packed"):
            if kind == SPANS:
                yield _row(SPANS, [(0, packed)])
            else:
                held.append(packed)
        if not held:
            return
        parts = [K.unpack(p) for p in held]
        del held
        keys, digests, first, strings, bucket, sizes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = np.argsort(bucket, kind="stable")
        upto = np.cumsum(sizes[order])
        found = []
        begin = 0
        while begin < len(order):
            end = min(len(order), max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + REFINE_BYTES, "right"))))
            while end < len(order) and bucket[order[end]] == bucket[order[end - 1]]:
                end += 1
            own = order[begin:end]
            own = own[np.lexsort((first[own], digests[own], keys[own]))]
            total = np.concatenate([[0], np.cumsum(sizes[own])])
            inside = np.arange(total[-1]) - np.repeat(total[:-1], sizes[own]) + np.repeat(at[own], sizes[own])
            which, a, b = refine(keys[own], digests[own], first[own], strings[own], data[inside], total[:-1], length)
            found.append((keys[own][which], digests[own][which], a, b))
            begin = end
        columns = _merged_by_doc(*(np.concatenate(x) for x in zip(*found, strict=True)))
        if len(columns[0]):
            yield _dealt(SPANS, _by_doc(columns[0], count), count, *columns)

    return run


def _slots_of(rows: DataFrame) -> np.ndarray:
    def count(batches):
        total = np.zeros(SLOTS, np.int32)
        for (packed,) in K.rows_of(batches, "packed"):
            total[_slots(K.unpack(packed)[0])] = 1
        return total

    return K.sum_counters(rows.select("packed"), count, SLOTS) > 0


def _spans_by_doc(packed: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    if not packed:
        return {}
    keys, digests, first, last = _merged_by_doc(*(np.concatenate(x) for x in zip(*map(K.unpack, packed), strict=True)))
    if not len(keys):
        return {}
    edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])]))
    return {(int(keys[a]), int(digests[a])): (first[a:b], last[a:b]) for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)}


def repeated_spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(narrow, spans) of docs (doc_id long, text): narrow has a row a document (key, missing, n, digest, sha); spans packed rows of kind SPANS."""
    count = partitions(docs.sparkSession)
    found = K.deal(docs.transform(arrow, _find_anchors(count, length), ROW), count=count).transform(arrow, _meet(count), ROW)
    found = checkpoint(found)

    def unpack(batches):
        for (packed,) in K.rows_of(batches, "packed"):
            keys, missing, n, digests, raw = K.unpack(packed)
            raw = raw.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(missing), pa.array(n), pa.array(digests.view(np.int64)), pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())],
                names=["key", "missing", "n", "digest", "sha"],
            )

    narrow = found.where(f"kind = {NARROW}").select("packed").transform(arrow, unpack, "key long, missing boolean, n long, digest long, sha binary")
    repeated, again = found.where(f"kind = {REPEATED}"), found.where(f"kind = {SPANS}")
    texts = docs.transform(arrow, _send_texts(count, _slots_of(repeated)), ROW)
    cut = K.deal(repeated.union(texts), count=count).transform(arrow, _cut(count, length), ROW)
    spans = checkpoint(K.deal(cut, count=count).transform(arrow, _refine(count, length), ROW).union(again))
    return narrow, spans


def _redeal(count: int):
    def run(batches):
        for (packed,) in K.rows_of(batches, "packed"):
            columns = K.unpack(packed)
            if len(columns[0]):
                yield _dealt(SPANS, _by_doc(columns[0], count), count, *columns)

    return run


def _gather_spans(spans: DataFrame, count: int) -> DataFrame:
    """(key, digest, firsts, lasts), one row a document that has spans."""

    def run(batches):
        where = _spans_by_doc([packed for (packed,) in K.rows_of(batches, "packed")])
        items = list(where.items())
        for first in range(0, len(items), 5000):
            part = items[first : first + 5000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for (k, _), _ in part], pa.int64()), pa.array(np.array([d for (_, d), _ in part], np.uint64).view(np.int64)), pa.array([a for _, (a, _) in part], pa.list_(pa.int64())), pa.array([b for _, (_, b) in part], pa.list_(pa.int64()))],
                names=["key", "digest", "firsts", "lasts"],
            )

    return K.deal(spans.transform(arrow, _redeal(count), ROW), count=count).transform(arrow, run, "key long, digest long, firsts array<long>, lasts array<long>")


def _rest(data: np.ndarray, firsts, lasts) -> tuple[bytes, int]:
    keep = np.ones(len(data), bool)
    for first, last in zip(firsts, lasts, strict=True):
        keep[first:last] = False
    return data[keep].tobytes(), int((~keep).sum())


def _with_heads(narrow: DataFrame) -> DataFrame:
    """narrow with the smallest key of each text."""
    heads = checkpoint(narrow.groupBy("sha").agg(F.min("key").alias("head"), F.count("*").alias("n_copies")))
    return join_skewed(narrow, heads.drop("n_copies"), "sha", hot_keys(heads, "sha", "n_copies"))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes)."""
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    count = partitions(docs.sparkSession)
    narrow, spans = repeated_spans(docs, length)
    texts = docs.transform(arrow, _send_texts(count, _slots_of(spans)), ROW)

    def apply(batches):
        held, bodies = [], []
        for kind, packed in K.rows_of(batches, "kind", "packed"):
            (held if kind == SPANS else bodies).append(packed)
        where = _spans_by_doc(held)
        out = []
        for packed in bodies:
            keys, digests, sizes, data = K.unpack(packed)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for k, d, a, b in zip(keys, digests, at, at[1:], strict=False):
                if own := where.pop((int(k), int(d)), None):
                    kept, removed = _rest(data[a:b], *own)
                    out.append((int(k), int(d.view(np.int64)), removed, len(own[0]), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["r_key", "r_digest", "n_removed", "n_spans", "kept_sha256"])

    spread = spans.transform(arrow, _redeal(count), ROW).union(texts)
    results = K.deal(spread, count=count).transform(arrow, apply, "r_key long, r_digest long, n_removed long, n_spans long, kept_sha256 string")
    joined = _with_heads(narrow).join(results, (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest")), "left")
    copy = (F.col("key") != F.col("head")) & (F.col("n") >= length)
    return joined.select(
        F.when(~F.col("missing"), F.col("key")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of `docs`, with all their columns, and the repeats cut out of their text.

    What a cut leaves of a character goes too.  A column `chars_col` is set to
    the new length where a text was cut.  A null text stays null.
    """
    count = partitions(docs.sparkSession)
    narrow, spans = repeated_spans(pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), length)
    copies = _with_heads(narrow).where((F.col("n") >= length) & (F.col("key") != F.col("head")))
    copies = copies.select("key", "digest", F.array(F.lit(0).cast("long")).alias("firsts"), F.array("n").alias("lasts")).distinct()
    of_others = _gather_spans(spans, count).join(copies.select("key", "digest"), ["key", "digest"], "left_anti")
    cuts = checkpoint(of_others.union(copies))
    key_col, digest_col, firsts_col, lasts_col = (free_name(docs, n) for n in ("cut_key", "cut_digest", "cut_firsts", "cut_lasts"))
    cuts = cuts.select(F.col("key").alias(key_col), F.col("digest").alias(digest_col), F.col("firsts").alias(firsts_col), F.col("lasts").alias(lasts_col))
    text, key = docs[f"`{text_col}`"], F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(int(NO_ID)))
    digest = F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16), 16, -10).cast("long")
    joined = docs.join(cuts, (key == F.col(key_col)) & (digest == F.col(digest_col)), "left")
    names, at = docs.columns, docs.columns.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None

    def apply(batches):
        for batch, data, offsets in T.slices(batches, text_col):
            firsts, lasts = (batch.column(batch.schema.get_field_index(c)) for c in (firsts_col, lasts_col))
            columns = [batch.column(i) for i in range(len(names))]
            hit = np.flatnonzero(np.asarray(firsts.is_valid()))
            if len(hit):
                texts, lengths = columns[at].to_pylist(), columns[chars].to_pylist() if chars is not None else None
                for row in hit:
                    kept, _ = _rest(data[offsets[row] : offsets[row + 1]], firsts[row].as_py(), lasts[row].as_py())
                    texts[row] = kept.decode("utf-8", "ignore")
                    if lengths:
                        lengths[row] = len(texts[row])
                columns[at] = pa.array(texts, columns[at].type)
                if lengths:
                    columns[chars] = pa.array(lengths, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.transform(arrow, apply, docs.schema)
