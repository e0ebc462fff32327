"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each distinct n-gram set and a column for
each n-gram.  Its product with its own transpose holds the overlaps of all
pairs; two rows link when 100 * overlap >= percent * union.

Column blocks discard pairs.  Rows of sizes m <= n that link differ in at most
D = m (100 - percent) / percent columns.  Columns are dealt by their hash into
groups, more than D / 2 of them, so some groups hold one difference at most;
with a group's columns dealt into a few blocks, all blocks but one are then
equal in both rows, and linked rows share the fingerprint of such a group
without a block.  Groups go by size class, and a row leaves out as many of its
poorest groups as the count allows (those with the fewest rare n-grams), so
that n-grams of very many documents bring nobody together.  Which n-grams are
frequent is told by a table of counters of fixed size over all documents; it
steers the work, never the result.

Row blocks then get the product itself.  Rows that shared fingerprints, directly
or over others, form a component; a component's rows meet in blocks of bounded
size, overlaps are accumulated from the columns' postings, and pairs outside
the size bounds, or already connected, are passed over.  A component larger
than a block is mostly a chain of rows that share a passage and link with
nothing, and grows faster than the table.  So its rows first meet as sketches,
a bit a column, in blocks of similar sizes: bits that differ bound the columns
that differ from below, and only rows that may link stay together.  What is
then still larger than a block meets its leaders; only what these leave apart
meets in pairs of blocks.  All linked documents end up connected; nothing is
capped.
That is enough for classes alone (`keep_one`).  Where links are counted
(`join_documents`), all blocks of a component meet in pairs and every pair of
rows within the size bounds is looked at; copies count by their number and are
not expanded.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; so does a row without an id, whose component is null;
rows with the same id count as one document; a text of fewer words than an
n-gram has is one n-gram; an empty table gives an empty one; other input
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from . import textkit as T
from .cluster import arrow, checkpoint, connected_components, free_name, hot_keys, join_skewed, partitions, pick, release

COUNTERS = 1 << 22
#: Rows, and n-grams, of a row block.
BLOCK_ROWS, BLOCK_GRAMS = 256, 400_000
LEADERS = 4
#: Row blocks of the product that counts links hold so many times as many rows, since all of a component meet.
COUNT_BLOCKS = 4
#: Rows, and bytes, of a block of sketches.
SKETCH_ROWS, SKETCH_BYTES = 2048, 4 << 20
#: Bits a member, at least, of the table that tells whose sets are needed, and the sizes it has at least and at most; false hits cost work, not rightness.
MEMBER_BITS, FEWEST_BITS, MOST_BITS = 16, 1 << 20, 1 << 26


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its distinct n-grams' fingerprints, ascending, and bounds."""
    data = T.LOWER[data]
    starts, ends = T.runs(~T.SPACES[data], offsets)
    bounds = T.row_bounds(starts, offsets)
    words = T.word_fingerprints(data, starts, ends)
    counts = np.diff(bounds)
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(upto[-1]), np.uint64)
    chained = T.chain(words, size)
    at = np.repeat(bounds[:-1] - upto[:-1], sizes) + np.arange(len(out))
    whole = np.repeat(counts >= size, sizes)
    out[whole] = chained[at[whole]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        key = counts[row : row + 1].astype(np.uint64)
        for k in range(bounds[row], bounds[row + 1]):
            key = T.mix(key * T.U64(0xE7037ED1A0B428DB) + words[k : k + 1])
        out[upto[row]] = key[0]
    for a, b in zip(upto, upto[1:], strict=False):
        out[a:b].sort()
    rows = T.row_of(upto)
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate([[0], np.cumsum(first)])
    return out[first], kept[upto]


def set_digest(grams: np.ndarray) -> bytes:
    """128 bits that are equal for equal sets."""
    a = np.add.reduce(T.mix(grams), dtype=np.uint64)
    b = np.add.reduce(T.mix(grams ^ T.U64(0x5851F42D4C957F2D)) * T.U64(0x2545F4914F6CDD1D), dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


class Scheme:
    """Size classes, and for each the groups of column blocks whose fingerprints rows share."""

    RATIO, DEALINGS = 1.5, 8

    def __init__(self, percent: int):
        self.percent = percent
        # Blocks in a group. A fingerprint is that of a group without one block: more blocks make it say more, and are more fingerprints.
        self.ways = 2 if percent >= 85 else 3
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * self.RATIO)))
        self.edges = np.array(edges)
        self.most = [(int(e) - 1) * (100 - percent) // percent for e in edges[1:]]

    def class_of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def classes(self, n: int) -> range:
        """Those in which a row of n columns meets rows as large or smaller, and those in which it is the smaller one."""
        return range(self.class_of(max(1, -(-n * self.percent // 100))), self.class_of(n) + 1)

    def groups(self, k: int) -> tuple[int, int]:
        """The number of groups, and how many of them at least differ in one column at most."""
        crowded = self.most[k] // 2
        spare = 1 + max(1, self.most[k] // 8)
        return crowded + spare, spare

    def signatures(self, grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Fingerprints of one row, over its classes; frequent tells which of its n-grams many documents have.

        A dealing in which too many groups have an empty fingerprint is no
        guarantee for the row.  Such a row goes on to another dealing, and so
        does each like it: of two linked rows, the first dealing that serves
        one of them is one that both take part in.
        """
        found, mixed = [], T.mix(grams)
        for k in self.classes(len(grams)):
            if not self.most[k]:
                continue  # in this class only equal sets link
            for dealing in range(self.DEALINGS):
                own, sure = self._dealt(k, dealing, grams, mixed, frequent)
                found.append(own)
                if sure:
                    break
            else:  # what no dealing serves meets by that
                found.append(T.mix(np.array([k + 1], np.uint64) * T.U64(0xD6E8FEB86659FD93)))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def _dealt(self, k: int, dealing: int, grams: np.ndarray, mixed: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, bool]:
        """Fingerprints of one dealing of the columns into blocks, and whether linked rows are sure to share one."""
        (count, sure), ways = self.groups(k), self.ways
        place = grams if not dealing else T.mix(grams ^ T.U64(dealing * 0x8CB92BA72F3D8DD7 % (1 << 64)))
        if dealing:
            order = np.argsort(place)
            place, mixed, frequent = place[order], mixed[order], frequent[order]
        block = ((place >> T.U64(32)) * T.U64(count * ways) >> T.U64(32)).astype(np.int64)
        begins = np.flatnonzero(np.diff(block, prepend=-1))
        sums, held, rare = np.zeros(count * ways, np.uint64), np.zeros(count * ways, np.int64), np.zeros(count * ways, np.int64)
        sums[block[begins]] = np.add.reduceat(mixed, begins)
        held[block[begins]] = np.diff(np.append(begins, len(grams)))
        rare[block[begins]] = held[block[begins]] - np.add.reduceat(frequent.astype(np.int64), begins)
        without = lambda x: x.reshape(count, ways).sum(axis=1, keepdims=True, dtype=x.dtype) - x.reshape(count, ways)
        # A level by content alone, so that equal fingerprints have equal levels in both rows; 0 for an empty one.
        level = np.minimum(without(rare), 7) * 8 + np.minimum(without(held), 7)
        lowest = int(np.sort(level.min(axis=1))[sure - 1])
        keep = level >= max(lowest, 1)
        which = np.arange(count * ways, dtype=np.uint64).reshape(count, ways) + T.U64((k * self.DEALINGS + dealing + 1) << 32)
        return T.mix(without(sums)[keep] + T.mix(which[keep])), lowest > 0


def frequent_grams(docs: DataFrame, size: int) -> np.ndarray:
    """Packed bits, one for each counter: whether it stands well above the mean."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, data, offsets in T.slices(batches, "text"):
            grams, _ = gram_sets(data, offsets, size)
            total += np.bincount((grams >> T.U64(42)).astype(np.int64), minlength=COUNTERS)
        return total.astype(np.int32)

    total = K.sum_counters(docs, count, COUNTERS)
    return np.packbits(total > 2 * total.mean() + 64)


def _is_frequent(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    at = (grams >> T.U64(42)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """As few of the pairs as connect what all of them connect."""
    above: dict[int, int] = {}

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    keep = []
    for a, b in pairs.tolist():
        a, b = top(a), top(b)
        keep.append(a != b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return pairs[np.array(keep, bool)] if len(pairs) else pairs


def _candidates(docs: DataFrame, size: int, percent: int, bits: np.ndarray) -> DataFrame:
    """Rows of two kinds: digest set: document a with n columns; digest null: candidate link of documents a and b."""
    scheme, count = Scheme(percent), partitions(docs.sparkSession)

    def sign(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent():
            signs, docs_of = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            out = []
            for k, (own, whose) in K.split_by((signs % T.U64(count)).astype(np.int64), count, signs, docs_of):
                # Five bytes of a fingerprint tell apart what meets in one task; a false meeting is found out later.
                begins = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                out.append((k, K.pack((own >> T.U64(32)).astype(np.uint32), (own >> T.U64(24)).astype(np.uint8), whose[begins], np.diff(np.append(begins, len(whose))).astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["target", "packed"])

        for batch, data, offsets in T.slices(batches, "text"):
            grams, bounds = gram_sets(data, offsets, size)
            frequent = _is_frequent(bits, grams)
            ids = batch.column(0).to_pylist()
            digests, seen = [], set()
            for row, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                digests.append(set_digest(grams[a:b]))
                if b > a and ids[row] is not None and digests[-1] not in seen:
                    seen.add(digests[-1])
                    signs = scheme.signatures(grams[a:b], frequent[a:b])
                    held.append((signs, np.full(len(signs), ids[row], np.int64)))
            missing = np.array([i is None for i in ids])
            whose = np.array([0 if i is None else i for i in ids], np.int64)
            packed = K.pack(whose, missing, np.diff(bounds), np.frombuffer(b"".join(digests), np.uint8))
            target = int(T.mix(whose[:1].view(np.uint64))[0] % T.U64(count))
            yield pa.RecordBatch.from_arrays([pa.array([-1 - target], pa.int32()), pa.array([packed], pa.binary())], names=["target", "packed"])
            if sum(len(s) for s, _ in held) > 400_000:
                yield sent()
        if held:
            yield sent()

    def meet(batches):
        signs, docs_of = [], []
        for target, kind, packed in K.rows_of(batches, "target", "kind", "packed"):
            if kind < 0:
                yield _packed([(target, kind, packed)])
            else:
                high, low, whose, lengths = K.unpack(packed)
                signs.append(high.astype(np.uint64) << T.U64(8) | low)
                docs_of.append(np.repeat(whose, lengths))
        if not signs:
            return
        signs, docs_of = np.concatenate(signs), np.concatenate(docs_of)
        order = np.lexsort((docs_of, signs))
        signs, docs_of = signs[order], docs_of[order]
        first = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
        leader = np.repeat(docs_of[first], np.diff(np.append(first, len(signs))))
        other = leader != docs_of
        pairs = _forest(np.unique(np.stack([leader[other], docs_of[other]], axis=1), axis=0))
        home = (T.mix(pairs[:, 0].astype(np.int64).view(np.uint64)) % T.U64(count)).astype(np.int64)
        yield _packed([(k, 0, K.pack(*held)) for k, held in K.split_by(home, count, pairs[:, 0].copy(), pairs[:, 1].copy())])

    def settle(batches):
        """Two documents share many fingerprints, found in many tasks: their link is kept once."""
        held = []
        for kind, packed in K.rows_of(batches, "kind", "packed"):
            arrays = K.unpack(packed)
            if kind < 0:
                ids, missing, sizes, digests = arrays
                raw = digests.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=missing), pa.array(sizes), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())], names=["a", "b", "digest"]
                )
            else:
                held.append(np.stack(arrays, axis=1))
        if held:
            pairs = _forest(np.unique(np.concatenate(held), axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.binary())], names=["a", "b", "digest"])

    schema = "target int, kind int, packed binary"
    signed = docs.transform(arrow, sign, "target int, packed binary")
    dealt = signed.select(F.when(F.col("target") < 0, -1 - F.col("target")).otherwise(F.col("target")).alias("target"), F.col("target").alias("kind"), "packed")
    met = K.deal(dealt, count=count).transform(arrow, meet, schema)
    return K.deal(met, count=count).transform(arrow, settle, "a long, b long, digest binary")


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["target", "kind", "packed"])


def _slots(ids: np.ndarray, size: int) -> np.ndarray:
    return (T.mix(ids.astype(np.int64).view(np.uint64)) % T.U64(size)).astype(np.int64)


def _member_bits(members: DataFrame) -> np.ndarray:
    """Packed bits, in number a power of two that follows the members: which slots hold one."""
    size = min(max(FEWEST_BITS, 1 << (MEMBER_BITS * members.count()).bit_length()), MOST_BITS)

    def mark(batches):
        bits = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            at = _slots(np.asarray(batch.column(0)), size)
            np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        return bits

    return K.join_bits(members.select("doc"), mark, size >> 3)


def _is_member(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids, len(bits) << 3)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def sketch(grams: np.ndarray) -> np.ndarray:
    """A bit for each of as many slots as there are columns or more, a power of two: whether an odd number of columns fall in it.

    A slot whose bits differ holds a column that only one of two rows has.  The
    first half xor the second is the sketch of half the slots.
    """
    slots = 1 << max(6, int(len(grams) - 1).bit_length())
    return np.packbits(np.bincount((grams & T.U64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint8) & 1).view(np.uint64)


def may_link(sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links by position that connect all rows whose sketches differ no more than those of linked rows can.

    Rows link when they differ in (100 - percent) / (100 + percent) of the sum
    of their sizes at most.  sides: rows of two sides meet only those of the
    other one; rows of one side all meet.
    """
    width = min(len(x) for x in sketches)
    bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in sketches])
    both = sides.min() != sides.max()
    root, links = np.arange(len(sizes)), []
    for i in np.flatnonzero(sides == 0) if both else range(1, len(sizes)):
        near = (sizes * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes) & (root != root[i])
        near = np.flatnonzero(near & (sides == 1) if both else near[:i])
        differ = np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in near[differ * (100 + percent) <= (100 - percent) * (sizes[near] + sizes[i])]:
            if root[i] != root[j]:
                links.append((int(j), int(i)))
                root[root == root[j]] = root[i]
    return links


def link_rows(ids: list[int], sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked rows of a block: a spanning forest.

    sides: 0 for rows that meet only others, 1 for rows that also meet each
    other; two rows of side 0 don't meet.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = np.array([sides[i] for i in order])
    columns, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    row_of = np.repeat(np.arange(len(order)), sizes)
    posting = np.argsort(inverse, kind="stable")
    posting_rows = row_of[posting]
    edges = np.searchsorted(inverse[posting], np.arange(len(columns) + 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    root, links = np.arange(len(order)), []
    for i in range(1, len(order)):
        apart = np.flatnonzero((sizes[:i] * 100 >= percent * sizes[i]) & (root[:i] != root[i]) & (side[:i] + side[i] > 0))
        if not len(apart):
            continue
        own = inverse[begins[i] : begins[i + 1]]
        lengths = edges[own + 1] - edges[own]
        starts = np.repeat(edges[own] - np.concatenate([[0], np.cumsum(lengths[:-1])]), lengths)
        overlap = np.bincount(posting_rows[starts + np.arange(int(lengths.sum()))], minlength=len(order))[apart]
        for j in apart[100 * overlap >= percent * (sizes[i] + sizes[apart] - overlap)]:
            if root[i] != root[j]:
                links.append((ids[order[j]], ids[order[i]]))
                root[root == root[j]] = root[i]
    return links


def count_links(sets: list[np.ndarray], copies: list[int], sides: list[int], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each row the documents of the rows it links with, and links by position that connect what links.

    sides: rows of two sides meet only those of the other one; rows of one side
    all meet.
    """
    sizes, copies, side = np.array([len(s) for s in sets]), np.array(copies, np.int64), np.array(sides)
    both = side.min() != side.max()
    columns, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row_of = np.repeat(np.arange(len(sets)), sizes)
    held = side[row_of] == 1 if both else np.ones(len(row_of), bool)
    posting = np.flatnonzero(held)[np.argsort(inverse[held], kind="stable")]
    posting_rows = row_of[posting]
    edges = np.searchsorted(inverse[posting], np.arange(len(columns) + 1))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    root, links, degrees = np.arange(len(sets)), [], np.zeros(len(sets), np.int64)
    for i in np.flatnonzero(side == 0) if both else range(1, len(sets)):
        near = (sizes * 100 >= percent * sizes[i]) & (sizes[i] * 100 >= percent * sizes)
        near = np.flatnonzero(near & (side == 1) if both else near[:i])
        if not len(near):
            continue
        own = inverse[begins[i] : begins[i + 1]]
        lengths = edges[own + 1] - edges[own]
        starts = np.repeat(edges[own] - np.concatenate([[0], np.cumsum(lengths[:-1])]), lengths)
        overlap = np.bincount(posting_rows[starts + np.arange(int(lengths.sum()))], minlength=len(sets))[near]
        linked = near[100 * overlap >= percent * (sizes[i] + sizes[near] - overlap)]
        degrees[i] += copies[linked].sum()
        degrees[linked] += copies[i]
        for j in linked[root[linked] != root[i]]:
            if root[i] != root[j]:
                links.append((int(j), int(i)))
                root[root == root[j]] = root[i]
    return degrees, links


def _counted(members: DataFrame, percent: int) -> DataFrame:
    """members: component, doc, digest, copies, n, grams -> rows of two kinds: digest set: so many links n of its; digest null: link (a, b), enough of them to connect all linked documents."""
    shape = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("columns"))
    shape = shape.where("rows > 1").select("component", F.greatest(F.ceil(F.col("rows") / (BLOCK_ROWS * COUNT_BLOCKS)), F.ceil(F.col("columns") / BLOCK_GRAMS)).alias("blocks"))
    met = members.join(shape, "component").withColumn("block", _block("digest", "blocks"))
    met = met.select("*", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
    met = met.select(
        "component", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "doc", "digest", "copies", "grams"
    )

    def run(batches):
        for _, held in K.grouped(batches, ("component", "block_a", "block_b"), ("doc", "digest", "copies", "side", "grams")):
            docs, digests, copies, sides, packed = zip(*held, strict=True)
            degrees, links = count_links([K.unpack(x)[0] for x in packed], list(copies), list(sides), percent)
            some = np.flatnonzero(degrees)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(some) + [docs[a] for a, _ in links], pa.int64()),
                    pa.array([None] * len(some) + [docs[b] for _, b in links], pa.int64()),
                    pa.array([digests[k] for k in some] + [None] * len(links), pa.binary()),
                    pa.array([*degrees[some].tolist(), *[None] * len(links)], pa.int64()),
                ],
                names=["a", "b", "digest", "n"],
            )

    keys = ["component", "block_a", "block_b"]
    return met.repartition(partitions(met.sparkSession), *keys).sortWithinPartitions(*keys).transform(arrow, run, "a long, b long, digest binary, n long")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """rows: component, block_a, block_b, doc, side, grams -> (a, b)."""

    def sent(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    def run(batches):
        found: list[tuple[int, int]] = []
        for _, held in K.grouped(batches, ("component", "block_a", "block_b"), ("doc", "side", "grams")):
            found += link_rows([r[0] for r in held], [K.unpack(r[2])[0] for r in held], [r[1] for r in held], percent)
            if len(found) > 10_000:
                yield sent(found)
                found = []
        yield sent(found)

    keys = ["component", "block_a", "block_b"]
    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.transform(arrow, run, "a long, b long")


def _block(column: str, count: str) -> F.Column:
    return F.pmod(F.xxhash64(column), F.col(count)).cast("int")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Rows of components of two rows or more, with their component's number of blocks and their own one."""
    shape = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("columns"))
    shape = shape.where("rows > 1").select("component", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("columns") / BLOCK_GRAMS)).alias("blocks"))
    return checkpoint(members.join(shape, "component").withColumn("block", _block("doc", "blocks")))


def _possible(members: DataFrame, percent: int) -> DataFrame:
    """members: component, doc, n, grams -> (a, b) that connect, within components, all rows whose sketches let them link."""

    def sketched(batches):
        for batch in batches:
            found = [sketch(K.unpack(x)[0]) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in found], pa.binary())], names=["component", "doc", "n", "bits"])

    rows = members.select("component", "doc", "n", "grams").transform(arrow, sketched, "component long, doc long, n long, bits binary")
    # Linked rows are of one step of sizes or of two that follow each other; a hair less than the ratio keeps rounding out of it.
    ratio = max(1e-3, math.log(100 / percent) * (1 + 1e-9))
    rows = checkpoint(rows.withColumn("step", F.floor(F.log("n") / ratio).cast("int")))
    shape = rows.groupBy("component", "step").agg(F.greatest(F.ceil(F.count("*") / SKETCH_ROWS), F.ceil(F.sum(F.length("bits")) / SKETCH_BYTES)).cast("int").alias("blocks"))
    around = shape.join(shape.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above")), ["component", "step"], "left")
    around = around.join(shape.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below")), ["component", "step"], "left")
    met = rows.join(around, ["component", "step"]).withColumn("block", _block("doc", "blocks"))

    def key(step, a, b, side):
        return F.struct(*(x.cast("int").alias(n) for n, x in (("low", step), ("block_a", a), ("block_b", b), ("side", side))))

    def each(count, where):  # nothing where there are no such blocks
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), where)).otherwise(F.array().cast("array<struct<low:int,block_a:int,block_b:int,side:int>>"))

    step, block = F.col("step"), F.col("block")
    own = each("blocks", lambda o: key(step * 2, F.least(block, o), F.greatest(block, o), F.when(block > o, 1).otherwise(0)))
    above = each("above", lambda o: key(step * 2 + 1, block, o, F.lit(0)))
    below = each("below", lambda o: key(step * 2 - 1, o, block, F.lit(1)))
    met = met.select("component", "doc", "n", "bits", F.explode(F.concat(own, above, below)).alias("at")).select("component", "at.low", "at.block_a", "at.block_b", "at.side", "doc", "n", "bits")

    def run(batches):
        for _, held in K.grouped(batches, keys, ("doc", "n", "side", "bits")):
            docs, sizes, sides, bits = zip(*held, strict=True)
            links = may_link(np.array(sizes), [np.frombuffer(x, np.uint64) for x in bits], np.array(sides), percent)
            yield pa.RecordBatch.from_arrays([pa.array([docs[a] for a, _ in links], pa.int64()), pa.array([docs[b] for _, b in links], pa.int64())], names=["a", "b"])

    keys = ["component", "low", "block_a", "block_b"]
    return met.repartition(partitions(met.sparkSession), *keys).sortWithinPartitions(*keys).transform(arrow, run, "a long, b long")


def _product(members: DataFrame, percent: int) -> DataFrame:
    """members: component, doc, n, grams -> links (a, b) that connect all linked documents."""
    members = _in_blocks(members)
    release(members.sparkSession)
    small, large = members.where("blocks = 1"), members.where("blocks > 1")
    if large.limit(1).count():
        parts = connected_components(_possible(large, percent)).withColumnRenamed("node", "doc")
        parted = _in_blocks(large.drop("component", "blocks", "block").join(parts, "doc").select("component", "doc", "n", "grams"))
        small, large = small.unionByName(parted.where("blocks = 1")), parted.where("blocks > 1")

    small = small.select("component", F.lit(0).alias("block_a"), F.lit(0).alias("block_b"), "doc", F.lit(1).alias("side"), "grams")
    own = large.select("component", "block", F.lit(0).alias("block_b"), "doc", F.lit(1).alias("side"), "grams")
    heads = large.groupBy("component", "blocks").agg(F.min_by("doc", F.xxhash64("doc", F.lit(0))).alias("h0"), *[F.min_by("doc", F.xxhash64("doc", F.lit(i))).alias(f"h{i}") for i in range(1, LEADERS)])
    heads = heads.select("component", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(LEADERS)]))).alias("doc"))
    led = large.join(heads, ["component", "doc"], "left_semi").select("component", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("to"), "block", "doc", "grams")
    led = led.where("to <> block").select("component", F.col("to").alias("block"), F.lit(0).alias("block_b"), "doc", F.lit(0).alias("side"), "grams")
    first = checkpoint(_links(small.union(own).union(led), percent))
    if large.limit(1).count() == 0:
        return first

    # What its leaders and its own block have not connected meets everything else of its component.
    parts = connected_components(first)
    parted = large.join(parts.select(F.col("node").alias("doc"), F.col("component").alias("part")), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    main = parted.groupBy("component", "part").agg(F.count("*").alias("held")).groupBy("component").agg(F.max(F.struct("held", "part")).getField("part").alias("main"), F.count("*").alias("n_parts"))
    open_ = checkpoint(parted.join(main.where("n_parts > 1"), "component").withColumn("rest", F.col("part") != F.col("main")))
    rest = open_.where("rest").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).alias("rest_blocks"))
    open_ = open_.join(rest, "component")
    lefts = open_.where("rest").withColumn("block_a", _block("doc", "rest_blocks")).select("component", "block_a", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block_b"), "doc", F.lit(1).alias("side"), "grams")
    rights = open_.select("component", F.explode(F.sequence(F.lit(0), (F.col("rest_blocks") - 1).cast("int"))).alias("block_a"), F.col("block").alias("block_b"), "doc", F.lit(0).alias("side"), "grams")
    return first.union(_links(lefts.union(rights), percent))


def join_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles (its set's size), component_id (the smallest id that links reach, its own included) and n_links.

    n_links is the number of other documents that link with this one, copies
    included; half its sum over a class is the number of links of the class.  An
    id with different texts counts once for each.
    """
    return _joined(docs, size, percent, id_col, text_col, counted=True)


def _joined(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, counted: bool) -> DataFrame:
    """`join_documents`; n_links only if counted."""
    narrow = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    bits = frequent_grams(narrow.select("text"), size)
    found = checkpoint(_candidates(narrow, size, percent, bits))
    release(docs.sparkSession)
    sized = found.where("digest is not null").select(F.col("a").alias("doc"), F.col("b").alias("n"), "digest")
    near = found.where("digest is null").select("a", "b")
    linkable = sized.where("n > 0 and doc is not null")
    heads = checkpoint(linkable.groupBy("digest").agg(F.min("doc").alias("head"), F.count_distinct("doc").alias("copies")))
    hot = hot_keys(heads, "digest", "copies")
    headed = checkpoint(join_skewed(linkable, heads, "digest", hot))
    copies = headed.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b"))

    groups = connected_components(near.union(copies))
    own = heads.select(F.col("head").alias("doc"), "digest", "copies")
    members = checkpoint(groups.withColumnRenamed("node", "doc").join(own, "doc").select("doc", "component", "digest", "copies"))
    wanted = _member_bits(members)

    def sets(batches):
        for batch in batches:
            ids = batch.column(0)
            hit = np.flatnonzero(np.asarray(ids.is_valid()))
            batch = batch.take(pa.array(hit[_is_member(wanted, np.asarray(ids.fill_null(0))[hit])]))
            for part, data, offsets in T.slices(iter([batch]), "text"):
                grams, bounds = gram_sets(data, offsets, size)
                own_sets = [grams[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([set_digest(s) for s in own_sets], pa.binary()), pa.array(np.diff(bounds)), pa.array([K.pack(s) for s in own_sets], pa.binary())],
                    names=["doc", "digest", "n", "grams"],
                )

    held = narrow.transform(arrow, sets, "doc long, digest binary, n long, grams binary").join(members, ["doc", "digest"])
    held = held.dropDuplicates(["doc", "digest"])
    if counted:
        product = checkpoint(_counted(held, percent))
        links, degrees = product.where("digest is null").select("a", "b"), product.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("links"))
    else:
        links = checkpoint(_product(held.select("component", "doc", "n", "grams"), percent))
    classes = connected_components(links).withColumnRenamed("component", "class")

    if counted:
        told = heads.join(classes, F.col("head") == F.col("node"), "left").join(degrees, "digest", "left")
        told = told.select("digest", F.coalesce("class", "head").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        alone = sized.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
        out = join_skewed(linkable, checkpoint(told), "digest", hot).select("doc", "n", "component_id", "n_links").union(alone)
        return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    linked = headed.join(classes, F.col("head") == F.col("node"), "left").select("doc", "n", F.coalesce("class", "head").alias("component_id"))
    alone = sized.where("n = 0 or doc is null").select("doc", "n", F.col("doc").alias("component_id"))
    return linked.union(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, without those that link to a smaller id; of each group the document with its smallest id stays."""
    joined, gone_col = _joined(docs, size, percent, id_col, text_col, counted=False), free_name(docs, "gone")
    gone = checkpoint(joined.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_col)).distinct())
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == F.col(gone_col), "left_anti")
