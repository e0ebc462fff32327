"""Subword lattice likelihood of whole texts.

Pieces and their scores come from an existing vocabulary file, and these scores
alone, normalised once, weigh the segmentations (`Pieces`).  A word's likelihood
is that of all its segmentations together: a forward recursion in log space over
the lattice of pieces, where single bytes stand in for whatever no piece covers.
A text is its words, each begun by the word mark, and one end.  Training
documents give the counts of the base score.

A vocabulary's scores know nothing of the corpus.  With `learn`, the pieces' own
probabilities and, by LEARNED, their shares of the training documents' pieces,
as the vocabulary's library splits these, weigh the lattice; and the lattice is what a token's probability falls back to: each distinct token of the
training documents leaves DISCOUNT of its count, and all that is left is dealt
out by the lattice, over any text there is.  Probabilities sum to 1 at most.

A task's documents are read as a unit: its distinct words, numbered, with their
counts, and the documents as lists of these numbers.  The words of all units
meet sorted by fingerprint, so each is counted and scored once a corpus, and
counts and scores go back to the units that have it: a row a word and unit, both
ways, whatever the number of tasks.  No task holds more than a unit or, sorted, a
word at a time.

Defined results: a null or empty text is its end alone; a null id is held out
(its text form is empty); repeated rows are scored, and learned from, each on
its own; ids may be of any type that has a text form; without training tokens
every token is unknown; an empty table gives an empty one; other input columns
are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from . import textkit as T
from .cluster import arrow, checkpoint, partitions, pick

SLICE_BYTES = 4 << 20
SPREAD = "unit long, kind int, print long, word binary, id int, n long, packed binary"
ANSWER = "unit long, kind int, id int, n long, score double"
#: In a unit, words come before documents.
WORDS, SCORED, DOCS, TRAINED = range(4)
#: Distinct words after which a task begins another unit, and rows that are scored or sent at a time.
UNIT_WORDS, SCORE_ROWS = 1 << 20, 1 << 17
WORD_MARK = "▁"
#: Words of more bytes are scored one by one.
LONG_WORD = 128
#: What every distinct token of the training documents gives of its count to the lattice.
DISCOUNT = 0.5
#: Weight of what training documents tell of the pieces, beside the vocabulary's own scores.
LEARNED = 0.9


class Pieces:
    """A vocabulary: the pieces' bytes, whether they begin a word, and natural logarithms of their probabilities, -inf for what is no piece of a text.

    Scores of a unigram vocabulary are such logarithms.  A vocabulary of merges
    has ranks instead, all whole numbers from 0 down; a piece of rank r then has
    the weight 1 / (RANK_SHIFT + r), the usual law of frequencies by rank.  Bytes
    that stand in for unknown text have no score of their own and get BYTE_WEIGHT
    of the whole each.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = model
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = p.get_piece_size()
        self.processor, self.end = p, p.eos_id()
        self.content: list[bytes | None] = []
        self.begins = np.zeros(n, bool)
        scores, stands_in = np.full(n, -np.inf), np.zeros(n, bool)
        for i in range(n):
            piece, score = p.id_to_piece(i), p.get_score(i)
            if p.is_byte(i):
                self.content.append(bytes([int(piece[3:5], 16)]))
                stands_in[i] = True
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.content.append(None)
                scores[i] = score if i == self.end else -np.inf
            else:
                self.begins[i] = piece.startswith(WORD_MARK)
                rest = piece[1:] if self.begins[i] else piece
                inside = WORD_MARK in rest or (not rest and not self.begins[i])
                self.content.append(None if inside else rest.encode())
                scores[i] = -np.inf if inside or score < NO_PIECE else score
        self.log_p = weigh(scores, stands_in)

    def __reduce__(self):
        return pieces_of, (self.model,)

    @staticmethod
    def read(path: str) -> Pieces:
        with open(path, "rb") as file:
            return pieces_of(file.read())


@functools.lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    """One vocabulary a worker process; the library's object is made anew from the model's bytes there."""
    return Pieces(model)


#: Scores below this mark pieces that a vocabulary file keeps but never uses.
NO_PIECE = -1e8
RANK_SHIFT, BYTE_WEIGHT = 10.0, 1e-6


def weigh(scores: np.ndarray, stands_in: np.ndarray) -> np.ndarray:
    """Natural logarithms of probabilities that sum to 1, from a file's scores (-inf: no piece); see Pieces."""
    scored = np.isfinite(scores)
    own = scores[scored]
    ranks = bool(len(own)) and bool((own == np.round(own)).all()) and bool((own <= 0).all())
    out = np.full(len(scores), -np.inf)
    out[scored] = -np.log(RANK_SHIFT - own) if ranks else own
    out[scored] += np.log1p(-BYTE_WEIGHT * stands_in.sum()) - np.logaddexp.reduce(out[scored]) if len(own) else 0.0
    out[stands_in] = np.log(BYTE_WEIGHT)
    return out


def _count_pieces(pieces: Pieces):
    """Of rows (word, n): how often each piece occurs when the vocabulary's library splits the words."""

    def count(batches):
        total = np.zeros(len(pieces.content), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            split = pieces.processor.encode(words, num_threads=1)
            lengths = np.fromiter(map(len, split), np.int64, len(split))
            flat = np.fromiter((i for ids in split for i in ids), np.int64, int(lengths.sum()))
            np.add.at(total, flat, np.repeat(np.asarray(batch.column(1)), lengths))
        return total

    return count


def learned_pieces(pieces: Pieces, counts: np.ndarray) -> np.ndarray:
    """Natural logarithms of the pieces' own probabilities and their shares of the counts, mixed; the former alone where nothing was counted."""
    used = np.where(np.isfinite(pieces.log_p), counts, 0)
    if not used.any():
        return pieces.log_p
    with np.errstate(divide="ignore"):
        return np.log((1 - LEARNED) * np.exp(pieces.log_p) + LEARNED * used / used.sum())


class Lattice:
    """Scores words under the log probabilities of the pieces, by default their own."""

    BITS = 20

    def __init__(self, pieces: Pieces, log_p: np.ndarray | None = None):
        log_p = pieces.log_p if log_p is None else log_p
        self.inner: dict[bytes, list[float]] = {}
        self.first: dict[bytes, list[float]] = {}
        for i, content in enumerate(pieces.content):
            if content is not None and np.isfinite(log_p[i]):
                (self.first if pieces.begins[i] else self.inner).setdefault(content, []).append(float(log_p[i]))
        merged = lambda held: {k: float(np.logaddexp.reduce(v)) for k, v in held.items()}
        self.inner, self.first = merged(self.inner), merged(self.first)
        self.longest = max(map(len, [*self.inner, *self.first]))
        self.bytes_log = np.array([self.inner.get(bytes([b]), -np.inf) for b in range(256)])
        mark = WORD_MARK.encode()
        # The word mark alone: as a piece, or as its bytes.
        ways = [self.first[b""]] if b"" in self.first else []
        self.mark_log = float(np.logaddexp.reduce([*ways, float(self.bytes_log[list(mark)].sum())]))
        self.tables = [self._table({k: v for k, v in held.items() if k}) for held in (self.inner, self.first)]

    def _table(self, held: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = list(held)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        keys = T.Fingerprints(np.frombuffer(b"".join(words), np.uint8)).of(ends - sizes, ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        seen = np.zeros(1 << self.BITS, bool)
        seen[(keys >> T.U64(64 - self.BITS)).astype(np.int64)] = True
        return keys[order], np.array([held[w] for w in words])[order], seen

    @classmethod
    def _look_up(cls, table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are pieces, and their log probabilities."""
        known, logs, seen = table
        maybe = np.flatnonzero(seen[(keys >> T.U64(64 - cls.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, keys[maybe]), max(len(known) - 1, 0))
        hit = known[at] == keys[maybe] if len(known) else np.zeros(len(maybe), bool)
        return maybe[hit], logs[at[hit]]

    def one(self, word: bytes) -> float:
        """A word's natural log likelihood, by plain recursion."""
        n = len(word)
        alpha = np.full(n + 1, -np.inf)
        alpha[0] = self.mark_log
        for j in range(1, n + 1):
            ways = []
            for i in range(max(0, j - self.longest), j):
                part = word[i:j]
                if part in self.inner:
                    ways.append(alpha[i] + self.inner[part])
                if i == 0 and part in self.first:
                    ways.append(self.first[part])
            alpha[j] = np.logaddexp.reduce(ways) if ways else -np.inf
        return float(alpha[n])

    def many(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of words given by their spans: the same recursion for all words at once, one end position after the other."""
        out = np.empty(len(starts))
        for k in np.flatnonzero(sizes > LONG_WORD):
            out[k] = self.one(data[starts[k] : starts[k] + sizes[k]].tobytes())
        short = np.flatnonzero(sizes <= LONG_WORD)
        short = short[np.argsort(-sizes[short], kind="stable")]
        begin, size = starts[short], sizes[short]
        prints = T.Fingerprints(data)
        longest = int(size.max(initial=0))
        alpha = np.full((longest + 1, len(short)), -np.inf)
        alpha[0] = self.mark_log
        for j in range(1, longest + 1):
            live = int(np.searchsorted(-size, -j, "right"))
            ends = begin[:live] + j
            row = alpha[j, :live]
            for i in range(max(0, j - self.longest), j):
                keys = prints.of(begin[:live] + i, ends)
                hit, logs = self._look_up(self.tables[0], keys)
                row[hit] = np.logaddexp(row[hit], alpha[i, hit] + logs)
                if i == 0:
                    hit, logs = self._look_up(self.tables[1], keys)
                    row[hit] = np.logaddexp(row[hit], logs)
        out[short] = alpha[size, np.arange(len(short))]
        return out


def held_out_ids(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _packed_ids(ids: list) -> list[np.ndarray]:
    """Which ids are missing, the lengths of the others' text forms, and these in one buffer."""
    texts = [b"" if i is None else str(i).encode() for i in ids]
    return [np.array([i is None for i in ids], bool), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)]


def _unpacked_ids(missing: np.ndarray, lengths: np.ndarray, raw: np.ndarray) -> list[str | None]:
    text, ends = raw.tobytes(), np.cumsum(lengths)
    return [None if gone else text[b - n : b].decode() for gone, n, b in zip(missing, lengths, ends, strict=True)]


class _Unit:
    """The distinct words of a task's documents, numbered in the order in which they come."""

    def __init__(self):
        self.prints, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the fingerprints
        self.counts = np.zeros(0, np.int64)
        self.words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, counts: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of words with these distinct fingerprints in order, counts added."""
        at = np.minimum(np.searchsorted(self.prints, prints), max(len(self.prints) - 1, 0))
        known = self.prints[at] == prints if len(self.prints) else np.zeros(len(prints), bool)
        ids = np.empty(len(prints), np.int32)
        ids[known] = self.ids[at[known]]
        new = np.flatnonzero(~known)
        ids[new] = np.arange(len(self.counts), len(self.counts) + len(new))
        text = data[_ranges(starts[new], sizes[new])]
        self.words.append((prints[new], sizes[new], text))
        self.prints, self.ids = np.concatenate([self.prints, prints[new]]), np.concatenate([self.ids, ids[new]])
        order = np.argsort(self.prints, kind="stable")
        self.prints, self.ids = self.prints[order], self.ids[order]
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts[ids] += counts
        return ids

    def rows(self, unit: int):
        first = 0
        for prints, sizes, text in self.words:
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for a in range(0, len(prints), SCORE_ROWS):
                b = min(len(prints), a + SCORE_ROWS)
                words = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends[a : b + 1] - ends[a]).astype(np.int32).tobytes()), pa.py_buffer(text[ends[a] : ends[b]].tobytes())])
                ids = np.arange(first + a, first + b, dtype=np.int32)
                yield _batch(SPREAD, b - a, unit=np.full(b - a, unit), kind=np.full(b - a, WORDS, np.int32), print=prints[a:b].view(np.int64), word=words, id=ids, n=self.counts[ids])
            first += len(prints)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i]+1, ... (sizes[i] of them), one after the other."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], sizes)


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """Columns in the schema's order, null where none is given."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _spread(held_out: Callable[[list], np.ndarray]):
    """Documents as numbers of their unit's words, and these words."""

    def run(batches):
        part, number, unit = TaskContext.get().partitionId(), 0, _Unit()
        for batch, data, offsets in T.slices(batches, "text", SLICE_BYTES):
            ids = batch.column(0).to_pylist()
            out = held_out(ids)
            data = T.LOWER[data]
            starts, ends = T.runs(~T.SPACES[data], offsets)
            bounds = T.row_bounds(starts, offsets)
            prints, first, inverse = np.unique(T.word_fingerprints(data, starts, ends), return_index=True, return_inverse=True)
            trained = np.bincount(inverse, weights=np.repeat(~out, np.diff(bounds)), minlength=len(prints)).astype(np.int64)
            numbers = unit.add(prints, trained, data, starts[first], (ends - starts)[first])
            name = part << 24 | number
            yield _batch(SPREAD, 2, unit=[name, name], kind=[DOCS, TRAINED], n=[None, int((~out).sum())], packed=[K.pack(*_packed_ids(ids), out, np.diff(bounds), numbers[inverse]), None])
            if len(unit.counts) > UNIT_WORDS:
                yield from unit.rows(name)
                number, unit = number + 1, _Unit()
        yield from unit.rows(part << 24 | number)

    return run


def _score(lattice_of: Callable[[], Lattice]):
    """Rows of words (print, word, unit, id, n) in order of their fingerprints: each word's count and score, to every unit that has it."""

    def run(batches):
        lattice, held, rows = lattice_of(), [], 0

        def told(table: pa.Table, last: bool):
            """Batches for all whole words, and the rows of the last one, of which more may come."""
            table = table.combine_chunks()
            prints = table["print"].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
            end = len(prints) if last else int(begins[-1])
            begins = begins[begins < end]
            if not len(begins):
                return [], table
            counts = table["n"].to_numpy()[:end]
            total = np.add.reduceat(counts, begins)
            words = table["word"].chunk(0).take(pa.array(begins))
            data, offsets = T.column(pa.RecordBatch.from_arrays([words], names=["word"]), "word")
            scores, first = np.empty(len(begins)), 0
            while first < len(begins):
                behind = max(first + 1, int(np.searchsorted(offsets, offsets[first] + T.SLICE_BYTES // 2, "right")) - 1)
                behind = min(behind, len(begins))
                scores[first:behind] = lattice.many(data[offsets[first] : offsets[behind]], offsets[first:behind] - offsets[first], np.diff(offsets[first : behind + 1]))
                first = behind
            repeats = np.diff(np.append(begins, end))
            return [_batch(ANSWER, end, unit=table["unit"].to_numpy()[:end], kind=np.full(end, SCORED, np.int32), id=table["id"].to_numpy()[:end], n=np.repeat(total, repeats), score=np.repeat(scores, repeats))], table.slice(end)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SCORE_ROWS:
                out, rest = told(pa.Table.from_batches(held), False)
                yield from out
                held, rows = rest.to_batches(), 0
        if held and sum(b.num_rows for b in held):
            out, _ = told(pa.Table.from_batches(held), True)
            yield from out

    return run


OUT = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _learned(counted: np.ndarray, scores: np.ndarray, tokens: int, distinct: int) -> np.ndarray:
    """Natural logarithms of the tokens' probabilities: what DISCOUNT leaves of each count in training, and the lattice's probability as a share of all that it took."""
    if not tokens:
        return scores
    with np.errstate(divide="ignore"):
        own = np.log(np.maximum(counted - DISCOUNT, 0.0) / tokens)
    return np.logaddexp(own, scores + np.log(DISCOUNT * distinct / tokens))


def _finish(tokens: int, distinct: int, ends: int, end_log: float, learn: bool):
    """Documents and answers meet; rows come in order of (unit, kind), so that one unit's words are held at a time."""
    names = [x.split()[0] for x in OUT.split(", ")]
    floor = tokens + 0.1 * (distinct + 1)
    if learn:
        end_log = float(_learned(np.array([ends]), np.array([end_log]), tokens, distinct)[0])

    def slices(batches):
        """(which words are known, base scores, scores, packed) of each slice of documents."""
        unit, answers, values = None, [], None
        for batch in batches:
            units, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            edges = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
            for a, b in zip(edges, [*edges[1:], len(units)], strict=True):
                if units[a] != unit:
                    unit, answers, values = units[a], [], None
                behind = a + int(np.searchsorted(kinds[a:b], DOCS))
                if behind > a:
                    answers.append([np.asarray(batch.column(c).slice(a, behind - a)) for c in (2, 3, 4)])
                for row in range(behind, b):
                    if values is None:
                        ids, counted, scores = (np.concatenate(y) for y in zip(*answers, strict=True)) if answers else (np.zeros(0, np.int64),) * 3
                        order = np.argsort(ids)
                        scores = _learned(counted, scores, tokens, distinct) if learn else scores
                    values, answers = ((counted > 0).astype(float)[order], np.log10((counted + 0.1) / floor)[order], scores[order]), []
                    yield *values, batch.column(5)[row].as_py()

    def run(batches):
        for known, base, scores, packed in slices(batches):
            missing, lengths, raw, out, sizes, places = K.unpack(packed)
            ids = _unpacked_ids(missing, lengths, raw)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            full = sizes > 0

            def total(values, bounds=bounds, full=full, places=places):
                sums = np.zeros(len(full))
                if full.any():
                    sums[full] = np.add.reduceat(values[places], bounds[:-1][full])
                return sums

            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()), pa.array(out), pa.array(sizes + 1), pa.array(total(known).astype(np.int64) + (ends > 0)), pa.array(np.full(len(ids), tokens)),
                    pa.array(total(base) + np.log10((ends + 0.1) / floor)), pa.array((total(scores) + end_log) / np.log(10)),
                ],
                names=names,
            )

    return run


def score_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[list], np.ndarray] = held_out_ids, learn: bool = False) -> DataFrame:
    """One row a document: OUT, with the id's own type. score is the log10 probability of the text, base_score that under smoothed word counts, which learn from the documents not held out; with `learn`, so does the score."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    count, pieces = partitions(docs.sparkSession), Pieces.read(vocabulary_path)
    spread = checkpoint(docs.transform(arrow, _spread(held_out), SPREAD))
    words = spread.where(f"kind = {WORDS}").select("print", "word", "unit", "id", "n")
    ends, tokens = spread.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in (TRAINED, WORDS)]).first()
    log_p = pieces.log_p
    if learn:
        counts = K.sum_counters(words.where("n > 0").select("word", "n"), _count_pieces(pieces), len(log_p))
        counts[pieces.end] += ends
        log_p = learned_pieces(pieces, counts)
    sorted_words = words.repartition(count, "print").sortWithinPartitions("print")
    answers = sorted_words.transform(arrow, _score(lambda: Lattice(pieces, log_p)), ANSWER)
    distinct = words.where("n > 0").select("print").distinct().count() + (ends > 0)  # counted by itself, so that answers needn't be written
    told = answers.withColumn("packed", F.lit(None).cast("binary"))
    held = spread.where(f"kind = {DOCS}").select("unit", "kind", *[F.lit(None).cast(k).alias(n) for n, k in (("id", "int"), ("n", "long"), ("score", "double"))], "packed")
    # Units by the number of their task, so that they are dealt evenly.
    target = F.pmod(F.shiftright("unit", 24) + F.col("unit").bitwiseAND((1 << 24) - 1), F.lit(count)).cast("int")
    met = K.deal(told.unionByName(held).withColumn("target", target), count=count).drop("target").sortWithinPartitions("unit", "kind")
    scored = met.transform(arrow, _finish(tokens + ends, distinct, ends, float(log_p[pieces.end]), learn), OUT)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
