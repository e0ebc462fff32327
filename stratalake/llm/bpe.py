"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a partition are laid out as linked sequences of symbols,
those that a slice of its rows brings along at a time, and kept with their ids
(`Memo`), so that a word is indexed once a partition.  An index maps every pair
that is a merge to all its positions; ranks are taken in ascending order, all
positions of a rank merge at once, and only the pairs beside them are looked up
anew and put into the lists of their ranks.  A pair that a merge brings about
has a higher rank than the merge, so that one pass in ascending order is exact;
`Vocabulary` checks this.

Understands the public JSON format of word-level BPE vocabularies: NFC, white
space collapsed, lower case, a pattern that splits words, bytes as characters
and a mark at the end of a word; special tokens are found in the raw text.

Defined results: a null or empty text has no tokens and decodes to the empty
text; special tokens are found wherever they stand in a text; code points that
newer Unicode versions than Python's assign are taken as the tokenizers library
takes them (`Newer`); repeated rows are encoded each on its own; an empty table gives an
empty one; other input columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import textkit as T
from .cluster import arrow, pick

SLICE_BYTES = 3 << 20
NEVER = np.int32(2**31 - 1)
# Fixed value: the Unicode white space that separates words; the five control characters that Python's split() adds aren't in it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
NOT_SPACE = regex.compile(f"[^{SPACE}]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Stands before a special token among the words of a text; no word has white space.
SPECIAL_MARK = "\n"


class Newer:
    """Code points that Python's Unicode tables do not assign but newer versions do: what the tokenizers library makes of them."""

    def __init__(self):
        from tokenizers import Regex, normalizers, pre_tokenizers

        everything = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
        newer = "".join(c for c in regex.findall(r"\P{Cn}", everything) if unicodedata.category(c) == "Cn")
        named = "".join(regex.findall(r"[\p{L}\p{N}]", newer))
        left = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(named)
        self.any = frozenset(newer)
        #: Letters and digits to the regex library alone.
        self.other = frozenset("".join(piece for piece, _ in left))
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


@functools.lru_cache(maxsize=1)
def newer() -> Newer:
    """One a worker process, made where a text first needs it."""
    return Newer()


#: Stands for such a code point where words are split: assigned, and no letter, digit or white space.
OTHER = "\ue000"


def stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) for the stretches of equal values of a sorted array; none is negative."""
    edges = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    for k, first in enumerate(edges):
        yield int(values[first]), first, edges[k + 1] if k + 1 < len(edges) else len(values)


def byte_characters() -> list[str]:
    """The character for each byte: itself where it is printable, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and pattern of a vocabulary file's text."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*ids.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.byte_ids = np.array([ids[c] for c in characters], np.int32)
        self.last_byte_ids = np.array([ids[c + self.mark] for c in characters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.size = size
        ranks = np.arange(len(merges), dtype=np.int32)
        keys = self.left.astype(np.int64) * size + self.right
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], ranks[order]
        self.by_left, self.by_right = self._rows(self.left, self.right), self._rows(self.right, self.left)
        first_use = np.full(size, len(merges), np.int64)
        np.minimum.at(first_use, self.left, ranks)
        np.minimum.at(first_use, self.right, ranks)
        if (first_use[self.merged] <= ranks).any():
            raise ValueError("a merge comes before the merge that makes one of its parts")
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def split(self, word: str) -> list[str]:
        """The parts of a word, by the file's pattern."""
        if word.isascii() or newer().other.isdisjoint(word):
            return self.pattern.findall(word)
        masked = "".join(OTHER if c in newer().other else c for c in word)
        return [word[m.start() : m.end()] for m in self.pattern.finditer(masked)]

    def _rows(self, own: np.ndarray, other: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each symbol that is `own` of some merges, the other parts in order and the ranks."""
        order = np.lexsort((other, own))
        return {symbol: (other[order[a:b]], order[a:b].astype(np.int32)) for symbol, a, b in stretches(own[order])}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of any pairs; NEVER where a pair is no merge."""
        keys = left.astype(np.int64) * self.size + right
        if not len(self.keys):
            return np.full(len(keys), NEVER)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NEVER)


def _ranks_beside(rows: tuple[np.ndarray, np.ndarray] | None, others: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of one symbol, whose merges are `rows`, with others."""
    if rows is None:
        return np.full(len(others), NEVER)
    known, ranks = rows
    at = np.minimum(np.searchsorted(known, others), len(known) - 1)
    return np.where(known[at] == others, ranks[at], NEVER)


class PairIndex:
    """The symbols of many words, merged to the end."""

    def __init__(self, vocabulary: Vocabulary, words: Sequence[bytes]):
        """No word is empty."""
        v = self.v = vocabulary
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        n = self.n = int(ends[-1]) if len(words) else 0
        data = np.frombuffer(b"".join(words), np.uint8)
        self.symbols = np.append(v.byte_ids[data], np.int32(-1))
        self.symbols[ends - 1] = v.last_byte_ids[data[ends - 1]]
        self.next = np.arange(1, n + 2, dtype=np.int32)
        self.previous = np.arange(-1, n, dtype=np.int32)
        self.next[ends - 1] = n  # n: no neighbour
        self.previous[ends - lengths] = n
        self.rank = np.full(n + 1, NEVER)  # of the pair that begins at a position
        inner = np.flatnonzero(self.next[:n] != n)
        self.rank[inner] = v.ranks(self.symbols[inner], self.symbols[inner + 1])
        self.alive = np.ones(n, bool)
        self.ends = ends
        self._merge_all()

    def _merge_all(self) -> None:
        at = np.flatnonzero(self.rank != NEVER).astype(np.int32)
        at = at[np.argsort(self.rank[at], kind="stable")]
        lists: dict[int, list[np.ndarray]] = {rank: [at[a:b]] for rank, a, b in stretches(self.rank[at])}
        active = list(lists)
        while active:
            rank = heapq.heappop(active)
            found = lists.pop(rank)
            places = found[0] if len(found) == 1 else np.concatenate(found)
            places = places[self.rank[places] == rank]
            if not len(places):
                continue
            if len(found) > 1:
                places = np.unique(places)
            changed, new = self._merge(rank, places)
            live = new != NEVER
            if not live.any():
                continue
            changed, new = changed[live], new[live]
            if len(new) > 1:
                order = np.argsort(new, kind="stable")
                changed, new = changed[order], new[order]
            for key, a, b in stretches(new):
                part = np.unique(changed[a:b])  # a place can be both merged and beside a merge
                if key in lists:
                    lists[key].append(part)
                else:
                    lists[key] = [part]
                    heapq.heappush(active, key)

    def _merge(self, rank: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pairs at ascending places; which positions' pairs have changed, and their new ranks."""
        v, n = self.v, self.n
        if v.left[rank] == v.right[rank] and len(places) > 1:  # in a run of overlapping pairs, every other one from the left
            joined = self.next[places[:-1]] == places[1:]
            if joined.any():
                index = np.arange(len(places))
                begins = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), index, 0))
                places = places[(index - begins) % 2 == 0]
        merged = v.merged[rank]
        gone = self.next[places]
        after = self.next[gone]
        self.symbols[places] = merged
        self.alive[gone] = False
        self.rank[gone] = NEVER
        self.next[places] = after
        self.previous[after] = places  # also writes the entry of "no neighbour", which nobody reads
        before = self.previous[places]
        right = np.where(after == n, NEVER, _ranks_beside(v.by_left.get(int(merged)), self.symbols[after]))
        self.rank[places] = right
        before = before[before != n]
        left = _ranks_beside(v.by_right.get(int(merged)), self.symbols[before])
        self.rank[before] = left
        return np.concatenate([places, before]), np.concatenate([right, left])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each word where its ids begin (and the end)."""
        upto = np.concatenate([[0], np.cumsum(self.alive)])
        return self.symbols[:-1][self.alive], np.concatenate([[0], upto[self.ends]]) if len(self.ends) else np.zeros(1, np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i]+1, ... (lengths[i] of them), one after the other."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)


#: Distinct words that a memo holds before it starts anew; bounds memory, never a result.
MEMO_WORDS = 400_000


class Memo:
    """The words that a partition has shown so far, and their ids."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 14, np.int64)

    def add(self, words: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        n, used = len(self.places), int(self.bounds[len(self.places)])
        for name, need in (("ids", used + len(ids)), ("bounds", n + len(words) + 1)):
            held = getattr(self, name)
            if need > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(need, 2 * len(held)) - len(held), held.dtype)]))
        self.ids[used : used + len(ids)] = ids
        self.bounds[n + 1 : n + len(words) + 1] = used + bounds[1:]
        self.places.update(zip(words, range(n, n + len(words)), strict=True))


class Encoder:
    def __init__(self, content: str):
        self.content = content
        self.v = Vocabulary(content)
        self.token_strings = pa.array(self.v.tokens)
        self.id_strings = pa.array([str(i) for i in range(self.v.size)])

    def __reduce__(self):
        return encoder_of, (self.content,)

    def words(self, text: str) -> list[str]:
        """The normalised text between white space; special tokens behind SPECIAL_MARK."""
        out = []
        pieces = self.v.special_split.split(text) if self.v.special_split else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(SPECIAL_MARK + piece)
            else:
                piece = self.normal(piece)
                out += NOT_SPACE.findall(piece) if ODD_SPACE.search(piece) else piece.split()
        return out

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            if not newer().any.isdisjoint(text):
                return newer().normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # character by character: no final sigma
        return text.lower()

    def simple(self, text: str) -> bool:
        """Whether splitting at any white space gives its words."""
        return not ODD_SPACE.search(text) and not any(s in text for s in self.v.specials)

    def encode(self, texts: list[str], memo: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text where its ids begin (and the end); words that the memo knows are not indexed again."""
        memo = memo or Memo()
        if all(map(self.simple, texts)):
            lists = pc.utf8_split_whitespace(pa.array(list(map(self.normal, texts)), pa.large_string()))
            flat, bounds = lists.flatten(), np.asarray(lists.offsets, np.int64)
            bounds = bounds - bounds[0]
            full = np.asarray(pc.greater(pc.binary_length(flat), 0))  # blanks at an end give empty words
            bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
            flat = flat.filter(pa.array(full))
        else:
            lists = list(map(self.words, texts))
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
            flat = pa.array([w for ws in lists for w in ws], pa.large_string())
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [w for w in distinct if w not in memo.places]
        if len(memo.places) + len(fresh) > MEMO_WORDS:
            memo.__init__()
            fresh = distinct
        if fresh:
            memo.add(fresh, *self._encode_words(fresh))
        place = np.fromiter(map(memo.places.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        first = memo.bounds[place]
        lengths = memo.bounds[place + 1] - first
        total = np.concatenate([[0], np.cumsum(lengths)])
        return memo.ids[ranges(first, lengths)], total[bounds]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of distinct words, by way of their distinct parts."""
        parts: dict[str, int] = {}
        counts, which = np.empty(len(words), np.int64), []
        find = self.v.split
        for k, word in enumerate(words):
            own = [word] if word.isalpha() or word[0] == SPECIAL_MARK else find(word)
            counts[k] = len(own)
            for part in own:
                which.append(parts.setdefault(part, len(parts)))
        special = {i: self.v.specials[p[1:]] for p, i in parts.items() if p[0] == SPECIAL_MARK}
        ids, bounds = PairIndex(self.v, [b"?" if i in special else p.encode() for i, p in enumerate(parts)]).result()
        for i, token in special.items():
            ids[bounds[i]] = token
        which = np.array(which, np.int64)
        lengths = np.diff(bounds)[which]
        part_bounds = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids[ranges(bounds[:-1][which], lengths)], total[part_bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of ids: tokens joined by one space, as a vocabulary without a decoder gives."""
        return self._joined(self.token_strings, ids, bounds)

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Decimal ids joined by one space."""
        return self._joined(self.id_strings, ids, bounds)

    @staticmethod
    def _joined(strings: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), strings.cast(pa.large_string()).take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


@functools.lru_cache(maxsize=2)
def encoder_of(content: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    return Encoder(content)


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), as_array: bool = False) -> DataFrame:
    """One row a document: doc_id, the columns in `keep`, n_tokens, ids and decoded.

    ids: decimal ids joined by one space, or with as_array an array<int>;
    decoded: the text that the ids decode to.  The vocabulary is read once, on
    the driver, and travels with the function (a few MB, fixed by the file).
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        encoder = encoder_of(file.read())
    narrow = pick(docs, **{"doc_id": id_col, "text": text_col}, **{k: k for k in keep})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch, data, offsets in T.slices(batches, "text", SLICE_BYTES):
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)]
            ids, bounds = encoder.encode(texts, memo)
            if as_array:
                held = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            else:
                held = encoder.written(ids, bounds)
            kept = [batch.column(batch.schema.get_field_index(k)) for k in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds)), held, encoder.decode(ids, bounds)], names=["doc_id", *keep, "n_tokens", "ids", "decoded"])

    kept = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in ("doc_id", *keep))
    return narrow.transform(arrow, run, f"{kept}, n_tokens long, ids {'array<int>' if as_array else 'string'}, decoded string")
