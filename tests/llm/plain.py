"""Plain versions of the operators, by other means and in memory, to hold results against."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAME_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def license_words(text: str | None) -> tuple:
    words, found = NAME_WORD.findall(lower(text)), []
    for phrase, label in BASE.items():
        found += [(i, label) for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
    return len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({name for _, name in found}))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def license_windows(text: str | None, notices) -> list[tuple]:
    """(phrase, first word, word behind, edits) of all windows within a notice's bounds: six letters for an edit in a word, fifteen for one in the phrase."""
    words, out = NAME_WORD.findall(lower(text)), []
    for notice in notices:
        want = notice.phrase.split()
        for i in range(len(words) - len(want) + 1):
            apart = [distance(a, b) for a, b in zip(words[i : i + len(want)], want, strict=True)]
            if all(d <= (len(w) >= 6) for d, w in zip(apart, want, strict=True)) and sum(apart) <= len(notice.phrase) // 15:
                out.append((notice.phrase, i, i + len(want), sum(apart)))
    return sorted(out)


def quality_measures(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def good_rows(rows: list[tuple]) -> list[tuple]:
    """Of (id, text, lang, source, ...) those that the quality rules keep, judged host by host."""
    measured = []
    for r in rows:
        n, _, symbols, dup, repeat = quality_measures(r[1])
        base = n < 50 or 100 * repeat > 50 * n
        lines = sum(bool(WORD.search(x)) for x in (r[1] or "").split("\n"))
        measured.append((r, base, symbols > n or 100 * dup > 30 * lines))
    n, bad = collections.Counter(r[3] for r in rows), collections.Counter(m[0][3] for m in measured if m[1] or m[2])
    total, failed = sum(n.values()), sum(bad.values())
    mean = min(max(failed / total, 1e-6), 1 - 1e-6)
    # The variance between hosts: weighted squares of the rates about the mean, less what chance gives equal hosts.
    spread = sum(n[h] * (bad[h] / n[h] - failed / total) ** 2 for h in n)
    room = total - sum(k * k for k in n.values()) / total
    own = (spread - (len(n) - 1) * mean * (1 - mean)) / room if room > 0 else 0
    weight = min(max(mean * (1 - mean) / own - 1 if own > 0 else 1000, 2), 1000)
    rate = {h: (bad[h] + mean * weight) / (n[h] + weight) for h in n}
    return [r for r, base, sign in measured if not (base or rate[r[3]] > 0.5 or rate[r[3]] > 0.05 and sign)]


def shingles(text: str | None, size: int) -> set:
    words = WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard_classes(rows: list[tuple], size: int, percent: int) -> dict:
    """id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, size) for i, t in rows}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in collections.Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def without_repeats(rows: list[tuple], length: int) -> dict:
    """id -> (bytes, removed, spans, sha256 of the rest)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                covered[k : k + length] = b"\1" * length
            else:
                seen.add(part)
        rest = bytes(c for c, gone in zip(data, covered, strict=True) if not gone)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out[i] = len(data), sum(covered), spans, hashlib.sha256(rest).hexdigest()
    return out


def token_scores(rows: list[tuple]) -> dict:
    """id -> (held out, tokens, known, training tokens, base score)."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words = {i: [*WORD.findall(lower(t)), None] for i, t in rows}
    count = collections.Counter(w for i in words if not held[i] for w in words[i])
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words.items()}


def water(amounts: dict, weights: dict, cap: int) -> dict:
    """Shares by weight of the sum of the amounts, none above cap times its amount."""
    left, open_, out = sum(amounts.values()), set(amounts), {}
    while open_:
        rate = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if weights[k] * rate >= cap * amounts[k]}
        if not full:
            return out | {k: weights[k] * rate for k in open_}
        for k in full:
            out[k] = float(cap * amounts[k])
            left -= cap * amounts[k]
        open_ -= full
    return out
