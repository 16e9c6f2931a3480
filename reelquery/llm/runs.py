"""Periodic runs of words: maximal stretches that repeat with their smallest period, and texts with the repeats taken out."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import map_texts

#: A run has at least so many words, and at least two periods.
LEAST_LENGTH = 12
#: Words that are compared one by one before the hashes are asked.
DIRECT = 4
MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extension:
    """How far two places of a word sequence agree, to the right and to the left.

    Prefix hashes (a polynomial modulo 2^64) and a binary search propose a length; the words themselves confirm it, so equal
    hashes of different words cost time, never a wrong result. What is confirmed for a distance is kept: later questions about
    the same stretch are answered from it, and its words are not compared again."""

    def __init__(self, words: np.ndarray):
        self.words, self.list, self.n = words, words.tolist(), len(words)
        self.hashes = None
        self.ahead: dict[int, tuple[int, int]] = {}
        self.behind: dict[int, tuple[int, int]] = {}

    def prepare(self) -> None:
        powers = np.full(self.n + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((self.words.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        self.hashes, self.powers = sums.tolist(), powers.tolist()

    def longest(self, same, most: int) -> int:
        """The largest length at most `most` for which same(length), which holds up to some length above DIRECT - 1."""
        low, step = DIRECT, DIRECT
        while low < most and same(min(most, low + step)):
            low, step = min(most, low + step), 2 * step
        high = min(most, low + step)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if same(middle) else (low, middle - 1)
        return low

    def right(self, i: int, j: int) -> int:
        """The largest L with words[i : i + L] == words[j : j + L]; i < j."""
        w, most, k = self.list, self.n - j, 0
        known = self.ahead.get(j - i)
        if known and known[0] <= i <= known[1]:
            return known[1] - i
        while k < most and k < DIRECT and w[i + k] == w[j + k]:
            k += 1
            if known and i + k == known[0]:
                k = known[1] - i
                break
        else:
            if k == DIRECT and k < most:
                k = self.far_right(i, j, most, known)
        self.ahead[j - i] = (i, i + k)
        return k

    def far_right(self, i: int, j: int, most: int, known: tuple[int, int] | None) -> int:
        if self.hashes is None:
            self.prepare()
        h, power = self.hashes, self.powers[j - i]
        k = self.longest(lambda x: (h[i + x] - h[i]) * power & MASK == h[j + x] - h[j] & MASK, most)
        joins = known is not None and i < known[0] <= i + k
        to = known[0] - i if joins else k
        differ = np.flatnonzero(self.words[i : i + to] != self.words[j : j + to])
        return int(differ[0]) if len(differ) else known[1] - i if joins else k

    def left(self, i: int, j: int) -> int:
        """The largest L with words[i - L + 1 : i + 1] == words[j - L + 1 : j + 1]; i < j, and i may be -1."""
        w, most, k = self.list, i + 1, 0
        known = self.behind.get(j - i)
        if known and known[0] <= i + 1 <= known[1]:
            return i + 1 - known[0]
        while k < most and k < DIRECT and w[i - k] == w[j - k]:
            k += 1
            if known and i + 1 - k == known[1]:
                k = i + 1 - known[0]
                break
        else:
            if k == DIRECT and k < most:
                k = self.far_left(i, j, most, known)
        self.behind[j - i] = (i + 1 - k, i + 1)
        return k

    def far_left(self, i: int, j: int, most: int, known: tuple[int, int] | None) -> int:
        if self.hashes is None:
            self.prepare()
        h, power = self.hashes, self.powers[j - i]
        k = self.longest(lambda x: (h[i + 1] - h[i + 1 - x]) * power & MASK == h[j + 1] - h[j + 1 - x] & MASK, most)
        joins = known is not None and i + 1 - k <= known[1] <= i
        low = known[1] if joins else i + 1 - k
        differ = np.flatnonzero(self.words[low : i + 1] != self.words[low + j - i : j + 1])
        return i - low - int(differ[-1]) if len(differ) else i + 1 - known[0] if joins else k


def next_smaller(words: list[int], extension: Extension) -> list[int]:
    """For every suffix the start of the next one that is smaller, n if none: where the longest Lyndon word there ends.
    Scanned from right to left; the chain of next smaller suffixes is the stack. words are the numbers that order them, or
    these with the sign changed for the reverse order; the end of the text is smaller than any word in both."""
    n = len(words)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, words[i]
        while j < n:
            other = words[j]
            if other < own:
                break
            if other == own:
                k = 1 if j + 1 < n and words[j + 1] != words[i + 1] else extension.right(i, j)
                if j + k == n or words[j + k] < words[i + k]:
                    break
            j = after[j]
        after[i] = j
    return after


def candidates(codes: np.ndarray, after: np.ndarray, depth: int) -> list[int]:
    """The starts of longest Lyndon words that agree with what follows them, or with what precedes it, for depth words."""
    padded = np.append(codes, (-1, -2))  # differs from every word; place -1 is the end of it
    ahead = np.flatnonzero(codes == padded[after])
    behind = np.flatnonzero(codes[:-1] == codes[after[1:] - 1]) + 1
    for k in range(1, depth):
        x, y = ahead + k, after[ahead] + k
        ahead = ahead[(y < len(codes)) & (padded[x] == padded[np.minimum(y, len(codes))])]
        behind = behind[behind > k]
        behind = behind[codes[behind - 1 - k] == codes[after[behind] - 1 - k]]
    return sorted({*ahead.tolist(), *behind.tolist()})


def runs_of(words: list, least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least `least` words, by start and period.

    A run's smallest period is the length of a Lyndon word that, under the order of words or the reverse order, is the longest
    one at its start; so both orders are scanned, and every longest Lyndon word is extended to both sides by its own length."""
    numbers: dict = defaultdict(count().__next__)
    codes = np.array(list(map(numbers.__getitem__, words)), np.int64)
    n = len(codes)
    if n < least or len(numbers) == n:
        return []
    extension, found = Extension(codes), set()
    # both sides together must reach max(period, least - period), which is least / 2 or more: one of them half of that
    depth = max(1, -(-least // 4))
    for order in (extension.list, (-codes).tolist()):
        after = np.array(next_smaller(order, extension))
        for i in candidates(codes, after, depth):
            j = int(after[i])
            period = j - i
            ahead = extension.right(i, j) if j < n else 0
            behind = extension.left(i - 1, j - 1)
            if ahead + behind >= max(period, least - period):
                found.add((i - behind, ahead + behind + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that any run holds after its first period."""
    if not runs:
        return words
    cuts = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cuts[start + period] += 1
        cuts[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(cuts)[:-1] == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in words from 0; by start and period) and collapsed, the words outside
    repeats joined by one space, of every row's whole text.

    Words are [^\\x20\\x09-\\x0D]+. A null or empty text has no words, no runs and collapses to the empty string. Every row is
    scanned by itself: null and repeated doc_ids and repeated rows each give a row. A text of any length is scanned whole, in
    time that grows with n log n. An empty table gives no rows; extra columns, whatever their names, are ignored."""

    def one():
        def work(ids, texts):
            out = {"doc_id": ids, "n_words": [], "runs": [], "collapsed": []}
            for text in texts:
                words = (text or b"").split()
                runs = runs_of(words, least)
                out["n_words"].append(len(words))
                out["runs"].append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                out["collapsed"].append(b" ".join(collapse(words, runs)))
            return out

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, RUNS)


def with_repeats(doc_id: Column, text: Column) -> Column:
    """text, but of one document in ten (by crc32 of its id) all words from one on repeat with one period. A text without words
    and one without doc_id stay as they are."""
    crc = F.crc32(doc_id.cast("string"))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(crc / 10).cast("long"), F.size(words).cast("long")
    first = g % n
    period = 1 + F.floor((n - first) / (3 + g % 8)).cast("long")
    block = F.slice(words, (first + 1).cast("int"), period.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, (F.floor((n - first) / period) + 1).cast("int"))), F.lit(1), (n - first).cast("int"))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), first.cast("int")), tail), " ")
    return F.when((crc % 10 == 0) & text.isNotNull() & (n > 0), repeated).otherwise(text)
