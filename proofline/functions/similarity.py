"""Arrow-batched similarity scores, used only where no built-in can give them.

Scores are on a 0-100 scale and come from the longest common subsequence
(`indel`): 200 * lcs / (len(a) + len(b)). Many windows of one text are scored
at once with numpy, one bit per keyword letter.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Workers get these helpers with the function that uses them: no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_WORD = 63  # letters of a keyword that fit one machine word with a carry bit


def _letter_bits(keyword: str, codes: np.ndarray) -> np.ndarray:
    """For each of the code points, the places of the keyword it stands at; none for letters the keyword lacks."""
    places: dict[int, int] = {}
    for place, letter in enumerate(keyword):
        places[ord(letter)] = places.get(ord(letter), 0) | 1 << place
    letters = np.array(sorted(places), dtype=np.int64)
    bits = np.array([places[c] for c in letters.tolist()], dtype=np.uint64)
    at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
    return np.where(letters[at] == codes, bits[at], np.uint64(0))


def _lcs_many(keyword: str, windows: np.ndarray) -> np.ndarray:
    """LCS length of `keyword` with each row of code points (0 = padding)."""
    if not keyword:
        return np.zeros(len(windows), dtype=np.int64)
    if len(keyword) > _WORD:
        return np.array([_lcs_long(keyword, row) for row in windows], dtype=np.int64)
    rows, width = windows.shape
    bits = _letter_bits(keyword, windows)
    full = np.uint64((1 << len(keyword)) - 1)
    state = np.full(rows, full, dtype=np.uint64)
    for column in range(width):
        hit = state & bits[:, column]
        state = ((state + hit) | (state - hit)) & full
    unset = (~state) & full
    return np.bitwise_count(unset).astype(np.int64)


def _lcs_long(keyword: str, codes: np.ndarray) -> int:
    previous = np.zeros(len(keyword) + 1, dtype=np.int64)
    letters = np.array([ord(c) for c in keyword])
    for code in codes[codes > 0]:
        matched = np.where(letters == code, previous[:-1] + 1, 0)
        current = np.maximum(previous[1:], matched)
        previous = np.concatenate(([0], np.maximum.accumulate(current)))
    return int(previous[-1])


def _pad(words: Sequence[str]) -> np.ndarray:
    width = max((len(w) for w in words), default=0)
    out = np.zeros((len(words), max(width, 1)), dtype=np.int64)
    for row, word in enumerate(words):
        out[row, : len(word)] = [ord(c) for c in word]
    return out


def ratio(a: str, b: str) -> float:
    """Indel similarity of two short strings."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    return 200.0 * float(_lcs_many(a, _pad([b]))[0]) / (len(a) + len(b))


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points in order, and for each code point its place among them: by counting, not by sorting."""
    kinds = np.flatnonzero(np.bincount(codes, minlength=1))
    places = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, dtype=np.int64)
    places[kinds] = np.arange(len(kinds))
    return kinds, places[codes]


class WordTable:
    """Words of many texts end to end: code points, and the place and text of each word."""

    def __init__(self, texts: Sequence[str]):
        words = [t.split() for t in texts]
        flat = [w for part in words for w in part]
        self.texts = len(texts)
        self.codes = np.frombuffer(" ".join(flat).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        # letters by number, so that a keyword looks up each kind of letter once
        self.kinds, self.letters = _numbered(self.codes)
        self.known_runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        # words hold no blank themselves
        self.ends = np.append(np.flatnonzero(self.codes == 32), len(self.codes))[: len(flat)]
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(flat)]
        self.counts = np.array([len(part) for part in words], dtype=np.int64)
        self.owner = np.repeat(np.arange(self.texts), self.counts)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, text) of each run of `n` words; all words of a text that has fewer."""
        if n not in self.known_runs:
            self.known_runs[n] = self._runs(n)
        return self.known_runs[n]

    def _runs(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin = np.arange(max(len(self.owner) - n + 1, 0))
        begin = begin[self.owner[begin] == self.owner[begin + n - 1]]
        last = begin + n - 1
        few = (self.counts > 0) & (self.counts < n)
        heads = (np.cumsum(self.counts) - self.counts)[few]
        begin = np.concatenate((begin, heads))
        last = np.concatenate((last, heads + self.counts[few] - 1))
        start = self.starts[begin]
        return start, self.ends[last] - start, self.owner[begin]


def best_window_ratios(keyword: str, table: WordTable, at_least: float) -> np.ndarray:
    """Per text, the best ratio of a keyword with runs of as many words; 0 below `at_least`."""
    best = np.zeros(table.texts)
    start, sizes, owner = table.runs(max(len(keyword.split()), 1))
    # A run whose length differs too much cannot reach the score.
    size = len(keyword)
    reach = (200.0 - at_least) / at_least
    near = np.flatnonzero((sizes >= size / reach) & (sizes <= size * reach))
    # Nor can one with too few of the keyword's letters.
    # Short numbers where they do: these arrays have an entry for each letter of all texts.
    bits = None
    if len(keyword) <= _WORD:
        bits = _letter_bits(keyword, table.kinds).astype(np.uint32 if size <= 32 else np.uint64)[table.letters]
    if bits is not None and len(near):
        shared = np.zeros(len(bits) + 1, dtype=np.int32)
        np.cumsum(bits > 0, dtype=np.int32, out=shared[1:])
        enough = shared[start[near] + sizes[near]] - shared[start[near]] >= at_least * (size + sizes[near]) / 200.0 - 1e-9
        near = near[enough]
    # Nor one with too few of its runs of three letters: a letter gone breaks three, one put in breaks two.
    if bits is not None and len(near) and size >= 3 and len(bits) >= 3:
        one, two = bits.dtype.type(1), bits.dtype.type(2)
        held = np.zeros(len(bits) + 1, dtype=np.int32)
        np.cumsum((bits[:-2] & (bits[1:-1] >> one) & (bits[2:] >> two)) > 0, dtype=np.int32, out=held[1:-2])
        held[-2:] = held[-3]
        own = sizes[near]
        common = np.ceil(at_least * (size + own) / 200.0 - 1e-9).astype(np.int64)
        whole = own - 2 - 3 * (own - common) - 2 * (size - common)
        last = start[near] + np.maximum(own - 2, 0)
        near = near[held[last] - held[start[near]] >= whole]
    start, sizes, owner = start[near], sizes[near], owner[near]
    if len(start):
        scores = 200.0 * _lcs_runs(keyword, table.codes, bits, start, sizes) / (size + sizes)
        np.maximum.at(best, owner, scores)
    return np.where(best >= at_least, best, 0.0)


def _lcs_runs(keyword: str, codes: np.ndarray, bits: np.ndarray | None, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCS length of `keyword` with each stretch of `codes`; `bits` are the keyword's places of each letter."""
    steps = np.arange(sizes.max())
    if bits is None:
        padded = np.where(steps < sizes[:, None], codes[np.minimum(start[:, None] + steps, len(codes) - 1)], 0)
        return _lcs_many(keyword, padded)
    # A last entry without any letter stands for places past the end of a run.
    letters = np.append(bits, np.uint64(0))
    full = np.uint64((1 << len(keyword)) - 1)
    state = np.full(len(start), full, dtype=np.uint64)
    for step in steps:
        hit = state & letters[np.where(step < sizes, start + step, len(codes))]
        state = ((state + hit) | (state - hit)) & full
    return np.bitwise_count((~state) & full).astype(np.int64)


def lcs_pairs(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """LCS length of each pair, all pairs of a batch at once: a bit for each letter of the shorter text."""
    short = [a if len(a) <= len(b) else b for a, b in zip(left, right, strict=True)]
    long = [b if len(a) <= len(b) else a for a, b in zip(left, right, strict=True)]
    sizes = np.array([len(s) for s in short], dtype=np.int64)
    out = np.zeros(len(short), dtype=np.int64)
    few = np.flatnonzero((sizes > 0) & (sizes <= _WORD))
    for begin in range(0, len(few), 4096):
        rows = few[begin : begin + 4096]
        out[rows] = _lcs_rows(_pad([short[i] for i in rows]), _pad([long[i] for i in rows]), sizes[rows])
    for i in np.flatnonzero(sizes > _WORD):
        out[i] = _lcs_long(short[i], np.array([ord(c) for c in long[i]], dtype=np.int64))
    return out


def _lcs_rows(short: np.ndarray, long: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """LCS length of each row of code points of `short` with the same row of `long` (0 = padding)."""
    places = np.uint64(1) << np.arange(short.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    state = full.copy()
    for column in range(long.shape[1]):
        codes = long[:, column]
        bits = np.where((short == codes[:, None]) & (codes[:, None] > 0), places, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        hit = state & bits
        state = ((state + hit) | (state - hit)) & full
    return np.bitwise_count((~state) & full).astype(np.int64)


def ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Indel similarity of each pair; two empty texts are equal."""
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], dtype=np.float64)
    return np.where(total > 0, 200.0 * lcs_pairs(left, right) / np.maximum(total, 1), 100.0)


def partial_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Best ratio of the shorter text of each pair with a stretch of the longer one that is no longer than it.

    Texts of equal length are tried both ways round. An empty text scores 0 unless both are empty.
    """
    out = np.zeros(len(left))
    owner: list[int] = []
    needles: list[str] = []
    windows: list[str] = []

    def settle() -> None:
        if owner:
            np.maximum.at(out, owner, ratios(needles, windows))
        for held in (owner, needles, windows):
            held.clear()

    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if not a or not b:
            out[i] = 100.0 if a == b else 0.0
            continue
        for needle, text in ((a, b), (b, a)):
            if len(needle) > len(text):
                continue
            if needle in text:
                out[i] = 100.0
                break
            size = len(needle)
            letters = set(needle)
            # a stretch that begins or ends with a letter the needle lacks is never the best one
            stretches = [text[:n] for n in range(1, size) if text[n - 1] in letters]
            stretches += [text[n : n + size] for n in range(len(text) - size) if text[n + size - 1] in letters]
            stretches += [text[n:] for n in range(len(text) - size, len(text)) if text[n] in letters]
            owner.extend([i] * len(stretches))
            needles.extend([needle] * len(stretches))
            windows.extend(stretches)
        if len(owner) > 20_000:
            settle()
    settle()
    return out


#: Fixed values of the weighted score: what scores by words, and by stretches of a text at least 1.5 times or over 8 times as long, count for.
BY_WORDS = 0.95
LONGER, MUCH_LONGER = 1.5, 8.0
BY_STRETCH, BY_SHORT_STRETCH = 0.9, 0.6


def _word_scores(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """The better of two ratios: of all words in order, and of the words that only one side has."""
    words = [(sorted(a.split()), sorted(b.split())) for a, b in pairs]
    only = [(sorted({*a} - {*b}), sorted({*b} - {*a}), {*a} & {*b}) for a, b in words]
    joined = ratios([" ".join(a) for a, _ in words], [" ".join(b) for _, b in words])
    rests = [(" ".join(a), " ".join(b)) for a, b, _ in only]
    shared = lcs_pairs([a for a, _ in rests], [b for _, b in rests])
    out = joined.copy()
    for i, ((a, b), (left, right, both)) in enumerate(zip(words, only, strict=True)):
        if not a or not b:
            continue
        if both and not (left and right):
            out[i] = 100.0
            continue
        own, other = map(len, rests[i])
        common = len(" ".join(both))
        gap = 1 if common else 0
        total = 2 * (common + gap) + own + other
        best = 100.0 - 100.0 * (own + other - 2 * shared[i]) / total
        if common:
            best = max(best, *(100.0 - 100.0 * (gap + n) / (2 * common + gap + n) for n in (own, other)))
        out[i] = max(out[i], best)
    return out


def _word_stretch_scores(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """100 where a word is shared, else the better partial ratio of all words in order and of the distinct ones."""
    words = [(sorted(a.split()), sorted(b.split())) for a, b in pairs]
    joined = [(" ".join(a), " ".join(b)) for a, b in words]
    distinct = [(" ".join(sorted({*a})), " ".join(sorted({*b}))) for a, b in words]
    out = np.maximum(
        partial_ratios([a for a, _ in joined], [b for _, b in joined]),
        partial_ratios([a for a, _ in distinct], [b for _, b in distinct]),
    )
    return np.where([bool({*a} & {*b}) for a, b in words], 100.0, out)


def weighted_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The weighted composite of each pair.

    Texts of about one length score by their ratio and, for a little less, by their words; where one is at least 1.5
    times as long, by the best stretch and, for less again, by the best stretch of words. Empty texts score 0.
    """
    out = np.zeros(len(left))
    whole = [i for i, (a, b) in enumerate(zip(left, right, strict=True)) if a and b]
    if not whole:
        return out
    a, b = [left[i] for i in whole], [right[i] for i in whole]
    score = ratios(a, b)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], dtype=np.float64)
    times = sizes.max(axis=1) / sizes.min(axis=1)
    worded = np.array([x.split() != [x] or y.split() != [y] for x, y in zip(a, b, strict=True)])
    scale = np.where(times <= MUCH_LONGER, BY_STRETCH, BY_SHORT_STRETCH)

    def raise_to(rows: np.ndarray, scores: Callable, factor: np.ndarray | float) -> None:
        if len(rows):
            score[rows] = np.maximum(score[rows], scores(rows) * factor)

    # texts of one word each score by words just as they do as a whole
    near, far = np.flatnonzero((times < LONGER) & worded), np.flatnonzero(times >= LONGER)
    raise_to(near, lambda rows: _word_scores([(a[i], b[i]) for i in rows]), BY_WORDS)
    raise_to(far, lambda rows: partial_ratios([a[i] for i in rows], [b[i] for i in rows]), scale[far])
    far = far[worded[far]]
    raise_to(far, lambda rows: _word_stretch_scores([(a[i], b[i]) for i in rows]), BY_WORDS * scale[far])
    out[whole] = score
    return out


def _batched(scores: Callable[[Sequence[str], Sequence[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    def column(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def score(left: pd.Series, right: pd.Series) -> pd.Series:
            held = (left.notna() & right.notna()).to_numpy()
            out = np.full(len(left), np.nan)
            out[held] = scores(left[held].tolist(), right[held].tolist())
            return pd.Series(out).astype("Float64").mask(~held)

        return score(a, b)

    return column


#: Indel similarity of two columns.
indel_ratio = _batched(ratios)
#: Weighted composite score of two columns.
weighted_ratio = _batched(weighted_ratios)


def keyword_partials(keyword: str, texts: Sequence[str]) -> np.ndarray:
    """Best ratio of a keyword with a stretch of each text, all texts at once; a shorter text is sought in the keyword."""
    out = np.zeros(len(texts))
    size = len(keyword)
    short = [i for i, t in enumerate(texts) if len(t) <= size or size > _WORD]
    out[short] = partial_ratios([keyword] * len(short), [texts[i] for i in short])
    rest = [i for i, t in enumerate(texts) if size < len(t) and size <= _WORD]
    if not rest or not size:
        return out
    # every text with as many blanks around it as let a stretch hang over either end
    lengths = np.array([len(texts[i]) for i in rest], dtype=np.int64)
    blank = "\0" * (size - 1)
    joined = blank + blank.join(texts[i] for i in rest) + blank
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    kinds, letters = _numbered(codes)
    known = _letter_bits(keyword, kinds)
    known[kinds == 0] = 0
    bits = known[letters]
    full = np.uint64((1 << size) - 1)
    begins = len(codes) - size + 1
    best = np.zeros(begins)
    for begin in range(0, begins, 1 << 18):
        end = min(begin + (1 << 18), begins)
        state = np.full(end - begin, full, dtype=np.uint64)
        for step in range(size):
            hit = state & bits[begin + step : end + step]
            state = ((state + hit) | (state - hit)) & full
        best[begin:end] = np.bitwise_count((~state) & full)
    starts = np.cumsum(lengths + size - 1) - lengths
    # a stretch that begins at place p of a text ends within it, or is cut off at either end
    place = np.concatenate([np.arange(1 - size, n) for n in lengths])
    owner = np.repeat(np.arange(len(rest)), lengths + size - 1)
    letters_in = np.minimum(place + size, lengths[owner]) - np.maximum(place, 0)
    scores = 200.0 * best[starts[owner] + place] / (size + letters_in)
    found = np.zeros(len(rest))
    np.maximum.at(found, owner, scores)
    out[rest] = found
    return out


def partial_ratio_text(keyword: str, text: str) -> float:
    """Best ratio of a keyword with any stretch of the text no longer than it."""
    return float(keyword_partials(keyword, [text])[0]) if keyword and text else 0.0


def partial_ratio(text: Column, keywords: Sequence[str]) -> Column:
    """Best partial score of a text against a fixed short list of keywords."""
    words = [k for k in keywords if k]

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        kinds = [t for t in texts.dropna().unique()]
        best = np.zeros(len(kinds))
        for word in words:
            best = np.maximum(best, keyword_partials(word, kinds))
        scores = dict(zip(kinds, best.tolist(), strict=True))
        return pd.Series([scores.get(t, 0.0) for t in texts], dtype="float64")

    return score(text)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - edits / longer length), built in."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, b) / longest)).otherwise(100.0)
