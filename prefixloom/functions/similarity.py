"""String similarity by longest common subsequence, as Arrow pandas UDFs.

The subsequence length is computed bit-parallel (Hyyro 2004): one 64-bit word
per string, all rows of an Arrow batch at once. Patterns over 64 characters use
Python integers instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WHITESPACE, col, tokenize

_WORD = 64
_CHUNK = 4096


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a zero-padded matrix (shifted by one), and the lengths."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    out = np.zeros((len(texts), max(int(lens.max(initial=0)), 1)), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out[np.arange(out.shape[1])[None, :] < lens[:, None]] = flat + 1
    return out, lens


def _match_masks(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bit i of cell (row, j) says pattern[row, i] equals text[row, j]."""
    masks = np.zeros(text.shape, dtype=np.uint64)
    for i in range(pattern.shape[1]):
        p = pattern[:, i : i + 1]
        masks |= ((text == p) & (p != 0)).astype(np.uint64) << np.uint64(i)
    return masks


def _full(lens: np.ndarray) -> np.ndarray:
    word = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.where(lens > 0, word >> np.clip(_WORD - lens, 0, 63).astype(np.uint64), np.uint64(0))


def _step(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    used = state & mask
    return (state + used) | (state - used)


def _matched(state: np.ndarray, full: np.ndarray) -> np.ndarray:
    return np.bitwise_count(full & ~state).astype(np.int64)


def _lcs_big(a: str, b: str) -> int:
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    state = full
    for ch in b:
        used = state & where.get(ch, 0)
        state = ((state + used) | (state - used)) & full
    return (full & ~state).bit_count()


def _ratio_big(a: str, b: str) -> float:
    return 2.0 * _lcs_big(a, b) / (len(a) + len(b)) if a or b else 1.0


def ratio_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """2*LCS/(len a + len b) per pair; two empty strings give 1."""
    out = np.ones(len(left))
    small, big = [], []
    for i, (a, b) in enumerate(zip(left, right)):
        (small if min(len(a), len(b)) <= _WORD else big).append(i)
    for i in big:
        out[i] = _ratio_big(left[i], right[i])
    # rows of similar length share a chunk, so padding to the longest stays small
    small.sort(key=lambda i: len(left[i]) + len(right[i]))
    for at in range(0, len(small), _CHUNK):
        rows = small[at : at + _CHUNK]
        pairs = [sorted((left[i], right[i]), key=len) for i in rows]
        pat, pl = _codes([p[0] for p in pairs])
        txt, tl = _codes([p[1] for p in pairs])
        masks, full = _match_masks(pat, txt), _full(pl)
        state = full.copy()
        for j in range(txt.shape[1]):
            state = _step(state, masks[:, j])
        total = pl + tl
        hit = 2.0 * _matched(state, full) / np.maximum(total, 1)
        out[rows] = np.where(total > 0, hit, 1.0)
    return out


def _end_windows(masks: np.ndarray, m: int, best: np.ndarray) -> None:
    """Windows shorter than the pattern at the start of each row."""
    full = _full(np.array([m]))
    state = np.repeat(full, masks.shape[0])
    for size in range(1, min(m, masks.shape[1] + 1)):
        state = _step(state, masks[:, size - 1])
        np.maximum(best, 2.0 * _matched(state, full) / (m + size), out=best)


def _mirror(masks: np.ndarray, lens: np.ndarray, m: int) -> np.ndarray:
    """Reverse each row within its length and the bits within the pattern."""
    at = lens[:, None] - 1 - np.arange(min(m, masks.shape[1]))[None, :]
    flipped = np.take_along_axis(masks, np.maximum(at, 0), axis=1)
    flipped[at < 0] = 0
    out = np.zeros_like(flipped)
    for i in range(m):
        out |= ((flipped >> np.uint64(i)) & np.uint64(1)) << np.uint64(m - 1 - i)
    return out


def best_window(masks: np.ndarray, lens: np.ndarray, m: int) -> np.ndarray:
    """Best ratio of an m-character pattern against any window of each row.

    ``masks`` are the match masks of the rows (all at least m long).
    """
    best = np.zeros(masks.shape[0])
    full = _full(np.array([m]))
    n_win = masks.shape[1] - m + 1
    state = np.full((masks.shape[0], n_win), full[0], dtype=np.uint64)
    for s in range(m):
        state = _step(state, masks[:, s : s + n_win])
    score = _matched(state, full) / m
    score[np.arange(n_win)[None, :] > (lens - m)[:, None]] = 0.0
    np.maximum(best, score.max(axis=1), out=best)
    _end_windows(masks, m, best)
    _end_windows(_mirror(masks, lens, m), m, best)
    return best


def _partial_big(a: str, b: str) -> float:
    m, n = len(a), len(b)
    windows = {b[:i] for i in range(1, m)} | {b[i : i + m] for i in range(n)}
    return max(_ratio_big(a, w) for w in windows)


def partial_ratio_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """Best ratio of the shorter string against the windows of the longer one."""
    out = np.zeros(len(left))
    by_len: dict[int, list[tuple[int, str, str]]] = {}
    for i, (a, b) in enumerate(zip(left, right)):
        if not a or not b:
            out[i] = 1.0 if a == b else 0.0
            continue
        short, long_ = (a, b) if len(a) <= len(b) else (b, a)
        both = [(short, long_)] + ([(long_, short)] if len(a) == len(b) else [])
        for p, t in both:
            if len(p) > _WORD:
                out[i] = max(out[i], _partial_big(p, t))
            else:
                by_len.setdefault(len(p), []).append((i, p, t))
    for m, rows in by_len.items():
        rows.sort(key=lambda r: len(r[2]))
        for at in range(0, len(rows), _CHUNK):
            part = rows[at : at + _CHUNK]
            pat, _ = _codes([r[1] for r in part])
            txt, tl = _codes([r[2] for r in part])
            np.maximum.at(out, [r[0] for r in part], best_window(_match_masks(pat, txt), tl, m))
    return out


class TextBlock:
    """A bounded list of texts, encoded once, scored against many patterns."""

    def __init__(self, texts: list[str]):
        self.texts = np.array(texts, dtype=object)
        self.codes, self.lens = _codes(texts)
        self.alphabet, inverse = np.unique(self.codes, return_inverse=True)
        self.codes = inverse.reshape(self.codes.shape)

    def partial_ratio(self, pattern: str, some: np.ndarray | None = None) -> np.ndarray:
        """The partial ratios of all texts, or of some rows."""
        m = len(pattern)
        some = np.arange(len(self.texts)) if some is None else some
        out = np.zeros(len(self.texts))
        longer = some[self.lens[some] > m] if 0 < m <= _WORD else np.array([], dtype=np.int64)
        lut = np.zeros(len(self.alphabet), dtype=np.uint64)
        for i, ch in enumerate(pattern[:_WORD]):
            lut[self.alphabet == ord(ch) + 1] |= np.uint64(1) << np.uint64(i)
        for at in range(0, len(longer), _CHUNK):
            rows = longer[at : at + _CHUNK]
            width = int(self.lens[rows].max())
            out[rows] = best_window(lut[self.codes[rows, :width]], self.lens[rows], m)
        rest = np.setdiff1d(some, longer)
        if len(rest):
            out[rest] = partial_ratio_pairs([pattern] * len(rest), self.texts[rest].tolist())
        return out[some]

    def window_bound(self, pattern: str, some: np.ndarray) -> np.ndarray:
        """No partial ratio of these rows, all longer than the pattern, is above: characters in common with any one window."""
        m, width = len(pattern), int(self.lens[some].max())
        codes, lens = self.codes[some, :width], self.lens[some]
        inside = np.zeros((len(some), width - m + 1), np.int16)
        first, last = (np.zeros((len(some), m), np.int16) for _ in range(2))  # of the first and last 0 .. m - 1 characters
        tail = lens[:, None] - np.arange(m)[None, :]
        for ch in set(pattern):
            at = np.searchsorted(self.alphabet, ord(ch) + 1)
            if at == len(self.alphabet) or self.alphabet[at] != ord(ch) + 1:
                continue
            most = np.int16(pattern.count(ch))
            summed = np.zeros((len(some), width + 1), np.int16)
            np.cumsum(codes == at, axis=1, dtype=np.int16, out=summed[:, 1:])
            inside += np.minimum(summed[:, m:] - summed[:, :width - m + 1], most)
            first += np.minimum(summed[:, :m], most)
            last += np.minimum(summed[np.arange(len(some)), lens][:, None] - np.take_along_axis(summed, tail, axis=1), most)
        inside[np.arange(width - m + 1)[None, :] > (lens - m)[:, None]] = 0
        ends = 2.0 * np.maximum(first, last) / (m + np.arange(m))
        return np.maximum(inside.max(axis=1) / m, ends.max(axis=1))


class BoundedBlock:
    """Texts of one block, searched for the best partial ratios with bounds from above.

    Texts with the same set of characters (the rarest share one place) are a class, and a class that has too few of a
    pattern's characters is skipped whole. Of the others, the counts of characters in common bound each text:
    with c in common and the shorter one s long, no window gives more than 2 c / (s + c). Texts are looked at by
    this bound, a batch at a time; windows bound them again, and what can still be among the best is compared.
    """

    PLACES = 64
    FIRST, BATCH = 64, 256

    def __init__(self, texts: list[str], parts: list[TextBlock]):
        """``parts`` hold the texts, each those of about one length."""
        spots = {t: (i, j) for i, part in enumerate(parts) for j, t in enumerate(part.texts.tolist())}
        self.texts = np.array(sorted(texts), dtype=object)
        self.parts = parts
        where = np.array([spots[t] for t in self.texts], np.int64).reshape(-1, 2)
        self.part, self.row = where[:, 0], where[:, 1]
        self.lens = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        flat = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(self.texts)), self.lens)
        found, inverse, often = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.empty(len(found), np.int64)
        place[np.argsort(-often, kind="stable")] = np.minimum(np.arange(len(found)), self.PLACES - 1)
        self.place = dict(zip(map(chr, found.tolist()), place.tolist()))
        counts = np.bincount(owner * self.PLACES + place[inverse], minlength=len(self.texts) * self.PLACES)
        self.counts = np.minimum(counts, 65_535).astype(np.uint16).reshape(-1, self.PLACES)
        bits = np.left_shift(np.uint64(1), np.arange(self.PLACES, dtype=np.uint64))
        signature = ((self.counts > 0) * bits).sum(axis=1, dtype=np.uint64)
        self.signatures, group = np.unique(signature, return_inverse=True)
        self.members = np.argsort(group, kind="stable")
        self.edges = np.searchsorted(group[self.members], np.arange(len(self.signatures) + 1))
        self.shortest = np.full(len(self.signatures), np.iinfo(np.int64).max)
        np.minimum.at(self.shortest, group, self.lens)

    def best(self, pattern: str, limit: int, threshold: float) -> tuple[list[tuple[float, str]], int]:
        """The ``limit`` best (score, text) of at least the threshold, by score and text, and how many texts were compared."""
        wanted: dict[int, int] = {}
        for ch in pattern:
            if ch in self.place:
                wanted[self.place[ch]] = wanted.get(self.place[ch], 0) + 1
        m, slack = len(pattern), 1e-6
        at, most = np.array(list(wanted), np.int64), np.array(list(wanted.values()), np.int64)
        if not len(at):
            return [], 0

        def bound(common: np.ndarray, lens: np.ndarray) -> np.ndarray:
            return 200.0 * common / np.maximum(np.minimum(m, lens) + common, 1)

        has = (self.signatures[:, None] >> at.astype(np.uint64)[None, :]) & np.uint64(1)
        classes = np.flatnonzero(bound(has.astype(np.int64) @ most, self.shortest) + slack >= threshold)
        rows = np.concatenate([self.members[self.edges[c]:self.edges[c + 1]] for c in classes] or [np.zeros(0, np.int64)])
        top = bound(np.minimum(self.counts[rows][:, at], most[None, :]).sum(axis=1, dtype=np.int64), self.lens[rows])
        order = np.lexsort((rows, -top))
        order = order[top[order] + slack >= threshold]
        rows, top = rows[order], top[order]
        kept_score, kept_row, compared, first = np.zeros(0), np.zeros(0, np.int64), 0, 0
        floor, last = threshold, len(self.texts)
        while first < len(rows):
            stop = first + (self.FIRST if not first else self.BATCH)
            part, upper = rows[first:stop], top[first:stop]
            open_ = (upper > floor + slack) | ((upper >= floor - slack) & (part <= last))
            if upper[0] < floor - slack:
                break
            part, first = part[open_], stop
            longer = (self.lens[part] > m) & (m <= _WORD)
            for i in np.unique(self.part[part[longer]]):
                mine = np.flatnonzero(longer & (self.part[part] == i))
                near = 100.0 * self.parts[i].window_bound(pattern, self.row[part[mine]])
                longer[mine[(near > floor + slack) | ((near >= floor - slack) & (part[mine] <= last))]] = False
            part = part[~longer]
            compared += len(part)
            score = np.zeros(len(part))
            for i in np.unique(self.part[part]):
                mine = self.part[part] == i
                score[mine] = np.round(100.0 * self.parts[i].partial_ratio(pattern, self.row[part[mine]]), 6)
            hit = score >= threshold
            kept_score, kept_row = np.concatenate([kept_score, score[hit]]), np.concatenate([kept_row, part[hit]])
            order = np.lexsort((kept_row, -kept_score))[:limit]
            kept_score, kept_row = kept_score[order], kept_row[order]
            if len(kept_row) == limit:
                floor, last = kept_score[-1], kept_row[-1]
        return list(zip(kept_score.tolist(), self.texts[kept_row].tolist())), compared


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratio_pairs(a.fillna("").tolist(), b.fillna("").tolist()))


@F.pandas_udf(T.DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(partial_ratio_pairs(a.fillna("").tolist(), b.fillna("").tolist()))


def ratio(a: Column | str, b: Column | str) -> Column:
    return ratio_udf(col(a), col(b))


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    return partial_ratio_udf(col(a), col(b))


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    """Ratio of the blank-separated tokens in sorted order."""
    return ratio_udf(*[F.array_join(F.sort_array(tokenize(c)), " ") for c in (a, b)])


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = ([" ".join(sorted(filter(None, t.split(" ")))) for t in c.fillna("")] for c in (a, b))
    return pd.Series(ratio_pairs(left, right))


def register(spark: SparkSession) -> None:
    """Make the similarity functions and normalisers callable from SQL text."""
    spark.udf.register("ratio", ratio_udf)
    spark.udf.register("partial_ratio", partial_ratio_udf)
    spark.udf.register("token_sort_ratio", token_sort_ratio_udf)
    low = "lower(coalesce(t, ''))"
    for name, pattern in (("normalize_strict", "[^a-z0-9]+"), ("normalize_loose", WHITESPACE)):
        body = f"trim(regexp_replace({low}, r'{pattern}', ' '))"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
