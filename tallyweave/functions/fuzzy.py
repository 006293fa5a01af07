"""String similarities without a built-in function, from their published definitions, as Arrow UDFs.

Each UDF takes pairs in batches and works out each distinct pair once. Common subsequences of many pairs are found together, a
bit for each character (H. Hyyro, "Bit-parallel LCS-length computation revisited", 2004). So are those of the windows that a
partial ratio slides over, of which only those are tried that can beat the best so far; where windows are too many they are
compared all at once by combing strands (A. Tiskin, "Semi-local string comparison", 2008). Texts of more than LONG characters
are taken pair by pair, with a whole number for the bits of a text. The scalar functions state what is computed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of `a`."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|), 1 for two empty strings."""
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, as long as it or cut at an end."""
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    best = _slide(short, long)
    return max(best, _slide(long, short)) if len(a) == len(b) and best < 1 else best


def _slide(short: str, long: str) -> float:
    n, own, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        low, high = max(0, end - n), min(end, len(long))
        # a window that neither begins nor ends with a shared character is matched by a smaller one
        if (long[high - 1] in own if end <= len(long) else long[low] in own) and (r := ratio(short, long[low:high])) > best:
            best = r
            if best == 1:
                break
    return best


def _joined(words) -> str:
    return " ".join(sorted(words))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_joined(a.split()), _joined(b.split()))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: the common words with either side's words, and both sides' words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_a, only_b = x & y, _joined(x - y), _joined(y - x)
    if common and not (only_a and only_b):
        return 1.0
    base = len(_joined(common))
    gap = int(base > 0)
    with_a, with_b = base + gap + len(only_a), base + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * lcs(only_a, only_b)
    best = 1 - apart / (with_a + with_b)
    if not common:
        return best
    return max(best, 1 - (gap + len(only_a)) / (base + with_a), 1 - (gap + len(only_b)) / (base + with_b))


def token_ratio(a: str, b: str) -> float:
    return max(token_sort_ratio(a, b), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    whole = partial_ratio(_joined(a.split()), _joined(b.split()))
    return max(whole, partial_ratio(_joined(x - y), _joined(y - x)) if x and y else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    """Whole, token and partial ratios, weighted by how much longer one string is."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity; beyond 0.7 with a tenth of the rest for each of up to four equal first characters."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken = [False] * len(b)
    in_a: list[str] = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                in_a.append(c)
                break
    if not in_a:
        return 0.0
    in_b = [c for c, t in zip(b, taken, strict=True) if t]
    m, moved = len(in_a), sum(x != y for x, y in zip(in_a, in_b, strict=True)) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if score <= 0.7:
        return score
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def jaro_winkler_by_places(a: str, b: str) -> float:
    """`jaro_winkler` in a step for each character: of equal characters of `b` those are taken first that are first, and none
    that a window has left behind comes into a later one."""
    if not a or not b or a == b:
        return float(bool(a) and a == b)
    reach = max(len(a), len(b)) // 2 - 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    in_a, taken = [], []
    for i, c in enumerate(a):
        own = places.get(c)
        if own:
            while own and own[-1] < i - reach:
                own.pop()
            if own and own[-1] <= i + reach:
                in_a.append(c)
                taken.append(own.pop())
    if not in_a:
        return 0.0
    m, moved = len(in_a), sum(x != b[j] for x, j in zip(in_a, sorted(taken), strict=True)) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if score <= 0.7:
        return score
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


def _masks(text: str) -> dict[str, int]:
    """The places of each character as bits."""
    places: dict[str, bytearray] = {}
    for i, c in enumerate(text):
        if c not in places:
            places[c] = bytearray(len(text) // 8 + 1)
        places[c][i >> 3] |= 1 << (i & 7)
    return {c: int.from_bytes(p, "little") for c, p in places.items()}


def _untrimmed(a: str, b: str) -> tuple[str, str, int]:
    """Both texts without what both begin and end with, and its length."""
    cut = 0
    for end in (False, True):
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if (a[len(a) - mid :] == b[len(b) - mid :]) if end else (a[:mid] == b[:mid]):
                low = mid
            else:
                high = mid - 1
        a, b, cut = (a[: len(a) - low], b[: len(b) - low], cut + low) if end else (a[low:], b[low:], cut + low)
    return a, b, cut


def long_lcs(a: str, b: str) -> int:
    """`lcs` for long texts: what both begin and end with is common, and the longer one's characters are the bits."""
    a, b, cut = _untrimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return cut
    masks, every = _masks(a), (1 << len(a)) - 1
    row = every
    for c in b:
        hit = masks.get(c)
        if hit is not None:
            hit &= row
            row = (row + hit | row ^ hit) & every
    return cut + len(a) - row.bit_count()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein's distance, a bit for each character of the longer text (H. Hyyro, "A bit-vector algorithm for computing
    Levenshtein and Damerau edit distances", 2003)."""
    a, b, _ = _untrimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    masks, every = _masks(a), (1 << len(a)) - 1
    up, down = every, 0
    for c in b:
        own = masks.get(c, 0)
        same = ((own & up) + up ^ up | own | down) & every
        right, left = (down | every ^ (same | up)) << 1 | 1, (same & up) << 1
        up, down = (left | every ^ (same | right) & every) & every, right & same
    return len(b) + up.bit_count() - down.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return lcs(a, b) / max(len(a), len(b)) if a and b else 0.0


#: Cells of the tables that are combed at once; words of bits of the pairs whose subsequences are found at once.
AT_ONCE, BITS_AT_ONCE = 1 << 18, 1 << 13
#: Characters of a text that is compared by itself; cells of a table of characters; from how many cells on Python finds an edit distance.
LONG, CELLS_AT_ONCE, CELLS_OF_EDITS = 1024, 1 << 20, 1 << 16


class Texts:
    """Distinct texts as numbers of characters, one after the other; the number 0 is of no character."""

    def __init__(self, texts: list[str]):
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        kinds, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32), return_inverse=True)
        self.codes = np.concatenate([codes.astype(np.int32) + 1, np.zeros(1, np.int32)])
        self.start = np.cumsum(self.length) - self.length
        self.kinds = len(kinds) + 1

    def cut(self, low: np.ndarray, size: np.ndarray, backwards: bool = False) -> np.ndarray:
        """The characters from the places `low` on, a column for each piece; beyond its size 0."""
        step = np.arange(size.max(initial=0))[:, None]
        place = low + (size - 1 - step if backwards else step)
        return self.codes[np.where(step < size, place, len(self.codes) - 1)]

    def masks(self, of: np.ndarray, words: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """For each word of bits the places of every character in the texts `of`, each text once; where each text's begin."""
        own, row = np.unique(of, return_inverse=True)
        out = np.zeros((words, len(own) * self.kinds), np.uint64)
        codes, begin = self.cut(self.start[own], self.length[own], backwards), np.arange(len(own)) * self.kinds
        for i, column in enumerate(codes):
            out[i // 64, begin + column] |= np.uint64(1 << i % 64)
        out[:, begin] = 0
        return out, row * self.kinds


def _common(masks: np.ndarray, begin: np.ndarray, columns: np.ndarray, each: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of masked texts with columns of characters; `each` gets them after every row."""
    words, n = len(masks), len(begin)
    rows = np.full((words, n), ~np.uint64(0))
    free = lambda: 64 * words - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
    for k, column in enumerate(columns):
        place, carry = begin + column, None
        for w in range(words):
            row = rows[w]
            hit = row & masks[w].take(place)
            total = row + hit
            if w + 1 < words or carry is not None:
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            rows[w] = total | row ^ hit
        if each is not None:
            each(k, free())
    return free()


def _in_parts(texts: Texts, masked: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Pairs of texts of like lengths, so many that their bits are few."""
    size, long = texts.length[masked], texts.length[other]
    order, parts, low = np.lexsort((long, size)), [], 0
    while low < len(order):
        words = -(-int(size[order[low]]) // 64) or 1
        end = int(np.searchsorted(size[order], 64 * words, "right"))
        high = min(end, low + max(1, BITS_AT_ONCE // words))
        while high - low > 1 and (high - low) * int(long[order[low:high]].max()) > CELLS_AT_ONCE:
            high -= (high - low) // 2
        parts.append(order[low:high])
        low = high
    return parts


def _lcs_of(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`lcs` of pairs of texts, by their numbers."""
    out = np.zeros(len(a), np.int64)
    for part in _in_parts(texts, a, b):
        x, y = a[part], b[part]
        if texts.length[x].max() and texts.length[y].max():
            out[part] = _common(*texts.masks(x, -(-int(texts.length[x].max()) // 64)), texts.cut(texts.start[y], texts.length[y]))
    return out


def _numbered(*columns: list[str]) -> tuple[Texts, list[np.ndarray]]:
    """Texts by number and the numbers of each column's."""
    number: dict[str, int] = {}
    rows = [np.fromiter((number.setdefault(t, len(number)) for t in c), np.int64, len(c)) for c in columns]
    return Texts(list(number)), rows


def lcs_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """`lcs` of each pair."""
    long = np.maximum(_lengths(a), _lengths(b)) > LONG
    few = np.flatnonzero(~long).tolist()
    texts, (x, y) = _numbered([a[k] for k in few], [b[k] for k in few])
    out = np.zeros(len(a), np.int64)
    out[few] = _lcs_of(texts, x, y)
    for k in np.flatnonzero(long).tolist():
        out[k] = long_lcs(a[k], b[k])
    return out


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _ratio_of(common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    return _ratio_of(lcs_of_pairs(a, b), _lengths(a) + _lengths(b))


def _best_windows(texts: Texts, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """`_slide` of pairs of texts. Its test of a window's ends saves work and changes no result.

    Windows cut at an end are the steps of one comparison from that end. Of neighbours the common subsequences differ by 1 at
    most, so that after a window the next one tried is the first that can beat the best.
    """
    m, n = texts.length[short], texts.length[long]
    words = -(-int(m.max()) // 64)
    best, whole = np.zeros(len(m)), np.zeros((2, len(m)), np.int64)
    masks = {False: texts.masks(short, words), True: texts.masks(short, words, True)}
    for backwards in (False, True):

        def each(k: int, found: np.ndarray, side: int = int(backwards)) -> None:
            inside = k < m
            np.maximum(best, np.where(inside, 2 * found / (m + k + 1), 0.0), out=best)
            whole[side] = np.where(inside, found, whole[side])

        low = texts.start[long]
        _common(*masks[backwards], texts.cut(low + n - m if backwards else low, m, backwards), each)
    at, last, found = np.zeros_like(m), n - m, whole[0]
    live = np.arange(len(m))
    bits, begin = masks[False]
    while len(live):
        beat = np.floor(best[live] * m[live] + 1e-9).astype(np.int64) + 1
        at[live] += np.maximum(1, beat - found[live])
        live = live[at[live] <= last[live] - np.maximum(1, beat - whole[1][live])]
        if len(live):
            found[live] = _common(bits, begin[live], texts.cut(texts.start[long[live]] + at[live], m[live]))
            best[live] = np.maximum(best[live], 2 * found[live] / (2 * m[live]))
    return best


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out.astype(np.int16) if out.max(initial=0) < 1 << 15 else out


def _combed(short: list[str], long: list[str]) -> tuple[np.ndarray, int]:
    """For each pair and each character of `long` the strand that ends below it, numbered so that those from `base` on began
    above a character; a window's characters that are in no common subsequence are the strands that begin and end in it.

    Strands come in from the left, the lowest row's first, and from above. Two that meet cross unless they have crossed
    before, but at equal characters they always turn. Cells on a diagonal don't depend on each other.
    """
    m, n = max(map(len, short)), max(map(len, long))
    a, b = _codes(short, m, -1), _codes(long, n, -2)[:, ::-1].copy()
    kind = np.int16 if m + n < 1 << 15 else np.int32
    across = np.tile(np.arange(m - 1, -1, -1, dtype=kind), (len(short), 1))
    down = np.tile(np.arange(m + n - 1, m - 1, -1, dtype=kind), (len(short), 1))  # from the last character to the first, as `b`
    for d in range(m + n - 1):
        low, high = max(0, d - n + 1), min(m - 1, d)
        rows, columns = slice(low, high + 1), slice(n - 1 - d + low, n - d + high)
        x, y = across[:, rows], down[:, columns]
        crossed = np.minimum(x, y)
        np.copyto(crossed, y, where=a[:, rows] == b[:, columns])
        y += x  # sums may wrap, and their differences wrap back
        y -= crossed
        x[:] = crossed
    return down[:, ::-1], m


def _best_window(short: str, long: str, strands: np.ndarray) -> float:
    """As `_slide`, from the strands that end below the longer string; those that began above it are numbered from 0."""
    m, n = len(short), len(long)
    own = set(short)
    shared = np.fromiter((c in own for c in long), bool, n)
    # from a window to the next one the strand of the first character, which ended there or further on, goes, and one comes
    ends, begun = np.full(n, n), np.flatnonzero(strands >= 0)
    ends[strands[begun]] = begun
    at = np.arange(n - m)
    steps = (strands[m:] > at).astype(np.int64) - (ends[: n - m] < at + m)
    whole = m - (np.count_nonzero(strands[:m] >= 0) + np.concatenate([[0], np.cumsum(steps)]))
    best = (whole / m)[shared[m - 1 :]].max(initial=0.0)
    if m > 1:
        ends = np.arange(1, m)
        first = ends - np.cumsum(strands >= 0)[: m - 1]
        best = max(best, (2 * first / (m + ends))[shared[: m - 1]].max(initial=0.0))
        starts = np.arange(n - m + 1, n)
        order = np.sort(strands)
        last = n - starts - (n - np.searchsorted(order, starts))
        best = max(best, (2 * last / (m + n - starts))[shared[n - m + 1 :]].max(initial=0.0))
    return float(best)


def _combed_best(work: list[tuple[int, str, str]]) -> list[tuple[int, float]]:
    """`_slide` of each (number, shorter, longer), by combing."""
    out, low = [], 0
    work.sort(key=lambda w: (len(w[1]), len(w[2])))
    while low < len(work):
        high, widest = low, 0
        while high < len(work) and (high - low + 1) * (len(work[high][1]) + max(widest, len(work[high][2]))) <= max(AT_ONCE, len(work[low][1]) + len(work[low][2])):
            widest = max(widest, len(work[high][2]))
            high += 1
        part = work[low:high]
        ends, base = _combed([w[1] for w in part], [w[2] for w in part])
        out += [(k, _best_window(short, long, strands[: len(long)] - base)) for (k, short, long), strands in zip(part, ends, strict=True)]
        low = high
    return out


def partial_ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """`partial_ratio` of each pair."""
    out = [0.0] * len(pairs)
    few: list[tuple[int, str, str]] = []
    many: list[tuple[int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        m, n = len(short), len(long)
        if not m:
            out[k] = float(a == b)
        elif short in long:
            out[k] = 1.0
        else:
            work = few if n <= LONG and (n - m + 1) * -(-m // 64) <= 2 * n else many  # by the words of bits of all windows, and the cells
            work.append((k, short, long))
            if m == n:
                work.append((k, long, short))
    texts, (short, long) = _numbered([w[1] for w in few], [w[2] for w in few])
    best = np.zeros(len(few))
    for part in _in_parts(texts, short, long):
        best[part] = _best_windows(texts, short[part], long[part])
    for k, value in [*zip((w[0] for w in few), best.tolist(), strict=True), *_combed_best(many)]:
        out[k] = max(out[k], value)
    return out


class Scores:
    """All scores of pairs; what several scores need is worked out once, and only when it is asked for."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs, self.a, self.b = pairs, [a for a, _ in pairs], [b for _, b in pairs]
        self.len_a, self.len_b = _lengths(self.a), _lengths(self.b)
        self.filled = (self.len_a > 0) & (self.len_b > 0)

    @functools.cached_property
    def common(self) -> np.ndarray:
        return lcs_of_pairs(self.a, self.b)

    @functools.cached_property
    def ratio(self) -> np.ndarray:
        return _ratio_of(self.common, self.len_a + self.len_b)

    @functools.cached_property
    def lcs_ratio(self) -> np.ndarray:
        return np.where(self.filled, self.common / np.maximum(np.maximum(self.len_a, self.len_b), 1), 0.0)

    @functools.cached_property
    def jw(self) -> list[float]:
        return [jaro_winkler_by_places(*p) for p in self.pairs]

    @functools.cached_property
    def edits(self) -> list[float]:
        """Edit distances of long texts; those of shorter ones, for which this is not a number, the JVM finds faster."""
        return [float(edit_distance(a, b)) if len(a) * len(b) >= CELLS_OF_EDITS else np.nan for a, b in self.pairs]

    @functools.cached_property
    def partial_ratio(self) -> np.ndarray:
        return np.array(partial_ratios(self.pairs), np.float64)

    @functools.cached_property
    def words(self) -> dict[str, tuple[str, list[str], set[str]]]:
        """Of each text its sorted words as a text, the distinct ones in order and as a set."""
        out, known = {}, {}
        for t in {*self.a, *self.b}:
            every = sorted(known.setdefault(w, w) for w in t.split())
            own = set(every)
            out[t] = " ".join(every), sorted(own), own
        return out

    @functools.cached_property
    def token_sort(self) -> np.ndarray:
        return _ratios([self.words[a][0] for a in self.a], [self.words[b][0] for b in self.b])

    @functools.cached_property
    def apart(self) -> tuple[list[str], list[str], np.ndarray]:
        """The words of either side alone, and the length of the common ones as a text."""
        only_a, only_b, base = [], [], []
        for a, b in self.pairs:
            (_, x, own_x), (_, y, own_y) = self.words[a], self.words[b]
            shared = own_x & own_y
            only_a.append(" ".join([w for w in x if w not in shared]))
            only_b.append(" ".join([w for w in y if w not in shared]))
            base.append(sum(map(len, shared)) + len(shared) - 1 if shared else 0)
        return only_a, only_b, np.array(base, np.int64)

    @functools.cached_property
    def token_set(self) -> np.ndarray:
        only_a, only_b, base = self.apart
        a, b = _lengths(only_a), _lengths(only_b)
        gap = (base > 0).astype(np.int64)
        with_a, with_b = base + gap + a, base + gap + b
        least = lambda part, whole: 1 - part / np.maximum(whole, 1)
        best = least(a + b - 2 * lcs_of_pairs(only_a, only_b), with_a + with_b)
        met = np.maximum(best, np.maximum(least(gap + a, base + with_a), least(gap + b, base + with_b)))
        worded = (base + a > 0) & (base + b > 0)
        return np.where(worded, np.where(base > 0, np.where((a > 0) & (b > 0), met, 1.0), best), 0.0)

    @functools.cached_property
    def WRatio(self) -> np.ndarray:
        low, high = np.minimum(self.len_a, self.len_b), np.maximum(self.len_a, self.len_b)
        longer = high / np.maximum(low, 1)
        scale = np.where(longer <= 8, 0.9, 0.6)
        out = np.maximum(self.ratio, 0.95 * np.maximum(self.token_sort, self.token_set))
        far = np.flatnonzero(self.filled & (longer >= 1.5))
        if len(far):
            only_a, only_b, base = self.apart
            partial = self.partial_ratio[far] if "partial_ratio" in vars(self) else np.array(partial_ratios([self.pairs[k] for k in far]))
            by_words = np.ones(len(far))
            strange = np.flatnonzero(base[far] == 0)
            wanted = [(self.words[self.a[k]][0], self.words[self.b[k]][0]) for k in far[strange]] + [(only_a[k], only_b[k]) for k in far[strange]]
            if wanted:
                found = np.array(partial_ratios(wanted)).reshape(2, -1)
                worded = np.fromiter((bool(only_a[k] and only_b[k]) for k in far[strange]), bool, len(strange))
                by_words[strange] = np.maximum(found[0], np.where(worded, found[1], 0.0))
            out[far] = np.maximum(self.ratio[far], np.maximum(scale[far] * partial, 0.95 * scale[far] * by_words))
        return np.where(self.filled, out, 0.0)


def _all_weighted(pairs: list[tuple[str, str]]) -> list[float]:
    """`weighted_ratio` of each pair."""
    return Scores(pairs).WRatio.tolist()


#: Distinct pairs that are scored at once, and their characters.
PAIRS_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 21


def _parts(pairs: list[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    low, chars = 0, 0
    for k, (a, b) in enumerate(pairs):
        chars += len(a) + len(b)
        if k > low and (k - low == PAIRS_AT_ONCE or chars > CHARS_AT_ONCE):
            yield pairs[low:k]
            low, chars = k, len(a) + len(b)
    if pairs:
        yield pairs[low:]


def _scored(names: tuple[str, ...], a: pa.Array, b: pa.Array) -> list[pa.Array]:
    """A column for each score; nulls count as empty strings. So many rows are taken at once that their texts are few."""
    sizes = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    step = np.cumsum(sizes[0] + sizes[1]) // CHARS_AT_ONCE
    begin = [*np.flatnonzero(np.diff(step, prepend=-1)).tolist(), len(a)]
    out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in names]
    for low, high in zip(begin, begin[1:], strict=False):
        for own, values in zip(out, _scored_at_once(names, a.slice(low, high - low).to_pylist(), b.slice(low, high - low).to_pylist()), strict=True):
            own.append(values)
    return [pa.array(np.concatenate(own)) for own in out]


def _scored_at_once(names: tuple[str, ...], a: list[str | None], b: list[str | None]) -> list[np.ndarray]:
    place: dict[tuple[str, str], int] = {}
    rows = np.fromiter((place.setdefault((x or "", y or ""), len(place)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    found: list[list[np.ndarray]] = [[] for _ in names]
    for own in _parts(list(place)):
        part = Scores(own)
        for n, out in zip(names, found, strict=True):
            out.append(np.asarray(getattr(part, n), np.float64))
    return [np.concatenate([np.zeros(0), *out])[rows] for out in found]


def _score(name: str) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(T.DoubleType())
    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        return _scored((name,), a, b)[0]

    return scored


#: Column functions by name; all scores from 0 to 1.
SCORES = {name: _score(name) for name in ("ratio", "partial_ratio", "token_sort", "token_set", "WRatio", "jw", "lcs_ratio")}


def all_scores(names: tuple[str, ...] = tuple(SCORES)) -> Callable[[Column | str, Column | str], Column]:
    """The named scores of a pair as a struct, in one trip to Python."""

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def scored(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_scored(names, a, b), list(names))

    return scored
