"""Metaphone codes (Lawrence Philips, 1990) of words, by Arrow UDFs that code each distinct word of a batch once."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiou"


def metaphone(word: str) -> str:
    """The code of a word; white space is kept as a space, other characters than letters are passed over."""
    s = unicodedata.normalize("NFKD", word).lower()
    if s[:2] in ("kn", "gn", "pn", "wr", "ae"):
        s = s[1:]
    out: list[str] = []
    i, n = 0, len(s)
    at = lambda k: s[k] if 0 <= k < n else ""
    while i < n:
        c, after, later = s[i], at(i + 1), at(i + 2)
        if c == after and c != "c":
            i += 1
            continue
        step = 1
        if c in _VOWELS:
            if i == 0 or s[i - 1] == " ":
                out.append(c)
        elif c == "b":
            if not (i and s[i - 1] == "m") or after:
                out.append("b")
        elif c == "c":
            if after == "i" and later == "a" or after == "h":
                out.append("x")
                step = 2
            elif after and after in "iey":
                out.append("s")
                step = 2
            else:
                out.append("k")
        elif c == "d":
            if after == "g" and later and later in "iey":
                out.append("j")
                step = 3
            else:
                out.append("t")
        elif c in "fjlmnr":
            out.append(c)
        elif c == "g":
            if after and after in "iey":
                out.append("j")
            elif after == "h" and later and later not in _VOWELS:
                step = 2
            elif after == "n" and not later:
                step = 2
            else:
                out.append("k")
        elif c == "h":
            if i == 0 or after in tuple(_VOWELS) or s[i - 1] not in _VOWELS:
                out.append("h")
        elif c == "k":
            if i == 0 or s[i - 1] != "c":
                out.append("k")
        elif c == "p":
            if after == "h":
                out.append("f")
                step = 2
            else:
                out.append("p")
        elif c == "q":
            out.append("k")
        elif c == "s":
            if after == "h":
                out.append("x")
                step = 2
            elif after == "i" and later in ("a", "o"):
                out.append("x")
                step = 3
            else:
                out.append("s")
        elif c == "t":
            if after == "i" and later in ("a", "o"):
                out.append("x")
            elif after == "h":
                out.append("0")
                step = 2
            elif not (after == "c" and later == "h"):
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c == "w":
            if i == 0 and after == "h":
                step = 2
                out.append("w")
            elif after and after in _VOWELS:
                out.append("w")
        elif c == "x":
            out.append(("x" if after == "h" or after == "i" and later in ("a", "o") else "s") if i == 0 else "ks")
        elif c == "y":
            if after and after in _VOWELS:
                out.append("y")
        elif c == "z":
            out.append("s")
        elif c == " " and out and out[-1] != " ":
            out.append(" ")
        i += step
    return "".join(out).upper()


@functools.lru_cache(1 << 16)
def sound(token: str) -> str:
    """The code of a token, or its first two characters where the code is empty."""
    return metaphone(token) or token[:2]


@F.arrow_udf(T.StringType())
def metaphone_of(words: pa.Array) -> pa.Array:
    known = words.dictionary_encode()
    return pa.array([metaphone(w) for w in known.dictionary.to_pylist()], pa.string()).take(known.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _sounds(lists: pa.Array) -> pa.Array:
    words = pc.list_flatten(lists).dictionary_encode()
    codes = pa.array([sound(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), codes, mask=pc.is_null(lists))


def sounds(tokens: Column) -> Column:
    """The code of each token of an array, in its order."""
    return _sounds(tokens)


def sound_set(tokens: Column) -> Column:
    """Sorted distinct codes of the tokens of two characters or more."""
    return F.array_sort(F.array_distinct(sounds(F.filter(tokens, lambda t: F.length(t) > 1))))
