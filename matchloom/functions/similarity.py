"""String similarities that no built-in has, over Arrow batches of distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit vectors: one machine word operation for each character of b and word of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def sorted_tokens(text: str | None) -> str:
    return " ".join(sorted((text or "").lower().split()))


def token_sort_similarity(a: str | None, b: str | None) -> float:
    """Twice the common subsequence over both lengths, of lower-cased words in order; 1 for two empty texts."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return 2 * lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0


def _token_sort_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        found = seen.get(pair)
        if found is None:
            found = seen[pair] = token_sort_similarity(*pair)
        out.append(found)
    return pd.Series(out, dtype="float64")


#: Letters of the 1990 Metaphone rules.
VOWELS, FRONT = "AEIOU", "EIY"


def metaphone(text: str | None) -> str:
    """The code of the published 1990 rules: consonant sounds as letters, vowels only at the start. Anything but A-Z parts words."""
    codes = [_word_code(w) for w in "".join(c if "A" <= c <= "Z" else " " if not c == "'" else "" for c in (text or "").upper()).split()]
    return " ".join(c for c in codes if c)


def _word_code(word: str) -> str:
    if word[:2] in ("AE", "GN", "KN", "PN", "WR"):
        word = word[1:]
    elif word[:1] == "X":
        word = "S" + word[1:]
    elif word[:2] == "WH":
        word = "W" + word[2:]
    out: list[str] = []
    n = len(word)
    at = lambda i: word[i] if 0 <= i < n else ""
    i = 0
    while i < n:
        c, before, after, second = word[i], at(i - 1), at(i + 1), at(i + 2)
        if c == before and c != "C":
            i += 1
            continue
        if c in VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (i == n - 1 and before == "M"):
                out.append("B")
        elif c == "C":
            if after and after in FRONT:
                if after == "I" and second == "A":
                    out.append("X")
                elif before != "S":
                    out.append("S")
            elif after == "H":
                out.append("K" if before == "S" or (i == 0 and second not in VOWELS) else "X")
                i += 1
            else:
                out.append("K")
        elif c == "D":
            out.append("J" if after == "G" and second and second in FRONT else "T")
            i += 1 if after == "G" and second and second in FRONT else 0
        elif c == "G":
            if after == "H" and not (i + 2 >= n or second in VOWELS):
                pass
            elif after == "N" and (i + 2 >= n or word[i + 2 :] == "ED"):
                pass
            elif after and after in FRONT and before != "G":
                out.append("J")
            elif after == "H":
                out.append("K" if second in VOWELS and second else "F" if i + 2 >= n else "")
                i += 1
            else:
                out.append("K")
        elif c == "H":
            if after and after in VOWELS and before not in tuple("CGPST"):
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
            i += after == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H":
                out.append("X")
                i += 1
            elif after == "I" and second in ("O", "A"):
                out.append("X")
            else:
                out.append("S")
        elif c == "T":
            if after == "I" and second in ("O", "A"):
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif not (after == "C" and second == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in VOWELS:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def token_sort_ratio(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_token_sort_batch, "double")(a, b)


def _metaphone_batch(text: pd.Series) -> pd.Series:
    seen: dict = {}
    return pd.Series([seen[t] if t in seen else seen.setdefault(t, metaphone(t)) for t in text], dtype="object")


def metaphone_code(text: Column | str) -> Column:
    return F.pandas_udf(_metaphone_batch, "string")(text)
