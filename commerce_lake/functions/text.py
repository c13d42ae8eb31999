"""Text columns: folding, normalising, tokens, trigrams.  All native but NFKC and edit distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžœ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyszo"
TOKEN = r"[\p{L}\p{N}]+"
MAX_TOKENS = 24


def fold(c: Column) -> Column:
    """Lower case without accents; one table for every operator."""
    return F.replace(F.translate(F.lower(c), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x1f\x7f]", " ")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """NFKC, in Python only for values with non-ASCII characters."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [None if x is None else unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")


def nfkc_each(c: Column) -> Column:
    """NFKC of each string of an array, in Python only for arrays with non-ASCII characters."""
    wide = F.array_join(c, " ").rlike(r"[^\x00-\x7F]")
    return F.when(wide, _nfkc_each(F.when(wide, c))).otherwise(c)


def normalize_query(c: Column, ascii_only: bool = False) -> Column:
    """Control characters, case, compatibility forms, punctuation and spaces made uniform."""
    x = F.lower(strip_control(c))
    x = x if ascii_only else nfkc(x)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N} ]", " "), " +", " "))


def tokenize(c: Column, cap: int = MAX_TOKENS) -> Column:
    """The first ``cap`` runs of letters and digits, lower-cased; null gives none."""
    return F.coalesce(F.slice(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), 1, cap), F.array().cast("array<string>"))


def folded_tokens(c: Column, cap: int = MAX_TOKENS) -> Column:
    """Tokens without accents, as documents, vocabulary and suggestions have them."""
    return tokenize(fold(c), cap)


def token_class(token: Column) -> Column:
    """numeric: digits only; code: letters and digits; word otherwise."""
    return F.when(token.rlike(r"^\p{Nd}+$"), "numeric").when(token.rlike(r"\p{L}") & token.rlike(r"\p{Nd}"), "code").otherwise("word")


def fuzzy_distance(token: Column) -> Column:
    """Edits allowed for a token of this length."""
    n = F.length(token)
    return F.when(n <= 3, 0).when(n <= 7, 1).otherwise(2)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two spaces before and one after."""
    words = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared distinct trigrams over all distinct trigrams; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    return set_similarity(x, y)


def set_similarity(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - shared
    return F.coalesce(F.when(either > 0, shared / either), F.lit(0.0))


def damerau(a: str, b: str, most: int | None = None) -> int:
    """Edit distance with transpositions of any two letters made adjacent; above ``most``: most + 1."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        same = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), same
            if x == y:
                same = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    n = d[-1][-1]
    return n if most is None or n <= most else most + 1


@F.pandas_udf(IntegerType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def _swapped(c: Column) -> Column:
    """All texts that exchange two neighbouring letters of a text."""
    one = lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.lit(1)), F.substring(c, i, F.lit(1)), F.substring(c, i + 2, F.length(c)))
    return F.when(F.length(c) > 1, F.transform(F.sequence(F.lit(1), F.length(c) - 1), one)).otherwise(F.array().cast("array<string>"))


def small_distance(a: Column, b: Column) -> Column:
    """The edit distance with transpositions where it is at most 2, null above; native.

    Two operations are two edits, one exchange and one edit in either order, or two exchanges. An exchange counts as two
    plain edits, so texts more than four plain edits apart are out at once."""
    plain = F.levenshtein(a, b, 4)
    near = lambda x, y: F.exists(_swapped(x), lambda s: F.levenshtein(s, y, 1) >= 0)
    two = (plain == 2) | near(a, b) | near(b, a) | F.arrays_overlap(_swapped(a), _swapped(b))
    return F.when(plain < 0, F.lit(None).cast("int")).when(plain <= 1, plain).when(F.array_contains(_swapped(a), b), 1).when(two, 2)


def resolve_locale(code: Column, available: list[str], default: str = "en") -> Column:
    """The available locale equal to code (any case), else the first of its language, else the default."""
    out = F.lit(default)
    base = F.lower(F.split(code, "-")[0])
    for a in reversed(available):
        out = F.when(base == a.split("-")[0].lower(), a).otherwise(out)
    for a in reversed(available):
        out = F.when(F.lower(code) == a.lower(), a).otherwise(out)
    return out


def valid_locale(code: Column) -> Column:
    return F.coalesce((F.length(code) <= 35) & code.rlike(r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), F.lit(False))


def valid_country(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^[A-Za-z]{2}$"), F.lit(False))


def valid_currency(code: Column) -> Column:
    return F.coalesce(code.rlike(r"^[A-Za-z]{3}$"), F.lit(False))
