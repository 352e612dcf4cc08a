"""Scalar text functions (T1-T5) as Catalyst expressions.

Everything here returns a ``Column`` so it stays inside whole-stage codegen;
no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace set of Python's ``str.isspace``/``re`` ``\s``
# for str patterns, written out because Java's and RE2's ``\s`` are ASCII
# only (and RE2's lacks \x0B).  The same class text works in DuckDB.
WS_CLASS = (r"[\t\n\x{000B}\f\r \x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}"
            r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS_CLASS + "+"
EDGE_WS = "^" + WS_RUN + "|" + WS_RUN + "$"

# Fixed value: characters kept by the query cleaner.
CLEAN_DROP = r"[^a-z0-9\t\n\x{000B}\f\r \x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-]"

# Word tokens: runs of letters/digits, or one other non-space character.
_WS_CHARS = WS_CLASS[1:-1]
WORD_TOKEN = r"[\p{L}\p{N}]+|[^" + _WS_CHARS + r"\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), EDGE_WS, "")


def normalize_text(c) -> Column:
    """Null -> '', lower case, strip, collapse whitespace runs to one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), WS_RUN, " "))


def clean_query(c) -> Column:
    """T1, then keep only [a-z0-9], whitespace and '-', then strip."""
    return strip_ws(F.regexp_replace(normalize_text(c), CLEAN_DROP, ""))


def char_ngram_text(c) -> Column:
    """The text T3 slices: lower-cased and stripped, null -> ''."""
    return strip_ws(F.lower(F.coalesce(_c(c), F.lit(""))))


def grams_from_chars(ch: Column, n: int, short_as_self: bool = True) -> Column:
    """Sliding n-grams over an array of characters.

    Indexing a character array keeps the work linear in the text length
    (``substring`` on UTF-8 would walk from the start for every position).
    ``ch`` must be a column reference: the lambda reads it once per gram.
    """
    size = F.size(ch)
    empty = F.array().cast("array<string>")
    short = F.array(F.array_join(ch, "")) if short_as_self else empty
    # split('', '') yields [''], so a one-element array of '' is empty text.
    is_empty = (size == 0) | ((size == 1) & (F.element_at(ch, 1) == ""))
    grams = F.transform(F.sequence(F.lit(1), size - n + 1),
                        lambda i: F.concat(*[F.element_at(ch, i + j) for j in range(n)]))
    return F.when(is_empty, empty).when(size < n, short).otherwise(grams)


def add_char_ngrams(df, col: str, out: str, n: int = 3, strict: bool = False):
    """T3 (``strict=False``) / T4 (``strict=True``) as a new array column.

    T3: lower, strip, text shorter than ``n`` gives itself, empty gives [].
    T4: raw text, no strip or lower, [] when shorter than 3.
    The character array is projected first so each row is split once.
    """
    src = F.coalesce(F.col(col), F.lit("")) if strict else char_ngram_text(col)
    tmp = f"__chars_{out}"
    df = df.withColumn(tmp, F.split(src, ""))
    return df.withColumn(out, grams_from_chars(F.col(tmp), n, short_as_self=not strict)).drop(tmp)


def word_tokens(c) -> Column:
    """T5: lower-cased word and punctuation tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(WORD_TOKEN), 0)


def md5_int(c) -> Column:
    """Portable 32-bit hash: first 8 hex digits of md5 as BIGINT.

    DuckDB twin: ``cast('0x' || substr(md5(x),1,8) as bigint)``.
    """
    return F.conv(F.substring(F.md5(_c(c)), 1, 8), 16, 10).cast("bigint")
