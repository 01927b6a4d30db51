"""Column expressions for text measures: lengths, token estimates, lines, cuts.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference behaviour.
CHARS_PER_TOKEN = 4          # token estimate = round(utf16 length / 4)
DEFAULT_MAX_LINES = 300      # read cap when none is given
DOCSTRING_CHARS = 120        # function docstring cut
TYPE_TEXT_CHARS = 200        # type alias text cut
PREVIEW_LINES = 300          # mock read preview


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def utf16_length(col: Column | str) -> Column:
    """String length in UTF-16 code units (what a JavaScript string reports).

    ASCII-only text (byte length == character length) skips the re-encode.
    """
    c = _c(col)
    return (
        F.when(F.octet_length(c) == F.char_length(c), F.char_length(c))
        .otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int"))
    )


def token_estimate(col: Column | str) -> Column:
    """round(length / 4) as BIGINT; half rounds up as in JavaScript for x >= 0."""
    return F.round(utf16_length(col) / CHARS_PER_TOKEN).cast("bigint")


def lines(col: Column | str) -> Column:
    """Split on LF only; a trailing LF yields a trailing empty line; CR is kept."""
    return F.split(_c(col), "\n", -1)


def line_count(col: Column | str) -> Column:
    return F.size(lines(col))


def size_kb(size_bytes: Column | str) -> Column:
    """round(bytes / 1024 * 10) / 10 -- one decimal, half up."""
    return F.round(_c(size_bytes) / 1024 * 10) / 10


def cut(col: Column | str, n: int) -> Column:
    return F.left(_c(col), F.lit(n))


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def decode_utf8(binary_col: Column | str) -> Column:
    """Bytes to text; invalid sequences become U+FFFD instead of failing."""
    return F.make_valid_utf8(_c(binary_col).cast("string"))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)
