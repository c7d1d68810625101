"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the Unicode sense, and the four ASCII separators.
WHITE_SPACE = "".join(
    [
        "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680",
        *[chr(c) for c in range(0x2000, 0x200B)],
        "\u2028\u2029\u202f\u205f\u3000",
    ]
)


def strip(col: Column) -> Column:
    """Remove Unicode white space (tab, line break, NBSP, ...) at both ends.

    Plain trimming of a character set: no regular expression per value.
    """
    return F.btrim(col, F.lit(WHITE_SPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(strip(col), F.lit(""))


def slugify(col: Column, empty: str = "target") -> Column:
    """File-name form: letters and digits stay, all else becomes ``_``."""
    word = F.regexp_replace(F.lower(strip(col)), r"[^\p{L}\p{N}]", "_")
    word = F.regexp_replace(word, r"^_+|_+$", "")
    return F.when(word == "", F.lit(empty)).otherwise(word)


def fixed(col: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals.

    Ties go to the even digit and are judged by the exact binary value, which
    ``format_string`` does not do.
    """
    return F.call_function("format_number", col.cast("double"), F.lit("0." + "0" * digits))
