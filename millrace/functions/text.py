"""Text cleaning: string columns to string columns, by the regular expressions of the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

SPACE = "[ \\t\\n\\x0B\\f\\r]"


def _c(s: Column | str) -> Column:
    return F.col(s) if isinstance(s, str) else s


def _r(s: Column | str, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(_c(s), pattern, to)


def replace_numbers(s, rep: str = "_num_") -> Column:
    """Runs of digits become ``rep``; two of it with white space between become one, in a single pass."""
    return _r(_r(s, "[0-9]+", rep), f"{rep}{SPACE}+{rep}", rep)


def replace_html_escapes(s, rep: str = " ") -> Column:
    """``&...;`` becomes ``rep``. What follows the last ';' holds none and isn't searched, as each '&' there would be
    compared with all the rest of the text."""

    def replaced(s: Column) -> Column:
        tail = F.instr(F.reverse(s), ";") - 1
        end = F.length(s) - tail
        return F.when(tail < 0, s).otherwise(F.concat(_r(F.substring(s, F.lit(1), end), "&[^;]+;", rep), F.substring(s, end + 1, tail)))

    return let(_c(s), replaced)


def remove_html_tags(s) -> Column:
    """Tags within a line become a blank."""
    return _r(s, "<.*?>", " ")


def replace_html_tags(s, rep: str = " ") -> Column:
    return _r(s, "<[^>]+>", rep)


# all but a-z A-Z 0-9 . - and white space (and _), said as ranges: several times as quick as a negated class
_OTHER = "\\x00-\\x08\\x0e-\\x1f!-,/:-@\\[-^`{-\\x{10FFFF}"


def replace_non_alphanumeric(s, rep: str = " ") -> Column:
    return _r(s, f"[{_OTHER}_]+", rep)


def replace_non_alphanumeric_underscore(s, rep: str = " ") -> Column:
    return _r(s, f"[{_OTHER}]+", rep)


def replace_non_alpha(s, rep: str = " ") -> Column:
    return _r(s, "[^a-zA-Z]+", rep)


def collapse_hyphens(s) -> Column:
    return _r(s, "--+", "--")


def collapse_underscores(s) -> Column:
    return _r(s, "__+", "__")


def collapse_periods(s) -> Column:
    return _r(s, "[.][.]+", "..")


def lower(s) -> Column:
    return F.lower(_c(s))


def upper(s) -> Column:
    return F.upper(_c(s))


def strip_punctuation(s) -> Column:
    """Without what isn't a letter or digit at either end."""
    return _r(_r(s, "^[^A-Za-z0-9]+"), "[^A-Za-z0-9]+$")


def collapse(s) -> Column:
    return _r(s, f"{SPACE}+", " ")


def rstrip(s) -> Column:
    return _r(s, f"{SPACE}+$")


def lstrip(s) -> Column:
    return _r(s, f"^{SPACE}+")


def strip(s) -> Column:
    """Without control characters and blanks at either end."""
    return _r(s, "^[\\x00-\\x20]+|[\\x00-\\x20]+$")


def wsclean(s) -> Column:
    return collapse(strip(s))


def remove_unprintables(s) -> Column:
    return _r(s, "[^\\x20-\\x7E]")


def collapse_whitespace_and_punctuation(s) -> Column:
    return _r(_r(collapse(s), "-+", "-"), "[.]+", ".")


def standard_filter(s) -> Column:
    """Tags and escapes out, numbers and other characters replaced, runs and white space collapsed; case stays."""
    out = replace_numbers(replace_html_escapes(remove_html_tags(s)))
    return wsclean(collapse_underscores(collapse_hyphens(replace_non_alphanumeric_underscore(out))))


def shingles(s, *sizes: int, short: bool = True) -> Column:
    """Character windows of each size, one size after another. A text shorter than a size yields itself (``short``) or
    nothing; an empty text yields nothing."""

    def of_size(s: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))

    def windows(s: Column) -> Column:
        parts = []
        for n in sizes:
            own = of_size(s, n)
            parts.append(F.when(F.length(s) >= (1 if short else n), own).otherwise(F.array().cast("array<string>")))
        return F.when(s.isNotNull(), F.concat(*parts))

    return let(_c(s), windows)


def tokens(s, separator: str = " ") -> Column:
    """Parts between separators (a regular expression), without the empty ones at the end."""
    last = lambda parts: F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    cut = let(F.split(_c(s), separator), lambda parts: F.slice(parts, F.lit(1), last(parts)))
    return F.when(_c(s) == "", F.array(F.lit(""))).otherwise(cut)


def is_empty(s) -> Column:
    return F.length(_c(s)) == 0


def clean_line(s) -> Column:
    return F.lower(_r(s, "[^A-Za-z]", " "))


_MARKS = " +.,~<>$?!:;(){}|\\x08\\t\\n\\f\\r\"'\\\\/=&%_"


def clean_line_robust(s, separator: str = " ", ignore_numbers: bool = False) -> Column:
    """Words between marks; runs of hyphens become one, a hyphen at either end goes, words of one character (and, if asked,
    those with digits) are left out."""
    words = F.transform(F.split(_c(s), f"[{_MARKS}]+"), lambda t: _r(_r(_r(t, "-{2,}", "-"), "^-"), "-$"))
    keep = lambda t: (F.length(t) >= 2) & (~t.rlike("[0-9]") if ignore_numbers else F.lit(True))
    return F.array_join(F.filter(words, keep), separator)


def clean_text(s, most: int) -> Column:
    """Words of 2 to ``most`` characters between marks, hyphens and digits, each followed by a blank."""
    words = F.filter(F.split(_c(s), f"[{_MARKS}0-9\\-]+"), lambda t: (F.length(t) >= 2) & (F.length(t) <= most))
    return F.array_join(F.transform(words, lambda t: F.concat(t, F.lit(" "))), "")


def sort_terms(s, separator: str = f"{SPACE}+") -> Column:
    """Terms in order, joined by single blanks."""
    return F.array_join(F.array_sort(tokens(s, separator)), " ")


def check_not_blank(s, message: str = "the string is blank") -> Column:
    """``s``, or an error if it is null or blank."""
    s = _c(s)
    return F.when(F.length(strip(F.coalesce(s, F.lit("")))) > 0, s).otherwise(F.raise_error(F.lit(message)))
