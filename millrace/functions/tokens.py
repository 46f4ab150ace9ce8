"""Token sequences: ``array<string>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .binding import let

#: Short, common English words, lower case; other lists are passed as parameters.
STOPWORDS = (
    "i a we me my he it us if in is be do go no of on or so to up at as by an am "
    "the and you for was are but not all any can had has her him his how its may now off one our out own say she too two "
    "who why get got let did been from have they that this with what when were will your each else even ever into just "
    "like more most much must only over said same some such than them then very want well went also does done here near "
    "about above after again could every might never often other shall since still their there these thing think those "
    "under until where which while whose would almost always anyone around became become before behind better between both "
    "cannot during either enough except itself little maybe mostly myself neither nobody nothing perhaps rather really "
    "several should something sometimes somewhere themselves therefore though through together toward towards unless "
    "usually various whatever whenever wherever whether within without yourself"
).split()
#: Insults; a list of one's own is passed as a parameter.
BADWORDS = "idiot moron stupid scum loser clown trash pathetic worthless disgusting damn crap jerk".split()

_NONE = "array<string>"


def _c(t: Column | str) -> Column:
    return F.col(t) if isinstance(t, str) else t


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(words)])


def _match(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


ALL_CAPS, CAPITALIZED, LOWERCASE, URL = "^[A-Z]+$", "^[A-Z][^A-Z]*$", "^[a-z]+$", "^https?://.+$"


def listing_pattern(host: str) -> str:
    """Pattern of the item pages of a market place."""
    return f"^https?://.+{host}.+/listing/[0-9]+.*$"


def concat(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def join(t, glue: str = " ") -> Column:
    return F.array_join(_c(t), glue)


def size(t) -> Column:
    return F.size(_c(t))


def intersect(a, b) -> Column:
    """Multiset intersection in the order of ``a``: each token as often as both have it."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))

    def kept(a: Column, b: Column) -> Column:
        marked = F.transform(a, lambda x, i: F.when(count(F.slice(a, F.lit(1), i + 1), x) <= count(b, x), x))
        return F.filter(marked, lambda x: x.isNotNull())

    return let(_c(a), lambda x: let(_c(b), lambda y: kept(x, y)))


def select(t, test: Callable[[Column], Column]) -> Column:
    return F.filter(_c(t), test)


def without_blank(t) -> Column:
    return F.filter(_c(t), lambda x: x != "")


def stopwords(t, words=STOPWORDS) -> Column:
    w = _words(words)
    return F.filter(_c(t), lambda x: F.array_contains(w, F.lower(x)))


def without_stopwords(t, words=STOPWORDS) -> Column:
    w = _words(words)
    return F.filter(_c(t), lambda x: ~F.array_contains(w, F.lower(x)))


def badwords(t, words=BADWORDS) -> Column:
    return stopwords(t, words)


def without_badwords(t, words=BADWORDS) -> Column:
    return without_stopwords(t, words)


def matching(t, pattern: str) -> Column:
    """Tokens that match a pattern such as ALL_CAPS, CAPITALIZED, LOWERCASE, URL or a listing pattern."""
    return F.filter(_c(t), _match(pattern))


def without_matching(t, pattern: str) -> Column:
    return F.filter(_c(t), lambda x: ~x.rlike(pattern))


def count(t, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(_c(t), test))


def fraction(part: Column, t, bins: int = 10) -> Column:
    """``part`` over the number of tokens, rounded to one of ``bins`` steps; null without tokens."""
    return F.round(F.try_divide(part * bins, F.size(_c(t)))) / bins


def size_bin(t) -> Column:
    """Floor of the logarithm of the number of tokens; null without tokens."""
    return F.floor(F.ln(F.nullif(F.size(_c(t)), F.lit(0)))).cast("int")


def each(t, f: Callable[[Column], Column]) -> Column:
    """A text function of each token, e.g. ``each("t", text.replace_numbers)``."""
    return F.transform(_c(t), f)


def ngrams(t, n: int, glue: str = " ", short: bool = True) -> Column:
    """Windows of ``n`` tokens. Fewer tokens than ``n`` yield one short window (``short``) or none."""

    def windows(t: Column) -> Column:
        out = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), glue))
        return F.when(F.size(t) >= (1 if short else n), out).when(t.isNotNull(), F.array().cast(_NONE))

    return let(_c(t), windows)


def unigrams_and_bigrams(t, glue: str = " ") -> Column:
    return F.concat(_c(t), ngrams(t, 2, glue, short=False))


def shingles(t, n: int, whitespace: str = "_") -> Column:
    """Character windows of the tokens joined."""
    return X.shingles(F.array_join(_c(t), whitespace), n)


def prepend(t, namespace: str) -> Column:
    return F.transform(_c(t), lambda x: F.concat(F.lit(namespace), x))


def grams(t, sizes: list[int], separator: str = " ") -> Column:
    """For each token in turn, the grams of the given sizes that end with it."""

    def ending(t: Column, i: Column) -> Column:
        own = [F.when(i + 1 >= n, F.array_join(F.slice(t, F.greatest(i + 2 - n, F.lit(1)), F.lit(n)), separator)) for n in sizes]
        return F.filter(F.array(*own), lambda x: x.isNotNull())

    return let(_c(t), lambda t: F.flatten(F.transform(t, lambda _, i: ending(t, i))))


def ngrams_up_to(s, n: int = 2, prefix: str = "") -> Column:
    """All 1- to ``n``-grams of a text's cleaned lower-case tokens between empty marks at both ends, joined by '::'."""
    words = F.split(X.standard_filter(F.lower(_c(s))), " ")
    padded = F.concat(F.array(F.lit("")), words, F.array(F.lit("")))
    out = let(padded, lambda t: F.concat(*[ngrams(t, m, "::") for m in range(1, n + 1)]))
    return prepend(without_blank(out), prefix) if prefix else without_blank(out)


def counts(t, weight: float = 1.0) -> Column:
    """Vector of the tokens, each weighing ``weight`` for every occurrence, in one pass over sorted runs."""
    def runs(ordered: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(ordered)))
        entries = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(ordered, a).alias("key"), ((b - a) * F.lit(float(weight))).alias("value")))
        return F.map_from_entries(F.when(F.size(ordered) > 0, entries).otherwise(F.slice(entries, 1, 0)))

    def starts(ordered: Column) -> Column:
        return F.filter(F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())

    return let(F.array_sort(_c(t)), lambda o: let(starts(o), lambda s: runs(o, s)))


def presence(t, weight: float = 1.0) -> Column:
    """Vector of the distinct tokens, each with ``weight``."""
    return F.map_from_entries(F.transform(F.array_distinct(_c(t)), lambda x: F.struct(x.alias("key"), F.lit(float(weight)).alias("value"))))
