"""Column builders for text: stripping, tokens, n-grams, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.settings import COMMON_QUERY_WORDS, FILLER_CHARS, STOP_WORDS, TOKEN_PATTERN


def strings(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column, stop_words=STOP_WORDS) -> Column:
    """Distinct meaningful words: CJK runs of two, Latin runs of three letters or more."""
    return F.array_except(F.array_distinct(found(F.lower(c), TOKEN_PATTERN)), strings(stop_words))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def bind(c: Column, f) -> Column:
    """f(c) with c computed once: inside f it is a variable, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams."""

    def of(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bind(c, of)


def char_grams(c: Column) -> Column:
    """2-grams and 3-grams of the lower-cased text, spaces included."""
    return bind(F.lower(c), lambda s: F.array_union(grams(s, 2), grams(s, 3)))


def clean_grams(c: Column, n: int = 2) -> Column:
    """n-grams over word characters only."""
    return grams(F.regexp_replace(F.lower(c), "(?U)[^\\w一-鿿]", ""), n)


def word_text(c: Column) -> Column:
    """The text with a space for each character that is not of a word."""
    return F.regexp_replace(c, "(?U)[^一-鿿\\w]", " ")


def terms(c: Column) -> Column:
    """Words of two characters or more and all their 2-grams."""
    words = F.filter(F.split(word_text(F.lower(c)), " "), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.array_union(F.array(w), grams(w, 2)))))


def query_terms(c: Column) -> Column:
    """White-space words of a query, lower case."""
    return F.filter(F.split(F.lower(c), "(?U)\\s+"), lambda t: t != "")


def is_filler(term: Column) -> Column:
    return term.rlike(f"^[{FILLER_CHARS}]+$")


def search_terms(c: Column) -> Column:
    """Query words without common and filler words, or all of them if none is left."""
    raw = query_terms(c)
    kept = F.filter(raw, lambda t: ~t.isin(*COMMON_QUERY_WORDS) & ~is_filler(t))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def all_common(c: Column) -> Column:
    """Three words or more, all of them common."""
    raw = query_terms(c)
    return (F.size(raw) >= 3) & F.forall(raw, lambda t: t.isin(*COMMON_QUERY_WORDS))


def round4(c: Column) -> Column:
    """Half up at four places, the same in any engine."""
    return F.floor(c * F.lit(1e4) + F.lit(0.5)) / F.lit(1e4)


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
