"""Text analysis: words, terms and stop words as column expressions."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words; taken out of queries, never of documents.
STOP_WORDS = frozenset(
    "a an as at be by if in is it no of on or to and are but for not the was into such that then they this will with their there these".split()
)


def terms(text: Column) -> Column:
    """The terms of a text in order: words between Unicode white space, stripped of everything that
    is not alphabetic, in lower case, empty ones left out. Null gives an empty array.

    One pass of each expression over the whole text, not over every word: deleting within words
    leaves the white space between them as it is.
    """
    letters = F.lower(F.regexp_replace(text, r"(?U)[^\p{IsAlphabetic}\s]+", ""))
    words = F.array_remove(F.split(letters, r"(?U)\s+"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def alnum_terms(text: Column) -> Column:
    """A second analyser: runs of letters and digits in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"(?U)[^\p{IsAlphabetic}\p{IsDigit}]+"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


ANALYSERS = {"alphabetic": terms, "alphanumeric": alnum_terms}


def not_stop_word(term: Column) -> Column:
    return ~term.isin(*sorted(STOP_WORDS))


def normalize_word(word: str) -> str:
    """The same normalisation for a single word on the driver."""
    return regex.sub(r"\P{Alphabetic}+", "", word).lower()


def normalize_words(text: Column) -> Column:
    """Words of a text beside their terms: array of (word, term), empty terms included."""
    words = F.array_remove(F.split(text, r"(?U)\s+"), "")
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.lower(F.regexp_replace(w, r"[^\p{IsAlphabetic}]+", "")).alias("term")))
