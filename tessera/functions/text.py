"""Column functions of words, tokens and lists of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, the same in every engine.
BLANK = "[ \\t\\n\\r\\f\\x0B]+"
# Suffixes of unknown words, in the order in which they are tried.
SUFFIXES = ["ed", "ing", "ion", "er", "est", "ly", "ity", "y", "al"]


def tokenize(line: Column, lower: bool = False) -> Column:
    """Words between runs of white space; no empty ones."""
    return F.filter(F.split(F.lower(line) if lower else line, BLANK), lambda x: x != "")


def signature(word: Column, suffixes: bool = True) -> Column:
    """What stands for an unknown word: UNK, then marks for a dash, a digit and an ending."""
    end = F.lit("")
    if suffixes:
        long = F.length(word) >= 5
        for s in reversed(SUFFIXES):
            end = F.when(long & word.endswith(s), f"-{s}").otherwise(end)
        end = F.when((F.length(word) >= 3) & word.endswith("s"), "-s").otherwise(end)
    dash = F.when(word.contains("-"), "-DASH").otherwise("")
    digit = F.when(word.rlike("[0-9]"), "-NUM").otherwise("")
    return F.concat(F.lit("UNK"), dash, digit, end)


def normal_trimmed(word: Column) -> Column:
    """Words without surrounding punctuation, lower-cased; nothing but punctuation gives the empty string."""
    core = F.regexp_extract(word, "^[^A-Za-z0-9_]*([A-Za-z0-9_].*[A-Za-z0-9_])[^A-Za-z0-9_]*$", 1)
    return F.lower(F.when(core != "", core).when(word.rlike("^[A-Za-z0-9_]+$"), word).otherwise(""))


def normal_number(word: Column) -> Column:
    """Lower-cased words; any with a digit becomes #."""
    return F.when(word.rlike("[0-9]"), "#").otherwise(F.lower(word))


def tag_and_word(token: Column, mark: str = "_@") -> tuple[Column, Column]:
    """The tag and word of `tag_@word`; an untagged token is both."""
    parts = F.split(token, mark, 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), parts[0])


def log10(p: Column) -> Column:
    """Base-10 logarithm with minus infinity at zero."""
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))


def binomial(n: Column, k: Column) -> Column:
    """How many sets of k there are of n; exact while it fits a long."""
    j = F.least(k, n - k)
    steps = F.when(j > 0, F.sequence(F.lit(1).cast("long"), F.greatest(j, F.lit(1)).cast("long")))
    return F.when((k < 0) | (k > n), F.lit(0).cast("long")).otherwise(F.coalesce(F.aggregate(steps, F.lit(1).cast("long"), lambda a, i: ((a * (n - j + i)) / i).cast("long")), F.lit(1).cast("long")))


def at(values: Column, i: Column) -> Column:
    """The i-th value, from 0."""
    return F.get(values, i.cast("int"))


def rank_percentile(values: Column, p: float) -> Column:
    """Percentile of a sorted list by rank p/100*N: the least below rank 1, the greatest from N-1 on, else between neighbours."""
    n = F.size(values)
    rank = F.lit(p / 100.0) * n
    k = F.floor(rank)
    low, high = at(values, k - 1), at(values, k)
    return F.when(k == 0, at(values, F.lit(0))).when(k >= n - 1, at(values, n - 1)).otherwise(low + (rank - k) * (high - low))


def spaced_percentile(values: Column, p: float) -> Column:
    """Percentile of a sorted list by position p(N+1)/100, kept within the list."""
    n = F.size(values)
    pos = F.lit(p / 100.0) * (n + 1)
    k = F.floor(pos)
    low, high = at(values, k - 1), at(values, k)
    return F.when(pos < 1, at(values, F.lit(0))).when(pos >= n, at(values, n - 1)).otherwise(low + (pos - k) * (high - low))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean_up_to(values: Column, limit: Column) -> Column:
    """Mean of values at or below a limit; the first value if there is none."""
    some = F.filter(values, lambda x: x <= limit)
    return F.when(F.size(some) > 0, total(some) / F.size(some)).otherwise(F.get(values, F.lit(0)))
