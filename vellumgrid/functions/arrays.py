"""Array functions as column expressions: spectra, arg-max, class sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def normalised(x: Column) -> Column:
    """Over its sum; null if that is 0."""
    return F.transform(x, lambda v: F.try_divide(v, total(x)))


def overlap(a: Column, b: Column) -> Column:
    """Sum of the roots of products of equal places: 1 for equal spectra of sum 1."""
    return total(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))


def rotated(x: Column, by: Column) -> Column:
    """The array read from place `by` on, round to its start."""
    n = F.size(x)
    start = F.pmod(by.cast("int"), n)
    return F.concat(F.slice(x, start + 1, n), F.slice(x, F.lit(1), start))


def argmax(x: Column) -> Column:
    """Place, from 0, of the first greatest element."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(label: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def collapse(classes: Column, blank: int = 0) -> Column:
    """Without blanks and without an element equal to the one before it."""
    kept = F.filter(classes, lambda t, i: (t != blank) & ((i == 0) | (F.get(classes, i - 1) != t)))
    return kept


def letters(classes: Column, alphabet: str, blank: int = 0) -> Column:
    """Class numbers from blank + 1 on as letters of an alphabet, joined."""
    return F.array_join(F.transform(classes, lambda t: F.substring(F.lit(alphabet), t - blank, F.lit(1))), "")


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    rest = F.log(total(F.transform(x, lambda v: F.exp(v - top))))
    return F.transform(x, lambda v: v - top - rest)


def routed(kind: Column, first: Column, second: Column) -> Column:
    """Log probabilities of two models' classes together: each model's, plus the log probability of its kind."""
    weight = log_softmax(kind)
    part = lambda x, k: F.transform(log_softmax(x), lambda v: v + F.get(weight, F.lit(k)))
    return F.concat(part(first, 0), part(second, 1))


#: Shares of red, green and blue in luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return LUMINANCE[0] * red + LUMINANCE[1] * green + LUMINANCE[2] * blue


def normalised(value: Column, mean: float = 0.5, deviation: float = 0.5) -> Column:
    return (value - mean) / deviation


def half_even(value: Column, digits: int) -> Column:
    """Rounded to a number of digits, halves to the even digit."""
    return F.bround(value, digits)


def read_upright(items: Column, turned: Column) -> Column:
    """An array in reading order: reversed where its line runs the other way."""
    return F.when(turned, F.reverse(items)).otherwise(items)
