"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of_name(name: Column, from_end: int = 5) -> Column:
    """The character so far from the end: the one before an extension of three letters."""
    return F.substring(name, -from_end, 1)


def class_of(letter: Column) -> Column:
    """0-9 as 0 to 9, A-Z as 10 to 35, others null."""
    code = F.ascii(letter)
    return F.when(letter.rlike("^[0-9]$"), code - 48).when(letter.rlike("^[A-Z]$"), code - 55)


def letter_of(number: Column) -> Column:
    return F.when(number.between(0, 9), F.char(number + 48)).when(number.between(10, 35), F.char(number + 55))


def encoded(text: Column, alphabet: str) -> Column:
    """Places of the lower-cased letters in an alphabet, from 1; 0 for one that isn't in it."""
    return F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))


def repeats_letter(word: Column, least: int = 3) -> Column:
    return word.rlike(r"(.)" + r"\1" * (least - 1))


def suffixes(number: Column, street: Column, connected: Column, none: Column) -> Column:
    """Marks of a word's kinds, in a fixed order."""
    mark = lambda flag, text: F.when(flag, F.lit(text)).otherwise("")
    return F.concat(mark(number, "_hn"), mark(street, "_st"), mark(connected, "_cc"), mark(none, "_nw"))
