"""Reading what tools and models print."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _header(text: Column) -> Column:
    """What stands before the first file of a text that begins with a commit line; null for other texts."""
    at = F.instr(text, "\ndiff --git ")
    return F.when(text.startswith("commit "), F.when(at > 0, F.left(text, at - 1)).otherwise(text))


def show_author(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(_header(text), F.lit("")), r"(?m)^Author:\s*(.+)$", 1))


def show_date(text: Column) -> Column:
    return F.trim(F.regexp_extract(F.coalesce(_header(text), F.lit("")), r"(?m)^Date:\s+(.+)$", 1))


def show_diff(text: Column) -> Column:
    """What follows the header, from the first file's line, or nothing if there is none; texts without a commit line are diffs."""
    at = F.instr(text, "\ndiff --git ")
    return F.when(~text.startswith("commit "), text).when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")


def show_text(commit: Column, author: Column, date: Column, message: Column, diff: Column) -> Column:
    indented = F.concat(F.lit("    "), F.replace(message, F.lit("\n"), F.lit("\n    ")))
    return F.concat(F.lit("commit "), commit, F.lit("\nAuthor: "), author, F.lit("\nDate: "), date, F.lit("\n\n"), indented, F.lit("\n\n"), diff)


def listwise(text: Column) -> Column:
    """The numbers in brackets, in order, each once; those that no long holds name nothing, and are left out."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull()))


def listwise_valid(text: Column) -> Column:
    return text.rlike(r"^\s*\[\d+\](\s*>\s*\[\d+\])*\s*$")


def after_marker(text: Column, marker: str) -> Column:
    return F.trim(F.substring_index(text, marker, -1))


def answer_number(text: Column) -> Column:
    """A bracketed number, else a loose one of at most three digits; null without, or where no int holds it."""
    return _first(text, r"\[(\d+)\]", r"\b(\d{1,3})\b").try_cast("int")


def answer_in_turns(text: Column) -> Column:
    """The number of an answer given over a manifest: the first digits, in brackets or after # or not; null without, or where no long holds it."""
    return _first(text, r"(\d+)").try_cast("long")


def answer_of_pool(text: Column) -> Column:
    """The number of an answer given over a pool: the first in brackets, else the first that stands alone, of any length."""
    return _first(text, r"\[(\d+)\]", r"\b(\d+)\b").try_cast("long")


def _first(text: Column, *patterns: str) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def answer_hash(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(text), r"\b([0-9a-f]{7,40})\b", 1), F.lit(""))


def index_name(repo: Column) -> Column:
    return F.lower(F.replace(F.replace(repo, F.lit("@@"), F.lit("_")), F.lit("/"), F.lit("_")))


def last_segment(doc_id: Column, separator: str = "@@") -> Column:
    return F.element_at(F.split(doc_id, separator), -1)


def tri_state(answer: Column) -> Column:
    """true, false, or null for anything else."""
    return F.when(F.trim(answer) == "True", True).when(F.trim(answer) == "False", False)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
