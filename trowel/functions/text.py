"""Text classifiers and scalars, as column expressions over strings and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a comment as unfinished work.
TAGS = ["TODO", "FIXME", "XXX", "HACK", "BUG", "WIP", "TEMP", "REVISIT", "REFACTOR"]
#: Words that say nothing about what a file is for.
STOPWORDS = ["the", "and", "for", "with", "from", "get", "set", "not", "new", "all", "are", "was", "has", "this", "that", "test", "tests", "init", "main", "self", "cls", "args", "kwargs", "name", "value", "data"]


def module_name(relpath: Column) -> Column:
    """Dotted name of a source path: suffix dropped, slashes to dots, a trailing __init__ dropped."""
    parts = F.filter(F.split(F.regexp_replace(relpath, r"\.py$", ""), "/"), lambda p: p != "")
    return F.array_join(F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), ".")


def qualified(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def stamped_date(text: Column) -> Column:
    """The first 20yy-mm-dd or 20yymmdd date in a text, as yyyy-mm-dd; digits around it end the match; null if none."""
    found = r"(?<![0-9])(20[0-9]{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12][0-9]|3[01])(?![0-9])"
    return F.when(text.rlike(found), F.concat_ws("-", *(F.regexp_extract(text, found, k) for k in (1, 2, 3))))


def vocabulary(text: Column) -> Column:
    """Words of identifiers: camel case split, lower case, runs of a-z longer than two letters, without stopwords."""
    split = F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1_$2"))
    words = F.filter(F.regexp_extract_all(split, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def size_share(n: Column, low: float = 40.0, high: float = 2400.0) -> Column:
    """Place of n between low and high on a logarithmic scale, 0 to 1."""
    share = (F.log10(n.cast("double")) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low)))
    return F.round(F.when(n <= low, F.lit(0.0)).when(n >= high, F.lit(1.0)).otherwise(share), 6)


def clip_end(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def clip_middle(text: Column, width: int) -> Column:
    head = (width - 1) // 2
    tail = width - 1 - head
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, head), F.lit("…"), F.substring(text, -tail, tail))).otherwise(text)


def clip_words(text: Column, width: int) -> Column:
    """Cut at the last blank that leaves room for dots, never through a word that another follows."""
    head = F.substring(text, 1, width - 4)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit(" ...")))


def meta_line(size: Column, owner: Column, badge: Column, chars: int) -> Column:
    """A card's last line: size and owner, or the size alone beside a badge; of a size that does not fit, its number."""
    alone = F.when(F.length(size) > chars, F.substring_index(size, " ", 1)).otherwise(size)
    return clip_end(F.when(badge != "", alone).otherwise(F.concat(size, F.lit("  ·  "), owner)), chars)


def text_bar(n: Column, most: Column, width: int = 20) -> Column:
    """A bar of '#' in proportion, at least one, filled up with dots; no '#' where most is 0."""
    filled = F.when(most == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / F.nullif(most, F.lit(0)) * width).cast("int")))
    return F.rpad(F.repeat(F.lit("#"), filled), width, ".")


def counted(n: Column, word: str, more: str = "s") -> Column:
    """3 files, 1 file."""
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise(more))


def stake_sentence(at_stake: Column, lines: Column, percent: Column, elsewhere: Column) -> Column:
    """What resuming a group of attempts gives back, with the figures that it comes from."""
    return F.concat(counted(at_stake, "line"), F.lit(" at stake: the furthest attempt has "), F.format_number(lines, 0), F.lit(", is "), percent, F.lit(" % written, and "), elsewhere, F.lit(" % of its names exist elsewhere"))


def effort_sentence(remaining: Column, unwritten: Column) -> Column:
    """What is left to write in the furthest attempt; null where nothing is."""
    return F.when(remaining > 0, F.concat(F.lit("about "), counted(remaining, "line"), F.lit(" to write, in "), counted(unwritten, "definition"), F.lit(" without a body")))


def copy_sentence(copy_of: Column) -> Column:
    """That a group is one file in several places; null for restarts."""
    return F.when(copy_of.isNotNull(), F.concat(F.lit("no restart: the same file is also at "), copy_of))


def coverage_sentence(total: Column, known: Column, untracked: Column, has_history: Column) -> Column:
    """How much of a tree its history covers."""
    none = F.concat(F.lit("no version history for any of "), counted(total, "module"))
    part = F.concat(F.lit("version history covers "), F.format_number(known, 0), F.lit(" of "), counted(total, "module"), F.lit("; "), F.format_number(untracked, 0), F.lit(" were never committed"))
    return F.when(total == 0, F.lit(None)).when(~has_history, none).when(untracked > 0, part).otherwise(F.concat(F.lit("version history covers all of "), counted(total, "module")))


def duration(seconds: Column) -> Column:
    """A time in the unit that fits it."""
    return F.when(seconds < 1, F.format_string("%.0f ms", seconds * 1000)).when(seconds < 90, F.format_string("%.1f seconds", seconds)).otherwise(F.format_string("%.1f minutes", seconds / 60))


def escape_html(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text
