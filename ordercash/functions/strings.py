"""Text expressions shared by the graph and text jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a text editor sees it: the Unicode class and the four ASCII separators.
WS = r"[\s\x1c-\x1f]"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Without white space at either end; ``trim`` alone removes spaces only."""
    return F.btrim(text, F.lit(WS_CHARS))


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){WS}+", " "))


def contains_any(text: Column, words) -> Column:
    """Whether lower-cased text holds any of the plain words, as substrings."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found
