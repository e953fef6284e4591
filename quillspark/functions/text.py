"""Column functions on text: cleaning, sentences, paragraphs, ratios and marks.

All stay on the JVM. White space is Unicode-aware, as in the patterns ``(?U)``, with the four separators \\x1c to \\x1f. Null texts count as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of table and template code, and the shorter list used for chat messages.
MARKUP = ("{|", "|}", "align=", "data-sort-value", "{{", "}}", "<ref", "</ref>", "[[", "]]")
CHAT_MARKUP = ("{|", "|}", "align=", "data-sort-value", "<ref", "</ref>")
#: Three notions of a control token, and what marks a target as table code.
CONTROL_STRIP = r"(?:<c\d+_\d+>|\bc\d+_\d+\b)"
CONTROL_MIX = r"(<c\d+_\d+>|\bc\d+=\d+)"
CONTROL_TARGET = r"(\|\||<c\d+_\d{4}>|c\d+_\d+>)"
TABLE_CODE = r"(?i)(\|\||^\s*\||align=right|data-sort-value=|rowspan=|colspan=|style=|class=|scope=|bgcolor=)"
#: What the cleaner of questions and answers takes out.
QA_NOISE = r"(\|\|+)|(\{\{.*?\}\})|(<ref.*?>.*?</ref>)|(<.*?>)"
#: Fixed value: where a sentence ends.
SENTENCE_GAP = r"(?<=[.!?])(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))  # most texts have no white space there, and are not searched
    return F.when(ends.rlike(r"(?U)[\s\x1c-\x1f]"), F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends cut."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def clean(c: Column) -> Column:
    return collapse(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " "))


def contains_any(c: Column, marks: tuple[str, ...]) -> Column:
    """Whether a text has one of the marks (ASCII), in any case. Marks without letters are plain searches, others patterns for texts that have their first sign."""
    c = F.coalesce(c, F.lit(""))
    found = F.lit(False)
    for m in sorted(marks, key=lambda m: m.upper() != m.lower()):
        sign = next((x for x in m if not x.isalpha()), "")
        found = found | (c.contains(m) if m.upper() == m.lower() else c.contains(sign) & c.rlike("(?i)" + re.escape(m)))
    return found


def has_markup(c: Column) -> Column:
    return contains_any(c, MARKUP)


def clean_message(c: Column, limit: int = 2000) -> Column:
    """A chat message: cleaned, empty if it has markup, cut to ``limit`` characters."""
    text = clean(c)
    return F.when(contains_any(text, CHAT_MARKUP), "").when(F.length(text) > limit, F.rtrim(F.substring(text, 1, limit))).otherwise(text)


def clean_qa(c: Column) -> Column:
    text = F.translate(F.coalesce(c, F.lit("")), "\u00a0", " ")
    return collapse(F.regexp_replace(F.regexp_replace(text, QA_NOISE, " "), r"\|{2,}", " "))


def sentences(c: Column) -> Column:
    """The sentences of a cleaned text: parted after . ! ? before white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), strip), lambda s: s != "")


def first_sentence(c: Column) -> Column:
    return F.element_at(F.split(clean(c), SENTENCE_GAP, 2), 1)


def first_dot(c: Column, limit: int = 220) -> Column:
    """What stands before the first dot of the first ``limit`` characters, with the dot put back."""
    text = strip(F.substring(F.coalesce(c, F.lit("")), 1, limit))
    head = strip(F.substring_index(text, ".", 1))
    return F.when(~text.contains("."), text).when(head == "", "").otherwise(F.concat(head, F.lit(".")))


def inference_sentences(c: Column, least: int = 5) -> Column:
    return F.filter(sentences(clean(c)), lambda s: F.length(s) >= least)


def paragraphs(c: Column) -> Column:
    """Lines stripped and joined by spaces; empty lines end a paragraph."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), strip)
    return F.filter(F.transform(F.split(F.array_join(lines, "\n"), r"\n{2,}"), lambda p: F.replace(F.regexp_replace(p, r"^\n+|\n+$", ""), F.lit("\n"), F.lit(" "))), lambda p: p != "")


def symbol_ratio(c: Column) -> Column:
    """The share of characters that are neither letters nor numbers among those that aren't white space; 1 if none."""
    # plain classes first: little is left for the Unicode ones. A lambda's variable is computed once
    dense = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x09-\x0D\x1c-\x20]+", "")

    def ratio(d: Column, rest: Column) -> Column:
        white = F.length(rest) - F.length(F.regexp_replace(rest, r"(?U)\s+", ""))
        symbols = F.length(F.regexp_replace(rest, r"(?U)[\s\p{L}\p{N}]+", ""))
        return F.coalesce(F.try_divide(symbols, F.length(d) - white), F.lit(1.0))

    inner = F.transform(F.array(dense), lambda d: F.transform(F.array(F.regexp_replace(d, "[A-Za-z0-9]+", "")), lambda rest: ratio(d, rest))[0])
    return inner[0]


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def strip_control(c: Column) -> Column:
    return collapse(F.regexp_replace(c, CONTROL_STRIP, ""))
