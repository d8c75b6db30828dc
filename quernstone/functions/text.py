"""Text functions: Column in, Column out, JVM-side unless said otherwise."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Markers of the ticket format.
NO_VALUE, NOT_APPLICABLE = "brak", "nie dotyczy"
NO_BODY, NO_COMMENTS, EMPTY_COMMENT = "(brak opisu)", "(brak komentarzy w wątku)", "(pusty komentarz)"
TICKET, SUBJECT, BODY, COMMENT = "ZGŁOSZENIE", "Temat", "OPIS ZGŁASZAJĄCEGO", "KOMENTARZ"

#: A word character in the Unicode sense; Java's own ``\w`` is ASCII.
WORD = r"[\p{L}\p{N}_]"
#: White space in the Unicode sense.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"

# The patterns of the two HTML variants, in the order in which they act.
BREAK, TAG = r"(?i)</(?:p|div|li|tr|h[1-6])>|<br\s*/?>", r"<[^>]+>"
SCRIPT = r"(?is)<(script|style)\b.*?</\1\s*>"
MEASURED_BREAK, MEASURED_ITEM = r"(?i)<(br|/p|/li|/tr|/h[1-6])[^>]*>", r"(?i)<li[^>]*>"

#: What may stand after ``&``: a number, a hexadecimal number, or a name.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def strip(text: Column) -> Column:
    """Without white space at both ends, in the Unicode sense (``trim`` takes spaces only)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


@lru_cache(maxsize=1)
def entity_tables() -> tuple[str, str, str]:
    """The HTML5 entities, from Python's own table: names by first letter, numbers that
    don't mean their code point (both as JSON objects), and a pattern of the names that
    need no semicolon, longest first."""
    import html
    from html.entities import html5

    names: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        names.setdefault(name[0], {})[name] = value
    odd = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
    numbers = {str(n): html.unescape(f"&#{n};") for n in odd if html.unescape(f"&#{n};") != chr(n)}
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(names), json.dumps(numbers), f"^(?:{'|'.join(bare)})"


def unescape(text: Column) -> Column:
    """All HTML5 character references, JVM-side: the text is cut at ``&`` and what follows
    is looked up. A reference that is none stays as it is."""
    names, numbers, bare = entity_tables()
    by_letter = F.from_json(F.lit(names), "map<string,map<string,string>>")
    special = F.from_json(F.lit(numbers), "map<string,string>")

    def resolved(part: Column) -> Column:
        found = F.regexp_extract(part, REFERENCE, 1)
        rest = F.substring(part, F.length(found) + 1, F.length(part))
        hexadecimal = F.regexp_extract(found, "^#[xX]0*([0-9a-fA-F]*)", 1)
        decimal = F.regexp_extract(found, "^#0*([0-9]*)", 1)
        digits = F.when(found.rlike("^#[xX]"), hexadecimal).otherwise(decimal)
        code = F.when(F.length(digits) > 8, F.lit(2**40)).when(found.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("long")).otherwise(F.concat(F.lit("0"), decimal).cast("long"))
        outside = (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(F.when(outside, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
        number = F.when(outside, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(special, code.cast("string")), plain))
        named = F.try_element_at(F.try_element_at(by_letter, F.substring(found, 1, 1)), found)
        short = F.regexp_extract(part, bare, 0)
        legacy = F.concat(F.try_element_at(F.try_element_at(by_letter, F.substring(short, 1, 1)), short), F.substring(part, F.length(short) + 1, F.length(part)))
        return F.when(found == "", F.concat(F.lit("&"), part)).when(found.startswith("#"), F.concat(number, rest)).when(named.isNotNull(), F.concat(named, rest)).when(short != "", legacy).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    whole = F.array_join(F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(resolved(part))), "")
    return F.when(text.contains("&"), whole).otherwise(text)


@F.pandas_udf(StringType())
def unescape_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same by Python's own function, by Arrow batches, as a check; null stays null."""
    import html

    for texts in batches:
        yield texts.map(lambda t: html.unescape(t) if isinstance(t, str) else None)


def strip_lines(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n"), "\n")
    return F.array_join(F.transform(lines, strip), "\n")


def strip_html(markup: Column, entities=unescape, drop_scripts: bool = False) -> Column:
    """Plain text of a fragment: closing block tags and ``<br>`` end a line, other tags
    go, entities are resolved after the tags, lines are stripped, more than one empty
    line becomes one. ``drop_scripts`` also removes script and style bodies."""
    if drop_scripts:
        markup = F.regexp_replace(markup, SCRIPT, "")
    text = F.regexp_replace(markup, BREAK, "\n")
    text = strip_lines(entities(F.regexp_replace(text, TAG, "")))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip_html_to_measure(markup: Column, entities=unescape) -> Column:
    """The other variant, for measuring content: list items get a dash, spaces and empty
    lines collapse; null gives the empty text."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), MEASURED_BREAK, "\n")
    text = F.regexp_replace(F.regexp_replace(text, MEASURED_ITEM, "- "), TAG, "")
    text = F.replace(F.replace(entities(text), F.lit("\u00a0"), F.lit(" ")), F.lit("\r"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n")
    return strip(F.array_join(F.transform(F.split(text, "\n"), strip), "\n"))


def or_else(text: Column, other: str) -> Column:
    """``other`` where the text is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(other)).otherwise(text)


def render_thread(ticket_id: Column, date: Column, subject: Column, body: Column, comments: Column) -> Column:
    """A ticket's thread as one text. ``comments``: array of structs with kind, role,
    created_at and body, in order; null is like none."""

    def one(c: Column, i: Column) -> Column:
        head = F.concat(F.lit(f"{COMMENT} "), (i + 1).cast("string"), F.lit(" — "), c["role"], F.lit(", "), c["created_at"], F.lit(" (typ: "), c["kind"], F.lit("):"))
        return F.concat(F.lit("\n"), head, F.lit("\n"), or_else(c["body"], EMPTY_COMMENT))

    told = F.when(F.coalesce(F.size(comments), F.lit(0)) <= 0, F.lit(f"\n{NO_COMMENTS}")).otherwise(F.array_join(F.transform(comments, one), "\n"))
    head = F.concat(F.lit(f"{TICKET} "), ticket_id, F.lit(" z "), date.cast("string"))
    return F.concat_ws("\n", head, F.concat(F.lit(f"{SUBJECT}: "), F.coalesce(subject, F.lit(""))), F.lit(""), F.lit(f"{BODY}:"), or_else(body, NO_BODY), told)


def thread_chars(body: Column, comments: Column) -> Column:
    """Characters of a thread as measured for the context window."""
    own = F.length(strip_html_to_measure(body))
    return own + F.aggregate(F.coalesce(comments, F.array()), F.lit(0), lambda n, c: n + F.length(strip_html_to_measure(c["body"])))


def embedding_text(*fields: Column) -> Column:
    """The text that is embedded: the fields, one below the other. Fields are validated
    before (a null field is skipped)."""
    return F.concat_ws("\n", *fields)


def strip_fence(text: Column) -> Column:
    """Without a Markdown code fence at either end."""
    return strip(F.regexp_replace(text, r"(?i)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def strip_editorial(text: Column) -> Column:
    """Without ``<!-- -->`` comments and the white space after them."""
    return F.regexp_replace(text, r"(?s)<!--.*?-->\s*", "")


def section(document: str, heading: str) -> str:
    """Text below a heading, up to the next second-level heading; driver-side."""
    return document.split(heading, 1)[1].split("\n## ", 1)[0].strip() if heading in document else ""


def render_vocabulary(classes: Column) -> Column:
    """Lines ``- name: hint`` of an array of structs."""
    return F.array_join(F.transform(classes, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["hint"])), "\n")


def parse_prompt(template: str, thread: Column, vocabulary: Column) -> Column:
    """The vocabulary is put in first, then the thread."""
    return F.replace(F.replace(F.lit(template), F.lit("{{vocabulary}}"), vocabulary), F.lit("{{thread}}"), thread)


def tokens_estimate(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def evidence(text: Column, length: int = 80) -> Column:
    return F.substring(strip(text), 1, length)


def clipped(text: Column, length: int) -> Column:
    """For display: at most ``length`` characters, the last one an ellipsis if cut."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def format_duration(seconds: Column) -> Column:
    """``42s``, ``2min 05s``, ``1h 04min``; seconds round half to even."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(seconds < 90, F.concat(F.bround(seconds, 0).cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("min "), two(whole % 60), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("long").cast("string"), F.lit("h "), two(minutes % 60), F.lit("min")))
    )


def model_alias(model: Column) -> Column:
    """A model id without its date, in either of two spellings."""
    return F.regexp_replace(model, r"-\d{4}-\d{2}-\d{2}$|-\d{8}$", "")


def has_phrase(text: Column, phrases: Sequence[str]) -> Column:
    return text.rlike(phrase_pattern(phrases))


def phrase_pattern(phrases: Sequence[str]) -> str:
    """Any phrase as whole words, whatever the case, in the Unicode sense."""
    return rf"(?iu)(?<!{WORD})(?:{'|'.join(phrases)})(?!{WORD})"


def words_beside(text: Column, phrases: Sequence[str]) -> Column:
    """Number of words once the phrases are taken out."""
    return F.regexp_count(F.regexp_replace(text, phrase_pattern(phrases), ""), F.lit(rf"{WORD}+"))
