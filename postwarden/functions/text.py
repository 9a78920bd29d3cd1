"""Text cleaning, counting and flag expressions (Column -> Column)."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from postwarden.functions import fixed as fx
from postwarden.functions import references


# Intersections let the regex engine reject ordinary letters on the first range.
SPACE = rf"[\x09-\x20\x{{85}}-\x{{3000}}&&[{fx.WHITE}]]"
DIGITS = rf"0-9[\x{{B2}}-\x{{10FFFF}}&&[{fx.DIGIT}]]"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _sum(parts: Iterable[Column]) -> Column:
    return reduce(add, parts)


def any_of(terms: Iterable[str], tail: str = "") -> str:
    """Regex that matches any of the literal ``terms``."""
    return "(?:" + "|".join(re.escape(t) for t in terms) + ")" + tail


# --- counting ---------------------------------------------------------------


def occurrences(text, term: str) -> Column:
    """Non-overlapping occurrences of a literal; byte lengths avoid recounting characters."""
    text = _col(text)
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(term), F.lit("")))
    width = len(term.encode())
    return removed.cast("int") if width == 1 else (removed / F.lit(width)).cast("int")


def _quoted(term: str) -> str:
    return "'" + term.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyword_occurrences(text: str | Column, terms: Iterable[str]) -> Column:
    """Sum of occurrences over the list.  Terms may overlap, so each is counted alone.

    Over a named column this is one SQL expression, which is much quicker to
    build than a tree of several hundred column objects.
    """
    if isinstance(text, Column):
        return _sum(occurrences(text, t) for t in terms)
    by_width: dict[int, list[str]] = {}
    for t in terms:
        by_width.setdefault(len(t.encode()), []).append(t)
    sums = []
    for width, group in by_width.items():
        # A search alone is much quicker than a replacement, and most terms don't occur.
        left = " + ".join(
            f"octet_length(if(contains({text}, {q}), replace({text}, {q}, ''), {text}))" for q in map(_quoted, group)
        )
        sums.append(f"({len(group)} * octet_length({text}) - ({left})) div {width}")
    return F.expr(f"cast({' + '.join(f'({x})' for x in sums)} as int)")


def keywords_present(text: str | Column, terms: Iterable[str]) -> Column:
    """How many of the listed terms occur at least once."""
    if isinstance(text, Column):
        return _sum(text.contains(F.lit(t)).cast("int") for t in terms)
    return F.expr(" + ".join(f"cast(contains({text}, {_quoted(t)}) as int)" for t in terms))


def contains_any(text: str | Column, terms: Iterable[str]) -> Column:
    if isinstance(text, Column):
        return reduce(lambda a, b: a | b, (text.contains(F.lit(t)) for t in terms))
    return F.expr("(" + " or ".join(f"contains({text}, {_quoted(t)})" for t in terms) + ")")


def chars_in(text, char_class: str) -> Column:
    """Characters inside a regex class body, counted by deleting runs of them."""
    text = _col(text)
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def pattern_count(text, pattern: str, needs: str | None = None) -> Column:
    """Matches of ``pattern``; texts without the literal ``needs`` skip the regex."""
    text = _col(text)
    n = F.regexp_count(text, F.lit(pattern))
    return n if needs is None else F.when(text.contains(F.lit(needs)), n).otherwise(F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(F.lit(1), whole)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


# --- cleaning ---------------------------------------------------------------


def squeeze(text) -> Column:
    """Collapse every run of white space to one blank and trim."""
    return F.trim(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def strip_tags(text) -> Column:
    return F.regexp_replace(_col(text), fx.TAG, " ")


def unescape_html(text: str | Column) -> Column:
    """Decode character references."""
    return references.unescape_html(_col(text))


def clean_text(text, order: str = "tags_first") -> Column:
    """Plain text from markup: ``tags_first`` strips then decodes, ``entities_first`` the reverse."""
    text = F.coalesce(_col(text), F.lit(""))
    if order == "tags_first":
        return squeeze(unescape_html(strip_tags(text)))
    if order == "entities_first":
        return squeeze(strip_tags(unescape_html(text)))
    raise ValueError(f"unknown order {order!r}")


def html_to_text(markup) -> Column:
    """Visible text of a page: script and style blocks and comments go first."""
    markup = F.coalesce(_col(markup), F.lit(""))
    no_blocks = F.regexp_replace(
        markup, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " "
    )
    return clean_text(no_blocks)


def safe_text(text) -> Column:
    """Training-side normalisation: decode references, then squeeze white space."""
    return squeeze(F.coalesce(unescape_html(text), F.lit("")))


def bytes_to_text(raw) -> Column:
    """UTF-8 bytes to string; invalid sequences are dropped."""
    valid = F.make_valid_utf8(_col(raw).cast("string"))
    return F.replace(valid, F.lit("\ufffd"), F.lit(""))


def map_text(mapping) -> Column:
    """A string map as JSON text with a blank after ``:`` and ``,``; null or empty gives ''."""
    mapping = _col(mapping)

    def quoted(c: Column) -> Column:
        for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(raw), F.lit(escaped))
        return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))

    pairs = F.transform(
        F.map_entries(mapping),
        lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])),
    )
    body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return F.coalesce(F.when(F.size(mapping) > 0, body), F.lit(""))


def redact_pii(text) -> Column:
    """Mask addresses and digit runs of six or more."""
    # Starts inside a run are left out: the first one has matched or none can, so time stays linear.
    masked = F.when(
        _col(text).contains("@"),
        F.regexp_replace(_col(text), f"(?<![{fx.WORD}.-])" + fx.PII_ADDRESS, "[REDACTED_EMAIL]"),
    ).otherwise(_col(text))
    return F.regexp_replace(
        masked, f"(?<![{fx.WORD}])[0-9]{{6,}}(?![{fx.WORD}])", "[REDACTED_NUMBER]"
    )


# --- scores and labels ------------------------------------------------------


def semantic_score(text, keyed: bool = False) -> Column:
    """0.15 per listed keyword present, at most 1; the keyed variant scales by 1.1."""
    hits = keywords_present(F.lower(F.coalesce(_col(text), F.lit(""))), fx.SEMANTIC_KEYWORDS)
    score = F.least(F.lit(1.0), hits * F.lit(0.15))
    return F.least(F.lit(1.0), score * F.lit(1.1)) if keyed else score


def label_code(label) -> Column:
    """0 ham, 1 spam, 2 phishing; null for anything unmapped."""
    pairs = [F.lit(x) for kv in fx.LABEL_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), squeeze(F.lower(_col(label).cast("string"))))


# --- statistics of one text -------------------------------------------------


def upper_words(text, min_len: int = 2) -> Column:
    """Words made only of ASCII capitals, at least ``min_len`` long, at Unicode word bounds."""
    return F.regexp_count(
        _col(text), F.lit(f"(?<![{fx.WORD}])[A-Z]{{{min_len},}}(?![{fx.WORD}])")
    )


def shouted_words(squeezed) -> Column:
    """Words over three characters that have capitals and nothing in lower case."""
    return F.size(
        F.filter(
            F.split(_col(squeezed), " "),
            lambda w: (F.octet_length(w) > 3)
            & (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 3),
        )
    )


def text_stats(text, squeezed, prefix: str, special: str) -> dict[str, Column]:
    """Length, words and character class ratios.

    ``squeezed`` is the text with single blanks, so blanks + 1 is the word
    count and no array of words is built.
    """
    text, squeezed = _col(text), _col(squeezed)
    length = F.length(text)
    blanks = occurrences(squeezed, " ")
    words = F.when(F.octet_length(squeezed) > 0, blanks + 1).otherwise(F.lit(0))
    return {
        f"{prefix}_text_length": length,
        f"{prefix}_word_count": words,
        f"{prefix}_avg_word_length": ratio(F.length(squeezed) - blanks, words),
        f"{prefix}_uppercase_ratio": ratio(chars_in(text, r"\p{IsUppercase}"), length),
        f"{prefix}_digit_ratio": ratio(chars_in(text, DIGITS), length),
        f"{prefix}_special_char_ratio": ratio(chars_in(text, special), length),
        f"{prefix}_exclamation_count": occurrences(text, "!"),
        f"{prefix}_question_count": occurrences(text, "?"),
    }
