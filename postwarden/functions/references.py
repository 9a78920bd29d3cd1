"""Character references of HTML, decoded by column functions.

A text is split at its ampersands, and what follows each one is decoded by itself, so a decoded ampersand never starts another
reference.  Named references come from the public HTML5 table.  A name without a semicolon counts where the table has it that
way; of several that fit, the longest one.  Numeric references follow the HTML rules: 0, surrogates and numbers beyond Unicode
give the replacement character, 128 to 159 mean the Windows code page, and other control characters and noncharacters vanish.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "�"
BEYOND = 0x110000


def _closed_names() -> str:
    """JSON of names that end in a semicolon, by their first character, so that a lookup passes few of them."""
    by_first: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        if name.endswith(";"):
            by_first.setdefault(name[0], {})[name] = text
    return json.dumps(by_first)


def _windows_characters() -> list[str]:
    """The characters of 128 to 159 in the Windows code page; the undefined ones stand for themselves."""
    texts = []
    for n in range(128, 160):
        try:
            texts.append(bytes([n]).decode("cp1252"))
        except UnicodeDecodeError:
            texts.append(chr(n))
    return texts


_OPEN = {name: text for name, text in html5.items() if not name.endswith(";")}
_OPEN_NAMES = "^(?:" + "|".join(re.escape(n) for n in sorted(_OPEN, key=lambda n: (-len(n), n))) + ")"
_NAME = r"^[^\t\n\f <&#;]{1,32};?"
_NUMBER = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _behind(text: Column, head: Column) -> Column:
    return F.substr(text, F.length(head) + 1)


def _character(code: Column) -> Column:
    whole = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    vanish = (
        code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
        | (code % 0x10000 >= 0xFFFE)
    )
    windows = F.array(*[F.lit(c) for c in _windows_characters()])
    return (
        F.when((code == 0) | code.between(0xD800, 0xDFFF) | (code >= BEYOND), REPLACEMENT)
        .when(code.between(128, 159), F.get(windows, code - 128))
        .when(vanish, "").otherwise(whole)
    )


def _code(reference: Column) -> Column:
    """The number of a numeric reference, ``BEYOND`` for all that are too large."""
    sixteen = F.substr(reference, F.lit(2), F.lit(1)).isin("x", "X")
    digits = F.regexp_replace(reference, "^#[xX]?0*|;$", "")
    large = F.length(digits) > F.when(sixteen, 6).otherwise(7)
    number = F.when(digits == "", "0").when(sixteen, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    return F.when(large, BEYOND).otherwise(F.least(number, F.lit(BEYOND)))


def _named(part: Column, name: Column) -> Column:
    closed = F.from_json(F.lit(_closed_names()), "map<string,map<string,string>>")
    found = F.try_element_at(F.try_element_at(closed, F.substr(name, F.lit(1), F.lit(1))), name)
    names = F.from_json(F.lit(json.dumps(_OPEN)), "map<string,string>")
    start = _let(
        F.regexp_extract(name, _OPEN_NAMES, 0),
        lambda n: F.when(n == "", F.concat(F.lit("&"), part)).otherwise(
            F.concat(F.try_element_at(names, n), _behind(part, n))
        ),
    )
    whole = F.endswith(name, F.lit(";"))
    return _let(
        F.when(whole, found), lambda text: F.when(text.isNotNull(), F.concat(text, _behind(part, name))).otherwise(start)
    )


def _decoded(part: Column) -> Column:
    """What follows an ampersand, with the reference at its start decoded."""
    number = _let(
        F.regexp_extract(part, _NUMBER, 0),
        lambda n: F.when(n == "", F.concat(F.lit("&"), part)).otherwise(
            F.concat(_let(_code(n), _character), _behind(part, n))
        ),
    )
    name = _let(F.regexp_extract(part, _NAME, 0), lambda n: _named(part, n))
    return F.when(F.startswith(part, F.lit("#")), number).otherwise(name)


def unescape_html(text: Column) -> Column:
    """Decodes character references; texts without an ampersand are left alone."""
    parts = F.split(text, "&")
    decoded = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(_decoded(part)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)
