"""Text rules shared by the parsers and the sinks.

The formats on the wire are defined in terms of Python text (``str.strip``, ``str.splitlines``,
``repr(float)``, ASCII-only JSON), so these helpers state those rules as built-in Spark
expressions. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode calls white space, plus the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: every line terminator of str.splitlines; \R lacks the three separators.
LINE_BREAK = r"\R|[\x1c-\x1e]"
# What \w and identifiers mean for Unicode text.
WORD = r"\p{L}\p{N}_"
IDENTIFIER = r"[\p{L}\p{Nl}][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_identifier(text: Column) -> Column:
    """A name that starts with a letter (so not with ``_``) and has no dots or hyphens."""
    return text.rlike(f"^{IDENTIFIER}\\z")


# Fixed value: the float grammar, ASCII digits with optional single underscores between them.
_DIGITS = r"[0-9]++(?:_[0-9]++)*+"
FLOAT_TEXT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)\z"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_float(text: Column) -> Column:
    """Strict float parse, NULL when the text is not a float.

    A plain cast is laxer: it takes ``1.0d`` and hexadecimal floats.
    """

    def general(bare: Column) -> Column:
        plain = F.replace(F.lower(bare), F.lit("_"), F.lit(""))
        number = F.when(plain.isin("+nan", "-nan"), F.lit("nan")).otherwise(plain).try_cast("double")
        return F.when(bare.rlike(FLOAT_TEXT), number)

    return F.when(text.rlike(r"^-?[0-9]++(?:\.[0-9]++)?\z"), text.try_cast("double")).otherwise(
        let(strip(text), general)
    )


def _shortest(value: Column) -> Column:
    """Shortest decimal text that reads back as ``value``, in the notation of a plain cast.

    Before JDK 19 the cast may give a digit too many, which only shows from 16 digits on.
    """
    java = value.cast("string")
    digits = F.length(F.regexp_replace(F.substring_index(java, "E", 1), r"^-?[0.]*|\.", ""))
    out = F.when(digits < 16, java)
    for decimals in (14, 15, 16):
        shorter = F.upper(F.format_string(f"%.{decimals}e", value))
        out = out.when(shorter.try_cast("double") == value, shorter)
    return out.otherwise(java)


def _scientific(short: Column, exponent: Column) -> Column:
    mantissa = F.rtrim(F.rtrim(F.substring_index(short, "E", 1), F.lit("0")), F.lit("."))
    digits = F.abs(exponent).cast("string")
    sign = F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+"))
    return F.concat(mantissa, sign, F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))


def _plain(short: Column) -> Column:
    text = F.rtrim(short.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    return let(text, lambda t: F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t))


def float_text(value: Column) -> Column:
    """Shortest float text: plain between 1e-4 and 1e16, ``1e+16`` and ``1e-05`` beyond."""
    value = value.cast("double")
    java = value.cast("string")

    def render(short: Column) -> Column:
        exponent = F.substring_index(short, "E", -1).try_cast("int")
        shown = let(exponent, lambda e: F.when(e.between(-4, 15), _plain(short)).otherwise(_scientific(short, e)))
        return F.when(short.contains("E"), shown).otherwise(short)

    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == F.lit(float("inf")), F.lit("inf"))
        .when(value == F.lit(float("-inf")), F.lit("-inf"))
        .when(~java.contains("E") & (F.length(java) <= 16), java)
        .when(value.isNotNull(), let(_shortest(value), render))
    )


# Characters with a short escape in JSON, by code point.
JSON_ESCAPES = {34: '\\"', 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t", 8: "\\b", 12: "\\f"}


def _json_piece(piece: Column) -> Column:
    """A run of plain characters as it is, a single other character as its ASCII escape."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(code: Column) -> Column:
        beyond = code - 0x10000
        pair = F.concat(
            unit(F.lit(0xD800) + F.shiftright(beyond, 10)), unit(F.lit(0xDC00) + beyond.bitwiseAND(F.lit(0x3FF)))
        )
        out = F.when(code.between(32, 126) & ~code.isin(34, 92), piece)
        for special, text in JSON_ESCAPES.items():
            out = out.when(code == special, F.lit(text))
        return out.when(code < 0x10000, unit(code)).otherwise(pair)

    return let(F.ascii(piece), escape)


def json_string(text: Column) -> Column:
    """Quoted JSON string in ASCII; only text outside printable ASCII is taken to pieces."""
    short = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)([ !#-\[\]-~]++|.)"), F.lit(1))
    wide = F.array_join(F.transform(pieces, _json_piece), "")
    body = F.when(text.rlike("[^ -~]"), wide).otherwise(short)
    return F.concat(F.lit('"'), body, F.lit('"'))


def name_uuid(text: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version-5 UUID of ``text``; the default namespace is the DNS one of RFC 4122."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(text, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
