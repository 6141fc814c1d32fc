"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII punctuation.
PUNCT = r"""[!-/:-@\[-`{-~]"""
#: The accented letters folded by simplify, and what they become.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
FALSE_WORDS = ("false", "0", "no", "n", "off")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
FLAGS = {"i": "i", "m": "m", "s": "s", "x": "x"}


def simplify(c: Column) -> Column:
    """Lower case without ASCII punctuation, white space runs as one space, trimmed, listed accents folded."""
    bare = F.regexp_replace(F.lower(c), PUNCT, "")
    return F.translate(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), ACCENTED, PLAIN)


def simplify_text(s: str) -> str:
    """The same for a parameter."""
    bare = re.sub(r"\s+", " ", re.sub(PUNCT, "", s.lower())).strip()
    return bare.translate(str.maketrans(ACCENTED, PLAIN))


def truthy(c: Column, kind: T.DataType) -> Column:
    """Python's truth of a value: null, "", 0 and empty collections are false."""
    if isinstance(kind, T.BooleanType):
        yes = c
    elif isinstance(kind, T.StringType):
        yes = c != ""
    elif isinstance(kind, T.NumericType):
        yes = c != 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        yes = F.size(c) > 0
    else:
        yes = c.isNotNull()
    return F.coalesce(yes, F.lit(False))


def to_bool(c: Column) -> Column:
    """Text as a boolean: all but the listed words and the empty text are true."""
    s = F.trim(F.lower(c))
    return F.when(c.isNull() | (c == ""), False).otherwise(~s.isin(*FALSE_WORDS))


def java_regex(pattern: str, flags: str = "") -> str:
    """A Python pattern for Java's engine: named groups, end of text, Unicode classes."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    out = out.replace(r"\Z", r"\z")
    inline = "".join(FLAGS[f] for f in flags.lower() if f in FLAGS) + ("" if "a" in flags.lower() else "U")
    return (f"(?{inline})" if inline else "") + out


def matches_at_start(c: Column, pattern: str, flags: str = "") -> Column:
    head = re.match(r"\(\?[a-zA-Z]+\)", j := java_regex(pattern, flags))
    inline, body = (head[0], j[head.end() :]) if head else ("", j)
    return c.rlike(f"{inline}\\A(?:{body})")


def word_count(c: Column) -> Column:
    """Words of more than two letters once punctuation is deleted."""
    words = F.split(F.regexp_replace(c, r"(?U)[^\w\s]", ""), r"(?U)\s+")
    return F.size(F.filter(words, lambda w: F.length(w) > 2))


def split_literal(c: Column, separator: str) -> Column:
    """Parts between a literal separator, stripped, empty ones dropped."""
    parts = F.transform(F.split(c, re.escape(separator)), strip)
    return F.filter(parts, lambda x: x != "")


def strip(c: Column) -> Column:
    """Python's strip: all white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_refs(c: Column) -> Column:
    """Without citations of one or two digits in brackets."""
    return F.regexp_replace(c, r"\[\d{1,2}\]", "")


def remove_ref_lists(c: Column) -> Column:
    """Without citations of any number of figures, comma-joined."""
    return F.regexp_replace(c, r"\[\d+(?:,\s*\d+)*\]", "")


def between(c: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing bracket, line feeds and tabs as spaces; empty if there are none."""
    flat = F.translate(c, "\n\t", "  ")
    return F.regexp_extract(flat, f"(?s){re.escape(opening)}.*{re.escape(closing)}", 0)


def longest_bracket(c: Column) -> Column:
    """The longer of the object and the list in a text."""
    a, b = between(c, "{", "}"), between(c, "[", "]")
    return F.when(F.length(b) > F.length(a), b).otherwise(a)


def month_year(c: Column) -> Column:
    """``June 2020`` of an ISO date text, null if it is none."""
    d = F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    return F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d)), F.year(d).cast("string"))


#: Second labels under which country domains are registered.
SECOND = ("ac", "asn", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "id", "k12", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch", "web")


def domain_of(url: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """Registered domain: one label more than the public suffix.

    A suffix has two labels if it is listed in ``suffixes`` or if it is a country's (two letters) below one of ``SECOND``, else one. The full list of public
    suffixes changes by the week and isn't part of this library: callers who need its exceptions pass them.
    """
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    upto = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    two = upto(2)
    wide = two.rlike(rf"^(?:{'|'.join(SECOND)})\.[a-z]{{2}}$")
    return F.when(two.isin(*suffixes) | wide if suffixes else wide, upto(3)).otherwise(two)


def render_date_refs(num: Column, date: Column, text: Column) -> Column:
    """Each part of a text between ``STOP`` marks behind ``[num] (Month Year)``, or ``[num]`` where the date can't be read."""
    when = month_year(date)
    head = F.when(when != "", F.concat(F.lit("["), num, F.lit("] ("), when, F.lit(") "))).otherwise(F.concat(F.lit("["), num, F.lit("] ")))
    return F.array_join(F.transform(split_literal(text, "STOP"), lambda p: F.concat(head, p)), "\n")
