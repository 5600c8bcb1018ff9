"""String columns: cleaning, tag lists, tokens, previews."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's ``\s`` matches (Java's ``\s`` is ASCII
# only) as text and as a pattern, the token pattern, and the control characters
# spreadsheets reject.
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
TOKEN = "[a-z0-9]{2,}"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# One item of a list literal: a string in either quote with backslash escapes, a number, or a named constant.
_ITEM = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|None|True|False"""
_ESCAPE = r"(?s)\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\.|[^\\]+"
_LIST = rf"(?s)^\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*,?\s*)?\]$"


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim whitespace of any kind on both ends."""
    return F.trim(_as_column(c), F.lit(WHITESPACE_CHARACTERS))


def clean_text(c: Column | str) -> Column:
    """Null to empty, whitespace runs to one space, trimmed.

    Mapping characters first leaves a trivial pattern for the runs, which takes
    half the time of a pattern that knows all of them.
    """
    filled = F.coalesce(_as_column(c).cast("string"), F.lit(""))
    spaced = F.translate(filled, WHITESPACE_CHARACTERS, " " * len(WHITESPACE_CHARACTERS))
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_as_column(c), F.lit(""))


def parse_tags(c: Column | str) -> Column:
    """``"['a', 'b']"`` to ``"a, b"``.

    Accepted list literals are comma separated strings, numbers and the
    constants None, True and False; anything else in the cell (plain text,
    broken or nested literals) passes through trimmed.
    """
    text = strip(F.coalesce(_as_column(c), F.lit("")))
    found = F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0))
    inner = lambda q: _unescape(F.substring(q, F.lit(2), F.length(q) - 2))
    items = F.transform(found, lambda q: strip(F.when(q.rlike("^['\"]"), inner(q)).otherwise(q)))
    joined = F.array_join(F.filter(items, lambda x: x != ""), ", ")
    return F.when(text.rlike(_LIST), joined).otherwise(text)


def _unescape(c: Column) -> Column:
    """Backslash escapes of a string literal; an unknown one stays as written."""
    named = F.create_map(*[F.lit(x) for pair in zip("ntr'\"\\", "\n\t\r'\"\\") for x in pair])

    def piece(p: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(p, 3, 4), 4, "0")), "UTF-16BE")
        return (
            F.when(p.rlike(r"^\\[ux]..") & (F.length(p) >= 4), code)
            .when(p.startswith("\\"), F.coalesce(F.try_element_at(named, F.substring(p, 2, 1)), p))
            .otherwise(p)
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_ESCAPE), F.lit(0)), piece), "")


def first_tag(tags: Column | str) -> Column:
    return F.trim(F.split_part(_as_column(tags), F.lit(","), F.lit(1)))


def tokens(c: Column | str) -> Column:
    """Lower-case alphanumeric tokens of two or more characters, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(_as_column(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    """Whitespace separated words."""
    return F.filter(F.split(_as_column(c), f"{WHITESPACE}+"), lambda w: w != "")


def token_estimate(c: Column | str) -> Column:
    """Rough model-token count: two per word."""
    return F.size(words(F.coalesce(_as_column(c), F.lit("")))) * 2


def preview(c: Column | str, limit: int, ellipsis: str = "…") -> Column:
    """The first ``limit`` characters, with an ellipsis where text was cut."""
    c = _as_column(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ellipsis))).otherwise(c)


def drop_control_characters(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_as_column(c), F.lit("")), CONTROL, "")


def contains_any(text: Column | str, keywords: Column | str) -> Column:
    """Whether any keyword of an array occurs in ``text``, ignoring case."""
    lowered = F.lower(_as_column(text))
    return F.exists(_as_column(keywords), lambda k: F.contains(lowered, F.lower(k)))
