"""Scalar text functions. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value for a key in a small fixed table; null when missing. Folds to a literal map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def trim_ws(c: ColumnOrName) -> Column:
    """Strip every kind of white space from both ends."""
    return F.trim(col(c), F.lit(fixed.WHITE_SPACE))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def decode_entities(c: ColumnOrName) -> Column:
    """The three entities a translation engine adds; one pass, ``&amp;`` last."""
    return replace_all(col(c), [("&#39;", "'"), ("&quot;", '"'), ("&amp;", "&")])


def escape_html(c: ColumnOrName) -> Column:
    return replace_all(
        col(c),
        [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")],
    )


def unescape_html(c: ColumnOrName) -> Column:
    """Inverse of :func:`escape_html`, plus ``&#39;`` and ``&nbsp;``."""
    return replace_all(
        col(c),
        [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"),
         ("&nbsp;", "\xa0"), ("&amp;", "&")],
    )


def strip_tags(c: ColumnOrName) -> Column:
    """One blank for each tag; an unclosed tag at the end goes as well."""
    return F.regexp_replace(col(c), r"<[^>]*>?", " ")


_BODY = r"(?i)<body[^>]*>([\s\S]*?)</body>"


def extract_body(c: ColumnOrName) -> Column:
    """Inner HTML of the first body element, or the input when there is none."""
    c = col(c)
    return F.when(F.regexp_like(c, F.lit(_BODY)), F.regexp_extract(c, _BODY, 1)).otherwise(c)


_FENCE = "```"


def strip_code_fence(c: ColumnOrName, variant: str = "plain") -> Column:
    """Remove a Markdown fence around a model's answer.

    ``plain``: first and last line go when there are more than two lines.
    ``batch``: like plain, then trimmed. ``safe``: the last line goes only when it is
    a fence, then trimmed. ``review``: first and last line always go, then trimmed.
    """
    text = trim_ws(c)
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 2, F.lit(0))), "\n")
    if variant == "review":
        body = trim_ws(inner)
    elif variant == "safe":
        keep_last = trim_ws(F.element_at(lines, -1)) != _FENCE
        rest = F.array_join(F.slice(lines, F.lit(2), n - 1), "\n")
        body = F.when(n > 2, trim_ws(F.when(keep_last, rest).otherwise(inner))).otherwise(text)
    elif variant in ("plain", "batch"):
        body = F.when(n > 2, trim_ws(inner) if variant == "batch" else inner).otherwise(text)
    else:
        raise ValueError(f"unknown fence variant: {variant}")
    return F.when(F.startswith(text, F.lit(_FENCE)), body).otherwise(text)


def output_name(filename: ColumnOrName, ext: str) -> Column:
    base = F.regexp_replace(col(filename), r"(?i)\.(docx|pdf)$", "")
    base = F.when(base == "", None).otherwise(base)
    return F.concat(F.lit("translated_"), F.coalesce(base, F.lit("document")), F.lit(ext))


def map_symbols(c: ColumnOrName, font: ColumnOrName | None = None) -> Column:
    """Symbol-font code points to Unicode glyphs; with ``font``, only where it is Wingdings."""
    c = col(c)
    mapped = F.translate(c, fixed.SYMBOLS_FROM, fixed.SYMBOLS_TO)
    return mapped if font is None else F.when(col(font) == "Wingdings", mapped).otherwise(c)


def segment_key(c: ColumnOrName) -> Column:
    """32-byte content key: joins move it instead of the text."""
    return F.unhex(F.sha2(col(c), 256))
