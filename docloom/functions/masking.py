"""Hide what a translator must not touch behind numbered tokens, and bring it back.

A mask is a struct ``(text, term_map)``; ``term_map`` is an array of
``(token, original)`` in the order the tokens were made. Restoring reads whole tokens,
so ``…_1`` never damages ``…_10``, and takes brackets before the terms inside them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.fixed import PROTECTED_TERMS
from docloom.functions.text import ColumnOrName, col

STYLE = r"<style[^>]*>[\s\S]*?</style>"
IMAGE = r"""src="data:image/[^"']+"|src='data:image/[^"']+'"""
BRACKET = r"(?d)\[\[.*?\]\]"

EMPTY_MAP = "array<struct<token:string,original:string>>"


def _entry(token: Column, original: Column) -> Column:
    return F.struct(token.alias("token"), original.alias("original"))


def _mask(text: Column, term_map: Column) -> Column:
    return F.struct(text.alias("text"), term_map.alias("term_map"))


def _numbered(c: Column, pattern: str, token, shown, original) -> Column:
    """Replace the k-th match by ``shown(token, match)`` and remember ``original(match)``.

    Parts and matches are zipped before the lambda: what a lambda reads from outside would
    be computed again for every element.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.split(c, pattern, -1).alias("part"), found.alias("match"))
    text = F.array_join(
        F.transform(
            pairs,
            lambda x, i: F.when(
                x["match"].isNotNull(), F.concat(x["part"], shown(token(i), x["match"]))
            ).otherwise(x["part"]),
        ),
        "",
    )
    return _mask(text, F.transform(found, lambda m, i: _entry(token(i), original(m))))


def _token(prefix: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), i.cast("string"), F.lit(suffix))


def mask_styles(html: ColumnOrName) -> Column:
    return _numbered(
        col(html), STYLE,
        token=lambda i: _token("STYLE_PLACEHOLDER_", i),
        shown=lambda t, m: F.concat(F.lit('<div class="'), t, F.lit('"></div>')),
        original=lambda m: m,
    )


def mask_images(html: ColumnOrName) -> Column:
    def quoted(t: Column, m: Column) -> Column:
        quote = F.substring(m, 5, 1)
        return F.concat(F.lit("src="), quote, t, quote)

    return _numbered(
        col(html), IMAGE,
        token=lambda i: _token("IMG_PLACEHOLDER_", i),
        shown=quoted,
        original=lambda m: F.substr(m, F.lit(6), F.length(m) - 6),
    )


def mask_brackets(c: ColumnOrName, prefix: str = "") -> Column:
    """``[[…]]`` on one line becomes ``__BRACKET_j__``; prefix ``R`` is the review form."""
    return _numbered(
        col(c), BRACKET,
        token=lambda i: _token(f"__{prefix}BRACKET_", i, "__"),
        shown=lambda t, m: t,
        original=lambda m: m,
    )


def mask_terms(
    c: ColumnOrName, terms: list[str] | None = None, prefix: str = "",
    html: bool = False, whole_word: bool = False,
) -> Column:
    """Hide protected terms, in list order, each occurrence, as plain substrings.

    Only terms that are present enter the map. ``html`` also looks for the escaped
    form of a term (``L&amp;T``); ``whole_word`` leaves terms inside longer words alone.
    """
    terms = PROTECTED_TERMS if terms is None else terms
    c = col(c)
    if not terms:
        return _mask(c, F.array().cast(EMPTY_MAP))
    rows = []
    for i, term in enumerate(terms):
        forms = [(term, f"__{prefix}TERM_{i}__")]
        escaped = term.replace("&", "&amp;")
        if html and escaped != term:
            forms.append((escaped, f"__{prefix}TERM_{i}A__"))
        rows += forms
    table = F.array(
        *[F.struct(F.lit(t).alias("term"), F.lit(k).alias("token"),
                   F.lit(_word_pattern(t)).alias("pattern")) for t, k in rows]
    )

    def step(acc: Column, row: Column) -> Column:
        if whole_word:
            hit = F.regexp_like(acc["text"], row["pattern"])
            text = F.regexp_replace(acc["text"], row["pattern"], row["token"])
        else:
            hit = F.contains(acc["text"], row["term"])
            text = F.replace(acc["text"], row["term"], row["token"])
        entry = F.array(_entry(row["token"], row["term"]))
        return F.when(hit, _mask(text, F.concat(acc["term_map"], entry))).otherwise(acc)

    return F.aggregate(table, _mask(c, F.array().cast(EMPTY_MAP)), step)


def _word_pattern(term: str) -> str:
    return r"(?<![\p{L}\p{N}])" + re.escape(term) + r"(?![\p{L}\p{N}])"


def mask_protected(c: ColumnOrName, terms: list[str] | None = None, prefix: str = "",
                   html: bool = False) -> Column:
    """Terms first, then ``[[…]]`` tokens, with one map for both."""
    by_term = mask_terms(c, terms, prefix, html)
    by_bracket = F.transform(
        F.array(by_term),
        lambda m: F.struct(m["term_map"].alias("head"), mask_brackets(m["text"], prefix).alias("tail")),
    )
    both = F.transform(
        by_bracket,
        lambda m: _mask(m["tail"]["text"], F.concat(m["head"], m["tail"]["term_map"])),
    )
    return F.get(both, F.lit(0))


def has_protected(c: ColumnOrName, html: bool = False) -> Column:
    """Whether there is anything to mask: one look instead of a fold over all terms. ``html``
    reads an escaped text as plain."""
    text = F.replace(col(c), F.lit("&amp;"), F.lit("&")) if html else col(c)
    return F.regexp_like(text, F.lit(rf"{terms_pattern()}|\[\["))


BRACKET_TOKEN = r"__R?BRACKET_[0-9]+__"
TERM_TOKEN = r"__R?TERM_[0-9]+A?__"
IMAGE_TOKEN = r"IMG_PLACEHOLDER_[0-9]+"
STYLE_TOKEN = r"STYLE_PLACEHOLDER_[0-9]+"
STYLE_DIV = r'<div class="(STYLE_PLACEHOLDER_[0-9]+)"\s*>\s*</div>'


def _lookup(known: Column, numbered: Column, token: Column) -> Column:
    """Original of a token. Numbered tokens stand at their number, so no search is needed."""
    number = F.regexp_extract(token, r"([0-9]+)", 1).try_cast("int")
    at = F.get(numbered, number)
    return F.coalesce(F.when(at["token"] == token, at["original"]), F.try_element_at(known, token))


def _restore(c: Column, entries: Column, pattern: str, numbered: str = "") -> Column:
    """One pass over the text: every match of ``pattern`` whose token is known is replaced.

    A replace for each token would read a long text once for each of its tokens. Text and
    map are bound in a struct first, so the lambda does not compute them per match.
    ``numbered`` is the head of tokens that are numbered 0, 1, … without gaps.
    """
    bound = F.array(F.struct(
        F.arrays_zip(F.split(c, pattern, -1).alias("part"),
                     F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("match")).alias("pairs"),
        F.map_from_entries(entries).alias("known"),
        F.filter(entries, lambda e: F.startswith(e["token"], F.lit(numbered))).alias("numbered")))

    def text(b: Column) -> Column:
        def one(x: Column) -> Column:
            original = _lookup(b["known"], b["numbered"], x["match"])
            return F.concat(x["part"], F.coalesce(original, x["match"], F.lit("")))

        return F.array_join(F.transform(b["pairs"], one), "")

    return F.get(F.transform(bound, text), F.lit(0))


def unmask(c: ColumnOrName, term_map: ColumnOrName, prefix: str = "") -> Column:
    """Put every original back: brackets first, as they may hold term tokens, then terms.

    ``prefix`` is that of the mask; another one only makes the look-up slower.
    """
    entries = col(term_map)
    return _restore(_restore(col(c), entries, BRACKET_TOKEN, f"__{prefix}BRACKET_"), entries, TERM_TOKEN)


def unmask_images(c: ColumnOrName, term_map: ColumnOrName) -> Column:
    return _restore(col(c), col(term_map), IMAGE_TOKEN)


def unmask_styles(c: ColumnOrName, term_map: ColumnOrName) -> Column:
    """Empty placeholder divs become style blocks again.

    When a translator damaged the div but the bare token survived, the token is
    deleted and the style block goes to the front.
    """
    entries = col(term_map)
    divs = F.transform(entries, lambda e: F.struct(
        F.concat(F.lit('<div class="'), e["token"], F.lit('"></div>')).alias("token"), e["original"].alias("original")))
    # blanks a translator put into a div go first, so that every div has its plain form
    plain = F.regexp_replace(col(c), STYLE_DIV, '<div class="$1"></div>')
    placed = _restore(plain, divs, STYLE_DIV)
    bound = F.array(F.struct(
        placed.alias("text"),
        F.array_intersect(
            F.transform(entries, lambda e: e["token"]),
            F.regexp_extract_all(placed, F.lit(STYLE_TOKEN), F.lit(0))).alias("bare"),
        F.map_from_entries(entries).alias("known"), entries.alias("numbered")))

    def text(b: Column) -> Column:
        moved = F.transform(b["bare"], lambda t: _lookup(b["known"], b["numbered"], t))
        gone = F.transform(b["numbered"], lambda e: F.struct(
            e["token"].alias("token"), F.lit("").alias("original")))
        rest = _restore(b["text"], gone, STYLE_TOKEN)
        return F.when(F.size(b["bare"]) == 0, b["text"]).otherwise(F.concat(F.array_join(moved, ""), rest))

    return F.get(F.transform(bound, text), F.lit(0))


def terms_pattern(terms: list[str] | None = None) -> str:
    """All terms as one pattern, in list order; a look at the first letter rejects most
    positions at once."""
    terms = PROTECTED_TERMS if terms is None else terms
    first = "".join(sorted({re.escape(t[0]) for t in terms}))
    return f"(?=[{first}])(?:{'|'.join(re.escape(t) for t in terms)})"


def term_hits(c: ColumnOrName, terms: list[str] | None = None) -> Column:
    """Array of ``(term_id, term, n)`` for the terms found, longest-first as in masking."""
    terms = PROTECTED_TERMS if terms is None else terms
    table = F.array(
        *[F.struct(F.lit(i).alias("term_id"), F.lit(t).alias("term"),
                   F.lit(f"__TERM_{i}__").alias("token")) for i, t in enumerate(terms)]
    )
    hit = "array<struct<term_id:int,term:string,n:int>>"
    start = F.struct(col(c).alias("text"), F.array().cast(hit).alias("hits"))

    def step(acc: Column, row: Column) -> Column:
        text = F.replace(acc["text"], row["term"], row["token"])
        # what one replacement adds in length tells how many there were
        n = (F.length(acc["text"]) - F.length(F.replace(acc["text"], row["term"], F.lit("")))) / F.length(
            row["term"])
        one = F.struct(row["term_id"].alias("term_id"), row["term"].alias("term"),
                       n.cast("int").alias("n"))
        return F.when(
            F.contains(acc["text"], row["term"]),
            F.struct(text.alias("text"), F.concat(acc["hits"], F.array(one)).alias("hits")),
        ).otherwise(acc)

    return F.aggregate(table, start, step)["hits"]
