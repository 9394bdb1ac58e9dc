"""Text normalisation, fragments, coverage and span positions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Ellipsis forms that mark an omission inside a quotation.
ELLIPSIS = r"\.\s?\.\s?\.|…"
# A bracketed alteration.
BRACKETED = r"\[[^\]]*\]"
# Parentheticals a writer adds inside the marks; they are not quoted words.
ALTERATION_NOTE = (
    r"(?i)\((?:emphasis (?:added|in original|omitted)|citations? omitted|"
    r"internal quotation marks (?:and citations? )?omitted|cleaned up|"
    r"footnote omitted|alterations? (?:in original|omitted))\)"
)
MIN_FRAGMENT = 15
LONG_WORD = 5
NEAR_MISS_AT = 0.85
PARAPHRASE_AT = 0.5
# Quotation marks: balanced smart pairs, and straight pairs on one line.
SMART_QUOTE = r"“([^“”]{20,600})”"
STRAIGHT_QUOTE = r'"([^"\n]{20,600})"'
FIRST_EDITION_QUOTE = r'["“]([^"“”]{20,600})["”]'
NOT_A_QUOTE = r"\n\s*\n|(^|\n)\s*#|\*\*|__"
SPLIT_ARTIFACT = r"^(\s*[—–)\].,;:]|\s)"
ALTERED = r"\[[^\]]*\]|\.\s?\.\s?\.|…"
SIGNAL_WORDS = r"(?i)dissent|concurr|separate opinion|plurality"
# What ``\\s`` stands for.
WHITESPACE = " \t\n\x0b\f\r"
# A private-use character that marks the two ends of a match.
MARK = "\ue000"
REFUSAL = r"(?i)\b(I cannot|I can't|I am unable|I'm unable|I must decline)\b"
# ----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate an expression once and hand it to ``body``.

    An expression used inside a lambda is evaluated again for every element;
    bound as the element of a one-element array it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(c) -> Column:
    """Lower case, unwrap brackets, drop apostrophes, every other run of non-alphanumerics to one space.

    Collapsing "anything but a-z0-9" in one pass equals replacing punctuation
    and then collapsing whitespace, with one regex pass fewer.
    """
    s = F.regexp_replace(F.lower(_col(c)), r"\[([^\]]*)\]", "$1")
    for mark in "‘’'":  # three searches of bytes; translate looks every letter up
        s = F.replace(s, F.lit(mark), F.lit(""))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def nospace(c) -> Column:
    return F.translate(_col(c), " ", "")


def words(c, first: int | None = None) -> Column:
    """Whitespace tokens; the empty text has none. With ``first`` that many, and all that follows as one more."""
    trimmed = F.trim(_col(c), F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+", -1 if first is None else first + 1))


def contains_either(fragment, text, text_nospace) -> Column:
    """Substring test, with a space-free second try for words split across a line break."""
    fragment, text, text_nospace = _col(fragment), _col(text), _col(text_nospace)
    return F.contains(text, fragment) | F.contains(text_nospace, nospace(fragment))


def token_coverage(fragment, text) -> Column:
    """Share of the fragment's words of five letters or more that occur in the text as substrings."""
    text = _col(text)
    long_words = F.filter(F.split(_col(fragment), " "), lambda w: F.length(w) >= LONG_WORD)
    return let(
        long_words,
        lambda ws: F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(ws, lambda w: F.contains(text, w))) / F.size(ws)
        ),
    )


def fragments(quote, mode: str = "strict") -> Column:
    """Normalised pieces of a quotation, at least 15 characters each.

    ``literal`` splits at ellipses only; ``strict`` also reads a bracketed
    alteration as an omission and drops alteration notes.
    """
    q = _col(quote)
    if mode == "strict":
        q = F.regexp_replace(q, ALTERATION_NOTE, " ")
        pieces = F.split(q, f"{ELLIPSIS}|{BRACKETED}")
    elif mode == "literal":
        pieces = F.split(q, ELLIPSIS)
    else:
        raise ValueError(mode)
    return F.filter(F.transform(pieces, normalize), lambda p: F.length(p) >= MIN_FRAGMENT)


def longest(pieces) -> Column:
    """The longest piece; the first one on ties."""
    ranked = F.transform(
        _col(pieces), lambda p, i: F.struct((-F.length(p)).alias("k"), i.alias("i"), p.alias("p"))
    )
    return F.array_min(ranked)["p"]


def longest_fragment(quote, mode: str = "literal") -> Column:
    """The longest fragment, or the whole normalised quotation when it has none."""
    return let(
        fragments(quote, mode), lambda ps: F.when(F.size(ps) > 0, longest(ps)).otherwise(normalize(quote))
    )


def middle_words(c, length: int, *, only_from: int | None = None) -> Column:
    """The middle ``length`` words of a space-joined text; the whole text when it is shorter."""
    limit = length if only_from is None else only_from - 1

    def cut(w: Column) -> Column:
        n = F.size(w)
        start = F.greatest(F.lit(1), F.floor(n / 2).cast("int") - length // 2 + 1)
        return F.when(n <= limit, F.array_join(w, " ")).otherwise(F.array_join(F.slice(w, start, F.lit(length)), " "))

    return let(F.split(_col(c), " "), cut)


def pieces(text, pattern: str) -> Column:
    """Gap, match, gap and so on of a text; a text without a match is one piece.

    Spark has no function that returns match offsets. One pass puts a mark on
    both sides of every match, and the text is split at the marks. A text that
    holds the mark itself is searched and split apart.
    """
    text = _col(text)
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    apart = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.when(h.isNull(), F.array(g)).otherwise(F.array(g, h))))
    return F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)


def placed(p: Column) -> Column:
    """The matches among :func:`pieces`: a start is the summed length of everything before it."""
    found = lambda start, i: F.struct(start.alias("start"), F.get(p, i).alias("body"))

    def starts(n: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(n, F.lit(1), i), F.lit(0), lambda x, y: x + y)
        return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda i: found(before(i), i))

    none = F.array().cast("array<struct<start:int,body:string>>")
    one = F.array(found(F.length(F.get(p, F.lit(0))), F.lit(1)))  # nothing to sum up
    several = let(F.transform(p, lambda x: F.length(x)), starts)
    return F.when(F.size(p) == 1, none).when(F.size(p) == 3, one).when(F.size(p) > 3, several)


def spans(text, pattern: str) -> Column:
    """All matches of a pattern as ``array<struct<start, body>>``, start counted from 0."""
    return let(pieces(text, pattern), placed)


def quote_spans(text) -> Column:
    """Quotations with the position of their first character, artifacts rejected, in text order."""
    def shape(found: Column) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                (m["start"] + 1).alias("start"),
                m["body"].substr(F.lit(2), F.length(m["body"]) - 2).alias("quote"),
            ),
        )

    straight = F.when(F.contains(_col(text), F.lit('"')), spans(text, STRAIGHT_QUOTE)).when(
        _col(text).isNotNull(), F.array().cast("array<struct<start:int,body:string>>")
    )
    both = F.concat(shape(spans(text, SMART_QUOTE)), shape(straight))
    kept = F.filter(
        both,
        lambda q: ~q["quote"].rlike(NOT_A_QUOTE) & ~q["quote"].rlike(SPLIT_ARTIFACT),
    )
    return F.array_sort(F.array_distinct(kept))


def head_tail(text, budget: int, mark: str) -> Column:
    """Three quarters of the budget from the head and the rest from the tail of a long text."""
    t = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    head, tail = (budget * 3) // 4, budget - (budget * 3) // 4
    cut = F.concat(
        F.regexp_replace(F.left(t, F.lit(head)), r"\s+$", ""),
        F.lit(mark),
        F.regexp_replace(F.right(t, F.lit(tail)), r"^\s+", ""),
    )
    return F.when(F.length(t) <= budget, t).otherwise(cut)


def from_marker(text, marker: str) -> Column:
    """Text from the first marker on; the whole text when there is none."""
    text = _col(text)
    at = F.regexp_instr(text, F.lit(marker))
    return F.when(at > 0, text.substr(at, F.length(text))).otherwise(text)


def strip_tags(html) -> Column:
    return F.regexp_replace(_col(html), "<[^>]+>", " ")


def around(text, start, before: int, after: int) -> Column:
    """The characters of a text from ``before`` ahead of a position to ``after`` past it."""
    text, start = _col(text), _col(start)
    lo = F.greatest(F.lit(0), start - before)
    return text.substr(lo + 1, start + after - lo)
