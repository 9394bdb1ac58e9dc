"""Party-name tokens, claimed names, masking and role parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let

# --- fixed values -----------------------------------------------------------
# Words that say nothing about which case a name belongs to (short list, used
# when a claimed name is compared with an indexed one).
SHORT_STOP = (
    "v vs the of in re ex parte et al state united states u.s. us inc llc co corp"
).split()
# The longer list, used when a name decides which case a quotation belongs to.
CASE_STOP = (
    "united states state people commonwealth city county board school court company corp "
    "corporation judicial circuit district rules federal national american department secretary "
    "commissioner attorney general government association trust bank insurance railroad railway "
    "education public service services administration agency office director officer council "
    "commission committee union america labor health human election elections welfare housing "
    "authority transportation industries products power light water sons brothers trustees estate "
    "citizens society"
).split()
CLAIMED = (
    r"(?U)[A-Z][\w.&'’,-]*(?: [A-Z&][\w.&'’,-]*){0,6} v\. "
    r"[A-Z][\w.&'’,-]*(?: [A-Z&][\w.&'’,-]*){0,6}"
)
# Separators and earlier citations that end the reach of a caption.
SEPARATOR = r"[;:()\n]|\d+\s+[A-Z][A-Za-z. ]*\d+"
# Parties too generic to identify a case, and entity suffixes to strip.
GENERIC_PARTIES = [
    "united states", "united states of america", "state", "government",
    "commissioner of internal revenue", "commissioner", "attorney general", "secretary", "people",
    "federal trade commission", "securities and exchange commission",
    "national labor relations board",
]
ENTITY_SUFFIXES = (
    r"(?i)(,?\s*(et al\.?|inc\.?|co\.?|corp\.?|company|corporation|llc|l\.l\.c\.|ltd\.?|l\.p\.)\s*)+$"
)
MASK_STOP = (
    "united states state county city board department district school america american national "
    "federal court justice director"
).split()
ROLE_TAIL = (
    r"(?i)[,;]?\s*(Plaintiffs?|Defendants?|Petitioners?|Respondents?|Claimants?|Intervenors?|"
    r"Cross-Appell(?:ant|ee)s?|Counter-\w+)[-\s]*$"
)
APPELLANT_FIRST = r"^(.+?),\s*([\w /-]*Appellants?)[,.]?\s+v\.\s+(.+?),\s*([\w /-]*Appellees?)[.,]?\s*$"
APPELLEE_FIRST = r"^(.+?),\s*([\w /-]*Appellees?)[,.]?\s+v\.\s+(.+?),\s*([\w /-]*Appellants?)[.,]?\s*$"
# ----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lits(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def short_tokens(name) -> Column:
    """Distinct lower-case name tokens of two letters or more, the short stop list removed."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(name), F.lit(""))), F.lit(r"[A-Za-z][A-Za-z.'-]+"), F.lit(0))
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, r"^[.,']+|[.,']+$", ""))
    return F.array_except(trimmed, _lits(SHORT_STOP))


def case_tokens(name) -> Column:
    """Distinct lower-case name tokens of four letters or more, the case stop list removed."""
    found = F.regexp_extract_all(F.coalesce(_col(name), F.lit("")), F.lit(r"[A-Za-z][A-Za-z'\-]{3,}"), F.lit(0))
    return F.array_except(F.transform(found, F.lower), _lits(CASE_STOP))


def claimed_name(text, start, window: int = 120) -> Column:
    """The last "A v. B" in the window before a citation, emphasis marks stripped; null if none."""
    text, start = _col(text), _col(start)
    lo = F.greatest(F.lit(0), start - window)
    ahead = F.translate(text.substr(lo + 1, start - lo), "*_", "")
    # the long pattern runs only on a stretch that holds its middle
    found = lambda a: F.when(F.contains(a, F.lit(" v. ")), F.get(F.reverse(F.regexp_extract_all(a, F.lit(CLAIMED), F.lit(0))), F.lit(0)))
    return let(ahead, found)


def claimed_caption(text, start, window: int = 160) -> Column:
    """"A v. B" ending where a citation begins: the plaintiff starts after the last separator; null if unclear."""
    text, start = _col(text), _col(start)
    lo = F.greatest(F.lit(0), start - window)
    ahead = F.translate(text.substr(lo + 1, start - lo), "*_", "")
    halves = r"(?s)^(.*) v\.? (.*)$"

    def caption(a: Column) -> Column:
        left = F.element_at(F.split(F.regexp_extract(a, halves, 1), SEPARATOR), -1)
        defendant = F.regexp_replace(F.regexp_extract(a, halves, 2), r"^\s+|[\s,]+$", "")
        plain = F.regexp_replace(left, r'(?s)^.*(?:[”"\]]|[.?!] )', "")
        last_six = F.regexp_extract(F.regexp_replace(plain, r"\s+$", ""), r"(\S+(?:\s+\S+){0,5})$", 1)
        plaintiff = F.regexp_replace(F.regexp_replace(last_six, r"\s+", " "), r"^[ ,.]+|[ ,.]+$", "")

        def joined(d: Column) -> Column:
            named = let(plaintiff, lambda p: F.when(p != "", F.concat(p, F.lit(" v. "), d)))
            return F.when((d != "") & ~d.rlike(SEPARATOR), named)

        # each part is worked out once, and only where the stretch has a caption
        return F.when(F.contains(a, F.lit(" v")) & a.rlike(halves), let(defendant, joined))

    return let(ahead, caption)


def mask_terms(name) -> Column:
    """Strings that identify a party, longest first; none for a generic party."""
    clean = F.trim(F.regexp_replace(_col(name), ENTITY_SUFFIXES, ""))
    tokens = F.filter(
        F.regexp_extract_all(clean, F.lit(r"[A-Za-z][A-Za-z'\-]{3,}"), F.lit(0)),
        lambda t: ~F.lower(t).isin(MASK_STOP),
    )
    ranked = F.array_sort(
        F.transform(
            F.array_distinct(F.concat(F.array(clean), tokens)),
            lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t")),
        )
    )
    terms = F.transform(ranked, lambda r: r["t"])
    return F.when(F.lower(clean).isin(GENERIC_PARTIES), F.array().cast("array<string>")).otherwise(terms)


def mask(text, terms, label: str) -> Column:
    """Replace every term in turn by a neutral label, ignoring case."""
    return F.aggregate(
        _col(terms),
        _col(text),
        lambda acc, term: F.regexp_replace(acc, F.concat(F.lit(r"(?i)\Q"), term, F.lit(r"\E")), F.lit(label)),
    )


def clean_party(party) -> Column:
    bare = F.regexp_replace(F.trim(_col(party)), ROLE_TAIL, "")
    bare = F.regexp_replace(bare, r"^[ ,;-]+|[ ,;-]+$", "")
    return F.regexp_replace(bare, r"\s+", " ")


def appeal_parties(line) -> Column:
    """struct(appellant, appellee) of a caption line; null fields when it does not parse."""
    flat = F.regexp_replace(_col(line), r"\s+", " ")
    usable = ~F.contains(flat, F.lit("Cross-Appell"))
    forward, backward = usable & flat.rlike(APPELLANT_FIRST), usable & flat.rlike(APPELLEE_FIRST)
    side = lambda pattern, group: clean_party(F.regexp_extract(flat, pattern, group))
    return F.struct(
        F.when(forward, side(APPELLANT_FIRST, 1)).when(backward, side(APPELLEE_FIRST, 3)).alias("appellant"),
        F.when(forward, side(APPELLANT_FIRST, 3)).when(backward, side(APPELLEE_FIRST, 1)).alias("appellee"),
    )
