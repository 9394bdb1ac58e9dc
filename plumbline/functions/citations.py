"""Reporter spelling, court tiers, pins and dates of citations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Spellings of the Federal Appendix, spaces and periods stripped.
REPORTER_ALIASES = {
    "FAppx": "FApp'x",
    "FedAppx": "FApp'x",
    "FedApp'x": "FApp'x",
    "FApp’x": "FApp'x",
    "FedApp’x": "FApp'x",
}
SUPREME_REPORTERS = ["U.S.", "S.Ct.", "L.Ed.", "L.Ed.2d", "U.S.LEXIS"]
FEDERAL_REPORTERS = ["F", "F2d", "F3d", "FSupp", "FSupp2d", "FSupp3d"]
FOREIGN_FORMS = [
    r"\[\d{4}\]\s+(UKSC|UKHL|EWCA|EWHC|UKPC)\b",
    r"\bECLI:[A-Z]{2}:",
    r"\bC-\d+/\d{2}\b",
]
PROCEDURAL_HISTORY = (
    r"(?i)cert\.?\s*(?:denied|granted|dismissed)|reh'?g\s+denied|aff'?d|rev'?d|vacated|remanded"
)
# State reporters, spaces and periods stripped.
STATE_REPORTER = (
    r"^(NE|NE2d|NE3d|NW|NW2d|NW3d|P|P2d|P3d|So|So2d|So3d|A|A2d|A3d|SE|SE2d|SW|SW2d|SW3d|"
    r"NYS|NYS2d|NYS3d|CalRptr|CalRptr2d|CalRptr3d|Cal|Cal2d|Cal3d|Cal4th|Cal5th|CalApp\w*|"
    r"NY|NY2d|NY3d|AD|AD2d|AD3d|Misc|Misc2d|Misc3d|Ill|Ill2d|IllApp\w*|IllDec|Mass|MassApp\w*|"
    r"NJ|NJSuper|Pa|PaSuper|PaCmwlth|Ohio\w*|Tex|TexCrim\w*|Wash|Wash2d|WashApp|Or|OrApp|"
    r"Mich|MichApp|Minn|Wis|Wis2d|Conn|ConnApp|Md|MdApp|Va|VaApp|Ga|GaApp|Fla|Ariz|ArizApp|"
    r"Colo|ColoApp|Idaho|Kan|KanApp\w*|Ky|La|Me|Mont|Neb|Nev|NH|NM|NC|NCApp|ND|Okla|"
    r"OklaCrim|RI|SC|SD|Tenn|TennApp|Utah|Vt|WVa|Wyo|Haw|HawApp|Alaska|Ala|AlaApp|Ark|ArkApp|"
    r"Del|DelCh|Ind|IndApp|Iowa|Miss|Mo|MoApp|Ill\w*|Ohio\w*)$"
)
# ----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reporter_key(reporter) -> Column:
    """Reporter without spaces and periods, alternate spellings folded onto the indexed one."""
    bare = F.translate(F.coalesce(_col(reporter), F.lit("")), " .", "")
    table = F.create_map(*[F.lit(x) for pair in REPORTER_ALIASES.items() for x in pair])
    return F.coalesce(table[bare], table[F.translate(bare, "’", "'")], bare)


def text_key(reporter) -> Column:
    """Upper-case reporter key used by the text archive."""
    return F.upper(F.translate(F.coalesce(_col(reporter), F.lit("")), " .", ""))


def is_vendor(reporter) -> Column:
    """Database record numbers (Westlaw, Lexis), which no reporter index can settle."""
    key = text_key(reporter)
    return (key == "WL") | key.endswith("LEXIS")


def court_tier(reporter) -> Column:
    r = F.translate(F.coalesce(_col(reporter), F.lit("")), " ", "")
    return (
        F.when(r.isin(SUPREME_REPORTERS), "scotus")
        .when(r.startswith("F.Supp"), "federal-district")
        .when(r.startswith("F.") | r.startswith("Fed."), "federal-appellate")
        .otherwise("state-or-other")
    )


def reporter_group(reporter) -> Column:
    """us / federal / other."""
    r = F.translate(F.coalesce(_col(reporter), F.lit("")), " .", "")
    return F.when(r == "US", "us").when(r.isin(FEDERAL_REPORTERS), "federal").otherwise("other")


def reporter_family(reporter) -> Column:
    """us / federal / sct_led / state / other."""
    r = F.translate(F.coalesce(_col(reporter), F.lit("")), " .", "")
    federal = r.startswith("F") | r.startswith("BR")
    return (
        F.when(r == "US", "us")
        .when(federal, "federal")
        .when(r.isin("SCt", "LEd", "LEd2d"), "sct_led")
        .when(r.rlike(STATE_REPORTER), "state")
        .otherwise("other")
    )


def is_foreign(text) -> Column:
    t = _col(text)
    out = F.lit(False)
    for form in FOREIGN_FORMS:
        out = out | t.rlike(form)
    return out


def foreign_hits(text) -> Column:
    """Every foreign-format citation of a text, one form after the other."""
    t = _col(text)
    return F.concat(*[F.regexp_extract_all(t, F.lit(form), F.lit(0)) for form in FOREIGN_FORMS])


def pin_pages(pin) -> Column:
    """All pages a pincite names: ranges expanded (dropped leading digits restored), else each number."""
    pin = _col(pin)
    ranges = F.regexp_extract_all(pin, F.lit(r"\d+\s*(?:-|–|to)\s*\d+"), F.lit(0))

    def expand(r: Column) -> Column:
        first = F.regexp_extract(r, r"^(\d+)", 1)
        last = F.regexp_extract(r, r"(\d+)$", 1)
        a = first.cast("long")
        shortened = last.cast("long") < a
        kept = F.length(first) - F.length(last.cast("long").cast("string"))
        b = F.when(shortened, F.concat(F.left(first, kept), last.cast("long").cast("string")).cast("long"))
        b = F.coalesce(b, last.cast("long"))
        return F.when((b >= a) & (b - a <= 40), F.sequence(a, F.greatest(a, b))).otherwise(
            F.array().cast("array<bigint>")
        )

    spread_out = F.flatten(F.transform(ranges, expand))
    singles = F.transform(
        F.regexp_extract_all(pin, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long")
    )
    return F.when(F.size(spread_out) > 0, spread_out).otherwise(singles)


def first_pin(pin) -> Column:
    digits = F.regexp_extract(_col(pin), r"\d+", 0)
    return F.when(digits != "", digits.cast("long"))


def year_of(date_text) -> Column:
    """Year of an ISO date string."""
    return F.try_to_number(F.left(_col(date_text), F.lit(4)), F.lit("9999")).cast("int")


def era(year, cutoff: int = 1970) -> Column:
    y = _col(year)
    return F.when(y.isNull(), F.lit(None).cast("string")).when(y < cutoff, "pre1970").otherwise("post1970")
