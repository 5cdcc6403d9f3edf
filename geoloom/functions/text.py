"""Cleaning and parsing of free text as columns; no Python runs per row."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
STATES = ("NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT")
COMPANY_WORDS = ("pty", "ltd", "limited", "inc", "llc", "group", "holdings", "australia", "aust")
OPERATOR_ALIASES = {
    "Tesla": ("tesla", "tesla motors", "tesla inc", "tesla australia", "tesla supercharger"),
    "Chargefox": ("chargefox", "charge fox"),
    "Evie Networks": ("evie", "evie networks", "evienetworks"),
    "BP Pulse": ("bp", "bp australia", "bp pulse", "bppulse", "bp charge", "bp chargemaster"),
    "Ampol": ("ampol", "ampol ampcharge", "ampcharge", "ampol energy"),
    "NRMA": ("nrma", "nrma parks and resorts", "the nrma"),
    "JOLT": ("jolt", "jolt charge", "jolt energy"),
    "Exploren": ("exploren",),
    "EVX": ("evx", "evx australia"),
    "PLUS ES": ("plus es", "plused", "plus-es", "plusesaustralia", "plus es australia"),
    "EVUp": ("evup", "ev up"),
    "Everty": ("everty",),
    "Origin Energy": ("origin", "origin energy"),
    "AGL": ("agl", "agl energy"),
    "Engie": ("engie",),
    "Charge Post": ("charge post", "chargepost"),
    "RAA": ("raa", "raa charge", "royal automobile association of south australia"),
    "RAC WA": ("rac", "rac wa", "rac electric highway", "royal automobile club of wa"),
    "Wattblock": ("wattblock",),
    "Schneider Electric": ("schneider", "schneider electric"),
    "ChargePoint": ("chargepoint", "charge point"),
    "Tritium": ("tritium",),
    "Non-networked": ("non-networked", "non networked", "nonnetworked", "unknown", "n/a", "na", "none", "private", "other"),
}
GENERIC_NAME_WORDS = ("ev", "charger", "chargers", "charging", "station", "stations", "site", "point", "points", "electric", "vehicle", "car", "park", "carpark", "the", "at", "of", "and")
SURVEYED, BY_ADDRESS, BY_LOCALITY = "surveyed", "geocoded_address", "geocoded_locality"
PRECISION_ERROR_M = {SURVEYED: 10, BY_ADDRESS: 100, BY_LOCALITY: 5000}
SPEED_BANDS = ((7, "trickle"), (25, "slow"), (50, "medium"), (150, "fast"), (250, "rapid"))
STATUS_WORDS = (
    ("planned", "upcoming|planned|proposed|future|coming soon"),
    ("construction", "construction|under way|underway|building"),
    ("decommissioned", "removed|decommission|closed|abandoned|disused|permanently"),
    ("operational", "active|operational|available|in service|open|existing|yes"),
)
# ----------------------------------------------------------------------------


def text_of(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def clean_text(x: Column) -> Column:
    """Control characters and runs of white space become one space; empty becomes null."""
    s = F.regexp_replace(F.regexp_replace(x.cast("string"), r"[\x00-\x1F]", " "), r"\s+", " ")
    return F.nullif(F.trim(s), F.lit(""))


def _words(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_of(x)), r"[^a-z0-9]+", " "))


_KEY_STEPS = ((r"[‘’'`]", ""), (r"\b(" + "|".join(COMPANY_WORDS) + r")\b", " "), (r"[^a-z0-9]+", " "))


def operator_key(x: Column) -> Column:
    """Comparison key of an operator name: no company words, no punctuation."""
    return F.trim(reduce(lambda s, step: F.regexp_replace(s, *step), _KEY_STEPS, F.lower(text_of(x))))


def _key_of(name: str) -> str:
    return reduce(lambda s, step: re.sub(step[0], step[1], s), _KEY_STEPS, name.lower()).strip()


def operator_table() -> dict[str, str]:
    """Alias key -> canonical name, in the order of OPERATOR_ALIASES."""
    table: dict[str, str] = {}
    for name, aliases in OPERATOR_ALIASES.items():
        for a in (name, *aliases):
            table[_key_of(a)] = name
    return table


def canonical_operator(x: Column) -> Column:
    """Canonical name by exact key, then by the first alias (4+ letters) that starts the key, else the squeezed input."""
    key, table = operator_key(x), operator_table()
    exact = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    starts = F.array(*[F.struct(F.lit(f"{a} ").alias("a"), F.lit(n).alias("n")) for a, n in table.items() if len(a) >= 4])
    by_prefix = F.get(F.filter(starts, lambda s: F.startswith(key, s["a"])), F.lit(0))["n"]
    return F.when(key == "", F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_element_at(exact, key), by_prefix, F.regexp_replace(F.trim(x.cast("string")), r"\s+", " "))
    )


def position_precision(precision: Column, geocoded: Column) -> Column:
    given = F.nullif(precision, F.lit(""))
    return F.coalesce(given, F.when(geocoded, BY_ADDRESS).otherwise(SURVEYED))


def is_mappable(precision: Column) -> Column:
    return precision.isin(SURVEYED, BY_ADDRESS)


def precision_error_m(precision: Column) -> Column:
    return F.when(precision == SURVEYED, 10).when(precision == BY_ADDRESS, 100).when(precision == BY_LOCALITY, 5000)


def connector_standard(x: Column) -> Column:
    """Connector standard of a label; combined charging is tested before its plain plug."""
    s = F.regexp_replace(F.lower(text_of(x)), r"[^a-z0-9]+", "")
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(s == "", F.lit(None).cast("string"))
        .when(has("type2combo") | has("ccs2") | has("ccscombo2") | (s == "ccs") | (has("ccs") & has("type2")), "CCS2")
        .when(has("type1combo") | has("ccs1") | (has("ccs") & has("type1")), "CCS1")
        .when(has("chademo"), "CHAdeMO")
        .when(has("tesla") | has("supercharger"), "TeslaProprietary")
        .when(has("type2") | has("mennekes"), "Type2")
        .when(has("type1") | has("j1772"), "Type1")
        .when((s == "dc") | has("dcfast") | has("rapid"), "DCUnspecified")
        .when((s == "ac") | has("acsocket") | has("destination"), "ACUnspecified")
    )


# What stands for no rating; a rating is an optional count and x, a number, an optional unit.
_BARE_RATING = r"(?i)^(ac|dc|ac/dc|type\s*2|unknown|n/a|na|tbc|upcoming)$"
_RATING = r"(?i)(?:([0-9]+)\s*[x×]\s*)?([0-9]+(?:\.[0-9]+)?)\s*(kw|kilowatt|mw)?"


def power_rating(x: Column) -> Column:
    """struct<groups array<struct<count, kw>>, max_kw, note> of a rating such as ``2x350kW & 22 kW``."""
    t = F.trim(text_of(x))
    part = lambda k: F.regexp_extract_all(t, F.lit(_RATING), F.lit(k))
    found = F.transform(
        F.arrays_zip(part(1).alias("c"), part(2).alias("k"), part(3).alias("u")),
        lambda g: F.struct(
            F.least(F.greatest(F.coalesce(g["c"].try_cast("int"), F.lit(1)), F.lit(1)), F.lit(64)).alias("count"),
            (g["k"].cast("double") * F.when(F.lower(g["u"]) == "mw", 1000.0).otherwise(1.0)).alias("kw"),
        ),
    )
    groups = F.when((t == "") | t.rlike(_BARE_RATING), F.array().cast("array<struct<count:int,kw:double>>")).otherwise(F.filter(found, lambda g: (g["kw"] >= 1) & (g["kw"] <= 1000)))
    note = (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike(_BARE_RATING), F.concat(F.lit('states no rating, only "'), t, F.lit('"')))
        .when(F.size(groups) == 0, F.concat(F.lit('cannot read the rating "'), t, F.lit('"')))
    )
    return F.struct(groups.alias("groups"), F.array_max(F.transform(groups, lambda g: g["kw"])).alias("max_kw"), note.alias("note"))


def speed_band(kw: Column) -> Column:
    out = F.when(kw.isNull() | F.isnan(kw) | (kw <= 0), "unknown")
    for top, band in SPEED_BANDS:
        out = out.when(kw < top, band)
    return out.otherwise("ultra")


def status_of(x: Column) -> Column:
    s = F.trim(F.lower(text_of(x)))
    out = F.when(s == "", "unknown")
    for name, words in STATUS_WORDS:
        out = out.when(s.rlike(words), name)
    return out.otherwise("unknown")


def access_of(x: Column) -> Column:
    s = F.trim(F.lower(text_of(x)))
    return (
        F.when(s.rlike("^(yes|public|permissive|designated)$"), "public")
        .when(s.rlike("customer|guest|patron|permit|residents|members"), "restricted")
        .when(s.rlike("^(private|no)$"), "private")
        .otherwise("unknown")
    )


def fee_of(x: Column) -> Column:
    """True, false or null: null is unknown, not free."""
    s = F.trim(F.lower(text_of(x)))
    return F.when(s.rlike("^(yes|true|paid|pay)"), True).when(s.rlike("^(no|false|free)"), False)


def address_of(x: Column) -> Column:
    """struct<full, street, suburb, state, postcode> of a one-line address; never null itself."""
    t = clean_text(x)
    none = F.lit(None).cast("string")
    post = F.nullif(F.regexp_extract(t, r"^.*\b([0-9]{4})\b", 1), F.lit(""))
    state = reduce(lambda out, s: out.when(t.rlike(rf"(?i)\b{s}\b"), s), STATES[1:], F.when(t.rlike(rf"(?i)\b{STATES[0]}\b"), STATES[0]))
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, rf"(?i)\b({'|'.join(STATES)})\b", ""), r"\b[0-9]{4}\b", "")))
    later = F.filter(F.slice(bare, F.lit(2), F.greatest(F.size(bare) - 1, F.lit(0))), lambda p: p.rlike("(?i)[a-z]{2,}"))
    suburb = F.when(F.size(parts) >= 2, F.try_element_at(later, F.lit(-1)))
    first = F.try_element_at(parts, F.lit(1))
    moved = suburb.isNull() & first.isNotNull() & ~first.rlike(r"(?i)^([0-9]|unit|shop|lot|level|suite|cnr|corner)\b")
    street, town = F.when(moved, none).otherwise(first), F.when(moved, first).otherwise(suburb)
    return F.struct(t.alias("full"), street.alias("street"), town.alias("suburb"), state.alias("state"), post.alias("postcode"))


def name_tokens(x: Column) -> Column:
    """Distinct words without the generic ones."""
    return F.array_except(F.array_remove(F.split(_words(x), " "), ""), F.array(*[F.lit(w) for w in GENERIC_NAME_WORDS]))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of ``name_tokens``; 0 if either has none."""
    x, y = name_tokens(a), name_tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(both, F.lit(1)))


def _accented() -> dict[str, str]:
    """Base letter -> the letters that decompose to it and marks."""
    out: dict[str, str] = {}
    for c in map(chr, range(0xC0, 0x250)):
        d = unicodedata.normalize("NFKD", c.lower())
        if len(c.lower()) == 1 and len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:]) and c.lower() not in out.get(d[0], ""):
            out[d[0]] = out.get(d[0], "") + c.lower()
    return out


def slug(x: Column, length: int = 40) -> Column:
    """Lower-case words joined by dashes, cut after trimming; a mark on a letter separates, as its decomposition does."""
    s = F.lower(text_of(x))
    for base, letters in sorted(_accented().items()):
        s = F.regexp_replace(s, f"[{letters}]", f"{base}-")
    s = F.regexp_replace(s, r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, length)


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _month(name: Column) -> Column:
    numbers = {m: k for names in (MONTHS, _MONTH_NAMES) for k, m in enumerate(names, 1)} | {"sept": 9}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.lower(name))


def loose_date(x: Column) -> Column:
    """First day of the period that a loosely written date names; days beyond a month's end roll over."""
    slashed, worded, month_year, iso = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$", r"^([A-Za-z]+)\s+([0-9]{4})$", r"^([0-9]{4}-[0-9]{2}(?:-[0-9]{2})?)"
    day = lambda y, m, d: F.date_add(F.make_date(y, m, F.lit(1)), d - 1)

    def parse(t: Column) -> Column:
        part = lambda pattern, k: F.regexp_extract(t, pattern, k)
        number = lambda pattern, k: part(pattern, k).try_cast("int")
        d, m = number(slashed, 1), number(slashed, 2)
        return (
            F.when(t.rlike(slashed), F.when(m.between(1, 12) & d.between(1, 31), day(number(slashed, 3), m, d)))
            .when(t.rlike(worded), day(number(worded, 3), _month(part(worded, 2)), number(worded, 1)))
            .when(t.rlike(month_year), F.make_date(number(month_year, 2), _month(part(month_year, 1)), F.lit(1)))
            .when(t.rlike(iso), F.rpad(part(iso, 1), 10, "-01").try_cast("date"))
        )

    # the cleaned text is bound once for all branches
    return F.get(F.transform(F.array(clean_text(x)), parse), F.lit(0))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of ASCII text, as a bigint."""
    codes = F.transform(F.filter(F.split(text_of(x), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def cache_key(x: Column) -> Column:
    """Lookup key of an address: lower-case words."""
    return _words(x)


def query_variants(address: Column, region: Column) -> Column:
    """Distinct lookup texts, most exact first: whole, from the first house number, last part with region."""
    t = clean_text(address)
    suffix = F.coalesce(F.concat(F.lit(", "), F.nullif(region, F.lit(""))), F.lit(""))
    at = F.regexp_instr(t, F.lit(r"\b[0-9]+[a-zA-Z]?(?:\s*[-/]\s*[0-9]+)?\s+[A-Z][\w'-]*"))
    parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
    numbered = F.when(at > 1, F.substring(t, at, F.length(t)))
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return F.array_distinct(F.array_compact(F.array(*[F.concat(v, suffix) for v in (t, numbered, last)])))


_ENTITIES = (("nbsp", " "), ("amp", "&"), ("apos", "'"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("rsquo", "’"), ("lsquo", "‘"), ("ndash", "–"), ("mdash", "—"))


def html_text(x: Column) -> Column:
    """Text of a piece of HTML: tags become spaces, entities their characters, decimal and hexadecimal ones included.

    Numeric entities are split off and rebuilt from the UTF-8 bytes of their code; one that names no character becomes a space.
    """
    s = F.regexp_replace(text_of(x), r"<[^>]*>", " ")
    for name, char in _ENTITIES:
        s = F.regexp_replace(s, f"(?i)&{name};", char)
    pieces = F.split(s, "&#(?=[0-9]{1,7};|[xX][0-9a-fA-F]{1,6};)")
    head = F.get(pieces, F.lit(0))
    told = r"^[xX]?[0-9a-fA-F]+;"
    tail = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(_char(_code(p)), F.regexp_replace(p, told, "")))
    return clean_text(F.concat(head, F.array_join(tail, "")))


def _code(p: Column) -> Column:
    """The code that a piece such as ``233;...`` or ``xE9;...`` starts with."""
    return F.coalesce(F.conv(F.nullif(F.regexp_extract(p, r"^[xX]([0-9a-fA-F]+);", 1), F.lit("")), 16, 10), F.regexp_extract(p, r"^([0-9]+);", 1)).cast("int")


def _char(code: Column) -> Column:
    """The character of a code, from its UTF-8 bytes."""
    part = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))
    lead = lambda shift, mark: F.shiftright(code, shift).bitwiseOR(F.lit(mark))
    octets = (
        F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(lead(6, 0xC0), part(0))).when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.array(F.lit(32)))
        .when(code < 0x10000, F.array(lead(12, 0xE0), part(6), part(0))).otherwise(F.array(lead(18, 0xF0), part(12), part(6), part(0)))
    )
    return F.decode(F.unhex(F.array_join(F.transform(octets, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8")


# The URL parameters that hold secrets, and the variable parts of issue messages.
def redact_url(x: Column) -> Column:
    """Values of key-like URL parameters replaced."""
    return F.regexp_replace(x, r"(?i)([?&](?:key|apikey|api_key|token|access_token)=)[^&]*", "$1REDACTED")


def issue_shape(x: Column) -> Column:
    """A message without its quoted and bracketed variable parts."""
    return F.regexp_replace(F.regexp_replace(text_of(x), r'"[^"]*"', '"…"'), r"\(-?[0-9.,\s]+\)", "(…)")


def money(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text_of(x), r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def connector_label(c: Column) -> Column:
    """``CCS2x2@350kW`` of a connector struct."""
    kw = F.regexp_replace(c["power_kw"].cast("string"), r"\.0$", "")
    return F.concat(c["standard"], F.coalesce(F.concat(F.lit("x"), c["count"].cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("@"), kw, F.lit("kW")), F.lit("")))


def text_score(text: str, fields: list[tuple[Column, float]], parts: list[Column], name: Column) -> Column:
    """Relevance of a row to a query; 0 if it does not match.

    Every word of the query must stand in some field or part; a row without a
    full match may still get its name's token similarity from 0.34 on.
    """
    tokens = text.lower().split()
    if not tokens:
        return F.lit(1.0)
    total, hits = F.lit(0.0), []
    lows = [(F.lower(text_of(c)), w) for c, w in fields]
    low_parts = [F.lower(text_of(c)) for c in parts]
    for t in tokens:
        lit, hit = F.lit(t), F.lit(False)
        for low, w in lows:
            here = F.contains(low, lit)
            hit = hit | here
            total = total + F.when(here, float(w)).otherwise(0.0) + F.when(F.startswith(low, lit), w / 2).otherwise(0.0)
        for low in low_parts:
            here = F.contains(low, lit)
            hit = hit | here
            total = total + F.when(here, 2.0).otherwise(0.0)
        hits.append(hit)
    # a word that stands twice in the query can never count twice
    full = reduce(lambda a, b: a & b, hits) if len(set(tokens)) == len(tokens) else F.lit(False)
    close = token_similarity(name, F.lit(text.lower().strip()))
    return F.when(full & (total > 0), total).when(F.coalesce(close, F.lit(0.0)) >= 0.34, close).otherwise(0.0)
