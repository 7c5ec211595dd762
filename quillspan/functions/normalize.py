"""Names, identifiers and addresses as Column -> Column functions; everything stays inside the JVM.

Null and empty inputs never raise: text functions give empty arrays or strings, identifier functions give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These tables define the results.
HONORIFICS = ["mr", "mrs", "ms", "dr", "haji", "mian", "engr", "mst", "sahib", "sahiba", "prof", "syed", "syeda"]
DIGRAPHS = [("kh", "k"), ("gh", "g"), ("sh", "x"), ("ch", "c"), ("zh", "z"), ("th", "t"), ("dh", "d"), ("ph", "f"), ("bh", "b"), ("rh", "r"), ("wh", "v")]
URDU_CLASSES = {
    "b": "ب", "p": "پ", "t": "تٹط", "s": "ثسص", "j": "ج", "c": "چ", "h": "حہھ", "k": "خقک", "d": "دڈ", "z": "ذزژضظ",
    "r": "رڑ", "x": "ش", "g": "غگ", "f": "ف", "l": "ل", "m": "م", "n": "نں", "v": "وؤ",
}
CITY_ABBREVIATIONS = {
    "rwp": "rawalpindi", "isb": "islamabad", "lhr": "lahore", "lhe": "lahore", "khi": "karachi", "pesh": "peshawar", "fsd": "faisalabad",
    "mtn": "multan", "skt": "sialkot", "hyd": "hyderabad", "gjw": "gujranwala", "grw": "gujranwala", "qta": "quetta", "bwp": "bahawalpur",
}
CITIES = ["rawalpindi", "islamabad", "lahore", "karachi", "peshawar", "faisalabad", "multan", "sialkot", "hyderabad", "gujranwala", "quetta", "bahawalpur"]
ADDRESS_REWRITES = [(r"\bh\.?\s*no\.?\s*", "house "), (r"\bh\s*#\s*", "house "), (r"\bhouse\s*no\.?\s*", "house "), (r"\bplot\s+", "house "), (r"\bst\.?\s+", "street "), (r"\bgali\s+", "street ")]
ADDRESS_TOKEN = r"[a-z][a-z\-/]+|\b[a-z]-?\d+(?:/\d+)?\b"

_URDU_FROM = "".join(URDU_CLASSES.values())
_URDU_TO = "".join(k * len(v) for k, v in URDU_CLASSES.items())
_EMPTY_TEXTS = "array<string>"


def clean(value: Column) -> Column:
    """trimmed text; null and any spelling of ``nan`` are empty."""
    text = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    return F.when(F.lower(text) == "nan", "").otherwise(text)


def is_urdu(text: Column) -> Column:
    """whether any character lies in U+0600..U+06FF; a null text has none."""
    return F.coalesce(text.rlike("[\\u0600-\\u06ff]"), F.lit(False))


def collapse(text: Column) -> Column:
    """runs of one character become that character."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def roman_skeleton(token: Column) -> Column:
    """the consonants of a Roman token."""
    out = F.regexp_replace(F.lower(token), "[^a-z]", "")
    for pair, one in DIGRAPHS:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return collapse(F.translate(out, "qwyaeiou", "kv"))


def urdu_skeleton(token: Column) -> Column:
    """the consonant classes of an Urdu token; letters without a class go."""
    return collapse(F.translate(F.regexp_replace(token, f"[^{_URDU_FROM}]", ""), _URDU_FROM, _URDU_TO))


def skeleton(token: Column) -> Column:
    """by the token's own script."""
    return F.when(is_urdu(token), urdu_skeleton(token)).otherwise(roman_skeleton(token))


def name_tokens(name: Column) -> Column:
    """lower-case tokens without leading honorifics; an all-honorific or null name has none."""
    text = F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(name, F.lit("")), ".,", "  ")), r"(?U)\s+", " "))
    bare = F.regexp_replace(text, rf"^(?:(?:{'|'.join(HONORIFICS)})(?: |$))+", "")
    return F.filter(F.split(bare, " "), lambda t: t != "")


def name_skeletons(name: Column) -> Column:
    """skeletons of the tokens, without empty ones."""
    return F.filter(F.transform(name_tokens(name), skeleton), lambda t: t != "")


def normalize_address(address: Column) -> Column:
    """F8: ``struct<house int, street int, area_tokens array<string>, city string>``; missing parts are null."""
    text = F.replace(F.lower(F.coalesce(address, F.lit(""))), F.lit(","), F.lit(" "))
    for pattern, becomes in ADDRESS_REWRITES:
        text = F.regexp_replace(text, "(?U)" + pattern, becomes)
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, "(?U)" + pattern, 1).try_cast("int")

    house, street = number(r"house\s+(\d+)"), number(r"street\s+(\d+)")
    pair = r"^(\d+)-(\d+)\b"
    both = house.isNull() & text.rlike("(?U)" + pair)
    tokens = F.regexp_extract_all(text, F.lit(ADDRESS_TOKEN), 0)
    full = F.create_map(*[F.lit(x) for kv in {**CITY_ABBREVIATIONS, **{c: c for c in CITIES}}.items() for x in kv])
    named = F.filter(F.transform(F.reverse(tokens), lambda t: F.try_element_at(full, F.regexp_replace(t, "^-+|-+$", ""))), lambda c: c.isNotNull())
    city = F.try_element_at(named, F.lit(1))
    skip = ["house", "street", "no", "", *CITY_ABBREVIATIONS]
    area = F.filter(tokens, lambda t: ~t.isin(skip) & (t != F.coalesce(city, F.lit(""))) & ~t.rlike(r"^\d+$"))
    return F.struct(
        F.when(both, number(pair)).otherwise(house).alias("house"),
        F.when(both, F.regexp_extract(text, "(?U)" + pair, 2).try_cast("int")).otherwise(street).alias("street"),
        area.alias("area_tokens"),
        city.alias("city"),
    )


def normalize_cnic(cnic: Column) -> Column:
    """``struct<digits, prefix, last>``; masked numbers keep their anchored first five digits and last digit."""
    kept = F.regexp_replace(F.upper(clean(cnic)), "[^0-9X*]", "")
    masked, full = kept.rlike("[X*]"), kept.rlike("^[0-9]{13}$")
    part = lambda pattern: F.nullif(F.regexp_extract(kept, pattern, 1), F.lit(""))
    return F.struct(
        F.when(full, kept).alias("digits"),
        F.when(masked | full, part("^([0-9]{5})")).alias("prefix"),
        F.when(masked | full, part("([0-9])$")).alias("last"),
    )


def normalize_phone(phone: Column) -> Column:
    """eleven digits with a leading zero, else null."""
    digits = F.regexp_replace(F.coalesce(phone.cast("string"), F.lit("")), "[^0-9]", "")
    local = F.when(digits.startswith("92"), F.concat(F.lit("0"), F.substring(digits, 3, 100))).otherwise(digits)
    return F.when(F.length(local) == 11, local)


def address_key(address: Column) -> Column:
    """``city:house:street`` where house and city are known."""
    known = address["house"].isNotNull() & address["city"].isNotNull()
    return F.when(known, F.concat_ws(":", address["city"], address["house"].cast("string"), F.coalesce(address["street"].cast("string"), F.lit("None"))))
