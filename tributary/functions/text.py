"""Normalizers as Catalyst expressions: everything stays in the JVM and composes into one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import CALLING_CODES, CITY_ALIASES, MARKED, OFFICIAL_FORM, OTHER_CODES, OTHER_NATIONAL, SKILL_ALIASES, country_codes, lookup, region_codes

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LINK = "STRUCT<kind: STRING, url: STRING, handle: STRING>"
LOCATION = "STRUCT<city: STRING, region: STRING, country: STRING>"


def strip(x: Column, chars: str = r"\s") -> Column:
    """Trims Unicode white space (or the characters of a class) on both sides."""
    return F.regexp_replace(x, rf"(?U)^[{chars}]+|[{chars}]+$", "")


def none_if_blank(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def result(value: Column, ok: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))


def email(raw: Column) -> Column:
    clean = F.lower(strip(raw))
    return result(clean, clean.rlike(EMAIL))


def phone(raw: Column, region: str = "IN") -> Column:
    """E.164 by the numbering plans at hand, elsewhere by assigned calling code and length; anything else stays as it is, not ok."""
    clean = strip(raw)
    digits = F.regexp_replace(clean, r"\D", "")
    found = []  # in one coalesce: nested ones cost each task seconds before its first row, in the search for common subexpressions
    for code, cc, trunk, national in CALLING_CODES:
        intl = digits.rlike(f"^{cc}(?:{national})$")
        found.append(F.when(clean.startswith("+") & intl, F.concat(F.lit("+"), digits)))
        if code == region:
            local = F.regexp_replace(digits, f"^{trunk}(?=(?:{national})$)", "") if trunk else digits
            found.append(F.when(~clean.startswith("+") & local.rlike(f"^(?:{national})$"), F.concat(F.lit(f"+{cc}"), local)))
            found.append(F.when(~clean.startswith("+") & intl, F.concat(F.lit("+"), digits)))
    known = "|".join(sorted({cc for _, cc, _, _ in CALLING_CODES}))
    other = clean.startswith("+") & digits.rlike(f"^(?:{OTHER_CODES}){OTHER_NATIONAL}$") & ~digits.rlike(f"^(?:{known})") & (F.length(digits) <= 15)
    best = F.coalesce(*found, F.when(other, F.concat(F.lit("+"), digits)))
    best = F.when(clean.rlike("[A-Za-z]"), F.lit(None)).otherwise(best)
    return result(F.coalesce(best, clean), best.isNotNull())


def country(token: Column) -> Column:
    """Alpha-2 code of an ISO 3166 code, a known English name, an official name ("Kingdom of ...") or a region of some countries, or null."""
    name = F.regexp_replace(F.lower(F.translate(strip(token), "".join(MARKED), "".join(MARKED.values()))), r"\.", "")
    known = country_codes()
    none = F.lit(None).cast("string")
    # the bare name behind an official form, which a code of two or three letters is not
    bare = F.regexp_replace(name, OFFICIAL_FORM, "")
    official = F.when((bare != name) & (F.length(bare) > 3), lookup(known, bare, none))
    return F.coalesce(lookup(known, name, none), official, lookup(region_codes(), name, none))


def country_result(raw: Column) -> Column:
    code = country(raw)
    return result(F.coalesce(code, strip(raw)), code.isNotNull())


def skill(raw: Column) -> Column:
    clean = strip(raw)
    known = lookup(SKILL_ALIASES, F.lower(clean), F.lit(None).cast("string"))
    plausible = (F.length(clean) <= 40) & (F.size(words(clean)) <= 4) & clean.rlike(r"\p{L}")
    return result(F.coalesce(known, clean), known.isNotNull() | plausible)


def name(raw: Column) -> Column:
    clean = F.array_join(words(raw), " ")
    return result(clean, clean != "")


def years(raw: Column) -> Column:
    """value is STRUCT<num, text>: a number, or the raw text where none is found."""
    num = F.regexp_extract(raw, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return result(F.struct(num.alias("num"), F.when(num.isNull(), raw).alias("text")), num.isNotNull())


def month(raw: Column) -> Column:
    """YYYY-MM of a date; null and ok for a date that is still open."""
    t = F.lower(strip(raw))
    formats = ("MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy/MM", "MM/yyyy", "yyyy-MM-dd", "dd MMM yyyy", "yyyy")
    at = F.coalesce(*(F.try_to_timestamp(F.initcap(t), F.lit(f)) for f in formats))
    open_ = t.isin("present", "current", "now", "ongoing")
    return result(F.when(~open_, F.date_format(at, "yyyy-MM")), (open_ | at.isNotNull()) & (t != ""))


def location(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, ","), lambda s_: strip(s_)), lambda p: p != "")
    n = F.size(parts)
    code = country(F.get(parts, n - 1))
    city = lookup(CITY_ALIASES, F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(0)))
    region = F.when(n >= 3, F.get(parts, F.lit(1)))
    alone = code.isNotNull() & (n == 1)  # one part that is a country leaves no city
    value = F.struct(F.when(~F.coalesce(alone, F.lit(False)), city).alias("city"), region.alias("region"), code.alias("country"))
    return result(value, code.isNotNull() | city.isNotNull())


def canonical_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(url), "(?i)^https?://", ""), r"(?i)^www\.", "")
    return F.lower(F.regexp_replace(bare, "/+$", ""))


def handle(kind: Column, url: Column) -> Column:
    """The user name in a canonical profile address, or null."""
    parts = F.filter(F.split(url, "/"), lambda p: p != "")
    path = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    at = F.get(F.filter(F.transform(path, lambda p, i: F.when(p.isin("in", "pub") & (i + 1 < F.size(path)), i)), lambda i: i.isNotNull()), F.lit(0))
    return F.when(kind == "github", F.get(path, F.lit(0))).when(kind == "linkedin", F.get(path, at + 1))


def link(raw: Column) -> Column:
    url = strip(raw)
    low = F.lower(url)
    kind = F.when(low.contains("github.com"), "github").when(low.contains("linkedin.com"), "linkedin").when(low.startswith("http"), "portfolio").otherwise("unknown")
    canonical = canonical_url(url)
    return result(F.struct(kind.alias("kind"), canonical.alias("url"), handle(kind, canonical).alias("handle")), kind != "unknown")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def candidate_id(email_: Column, phone_: Column, name_: Column, location_: Column) -> Column:
    """First 16 hex digits of the sha256 of the best identity at hand."""
    basis = F.coalesce(
        F.concat(F.lit("email:"), F.lower(F.nullif(email_, F.lit("")))),
        F.concat(F.lit("phone:"), F.nullif(phone_, F.lit(""))),
        F.when(F.nullif(name_, F.lit("")).isNotNull(), F.concat(F.lit("name:"), slug(name_), F.lit("|loc:"), slug(F.coalesce(location_, F.lit(""))))),
        F.lit("anonymous"),
    )
    return F.substring(F.sha2(basis, 256), 1, 16)


def surname_key(x: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)), F.lit(-1))


#: Letters of one BIGINT: two bits stay free, so that a sum with its carry does not overflow.
_LETTERS = 62
_ALL = (1 << _LETTERS) - 1


def computed(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: an expression that a lambda refers to is else computed at each call."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _bits(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1


def _masks(parts: Column, letters: Column) -> Column:
    """For each of the letters the bits of its places in each part (strings), the last place being the lowest bit."""
    names = F.struct(letters.alias("each"), F.array_join(letters, "").alias("all"), F.call_function("repeat", F.lit("0"), F.size(letters)).alias("zeros"))

    def made(p: Column) -> Column:
        def of(_: Column, i: Column) -> Column:
            ones = F.overlay(p["zeros"], F.lit("1"), i + 1)
            return F.transform(parts, lambda part: F.conv(F.call_function("translate", part, p["all"], ones), 2, 10).cast("long"))

        return F.map_from_arrays(p["each"], F.transform(p["each"], of))

    return computed(names, made)


def _lcs(x: Column, y: Column) -> Column:
    """Of texts that are not empty. The state is an array of words, from the end of x."""
    n = F.length(x)
    count = F.floor((n - 1) / _LETTERS).cast("int")
    part = lambda w: F.substr(x, F.greatest(F.lit(1), n - (w + 1) * F.lit(_LETTERS) + 1), F.least(F.lit(_LETTERS), n - w * F.lit(_LETTERS)))
    parts = F.transform(F.sequence(F.lit(0), count), part)
    letters = F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))

    def found(p: Column) -> Column:
        ys = F.split(F.reverse(y), "")

        def one(v: Column, c: Column) -> Column:
            m = F.get(F.try_element_at(p["masks"], c), F.lit(0))
            return F.when(m.isNull(), v).otherwise((v + v.bitwiseAND(m)).bitwiseAND(F.get(p["used"], F.lit(0))).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))))

        def many(v: Column, c: Column) -> Column:
            empty = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))

            def word(s: Column, z: Column) -> Column:
                total = z["v"] + z["v"].bitwiseAND(z["m"]) + s["carry"]
                new = total.bitwiseAND(F.lit(_ALL)).bitwiseOR(z["v"].bitwiseAND(F.bitwise_not(z["m"]))).bitwiseAND(z["used"])
                return F.struct(F.array_append(s["out"], new).alias("out"), F.shiftright(total, _LETTERS).alias("carry"))

            m = F.try_element_at(p["masks"], c)
            zipped = F.arrays_zip(v.alias("v"), m.alias("m"), p["used"].alias("used"))
            return F.when(m.isNull(), v).otherwise(F.aggregate(zipped, empty, word, lambda s: s["out"]))

        left = F.bit_count(F.aggregate(ys, F.get(p["used"], F.lit(0)), one))
        left_of_many = F.aggregate(F.aggregate(ys, p["used"], many), F.lit(0), lambda t, v: t + F.bit_count(v))
        return n - F.when(n <= _LETTERS, left).otherwise(left_of_many)

    return computed(parts, lambda q: computed(F.struct(computed(letters, lambda d: _masks(q, d)).alias("masks"), F.transform(q, lambda w: _bits(F.length(w))).alias("used")), found))


def lcs_length(x: Column, y: Column) -> Column:
    """Length of the longest common subsequence of two texts, by bits (Hyyrö, 2004).

    A word of bits stands for 62 letters of x, and a letter of y takes one step: with m the places of that letter in x,
    v becomes (v + (v and m)) or (v and not m), sums carried from word to word. Bits of v that became 0 are the answer.
    """
    empty = (F.length(x) == 0) | (F.length(y) == 0)
    return F.when(empty, 0).otherwise(computed(F.struct(x.alias("x"), y.alias("y")), lambda p: _lcs(p["x"], p["y"])))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """100 * 2 LCS / (len a + len b) of the texts with their words sorted."""
    sorted_ = lambda c: F.array_join(F.array_sort(words(c)), " ")

    def ratio(p: Column) -> Column:
        total = F.length(p["x"]) + F.length(p["y"])
        return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(p["x"], p["y"]) / total)

    return F.when(a.isNotNull() & b.isNotNull(), computed(F.struct(sorted_(a).alias("x"), sorted_(b).alias("y")), ratio))
