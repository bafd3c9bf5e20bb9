"""Checks of candidate values, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from privlake.functions.spans import once
from privlake.schema import literal_map

# --- fixed values: IBAN length by country ---
IBAN_LENGTH = {
    "SN": 28, "BJ": 28, "TG": 28, "CI": 28, "BF": 28, "ML": 28, "NE": 28, "GW": 28, "CM": 27, "GA": 27, "CD": 27,
    "FR": 27, "BE": 16, "DE": 22, "ES": 24, "IT": 27, "PT": 25, "NL": 18, "LU": 20, "CH": 21, "GB": 22, "MA": 28, "TN": 24, "DZ": 26,
}
# --- fixed values: lengths of national numbers by calling code ---
NATIONAL_LENGTH = {
    "221": (9,), "229": (8, 10), "228": (8,), "225": (10,), "233": (9,), "226": (8,), "223": (8,), "227": (8,), "234": (10,), "33": (9,),
}
# --- fixed values: French month names ---
MONTHS = {
    "janvier": 1, "fevrier": 2, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "août": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12, "décembre": 12,
}
# --- fixed values: national identity numbers, (length, pattern of the start) by country ---
IDENTITY = {"SN": (13, "[12]"), "BJ": (10, ""), "TG": (13, ""), "CI": (11, "C")}
FIRST_YEAR = 1900
# --- fixed values: the forms of a date: day, month and year in digits; with a month's name; year first ---
DATE_FORMS = (
    r"^(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{2,4})$",
    r"^(\d{1,2})(?:er)?\s+([a-zéûôà]+)\s+(\d{4})$",
    r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$",
)


def iban_valid(value: Column) -> Column:
    """Length of the country, and remainder 1 modulo 97 once the first four characters are moved to the end."""
    c = F.upper(F.regexp_replace(value, r"(?U)[\s-]", ""))
    moved = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
        return F.when(n > 9, acc * 100 + n).otherwise(acc * 10 + n) % 97

    remainder = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step)
    length = F.try_element_at(literal_map(IBAN_LENGTH), F.substr(c, F.lit(1), F.lit(2)))
    shaped = c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & F.coalesce(F.length(c) == length, F.lit(True))
    return F.when(shaped, remainder == 1).otherwise(F.lit(False))


def card_valid(value: Column) -> Column:
    """13 to 19 digits, not all the same, that pass Luhn's check."""
    c = F.regexp_replace(value, r"(?U)[\s.-]", "")
    return F.when(c.rlike("^[0-9]{13,19}$") & ~c.rlike(r"^(.)\1+$"), F.call_function("luhn_check", c)).otherwise(F.lit(False))


def phone_valid(value: Column) -> Column:
    """Length of the national number by calling code, longest code first; 8 to 15 digits for others, 8 to 10 without a code."""

    def of(c: Column) -> Column:
        rest, ok = F.substr(c, F.lit(2)), None
        for code, lengths in sorted(NATIONAL_LENGTH.items(), key=lambda x: -len(x[0])):
            fits = (F.length(c) - 1 - len(code)).isin(*lengths)
            ok = F.when(rest.startswith(code), fits) if ok is None else ok.when(rest.startswith(code), fits)
        ok = ok.otherwise(F.length(rest).between(8, 15))
        return F.coalesce(F.when(c.rlike(r"^\+[0-9]+$"), ok).otherwise(c.rlike("^[0-9]{8,10}$")), F.lit(False))

    return once(F.regexp_replace(F.regexp_replace(value, r"(?U)[\s.\-()/]", ""), "^00", "+"), of)


def parsed_date(value: Column) -> Column:
    """d/m/y in digits (two-digit years over 30 are 19xx), a day with a French month name, or y-m-d; else null."""
    t = F.lower(F.trim(value))
    number, words, iso = DATE_FORMS
    part = lambda p, k: F.regexp_extract(t, p, k)
    date = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    year = part(number, 3).try_cast("int")
    year = F.when(year < 100, year + F.when(year > 30, 1900).otherwise(2000)).otherwise(year)
    month = F.try_element_at(literal_map(MONTHS), part(words, 2))
    return (
        F.when(t.rlike(number), date(year.cast("string"), part(number, 2), part(number, 1)))
        .when(t.rlike(words), date(part(words, 3), month.cast("string"), part(words, 1)))
        .when(t.rlike(iso), date(part(iso, 1), part(iso, 2), part(iso, 3)))
    )


def birth_date_valid(value: Column, today: Column) -> Column:
    """A real date from 1900 to ``today`` (a parameter: results don't depend on the clock)."""
    return once(parsed_date(value), lambda d: F.coalesce((F.year(d) >= FIRST_YEAR) & (d <= today), F.lit(False)))


def identity_valid(value: Column, country: str | None = None) -> Column:
    """National identity number by length and start; of any known country without one."""
    forms = [IDENTITY[country]] if country in IDENTITY else list(IDENTITY.values())

    def of(c: Column) -> Column:
        fits = [(F.length(c) == n) & c.rlike(f"^{start}") for n, start in forms]
        return F.coalesce((F.length(c) >= 8) & reduce(lambda a, b: a | b, fits), F.lit(False))

    return once(F.upper(F.regexp_replace(value, r"(?U)[\s.\-]", "")), of)
