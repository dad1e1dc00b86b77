"""Seeded field values: identities, prices, numbers, dates, check boxes, patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draw import between, draw, pick

FIRST = ["Ada", "Ben", "Carla", "Dmitri", "Elif", "Femi", "Greta", "Hugo", "Ines", "Jonas", "Kira", "Liam", "Mona", "Noor", "Otto", "Paula"]
LAST = ["Archer", "Bauer", "Castillo", "Dunn", "Eriksen", "Fontaine", "Garcia", "Holm", "Ivanova", "Jansen", "Keller", "Lindgren", "Moreau", "Novak", "Okafor", "Petrov"]
STREETS = ["Alder Way", "Birch Street", "Canal Road", "Dock Lane", "Elm Avenue", "Forge Hill", "Garden Row", "Harbour Street"]
CITIES = ["Ashford", "Bellmont", "Carrick", "Danvers", "Elmira", "Fairhaven", "Glenwood", "Hartwell"]
COMPANIES = ["Northline", "Bluewater", "Ironbridge", "Silverlake", "Redwood", "Stonegate"]
WORDS = ["amber", "bridge", "cloud", "delta", "ember", "field", "grove", "harbor", "island", "jetty", "kettle", "lantern"]

#: Fixed symbols.
CHECKBOXES = {"checkbox_checked": "☑", "checkbox_unchecked": "☐", "checkbox_x": "☒"}
IDENTITY_FIELDS = ["first_name", "last_name", "full_name", "initials", "address", "ssn", "signature"]
ANCHOR = "2024-01-01"


def identity(seed: Column, respondent: Column) -> Column:
    """struct of IDENTITY_FIELDS, all from one seed and respondent: correlated and repeatable."""
    first, last = pick(FIRST, seed, respondent, "first"), pick(LAST, seed, respondent, "last")
    full = F.concat_ws(" ", first, last)
    ssn = F.format_string("%03d-%02d-%04d", between(1, 899, seed, respondent, "a"), between(1, 99, seed, respondent, "b"), between(1, 9999, seed, respondent, "c"))
    return F.struct(
        first.alias("first_name"),
        last.alias("last_name"),
        full.alias("full_name"),
        F.concat(F.substring(first, 1, 1), F.lit("."), F.substring(last, 1, 1), F.lit(".")).alias("initials"),
        street(seed, respondent).alias("address"),
        ssn.alias("ssn"),
        full.alias("signature"),
    )


def street(*keys) -> Column:
    return F.concat_ws(" ", between(1, 999, *keys, "no").cast("string"), pick(STREETS, *keys, "street"))


def price(low: int, high: int, *keys) -> Column:
    """$ with thousands commas and two digits of cents."""
    return F.concat(F.lit("$"), F.format_number(between(low, high, *keys, "price"), 0), F.lit("."), F.format_string("%02d", between(0, 99, *keys, "cents")))


def digits(n: int, *keys) -> Column:
    """n digits, leading zeros allowed."""
    return F.concat(*[(draw(*keys, "digit", i) % 10).cast("string") for i in range(n)])


def date_within(days_from: int, days_to: int, pattern: str, anchor: str, *keys) -> Column:
    return F.date_format(F.date_add(F.lit(anchor).cast("date"), between(days_from, days_to, *keys, "day").cast("int")), pattern)


def fill_pattern(pattern: Column, letters: bool, *keys) -> Column:
    """# becomes a digit and, with letters, ? a lower-case letter."""

    def fill(c: Column, i: Column) -> Column:
        digit = (draw(*keys, i) % 10).cast("string")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw(*keys, i, "letter") % 26 + 1).cast("int"), F.lit(1))
        out = F.when(c == "#", digit)
        return (out.when(c == "?", letter) if letters else out).otherwise(c)

    return F.array_join(F.transform(F.split(pattern, ""), fill), "")


def address(*keys) -> Column:
    """Two lines: street, and city with its code."""
    return F.concat(street(*keys), F.lit("\n"), pick(CITIES, *keys, "city"), F.lit(" "), digits(5, *keys, "zip"))


def custom(anchor: str, *keys) -> dict[str, Column]:
    """Named providers of prices, numbers, dates and the address on one line."""
    written = "MMMM dd, yyyy"
    return {
        "price_short": price(1, 99, *keys),
        "price_medium": price(100, 9_999, *keys),
        "price_large": price(10_000, 999_999, *keys),
        "number_short": digits(4, *keys),
        "number_medium": digits(7, *keys),
        "number_long": digits(12, *keys),
        "date_numeric": date_within(-18_000, 0, "MM/dd/yyyy", anchor, *keys),
        "date_written": date_within(-18_000, 0, written, anchor, *keys),
        "signing_date": date_within(-1_461, 0, written, anchor, *keys),
        "effective_date": date_within(-1_461, 0, written, anchor, *keys, "effective"),
        "termination_date": date_within(1, 1_095, written, anchor, *keys),
        "address_single_line": F.replace(address(*keys), F.lit("\n"), F.lit(", ")),
    }


def generic(*keys) -> dict[str, Column]:
    """Named providers that a form offers."""
    name = F.concat_ws(" ", pick(FIRST, *keys, "first"), pick(LAST, *keys, "last"))
    return {
        "name": name,
        "email": F.concat(F.lower(F.replace(name, F.lit(" "), F.lit("."))), F.lit("@example.com")),
        "phone_number": F.concat(F.lit("555-"), digits(3, *keys, "p"), F.lit("-"), digits(4, *keys, "q")),
        "company": F.concat_ws(" ", pick(COMPANIES, *keys, "company"), F.lit("Ltd")),
        "address": address(*keys),
        "city": pick(CITIES, *keys, "city"),
        "postcode": digits(5, *keys, "zip"),
        "credit_card_number": F.concat(F.lit("4"), digits(15, *keys, "card")),
        "date_of_birth": date_within(-36_500, -6_570, "yyyy-MM-dd", ANCHOR, *keys),
        "sentence": F.concat(F.initcap(pick(WORDS, *keys, "w0")), *[F.concat(F.lit(" "), pick(WORDS, *keys, f"w{i}")) for i in range(1, 6)], F.lit(".")),
        "word": pick(WORDS, *keys, "word"),
    }


def zone_text(provider: Column, custom_values: Column, who: Column, seed: Column, zone: Column, anchor: str = ANCHOR) -> Column:
    """A zone's text: the first that fits of its own values, a check box, the respondent's identity, a custom provider, a generic one, a
    pattern (bothify:, numerify:), and a word. The pick among own values depends on the seed only, so equal lists agree within a document."""
    own = F.when(F.size(custom_values) > 0, F.try_element_at(custom_values, (draw(seed) % F.greatest(F.lit(1), F.size(custom_values)) + 1).cast("int")))
    out = F.when(own.isNotNull(), own)
    for name, symbol in CHECKBOXES.items():
        out = out.when(provider == name, F.lit(symbol))
    for name in IDENTITY_FIELDS:
        # an address of no known respondent is a generic one
        out = out.when((provider == name) & (who[name].isNotNull() if name == "address" else F.lit(True)), F.coalesce(who[name], F.lit("")))
    made = custom(anchor, seed, zone) | generic(seed, zone)
    for name, value in made.items():
        out = out.when(provider == name, value)
    pattern = F.regexp_replace(provider, "^(bothify|numerify):", "")
    out = out.when(provider.startswith("bothify:"), fill_pattern(pattern, True, seed, zone)).when(provider.startswith("numerify:"), fill_pattern(pattern, False, seed, zone))
    return out.otherwise(made["word"])
