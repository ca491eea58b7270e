"""Deterministic pseudonyms: the same identity gets the same fake name, e-mail and phone, by hashing alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.functions.scalars import _c, full_name, text_or_empty, trim_space

# Pseudonyms must be the same everywhere.
FIRST_NAMES = [
    "Alex", "Avery", "Blake", "Casey", "Charlie", "Dakota", "Drew", "Elliot", "Emerson", "Finley",
    "Harper", "Hayden", "Indigo", "Jamie", "Jordan", "Kai", "Kendall", "Lane", "Logan", "Morgan",
    "Noel", "Parker", "Quinn", "Reese", "Remy", "River", "Rowan", "Rylan", "Sage", "Sawyer",
    "Shawn", "Skyler", "Spencer", "Taylor", "Terry", "Winter", "Wren", "Ari", "Micah", "Nico",
    "Ash", "Cameron", "Jules", "Kris", "Lee", "Milan", "Robin", "Shay", "Tatum", "Zion",
]
LAST_NAMES = [
    "Adams", "Baker", "Barnes", "Bennett", "Brooks", "Campbell", "Carter", "Collins", "Cooper", "Cruz",
    "Davis", "Diaz", "Edwards", "Evans", "Foster", "Garcia", "Gomez", "Gray", "Green", "Hall",
    "Harris", "Hayes", "Hill", "Howard", "Hughes", "James", "Jenkins", "Kelly", "King", "Lee",
    "Lewis", "Long", "Lopez", "Martin", "Miller", "Mitchell", "Moore", "Morgan", "Morris", "Nelson",
    "Parker", "Perry", "Price", "Reed", "Rivera", "Roberts", "Russell", "Stewart", "Taylor", "Ward",
]


def hash_hex(c: Column | str, secret: str = "") -> Column:
    """SHA-256 in hex; with a secret that isn't blank, HMAC-SHA-256 keyed with it."""
    data = F.encode(_c(c), "UTF-8")
    if not secret.strip():
        return F.sha2(data, 256)
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def hash_byte(hexed: Column, i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(hexed, 2 * at + 1, F.lit(2)), 16, 10).cast("int")


def canonical(c: Column | str) -> Column:
    return F.lower(trim_space(text_or_empty(c)))


def only_digits(c: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(c), "[^0-9]", "")


def slug(c: Column | str) -> Column:
    s = F.regexp_replace(F.regexp_replace(canonical(c), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    return F.when(s == "", "anon").otherwise(s)


def person_key(first: Column | str, last: Column | str, email: Column | str, phone: Column | str | None = None) -> Column:
    """What stands for a person: the e-mail, else the name, else (where a phone is given) the phone; empty for none."""
    mail, name = canonical(email), canonical(full_name(first, last))
    out = F.when(mail != "", F.concat(F.lit("email:"), mail)).when(name != "", F.concat(F.lit("name:"), name))
    if phone is not None:
        out = out.when(canonical(phone) != "", F.concat(F.lit("phone:"), only_digits(phone)))
    return out.otherwise("")


def fake_person(key: Column | str, secret: str = "") -> Column:
    """struct(first, last, email) for a key."""
    h = hash_hex(F.concat(F.lit("person|"), _c(key)), secret)
    # One literal for each list, which the optimizer folds into an array; a literal for each name would make plans slow to build.
    pick = lambda names, i: F.element_at(F.split(F.lit(",".join(names)), ","), hash_byte(h, i) % len(names) + 1)
    first, last = pick(FIRST_NAMES, 0), pick(LAST_NAMES, 1)
    # All names of the lists are one word, so their slugs are their lower case.
    email = F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("-"), F.substring(h, 5, 4), F.lit("@anon.local"))
    return F.struct(first.alias("first"), last.alias("last"), email.alias("email"))


def redact_person(first: Column | str, last: Column | str, email: Column | str, secret: str = "") -> Column:
    """struct(first, last, email): both names replaced if either is there, the e-mail if it is; nothing without a key."""
    key = person_key(first, last, email)
    fake, named = fake_person(key, secret), canonical(full_name(first, last)) != ""
    swap = lambda old, new, when: F.when((key != "") & when, new).otherwise(_c(old))
    return F.struct(swap(first, fake["first"], named).alias("first"), swap(last, fake["last"], named).alias("last"), swap(email, fake["email"], canonical(email) != "").alias("email"))


def redact_email(email: Column | str, secret: str = "") -> Column:
    key = canonical(email)
    return F.when(key != "", fake_person(F.concat(F.lit("email:"), key), secret)["email"]).otherwise(_c(email))


def redact_phone(phone: Column | str, secret: str = "") -> Column:
    """Other digits, the same separators and length. The first digit is never 0. Digits are 0 to 9."""
    p, digits = _c(phone), only_digits(phone)
    h = hash_hex(F.concat(F.lit("phone|"), digits), secret)

    def swap(ch: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(p, F.lit(1), i), "[^0-9]", ""))
        d = ((hash_byte(h, at % 32) + at) % 256) % 10
        return F.when(F.regexp_like(ch, F.lit("^[0-9]$")), F.when((at == 0) & (d == 0), F.lit(7)).otherwise(d).cast("string")).otherwise(ch)

    return F.when(digits == "", p).otherwise(F.array_join(F.transform(F.split(p, ""), swap), ""))


def token(kind: str, raw: Column | str, secret: str = "") -> Column:
    """``[[kind_xxxx]]`` with the first two hash bytes of kind and value, so 65,536 tokens for each kind."""
    h = hash_hex(F.concat(F.lit(kind.strip().lower() + "|"), canonical(raw)), secret)
    return F.concat(F.lit(f"[[{kind}_"), F.substring(h, 1, 4), F.lit("]]"))
