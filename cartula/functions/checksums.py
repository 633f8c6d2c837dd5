"""Checks and check characters of identifiers, as Column expressions without Python.

The ``*_ok`` functions clean their input and never fail; the ``*_exact`` ones take it as it stands. Null gives null
from cleaning functions only where the text itself is null; every other bad input gives false.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartula.functions.text import let

_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Weight of each sign at an odd place of a tax code, in the order of the signs above.
_ODD = [
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21,
    1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23,
]
# Letter of each month in a tax code.
MONTHS = "ABCDEHLMPRST"

SPACE = r"(?U)[\s\x1c-\x1f]"


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _at(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def _letter(n: Column) -> Column:
    return F.substring(F.lit(_SIGNS[10:]), (n + 1).cast("int"), F.lit(1))


def tax_letter(body: Column, length: int = 15) -> Column:
    """Check letter of ``length`` digits and capitals: weighted by the odd table at even indices, by value at odd ones."""
    odd = F.array(*[F.lit(v) for v in _ODD])
    even = F.array(*[F.lit(v) for v in [*range(10), *range(26)]])

    def letter(b: Column) -> Column:
        return _letter(_sum([F.element_at(even if i % 2 else odd, F.instr(F.lit(_SIGNS), _at(b, i))) for i in range(length)]) % 26)

    return let(body, letter)


def cf_exact(s: Column) -> Column:
    """Whether 16 digits and capitals end with their check letter."""
    return let(s, lambda x: F.coalesce(F.when(x.rlike("^[0-9A-Z]{15}[A-Z]$"), tax_letter(x) == _at(x, 15)), F.lit(False)))


def cf_ok(s: Column) -> Column:
    """The same after trimming, in any case."""
    return cf_exact(F.upper(F.regexp_replace(s, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")))


def _doubled(d: Column) -> Column:
    x = d.cast("int") * 2
    return F.when(x > 9, x - 9).otherwise(x)


def vat_digit(ten: Column) -> Column:
    """Check digit of ten digits: those at odd indices doubled."""
    total = lambda t: _sum([_at(t, i).cast("int") if i % 2 == 0 else _doubled(_at(t, i)) for i in range(10)])
    return let(ten, lambda t: ((10 - total(t) % 10) % 10).cast("string"))


def piva_exact(s: Column) -> Column:
    """Whether a text is 11 digits that end with their check digit."""
    return let(s, lambda x: F.coalesce(F.when(x.rlike("^[0-9]{11}$"), vat_digit(x) == _at(x, 10)), F.lit(False)))


# Decimal digits of the first plane of Unicode that aren't ASCII.
_DIGITS = "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd")


def digits(s: Column) -> Column:
    """The decimal digits of a text, of whatever script, as ASCII digits."""
    plain = F.when(s.rlike(r"^\p{ASCII}*$"), s).otherwise(F.translate(s, _DIGITS, "".join(str(unicodedata.digit(c)) for c in _DIGITS)))
    return F.regexp_replace(plain, r"[^0-9]", "")


def piva_ok(s: Column) -> Column:
    """The same after leaving out what is no digit; digits of any script count."""
    return piva_exact(digits(s))


def mod97(s: Column) -> Column:
    """A text of digits and capitals as a number (A = 10 ... Z = 35) modulo 97; null when it has another sign."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, "(?!^)(?!$)"), F.lit(0), step)


def iban_exact(s: Column) -> Column:
    """Whether the account number, its first four signs moved to the end, leaves 1 modulo 97; no cleaning."""
    return let(s, lambda x: F.coalesce(F.when(x.rlike("^[0-9A-Z]+$"), mod97(F.concat(F.substring(x, 5, 1000), F.substring(x, 1, 4))) == 1), F.lit(False)))


def iban_ok(s: Column) -> Column:
    """The same without white space, in any case, of 15 to 34 signs."""
    clean = F.upper(F.regexp_replace(s, SPACE, ""))
    return let(clean, lambda x: F.coalesce(F.length(x).between(15, 34), F.lit(False)) & iban_exact(x))


def luhn_ok(s: Column) -> Column:
    """Whether the digits of a text, of any script, are 13 to 19 and pass the Luhn check."""
    return let(digits(s), lambda x: F.coalesce(F.length(x).between(13, 19) & F.call_function("luhn_check", x), F.lit(False)))


def piva_build(ten: Column) -> Column:
    """A VAT number from ten digits."""
    return let(ten, lambda t: F.concat(t, vat_digit(t)))


def iban_build(bank: Column, branch: Column, account: Column) -> Column:
    """An Italian account number from bank (5 digits), branch (5) and account (12)."""
    check = lambda bban: F.lpad((98 - mod97(F.concat(bban, F.lit("IT00")))).cast("string"), 2, "0")
    whole = let(F.concat(bank, branch, account), lambda d: F.concat(tax_letter(d, 22), d))
    return let(whole, lambda bban: F.concat(F.lit("IT"), check(bban), bban))


def _letters(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii() and x.isalpha())


# Signs that decompose to one plain letter, and these letters, by the rule of Unicode; and the few that do to more.
_MARKED = "".join(c for c in map(chr, range(128, 0xFFFF)) if len(_letters(c)) == 1)
_PLAIN = "".join(map(_letters, _MARKED))
_DOUBLE = {c: _letters(c) for c in map(chr, range(128, 0xFFFF)) if len(_letters(c)) > 1}


def strip_accents(s: Column) -> Column:
    """Plain capitals of a name: signs decomposed, marks off letters, all else out (a letter that doesn't decompose goes, too)."""
    table = F.create_map(*[F.lit(x) for kv in _DOUBLE.items() for x in kv])
    more = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(table[c], c)), "")
    whole = F.when(s.rlike("[" + "".join(_DOUBLE) + "]"), more).otherwise(s)
    return F.upper(F.regexp_replace(F.translate(whole, _MARKED, _PLAIN), "[^A-Za-z]", ""))


def _three(s: Column) -> Column:
    return F.substring(F.concat(F.regexp_replace(s, "[AEIOU]", ""), F.regexp_replace(s, "[^AEIOU]", ""), F.lit("XXX")), 1, 3)


def surname_code(name: Column) -> Column:
    """Consonants, then vowels, then X: the first three."""
    return let(strip_accents(name), _three)


def name_code(name: Column) -> Column:
    """As for surnames; of four or more consonants the first, third and fourth."""
    some = lambda s, c: F.when(F.length(c) >= 4, F.concat(_at(c, 0), _at(c, 2), _at(c, 3))).otherwise(_three(s))
    return let(strip_accents(name), lambda s: let(F.regexp_replace(s, "[AEIOU]", ""), lambda c: some(s, c)))


def cf_build(given: Column, surname: Column, sex: Column, year: Column, month: Column, day: Column, place: Column) -> Column:
    """A tax code; ``place`` is the municipality's code (a letter and three digits), days of women count from 41."""
    two = lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    body = F.concat(surname_code(surname), name_code(given), two(year), F.substring(F.lit(MONTHS), month, F.lit(1)), two(F.when(sex == "F", day + 40).otherwise(day)), place)
    return let(body, lambda b: F.concat(b, tax_letter(b)))
