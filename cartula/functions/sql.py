"""The checks as SQL functions of a session; their bodies are SQL, so Catalyst inlines them and no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cartula.functions.checksums import _ODD, _SIGNS

_AT = f"instr('{_SIGNS}', substr(s, i, 1))"
_CLEAN = r"upper(regexp_replace(s, r'(?U)[\s\x1c-\x1f]', ''))"
_ENDS = r"upper(regexp_replace(s, r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', ''))"

#: Name, arguments, result and body of each function, in an order in which each uses earlier ones only.
FUNCTIONS = [
    ("mod97", "s STRING", "INT", "aggregate(split(s, '(?!^)(?!$)'), 0, (a, c) -> CASE WHEN c RLIKE '[0-9]' THEN (a * 10 + int(c)) % 97 WHEN c RLIKE '[A-Z]' THEN (a * 100 + ascii(c) - 55) % 97 END)"),
    ("tax_letter", "s STRING", "STRING", f"substr('{_SIGNS[10:]}', aggregate(sequence(1, 15), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN element_at(array({', '.join(map(str, _ODD))}), {_AT}) WHEN {_AT} <= 10 THEN {_AT} - 1 ELSE {_AT} - 11 END) % 26 + 1, 1)"),
    ("vat_digit", "s STRING", "STRING", "string((10 - aggregate(sequence(1, 10), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(s, i, 1)) WHEN int(substr(s, i, 1)) > 4 THEN int(substr(s, i, 1)) * 2 - 9 ELSE int(substr(s, i, 1)) * 2 END) % 10) % 10)"),
    ("cf_exact", "s STRING", "BOOLEAN", "coalesce(CASE WHEN s RLIKE '^[0-9A-Z]{15}[A-Z]$' THEN tax_letter(s) = substr(s, 16, 1) END, false)"),
    ("piva_exact", "s STRING", "BOOLEAN", "coalesce(CASE WHEN s RLIKE '^[0-9]{11}$' THEN vat_digit(s) = substr(s, 11, 1) END, false)"),
    ("iban_exact", "s STRING", "BOOLEAN", "coalesce(CASE WHEN s RLIKE '^[0-9A-Z]+$' THEN mod97(concat(substr(s, 5), substr(s, 1, 4))) = 1 END, false)"),
    ("cf_ok", "s STRING", "BOOLEAN", f"cf_exact({_ENDS})"),
    ("piva_ok", "s STRING", "BOOLEAN", "piva_exact(regexp_replace(s, '[^0-9]', ''))"),
    ("iban_ok", "s STRING", "BOOLEAN", f"coalesce(length({_CLEAN}) BETWEEN 15 AND 34, false) AND iban_exact({_CLEAN})"),
    ("luhn_ok", "s STRING", "BOOLEAN", "coalesce(length(regexp_replace(s, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(s, '[^0-9]', '')), false)"),
]


def register(spark: SparkSession) -> list[str]:
    """Make the checks functions of the session; gives their names. Digits are ASCII here."""
    for name, args, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
