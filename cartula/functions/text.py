"""Scalar and array functions over text, as Column expressions. Offsets count code points and are half open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode and Python see it, inside a character class.
WS = r"\s\x1c-\x1f"
#: A sign of a word: letters, numbers and the underscore (combining marks are none).
WORD = r"\p{L}\p{N}_"
TOKEN = rf"(?U)[{WORD}]+|[^{WORD}{WS}]"
BLOCK = rf"(?U)[^{WS}]+"
SLOT = rf"\{{([{WORD}]+)\}}"

_SIGN = "\ufdd0"
Span = "array<struct<value:string,start:int,end:int>>"


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` or a lambda in it reads the value."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern with its offsets, left to right: array of (value, start, end).

    One scan puts a sign that no text should hold (U+FDD0; read as U+FFFD where one does, values keep it) around each match; the
    text cut at that sign is gap and match in turn, and offsets are running sums of lengths, carried in one fold.
    Null gives null, no match an empty array.
    """
    zero = F.struct(F.lit(0).alias("p"), F.lit(False).alias("odd"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["p"] + F.length(x)).alias("p"), (~a["odd"]).alias("odd"), F.when(a["odd"], F.concat(a["out"], F.array(a["p"]))).otherwise(a["out"]).alias("out"))

    def placed(cut: Column) -> Column:
        own = F.filter(cut, lambda x, i: i % 2 == 1)
        starts = F.aggregate(cut, zero, step, lambda a: a["out"])
        value = lambda x, p: F.when(F.contains(text, F.lit(_SIGN)), F.substring(text, p + 1, F.length(x))).otherwise(x)
        return F.when(F.size(cut) < 2, F.array().cast(Span)).otherwise(F.zip_with(own, starts, lambda x, p: F.struct(value(x, p).alias("value"), p.alias("start"), (p + F.length(x)).alias("end"))))

    marked = F.regexp_replace(F.replace(text, F.lit(_SIGN), F.lit("\ufffd")), F.lit(pattern), F.lit(f"{_SIGN}$0{_SIGN}"))
    return F.when(text.isNull(), F.lit(None).cast(Span)).otherwise(let(F.split(marked, _SIGN, -1), placed))


def tokens(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0))


def slots(template: Column) -> Column:
    """Names in braces, in order."""
    return F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))


def parts(template: Column) -> Column:
    """A template cut at its slots: array of (text, slot); literal parts have a null slot, empty ones are left out."""
    kind = "array<struct<text:string,slot:string>>"
    both = F.arrays_zip(F.split(template, SLOT, -1).alias("0"), slots(template).alias("1"))  # one more gap than slots
    zipped = F.transform(both, lambda x: F.array(F.struct(x["0"].alias("text"), F.lit(None).cast("string").alias("slot")), F.struct(F.lit("").alias("text"), x["1"].alias("slot"))))
    return F.filter(F.flatten(zipped).cast(kind), lambda x: x["slot"].isNotNull() | (x["text"] != ""))


def same_value(text: Column) -> Column:
    """The key under which values count as one: white space runs as one space, trimmed, without letter case."""
    return casefold(F.trim(F.regexp_replace(text, rf"(?U)[{WS}]+", " ")))


# Signs whose folded form isn't their small letter, by the rule of Unicode.
_FOLDED = {c: c.casefold() for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x20000)]) if c.casefold() != c.lower()}


def casefold(text: Column) -> Column:
    """Without letter case: full case folding, sign by sign (sharp s as ss, any sigma as one)."""
    table = F.create_map(*[F.lit(x) for kv in _FOLDED.items() for x in kv])
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], F.lower(c)))
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(F.array_join(each, ""))


def placeholder(label: Column, n: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), n.cast("string"), F.lit("]"))


def label_of(mark: Column) -> Column:
    """The label of a placeholder: all up to the last underscore; empty when it is none."""
    return F.regexp_extract(mark, r"^\[(.*)_\d+\]$", 1)


def hue(label: Column) -> Column:
    """A colour angle that a label always gets: (h * 31 + code) mod 360 over its UTF-16 units."""
    units = F.regexp_extract_all(F.hex(F.encode(label, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    return F.aggregate(units, F.lit(0), lambda h, c: ((h * 31 + F.conv(c, 16, 10).cast("int")) % 360).cast("int"))


def lead(text: Column) -> Column:
    """How many signs of white space a text begins with."""
    return F.length(text) - F.length(F.regexp_replace(text, rf"(?U)^[{WS}]+", ""))


def tail(text: Column) -> Column:
    """How many signs of white space a text ends with."""
    return F.length(text) - F.length(F.regexp_replace(text, rf"(?U)[{WS}]+$", ""))


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def capitalised(word: Column) -> Column:
    """First sign large, all others small."""
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))


def without_suffix(label: Column) -> Column:
    """A label without its last underscore and what follows."""
    return F.regexp_replace(label, "_[^_]*$", "")


def span_list(literal: Column) -> Column:
    """A list literal of [start, end, label]: array of (start, end, label); null when it can't be read."""
    raw = F.from_json(literal, "array<array<string>>", {"allowSingleQuotes": "true"})
    return F.transform(raw, lambda x: F.struct(F.get(x, F.lit(0)).cast("int").alias("start"), F.get(x, F.lit(1)).cast("int").alias("end"), F.get(x, F.lit(2)).alias("label")))


def weights(spec: Column) -> Column:
    """``TAG=2,OTHER=3.5`` as a map of capitals to numbers; an entry without a number gives null."""
    raw = F.str_to_map(spec, F.lit(r"[,\s]+"), F.lit("="))
    return F.transform_values(F.transform_keys(raw, lambda k, v: F.upper(F.trim(k))), lambda k, v: v.try_cast("double"))


def strip_code_marks(text: Column) -> Column:
    """A text without fences of code blocks and white space around."""
    edge = rf"(?U)\A[{WS}]+|[{WS}]+\z"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, edge, ""), r"(?m)^```.*?\n|```$", ""), edge, "")


def contains_any(text: Column, keys: list[str]) -> Column:
    """Whether any key occurs, in any letter case."""
    low = F.lower(text)
    hit = F.lit(False)
    for k in keys:
        hit = hit | F.contains(low, F.lit(k.lower()))
    return hit


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def choose(values: list[str], *keys: Column, seed: int = 42) -> Column:
    """One of the values, each as likely, by the keys and the seed."""
    at = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(len(values))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
