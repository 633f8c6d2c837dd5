"""Detectors of identifiers: shapes, checks, and all candidates of a text with offsets; no Python, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartula.functions import checksums
from cartula.functions.text import WORD, WS, matches

Candidates = "array<struct<label:string,start:int,end:int,score:double,validated:boolean,source:string,ord:int>>"

_LEFT, _RIGHT = rf"(?<![{WORD}])", rf"(?![{WORD}])"


@dataclass(frozen=True)
class Detector:
    """``hint``: a cheap condition without which no match is possible. ``strict``: a failed check drops the match."""

    label: str
    pattern: str
    check: Callable[[Column], Column] | None = None
    strict: bool = True
    hint: str | None = None


# Labels and shapes of the identifiers, in the order in which their candidates come.
DETECTORS = [
    Detector("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", hint="@"),
    Detector("CF", rf"(?U){_LEFT}[A-Za-z]{{6}}\d{{2}}[A-Za-z]\d{{2}}[A-Za-z]\d{{3}}[A-Za-z]{_RIGHT}", checksums.cf_ok, strict=False),
    Detector("IBAN", rf"(?U){_LEFT}[A-Za-z]{{2}}\d{{2}}[A-Za-z0-9]{{11,30}}{_RIGHT}", checksums.iban_ok),
    Detector("CREDITCARDNUMBER", r"(?U)(?<!\d)(?:\d[ \-]?){13,19}(?!\d)", checksums.luhn_ok),
    Detector("PIVA", r"(?U)(?<!\d)\d{11}(?!\d)", checksums.piva_ok),
    Detector("TELEPHONENUM", rf"(?U)(?<![{WORD}.])(?:\+39[{WS}.]?)?(?:3\d{{2}}[{WS}.]?\d{{3}}[{WS}.]?\d{{3,4}}|0\d{{1,3}}[{WS}.]?\d{{5,8}}){_RIGHT}"),
    Detector(
        "AMOUNT",
        rf"(?iuU)(?:€|EUR|euro)[{WS}]?\d{{1,3}}(?:[.{WS}]\d{{3}})*(?:,\d{{2}})?|\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}[{WS}]?(?:€|EUR|euro)",
    ),
    Detector("TARGA", rf"(?U){_LEFT}[A-Za-z]{{2}}[{WS}]?\d{{3}}[{WS}]?[A-Za-z]{{2}}{_RIGHT}"),
]


def _of(text: Column, d: Detector, ord_: int) -> Column:
    found = matches(text, d.pattern)
    if d.hint:
        found = F.when(F.contains(text, F.lit(d.hint)), found).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))
    checked = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), (d.check(m["value"]) if d.check else F.lit(False)).alias("ok")))
    if d.check and d.strict:
        checked = F.filter(checked, lambda m: m["ok"])
    return F.transform(
        checked,
        lambda m, i: F.struct(
            F.lit(d.label).alias("label"), m["start"].alias("start"), m["end"].alias("end"), F.when(m["ok"], 1.0).otherwise(0.9).alias("score"),
            m["ok"].alias("validated"), F.lit("regex").alias("source"), (F.lit(ord_ * 1_000_000) + i).alias("ord"),
        ),
    ).cast(Candidates)


def candidates(text: Column, detectors: list[Detector] = DETECTORS) -> Column:
    """All candidates of a text, detector by detector, each from left to right.

    The score is 1 where a check passed, else 0.9. Null gives null; a text without a digit or an @ is not searched.
    """
    none = F.array().cast(Candidates)
    some = F.concat(*[_of(text, d, 1000 + i) for i, d in enumerate(detectors)])
    return F.when(text.isNull(), F.lit(None).cast(Candidates)).when(text.rlike(r"(?U)[\d@]"), some).otherwise(none)


def detect(df: DataFrame, key: str, text: str, detectors: list[Detector] = DETECTORS) -> DataFrame:
    """One row for each candidate: (``key``, label, start, end, score, validated, source, ord, value)."""
    one = df.select(key, F.col(text).alias("d__text"), F.explode(candidates(F.col(text), detectors)).alias("c"))
    return one.select(key, "c.*", F.substring(F.col("d__text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("value"))
