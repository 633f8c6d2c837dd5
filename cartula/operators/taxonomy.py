"""Tags, their coarse classes, and label arrays under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartula.functions.text import let

# The final tags.
TAGS = [
    "FULLNAME", "AGE", "GENDER", "DATE", "TIME", "STREET", "BUILDINGNUM", "ZIPCODE", "CITY", "PROVINCE", "EMAIL", "TELEPHONENUM",
    "CF", "PIVA", "ID_DOC", "IBAN", "CREDITCARDNUMBER", "AMOUNT", "TARGA", "ORG", "DOCID", "CATASTO",
]
# Fine tags and the coarse tag of each.
COARSE = {
    "ATTORE": "FULLNAME", "AVVOCATO": "FULLNAME", "CONTO": "IBAN", "CONVENUTO": "FULLNAME", "DRIVERLICENSENUM": "ID_DOC", "GIUDICE": "FULLNAME",
    "GIVENNAME": "FULLNAME", "IDCARDNUM": "ID_DOC", "PASSPORTNUM": "ID_DOC", "PEC": "EMAIL", "RG": "DOCID", "SEX": "GENDER", "SOCIALNUM": "ID_DOC",
    "SURNAME": "FULLNAME", "TAXNUM": "PIVA", "TESTIMONE": "FULLNAME",
}
# Tags that become O.
DROPPED = ["TITLE", "TRIBUNAL"]
# Tags of an outside corpus and ours; all others become O.
OUTSIDE = {
    "ACCOUNTNUMBER": "IBAN", "AGE": "AGE", "AMOUNT": "AMOUNT", "BUILDINGNUMBER": "BUILDINGNUM", "CITY": "CITY", "COMPANYNAME": "ORG",
    "CREDITCARDNUMBER": "CREDITCARDNUMBER", "DATE": "DATE", "DOB": "DATE", "EMAIL": "EMAIL", "FIRSTNAME": "FULLNAME", "GENDER": "GENDER",
    "IBAN": "IBAN", "LASTNAME": "FULLNAME", "MIDDLENAME": "FULLNAME", "PHONENUMBER": "TELEPHONENUM", "SEX": "GENDER", "SSN": "ID_DOC",
    "STREET": "STREET", "TIME": "TIME", "VEHICLEVRM": "TARGA", "ZIPCODE": "ZIPCODE",
}
# Fine tags that boosts are stated for by their coarse tag.
BOOSTED = [t for t in COARSE if t not in ("SEX", "TAXNUM", "PASSPORTNUM", "SOCIALNUM")]


def lookup(tag: Column, table: dict[str, str]) -> Column:
    """The table's value for a tag, or null."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[tag]


def coarse(tag: Column, table: dict[str, str] = COARSE) -> Column:
    """The coarse tag of a tag; a tag that the table lacks is its own."""
    return F.coalesce(lookup(tag, table), tag)


def type_of(label: Column) -> Column:
    """The tag of a B- or I- label (all after the second sign)."""
    return F.substring(label, 3, 1000)


def normalised(labels: Column, table: dict[str, str] = COARSE, dropped: list[str] = DROPPED) -> Column:
    """Labels under coarse tags, dropped tags as O, neighbours of one tag fused into one entity."""
    known = F.transform(labels, lambda x: F.when(x != "O", coarse(type_of(x), table)))
    kept = F.transform(known, lambda t: F.when(~t.isin(dropped), t))

    def marked(all_: Column) -> Column:
        same = lambda t, i: (i > 0) & t.eqNullSafe(F.get(all_, i - 1))
        return F.transform(all_, lambda t, i: F.when(t.isNull(), "O").when(same(t, i), F.concat(F.lit("I-"), t)).otherwise(F.concat(F.lit("B-"), t)))

    return F.when(labels.isNull(), F.lit(None).cast("array<string>")).otherwise(let(kept, marked))


def tags_of(labels: Column) -> Column:
    """The different tags of a label array, in order of first occurrence."""
    return F.array_distinct(F.transform(F.filter(labels, lambda x: x != "O"), type_of))


def begins(labels: Column) -> Column:
    """The B- labels only."""
    return F.filter(labels, lambda x: F.startswith(x, F.lit("B-")))


def valid(tokens: Column, labels: Column) -> Column:
    """Both arrays present, not empty and equally long."""
    return F.coalesce((F.size(tokens) > 0) & (F.size(tokens) == F.size(labels)), F.lit(False))
