"""Texts that end inside a word or a sentence because the rest was lost.

First the lengths of all texts are recomputed under the encodings in which they may have been stored (characters, bytes,
UTF-16 units, markup and JSON escapes, other line ends) and counted by source and encoding. A length that far more texts
have than lengths near it is a storage limit; texts that fill one are cut unless their ending is complete. Endings of the
other texts show how whole texts end: which line forms close them, which words end sentences, after which words a full
stop belongs to an abbreviation. An ending off every limit is judged by these counts and by its form, not by known phrases.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import html.entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartula.functions.names import name_key, spelling
from cartula.llm.boundaries import DOMAINS, LEADING
from cartula.plans.lineage import broadcast_within, cut, spread

#: A limit: so many times as many texts of a source as lengths near it have on average, and more than chance gives: at least
#: so many, and so many standard deviations (the root of the mean), over that average.
EXCESS, PILE, SIGMAS = 4.0, 4, 6.0

#: Of the measures that show one limit those are kept that show it nearly as well as the best.
AS_WELL = 0.9

#: Near: so much shorter or longer, in parts of the length and at least so many characters.
NEAR, LEAST_NEAR = 0.02, 10

#: A system that cuts between words leaves a text so many characters below its limit, at most.
WORD_BAND = 10

#: A form closes texts when at least so many different ones end with it, and so large a part of those that have it at their end.
CLOSES, SHARE = 3, 0.2

#: And so large a part of those that go on without its last word: else that word is a beginning of the one that commonly stands there.
BRANCH = 0.02

#: A form closes what it follows, and is no mark, when so large a part of the texts before it are complete.
ALWAYS = 0.97

#: A form that ends with a mark is one of its own when so large a part of the mark's texts have it; else the mark alone counts.
OWN = 0.25

#: Characters of the longest mark that stands for itself.
MARK = 300

#: Words of a form, and places before the end of a text at which forms may begin.
FORM_WORDS, PLACES = 32, 6

#: A word can end a sentence when it does so at least so often, as a part of how often words do on average.
RATE = 0.5

#: An abbreviation: a word of so many letters at most that has a full stop at least so often, of so many occurrences.
LONGEST, STOPPED, SEEN = 6, 0.9, 8

_SPACE = " \t\r\n\f\v\x00\x1c\x1d\x1e\x1f\x85\xa0​‌‍  ‪‬‮　﻿"

_NAME = r"(?:[A-ZÀ-Ý][\w'’\-]*\.?)"
_DATE = r"(?:\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\.? (?:\w{1,3} )?[^\W\d_]{3,}\.? (?:\w{1,3} )?(?:1\d|20)\d\d)"

# Marks that stand for themselves at the end of any text, whatever their words: tags, groups in square brackets or between
# stars or dashes, page numbers, arrows.
_mark = re.compile(
    r"(?:<!--[^<>]*-->|</?[a-zA-Z][^<>]*>|\[[^\[\]\n]{0,60}\]|\(\s*(?:…|\.{3})\s*\)|(?P<s>\*{2,}|-{2,}|={2,}|_{2,})[^*=_\n]{2,60}(?P=s)|-\s?\w+\s?-|[>»]{2,}|[*=_~|\-–—]{2,}"
    r"|\([^()\n\d]{0,40}\)|(?:(?<=\n)|(?<=[.!?…] )|^)[ \t]*(?:\w{1,8}\.? )?\d{1,4} ?(?:/|[^\W\d]{2,3}) ?\d{1,4})\Z"
)
_CLOSERS = "])}»”’\"'"
_ellipsis = re.compile(r"(?:\s*(?:…|\.\.\.)[\])}»”’\"']*)+\Z")
_form = re.compile(r"(?:^|[ («])(?:S\.? ?p\.? ?A|S\.? ?r\.? ?l(?:\.? ?s)?|S\.? ?n\.? ?c|S\.? ?a\.? ?s|& ?C)\.\Z", re.IGNORECASE)
_half_number = re.compile(
    r"(?:(?:€|\bEUR|\beuro) ?\d{1,3}(?:\.\d{3})*\.|(?:\b(?:il|al|dal|data|del|dem|vom|le|on|of|am|fecha|el|du|from) )\d{1,2}(?:\.\d{1,2})?\.|(?:\b(?:ore|h\.|um|à|at|las) )\d{1,2}\.)\Z"
)
_last_stopped = re.compile(r"(?<!\w)([^\W\d_]+(?:['’])?)\.\Z")
_last = re.compile(r"(?<!\w)([^\W\d_]{2,})(?:\s*(?:…|\.\.\.)[\])}»”’\"']*)*\Z")
_half_mail = re.compile(r"(?:(?:scrivendo a|e-?mail|indirizzo pec|p\.e\.c\.|\bmail|correo) [\w.\-]+|@[\w.\-]+)\.\Z", re.IGNORECASE)
# A unit of an encoding that isn't whole: an escape, an entity, a tag, a byte sequence.
_half_unit = re.compile(r"(?:�|\\u[0-9a-fA-F]{0,3}|\\u[dD][89abAB][0-9a-fA-F]{2}|\\u00[0-9a-fA-F]{2}|\\|&#?\w{0,8}|=[0-9A-F]{0,2}|%[0-9A-F]{0,2}|</?[a-zA-Z][^<>]{0,200}|</?)\Z")

# Structures of a last line or sentence, whatever its words.
_dated = re.compile(rf"(?:[^\d\n.;:!?]{{0,40}}?[, ] ?)?{_DATE}\Z")
_signed = re.compile(rf"[A-ZÀ-Ýa-zà-ÿ][^\n.!?;:,\d/]{{2,50}}(?:[,:/]|[ \t]*\n|,[ \t]*\n| /)\s*(?:[\w]{{2,6}}\. ?)?{_NAME}(?: {_NAME}){{0,4}}\Z")
_numbered = re.compile(r"[^\W\d_][\w'’ ]{1,40} ?:\s*1[).]\s?[^;\n]{2,80}?(?:[;,]?\s+\d{1,2}[).]\s?[^;\n]{2,80}?)+\Z")
_item = re.compile(r"[ \t]*(?:[-•*–]|\d{1,3}[).])[ \t]?\S")


def _stops(text: str) -> bool:
    """Whether a text ends with a full stop, question or exclamation mark, inside closing marks or not."""
    return text.rstrip(_CLOSERS)[-1:] in (".", "!", "?")


def _dots(text: str) -> str | None:
    """The text without an ellipsis at its end, or None where there is none."""
    bare = text.rstrip(_CLOSERS + _SPACE)
    if bare[-1:] != "…" and bare[-3:] != "...":
        return None
    at = max(0, len(bare) - 60)
    return text[:at] + _ellipsis.sub("", text[at:])


_MARK_ENDS = frozenset(">])»*=_~|-–—0123456789")


def stripped(text: str) -> tuple[str, bool]:
    """The text without white space and marks at its end, and whether there were marks."""
    core, marked = text.rstrip(_SPACE), False
    while core and core[-1] in _MARK_ENDS:
        m = _mark.search(core, max(0, len(core) - MARK))
        if not m:
            break
        core, marked = core[: m.start()].rstrip(_SPACE), True
    return core, marked


def state(text: str) -> tuple[bool, str | None]:
    """Of a text before a place: whether it is empty or ends, but for white space and marks, with a mark that ends a sentence;
    and the word before an ellipsis, where it ends with one."""
    core = stripped(text)[0]
    if not core:
        return True, None
    rest = _dots(core)
    done = _stops(core if rest is None else rest) and _stopped((core if rest is None else rest)[-400:]) == "whole"
    return done, None if done or rest is None else last_word(core) or ""


def _stopped(tail: str) -> str:
    """``whole``, ``short`` or ``torn``, for a text that ends with a full stop, question or exclamation mark."""
    bare = tail.rstrip(_CLOSERS)
    if bare[-1] in "!?" or bare.endswith(".."):
        return "whole"
    if bare != tail or _form.search(bare, max(0, len(bare) - 20)):
        return "whole"
    if _half_number.search(bare, max(0, len(bare) - 40)):
        return "torn"
    if m := _half_mail.search(bare):
        return "whole" if "@" in m.group() and _domain(m.group().rstrip(".").rpartition(".")[2].lower()) else "torn"
    word = _last_stopped.search(bare, bare.rfind(" ") + 1)
    if not word:
        return "whole"
    low, before = word.group(1).lower(), bare[: word.start()]
    if len(low) == 1:
        return "whole" if re.search(r"(?:sesso |sex |Geschlecht |sexe |sexo |\d ?/ ?|\d)\Z", before) else "short"
    if low in ("sa", "sc", "es", "ex", "st", "co", "us", "s"):
        return "whole" if low not in LEADING else "short"
    return "short" if low in LEADING and not before.endswith("@") else "whole"


def _domain(label: str) -> bool:
    """Whether a label is the last part of an address, misread letters allowed."""
    return label in DOMAINS or any(len(d) == len(label) > 3 and sum(a != b for a, b in zip(d, label, strict=True)) <= 2 for d in DOMAINS)


def _opened(tail: str) -> bool:
    """Whether the last sentence opens a bracket that it doesn't close; ``1)`` and the like close none."""
    depth = 0
    for c in re.sub(r"(?<!\w)\w{1,3}\)", "", re.split(r"[.!?]\s+(?=[A-ZÀ-Ý])", tail)[-1]) if tail.count("(") > tail.count(")") else "":
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
    return depth > 0


_begins = re.compile(r"\n|[.!?…][\])}»”’\"']*\s+(?=[^\s\d])|(?<=\.\.\.)(?=[^\s.])|(?=[…\[(])")


def places(core: str, most: int = PLACES) -> list[int]:
    """Where the last lines and sentences of a text begin, the last first, at most ``most``; 0 if the text is that short."""
    size = 150 * most
    while True:
        low = max(0, len(core) - size)
        found = sorted({m.end() for m in _begins.finditer(core, low)} | ({0} if not low else set()), reverse=True)
        out = [at for i, at in enumerate(found) if core[at : found[i - 1] if i else len(core)].strip(_SPACE)][:most]
        if not low or len(out) == most:
            return out
        size *= 4


def listed(core: str) -> bool:
    """Whether a text ends with a list under a heading with a colon: at least two items, on lines or numbered in one."""
    lines, n, upto = 0, 0, len(core)
    while upto > 0:
        at = core.rfind("\n", 0, upto) + 1
        if not _item.match(core, at, upto):
            lines = at
            break
        n, upto = n + 1, at - 1
    if n >= 2 and core[lines:upto].rstrip(_SPACE).endswith(":"):
        return True
    return any(_numbered.match(core, at) for at in places(core))


def shaped(core: str) -> str | None:
    """The structure that ends a text, if any: ``list``, ``date``, ``signature``, or ``loose`` for the last two after a line
    that isn't complete."""
    if listed(core):
        return "list"
    for name, pattern in (("date", _dated), ("signature", _signed)):
        at = [a for a in places(core) if pattern.match(core, a)]
        if at:
            return name if any(any(x is True or x for x in state(core[:a])) for a in at) else "loose"
    return None


_token = re.compile(rf"(?P<n>(?<!\w){_DATE}(?!\w)|\d+(?:[./:\-]\d+)*)|(?P<e>\.{3}|…)|\n|[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]|_")


def tokens(core: str, at: int) -> list[tuple[int, str, bool]]:
    """Words of a text from a place on: where each begins, the word of a form that it gives (numbers and dates 0, line
    ends kept, all else in small letters), and whether it has a capital."""
    return [(m.start(), "0" if m.group("n") else "…", False) if m.group("n", "e") != (None, None) else (m.start(), m.group().lower(), m.group()[0].isupper()) for m in _token.finditer(core, at)]


def form(words: list[tuple[int, str, bool]]) -> list[str]:
    """The words of a form: runs of capitalised words after the first are one A; line ends at its edges and an ellipsis at its end go."""
    out: list[str] = []
    for _, w, capital in words:
        x = "A" if capital and out else w
        if (x != "A" or out[-1] != "A") and (out or x != "\n"):
            out.append(x)
    while out and out[-1] in "\n…":
        out.pop()
    return out


@functools.lru_cache(100_000)
def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def hashes(words: list[str]) -> list[int]:
    """The hash of each beginning of a form, the whole form last."""
    out, h = [], 0
    for w in words:
        h = (h * 0x9E3779B97F4A7C15 + _code(w) + 1) & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


# ---- one text


def ending(text: str | None) -> str:
    """How a text ends, by its form alone: ``blank``, ``whole`` (a mark ends a sentence), ``short`` (a full stop, but
    after an abbreviation or initial), ``torn`` (inside a number, an address, a bracket or a unit of an encoding), ``list``, ``date``, ``signature``, ``loose`` (see shaped), ``page`` (a page number and the like alone),
    ``open`` (an ellipsis after what may be a whole sentence) or ``bare`` (no mark; counts over the corpus decide)."""
    if not text or not text.strip(_SPACE):
        return "blank"
    core, marked = stripped(text)
    if not core:
        return "page"
    if (rest := _dots(core)) is not None:
        rest = rest[-400:]
        if not rest or _form.search(rest[-20:] + "."):
            return "whole"
        if _stops(rest):
            return _stopped(rest)
        cased = not rest[-1].isalpha() or rest[-1].lower() != rest[-1].upper()
        if _opened(rest) or rest[-1] in ",;:-–([" or cased and _stopped(rest + ".") == "torn":
            return "torn"
        return "short" if cased and _stopped(rest + ".") == "short" else "open"
    if _stops(core):
        return _stopped(core[-400:])
    if _half_unit.search(core, max(0, len(core) - 210)):
        return "torn"
    return shaped(core) or "bare"


# ---- lengths

_NAMED = {chr(code): f"&{name};" for code, name in html.entities.codepoint2name.items()}
_named = re.compile("[" + re.escape("".join(_NAMED)) + "]")


def measures(text: str) -> dict[str, int]:
    """Lengths of a text as it may have been stored: encodings, escapes, line ends."""
    nl = text.count("\n") - text.count("\r\n")
    raw = len(text.encode("utf-8", "surrogatepass"))
    escaped = html.escape(text, quote=False)
    quoted = html.escape(text)
    plain = json.dumps(text, ensure_ascii=False)
    return {
        "chars": len(text),
        "utf8": raw,
        "utf16": len(text.encode("utf-16-le", "surrogatepass")) // 2,
        "markup": len(escaped),
        "markup_quotes": len(quoted),
        "markup_utf8": raw + len(escaped) - len(text),
        "markup_names": len(text) + sum(len(_NAMED[c]) - 1 for c in _named.findall(text)),
        "json": len(plain) - 2,
        "json_utf8": len(plain.encode("utf-8", "surrogatepass")) - 2,
        "json_ascii": len(json.dumps(text)) - 2,
        "crlf": len(text) + nl,
        "crlf_utf8": raw + nl,
        "lf": len(text) - text.count("\r\n"),
        "lf_utf8": raw - text.count("\r\n"),
    }


MEASURES = list(measures(""))


def last_word(text: str) -> str | None:
    """The word of letters that ends a text, before an ellipsis if there is one, in small letters; it can show whether a sentence
    ends there. None after a number, a code, a single letter or a closing bracket, which are judged by their form alone."""
    m = _last.search(stripped(text)[0][-100:])
    return m.group(1).lower() if m else None


def stop_word(core: str) -> str | None:
    """The word of letters before the full stop that ends a text without marks."""
    m = _last_stopped.search(core, core.rfind(" ") + 1)
    return m.group(1) if m and len(m.group(1)) > 1 else None


def read_one(text: str) -> dict:
    """What is read of a text that isn't blank: ``kind`` (see ending), ``last``, ``stop``, ``sizes`` under all measures,
    ``cores``: the same without marks at the end, ``forms``: (from, to, hash, hash
    without the last word, hash of what stands before) of its last parts, ``states``: see state, before each place, ``goes``: hashes of the beginnings of its last parts, which go on."""
    kind = ending(text)
    core, marked = stripped(text)
    if kind == "open":
        core = _dots(core) or ""
    said = kind not in ("whole", "torn", "page")
    at, parts, goes = places(core, PLACES if said else 2), [], set()
    words = tokens(core, at[-1]) if at else []
    starts = [w[0] for w in words]
    for p in at[:2]:
        some = form(words[bisect.bisect_left(starts, p) :][: 2 * FORM_WORDS])[: FORM_WORDS + 1]
        goes.update(h for h, after in zip(hashes(some), some[1:]) if after != "\n")
    if said:  # the forms of the others say nothing
        ends = [len(core), *at]
        cuts = [bisect.bisect_left(starts, p) for p in ends]
        for i in range(1, len(ends)):
            before = "".join(c for c in core[max(0, ends[i] - 60) : ends[i]].lower() if c.isalnum())[-30:]
            for j in range(i):
                some = form(words[cuts[i] : cuts[j]]) if cuts[j] - cuts[i] <= 2 * FORM_WORDS else []
                if 0 < len(some) <= FORM_WORDS:
                    codes = hashes(some)
                    parts.append({"i": i, "j": j, "h": codes[-1], "less": codes[-2] if len(codes) > 1 else None, "c": hashes([before])[-1]})
    return {
        "kind": kind,
        "last": last_word(text) if said else None,
        "stop": stop_word(core) if kind == "whole" else None,
        "sizes": list(measures(text).values()),
        "cores": list(measures(core).values()) if marked else None,
        "forms": parts,
        "states": [dict(zip(("done", "open"), state(core[:p]), strict=True)) for p in at] if parts else [],
        "goes": sorted(goes),
    }


_READ = (
    "kind string, last string, stop string, sizes array<int>, cores array<int>, forms array<struct<i:int,j:int,h:bigint,less:bigint,c:bigint>>, states array<struct<done:boolean,open:string>>, goes array<bigint>"
)
_ARROW = pa.schema(
    [
        ("kind", pa.string()), ("last", pa.string()), ("stop", pa.string()), ("sizes", pa.list_(pa.int32())), ("cores", pa.list_(pa.int32())),
        ("forms", pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("h", pa.int64()), ("less", pa.int64()), ("c", pa.int64())]))),
        ("states", pa.list_(pa.struct([("done", pa.bool_()), ("open", pa.string())]))), ("goes", pa.list_(pa.int64())),
    ]
)
_BLANK = {"kind": "blank", "last": None, "stop": None, "sizes": None, "cores": None, "forms": [], "states": [], "goes": []}


def read_endings(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(``id``, ``src``, ``source``, ``text_hash`` and what read_one gives) of every text; the whole text is read once.

    ``key`` must be unique. A null, empty or blank text is ``blank`` and has no lengths; other columns are not read; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_one(t) if t and t.strip(_SPACE) else _BLANK for t in b.column(4).to_pylist()]
            told = pa.RecordBatch.from_pylist(rows, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *told.columns], ["id", "src", "source", "text_hash", *_ARROW.names])

    missing = name_key(F.col(source)).isNull()
    spelt = F.when(~missing, spelling(F.col(source)))
    rows = spread(docs).select(F.col(key).alias("id"), name_key(F.col(source)).alias("src"), spelt.alias("source"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, src string, source string, text_hash bigint, {_READ}")


def _measured(sizes: str) -> Column:
    return F.arrays_zip(F.array(*[F.lit(m) for m in MEASURES]).alias("measure"), F.col(sizes).alias("size"))


def limits(ends: DataFrame) -> DataFrame:
    """(``src``, ``measure``, ``size``, ``texts``, ``expected``, ``band``): the storage limits of each source.

    Of all texts, whole ones included, equal ones of a source once, the lengths under every measure are counted. A
    length is a limit when EXCESS times as many texts have it as lengths near it have on average, and more than chance
    explains (PILE, SIGMAS); or, where cuts fall between words, when the WORD_BAND lengths below it together are so many. Of the
    measures that show one limit, those that show it nearly as well as the best are kept. Texts of missing source are a group of their own. Only counts are windowed, one row a length.
    """
    one = ends.where("sizes is not null").dropDuplicates(["src", "text_hash"]).select("src", F.explode(_measured("sizes")).alias("x"))
    counts = one.groupBy("src", "x.measure", "x.size").agg(F.count(F.lit(1)).alias("texts"))
    more = LEAST_NEAR / NEAR
    scaled, step = F.round(F.ln(F.col("size") + more) * 100_000).cast("bigint"), round(100_000 * NEAR)
    near = Window.partitionBy("src", "measure").orderBy(scaled).rangeBetween(-step, step)
    below = Window.partitionBy("src", "measure").orderBy("size").rangeBetween(-WORD_BAND, 0)
    span = 2 * NEAR * (F.col("size") + more)
    all_ = counts.withColumns({"about": F.sum("texts").over(near), "banded": F.sum("texts").over(below), "most": F.max("texts").over(below), "kinds": F.count(F.lit(1)).over(below)})
    mean = (F.col("about") - F.col("texts")) / span
    band_mean = (F.col("about") - F.col("banded")) * (WORD_BAND + 1) / (span - WORD_BAND - 1)
    over = lambda n, m: (n >= EXCESS * m) & (n >= m + PILE + SIGMAS * F.sqrt(F.greatest(m, F.lit(0.0))))
    sharp = all_.where(over(F.col("texts"), mean)).select("src", "measure", "size", "texts", mean.alias("expected"), F.lit(0).alias("band"))
    wide = all_.where(
        over(F.col("banded") - PILE, band_mean) & (F.col("kinds") >= 3) & (F.col("most") < 0.5 * F.col("banded"))
    ).select("src", "measure", "size", F.col("banded").alias("texts"), band_mean.alias("expected"), F.lit(WORD_BAND).alias("band"))
    found = sharp.unionByName(wide)
    around = Window.partitionBy("src").orderBy(scaled).rangeBetween(-step, step)  # over limits found: few
    best = found.withColumn("best", F.max("texts").over(around)).where(F.col("texts") >= AS_WELL * F.col("best"))
    own = Window.partitionBy("src", "measure", "band").orderBy(scaled).rangeBetween(-step, step)
    top = best.withColumns({"top": F.max("texts").over(own), "sharp": F.max(F.when(F.col("band") == 0, F.col("texts"))).over(around)})
    kept = top.where((F.col("band") == 0) | ((F.col("texts") == F.col("top")) & F.col("sharp").isNull()))
    return kept.select("src", "measure", "size", "texts", "expected", "band")


def filling(ends: DataFrame, found: DataFrame) -> DataFrame:
    """(``id``): texts that fill a limit of their source (of any source, where their own is missing), with or without the
    marks at their end."""
    each = found.select("src", "measure", F.explode(F.sequence(F.col("size") - F.col("band"), F.col("size"))).alias("size")).distinct()
    each = broadcast_within(cut(each))
    both = ends.select("id", "src", F.explode(_measured("sizes")).alias("x")).unionByName(ends.where("cores is not null").select("id", "src", F.explode(_measured("cores")).alias("x")))
    at = both.select("id", "src", "x.measure", "x.size")
    own = at.join(each, ["src", "measure", "size"]).select("id")
    any_ = at.where("src is null").join(each.select("measure", "size").distinct(), ["measure", "size"]).select("id")
    return own.union(any_).distinct()


def line_forms(ends: DataFrame) -> DataFrame:
    """(``h``, ``n``, ``closes``, ``mark``, ``tells``, ``goes``): forms that end texts below every limit, by counts over different texts.

    A form ``closes`` when at least CLOSES texts, different in what stands before it, end with it, and not most of those in which it begins the last lines go on; it is a ``mark`` when the text before
    it is often not complete, so that it says nothing of what it follows, and it ``tells`` of a cut when that never is; it ``goes`` on when more texts do so than end.
    """
    one = ends.dropDuplicates(["text_hash"])
    last = one.select(F.explode("forms").alias("f"), "states").where("f.j = 0").select("f.h", "f.less", "f.c", F.get("states", F.col("f.i") - 1).alias("state"))
    each = last.groupBy("h", "c").agg(F.max("less").alias("less"), F.max("state.done").alias("done"), F.max(F.col("state.done") | F.col("state.open").isNotNull()).alias("state"))
    ended = each.groupBy("h").agg(F.max("less").alias("less"), F.count(F.lit(1)).alias("n"), F.sum(F.col("state").cast("int")).alias("after"), F.sum(F.col("done").cast("int")).alias("done"))
    on = one.select(F.explode("goes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("on"))
    on = cut(on)
    both = ended.join(on, "h", "left").join(on.select(F.col("h").alias("less"), F.col("on").alias("others")), "less", "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("on", "others")})
    closes = (F.col("n") >= CLOSES) & (F.col("n") >= SHARE * (F.col("n") + F.col("on"))) & (F.col("n") >= BRANCH * F.col("others"))
    goes = (F.col("on") >= CLOSES) & (F.col("on") > F.col("n"))
    return both.select("h", "n", closes.alias("closes"), ((F.col("after") < ALWAYS * F.col("n")) | (F.col("done") == 0)).alias("mark"), (closes & (F.col("done") == 0)).alias("tells"), goes.alias("goes")).where("closes or goes")


def word_uses(docs: DataFrame, text: str, ends: DataFrame) -> DataFrame:
    """(``last``, ``n``, ``final``, ``inside``, ``short``): words in small letters, how often they occur, whether they can end
    a sentence, whether a text goes on after them, and whether they are abbreviations. Equal texts count once.

    A word can end a sentence when it does so (before one that opens with a capital) at least RATE times as often, of
    all its occurrences, as words do on average. An abbreviation has a full stop nearly always and yet ends texts less than
    RATE times as often, of its full stops, as words do. Both are rates, so a word is judged alike in a small and a large corpus.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}])\p{L}{2,}(?![\p{L}\p{N}])(?:[.!?]\s+(?=[«(]?\p{Lu})|\.| (?=\p{Ll}))?"), F.lit(0))
    each = docs.select(text).where(F.col(text).isNotNull()).distinct().select(F.explode(words).alias("x"))
    word, sentence, stopped, on = F.lower(F.regexp_extract("x", r"^\p{L}+", 0)), F.col("x").rlike(r"[.!?]\s+$"), F.col("x").contains("."), F.col("x").rlike(r"[.!?\s]$")
    count = lambda c: F.sum(c.cast("bigint"))
    counts = each.groupBy(word.alias("last")).agg(F.count(F.lit(1)).alias("n"), count(sentence).alias("ends"), count(stopped).alias("stops"), F.max(on).alias("inside"))
    closing = ends.where("stop is not null").dropDuplicates(["text_hash"]).groupBy(F.col("stop").alias("last")).agg(F.count(F.lit(1)).alias("closing"))
    counts = cut(counts.join(closing, "last", "left").withColumn("closing", F.coalesce("closing", F.lit(0))))
    mean = counts.agg((F.sum("ends") / F.sum("n")).alias("mean"), F.try_divide(F.sum("closing"), F.sum("stops")).alias("mean_closing"))
    known = F.col("last").isin(sorted(LEADING))
    final = (F.col("ends") > 0) & (F.col("ends") >= RATE * F.col("mean") * F.col("n")) & ~known
    short = (F.length("last") <= LONGEST) & (F.col("n") >= SEEN) & (F.col("stops") >= STOPPED * F.col("n")) & (F.col("closing") < RATE * F.col("mean_closing") * F.col("stops"))
    return counts.crossJoin(F.broadcast(mean)).select("last", "n", final.alias("final"), "inside", F.coalesce(short, F.lit(False)).alias("short"))  # mean: one row


def truncated(ends: DataFrame, full: DataFrame, forms: DataFrame, uses: DataFrame) -> DataFrame:
    """(``id``, ``src``, ``source``, ``kind``, ``full``, ``cut``): whether each text was cut off. Null, empty and blank texts are not.

    A text that fills a limit is cut unless its ending is complete: a mark that ends a sentence after a word that occurs elsewhere, too,
    or a form that closes other texts after a complete one. Below the limits a text without such an ending is cut unless
    it ends with a list, date or signature (a list whose last word occurs nowhere else, or a date or signature whose
    form goes on elsewhere, is cut) or with an ellipsis after a word that can end sentences.
    """
    known = broadcast_within(cut(forms))
    def step(a: Column, e: Column) -> Column:
        goes = F.array_contains(a["reach"], e["j"]) & ((a["at"] != e["j"]) | (e["n"] >= OWN * a["n"]))
        with_ = lambda x, c: F.when(c, F.array_union(a[x], F.array(e["i"]))).otherwise(a[x]).alias(x)
        at = F.when(e["mark"], e["j"]).otherwise(a["at"]).alias("at")
        return F.struct(with_("reach", goes), with_("fine", goes & ~e["mark"]), at, F.when(e["mark"], e["n"]).otherwise(a["n"]).alias("n"))

    none = F.array().cast("array<int>")
    start = F.struct(F.array(F.lit(0)).alias("reach"), none.alias("fine"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("n"))  # at, n: the last mark and its texts
    some = ends.where("size(forms) > 0").select("id", "states", F.explode("forms").alias("f")).select("id", "states", "f.i", "f.j", "f.h").join(known, "h")
    edge = F.when(F.col("closes"), F.struct("j", "i", "mark", "n"))
    per = some.groupBy("id", "states").agg(F.array_sort(F.collect_list(edge)).alias("edges"), F.max(F.col("goes") & (F.col("j") == 0)).alias("on"), F.max("tells").alias("tells"))  # at most PLACES squared a text
    ends_ = per.withColumn("r", F.aggregate("edges", start, step))
    done = F.exists("r.reach", lambda i: (i > 0) & F.get("states", i - 1)["done"]) | F.exists("r.fine", lambda i: F.get("states", i - 1)["open"].isNotNull())
    words = F.filter(F.transform(F.filter("r.reach", lambda i: i > 0), lambda i: F.get("states", i - 1)["open"]), lambda w: w.isNotNull())
    lines = ends_.select("id", done.alias("closed"), "on", F.when(~F.col("tells"), F.get(words, F.lit(0))).alias("before"))
    short = broadcast_within(cut(uses.where("short").select(F.col("last").alias("w"), F.lit(True).alias("short"))))
    told = ends.join(full.withColumn("full", F.lit(True)), "id", "left").join(lines, "id", "left").join(short, F.col("stop") == F.col("w"), "left")
    told = told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("full", "closed", "on", "short")})
    left = F.col("before").isNotNull() & (F.col("kind") == "bare")  # an ellipsis, and a mark after it
    told = told.withColumns({"kind": F.when(left, "open").otherwise(F.col("kind")), "last": F.when(left, F.nullif("before", F.lit(""))).otherwise(F.col("last"))})
    asked = told.where("last is not null and kind in ('open', 'list') or kind = 'whole' and full and stop = lower(stop)")
    asked = asked.select("id", F.when(F.col("kind") == "whole", F.col("stop")).otherwise(F.lower("last")).alias("last"))
    seen = asked.join(uses.select("last", "n", "final", "inside"), "last", "left").select("id", F.coalesce("final", F.lit(False)).alias("final"), F.coalesce("inside", F.lit(False)).alias("inside"), (F.coalesce("n", F.lit(0)) > 1).alias("seen"))
    told = told.join(seen, "id", "left")
    gone = (
        F.when(F.col("kind") == "torn", True)
        .when(F.col("kind") == "whole", F.col("short") | (F.col("full") & ~F.coalesce("seen", F.lit(True))))
        .when(F.col("kind") == "list", ~F.col("closed") & (F.col("full") | ~F.coalesce("seen", F.lit(True))))
        .when(F.col("kind").isin("signature", "date"), F.col("on") & ~F.col("closed"))
        .when(F.col("kind") == "loose", ~F.col("closed") & (F.col("full") | F.col("on")))
        .when(F.col("kind") == "open", ~F.col("closed") & (F.col("full") | ~F.coalesce("final", F.lit(True))))
        .when(F.col("kind").isin("bare", "short"), ~F.col("closed"))
        .otherwise(False)
    )
    return told.select("id", "src", "source", "kind", "full", gone.alias("cut"))


def report(told: DataFrame) -> DataFrame:
    """Per source: texts, texts cut off, those of them that fill a limit, and the share cut off; the source under its commonest
    spelling, null when missing."""
    count = lambda c: F.sum(c.cast("bigint"))
    spelled = told.groupBy("src", "source").agg(F.count(F.lit(1)).alias("texts"), count(F.col("cut")).alias("cut_texts"), count(F.col("cut") & F.col("full")).alias("at_limit"))
    per = spelled.groupBy("src").agg(F.max_by("source", F.struct("texts", "source")).alias("source"), *[F.sum(c).alias(c) for c in ("texts", "cut_texts", "at_limit")])
    return per.select("source", "texts", "cut_texts", "at_limit", (F.col("cut_texts") / F.col("texts")).alias("share"))
