"""Natural boundaries in token lists: where a new sentence or a numbered point opens.

Rules over tokens, not over a list of phrases: what ends a sentence, what an abbreviation, initial, number, address
or date is, and what can open a sentence in mixed case or in text of one case.
"""

from __future__ import annotations

# Abbreviations that always stand before what they belong to.
LEADING = frozenset(
    "all allg art artt avv cap cc cell cfr circ co cod col comma cpv d dep dir doc dott dr ecc.mo es est fasc fig figg fisc fn geom gg ill"
    " id ing int iva lett lin loc m mons n nn not nr num on op p pag pagg par part pec ph pp prof prot prov ra rag rep rev r rif s sc"
    " sec seg segg sez sig soc sigg sign spett ss ssa st sub tab tel ti tit v vd vol voll vs w".split()
)
# Abbreviations and company forms that may close a sentence.
CLOSING = frozenset("ag bv coop corp ecc etc gmbh inc llc ltd sa sapa sarl sas snc spa srl srls".split())
# Letters of company forms written apart, each followed by a full stop.
FORMS = frozenset(["s p a", "s r l", "s r l s", "s n c", "s a s", "s s", "s c", "s c a r l", "s c r l", "s a p a", "& c", "s a", "e c"])
# Words that can open a full sentence after a semicolon or an ambiguous abbreviation.
OPENING = frozenset(
    "a ad agli ai al all alla alle allo anche ancora anzi così che chi ci come con contrariamente contro cui d da dagli dai dal dall dalla dalle"
    " data dato degli dei del dell della delle dello di dinanzi dopo dunque durante e è ed entro essa esse essi esso fermo ferma fino fra fu gli i il"
    " in infine inoltre innanzi invece l la le letto lo lungo ma malgrado mediante mentre né negli nei nel nell nella nelle nello non nonostante"
    " o oltre ora ove per perché perciò pertanto però poi poiché premesso presso prima può qualora quando quanto quello questa queste questi"
    " questo quindi resta restano rilevato ritenuto salva salvo se secondo seguono senza si sia sotto stante su sui sul sull sulla sulle tale"
    " tali trattasi tra tramite tutta tutte tutti tutto un un' una uno visto vista".split()
)
# Last parts of mail and web addresses.
DOMAINS = frozenset("com de edu es eu example fr gov info int invalid it local net org test uk".split())

ENDERS = frozenset(".!?…")
CLOSERS = frozenset(")]}»”’")
OPENERS = frozenset("([{«“‘„")
QUOTES = frozenset("\"'")
BULLETS = frozenset(").–-—]")

SENTENCE, CLAUSE, COMMA = 3, 2, 1


def _one_case(tokens: list[str]) -> bool:
    """Whether the text is all in capitals or all in small letters, so that case tells nothing."""
    words = [t for t in tokens if len(t) > 1 and t.isalpha()]
    if not words:
        return True
    lower = sum(t.islower() for t in words)
    upper = sum(t.isupper() for t in words)
    return lower >= 0.98 * len(words) or upper >= 0.8 * len(words)


def _numbered(t: list[str], k: int) -> int:
    """Tokens of the number that opens a point at ``k`` (``1 )``, ``1 .``, ``1 –``, ``( 1 )``), or 0."""
    n = len(t)
    if t[k] in "([" and k + 3 < n and t[k + 1].isdigit() and len(t[k + 1]) < 4 and t[k + 2] in ")]":
        return 3
    if t[k].isdigit() and len(t[k]) < 4 and k + 2 < n and t[k + 1] in BULLETS and t[k + 2][0].isalpha():
        return 2
    if k + 1 < n and t[k].endswith(tuple(")°.")) and t[k][:-1].isdigit() and len(t[k]) < 5 and t[k + 1][0].isalpha():
        return 1
    return 0


def _in_address(t: list[str], stop: int) -> bool:
    """Whether the full stop at ``stop`` stands inside a mail or web address."""
    i, n = stop + 1, len(t)
    while i < n and (t[i][0].isalnum() or t[i] in ".-_"):  # forwards to an @
        if i + 1 < n and t[i + 1] == "@":
            return i - stop < 8 and all(t[j][0].isalnum() or t[j] in ".-_" for j in range(stop, i))
        if t[i][0].isalnum() and (i + 1 >= n or t[i + 1] not in ".-_"):
            break
        i += 1
    i = stop - 1
    dots = 0
    while i >= 0 and stop - i < 12:  # back to an @
        if t[i] == "@" or t[i].lower() in ("www", "http", "https"):
            last = t[stop - 1].lower()
            return not (last in DOMAINS and dots > 0)
        dots += t[i] == "."
        if not (t[i][0].isalnum() or t[i] in ".-_/"):
            break
        i -= 1
    return False


def _form_before(t: list[str], stop: int) -> bool:
    """Whether the letters and stops that end at ``stop`` are a company form (``S . p . A .``)."""
    letters, i = [], stop
    while i >= 1 and t[i] == "." and len(t[i - 1]) == 1 and t[i - 1].isalpha() and len(letters) < 6:
        letters.insert(0, t[i - 1].lower())
        i -= 2
    if i >= 0 and letters and t[i] == "&":
        letters.insert(0, "&")
    return any(" ".join(letters[j:]) in FORMS for j in range(len(letters))) and not (letters == ["s", "s"])


def strengths(tokens: list[str | None]) -> list[int]:
    """For each place the strength of a cut before its token: 3 a sentence or numbered point, 2 a clause, 1 a comma."""
    t = [x if x else " " for x in tokens]
    n, one_case = len(t), _one_case(t)
    out = [0] * n
    markers: set[int] = set()
    open_quotes: set[str] = set()
    for k in range(1, n):
        b = t[k - 1]
        if t[k] in QUOTES and not (k + 1 < n and t[k - 1][-1:].isalpha() and t[k + 1][:1].isalpha()):
            open_quotes ^= {t[k]}
        if b == ";" or b == ":":
            out[k] = CLAUSE
        elif b == ",":
            out[k] = COMMA
        i = k - 1  # the last token before closers
        while i > 0 and (t[i] in CLOSERS or (t[i] in QUOTES and t[i - 1] in ENDERS)) and t[k] not in CLOSERS:
            i -= 1
        ends = t[i] in ENDERS
        if not ends and i != k - 1:
            i, b = k - 1, t[k - 1]
        size = _numbered(t, k)
        if size and (b == ";" or (b == ":" and not (k > 1 and t[k - 2].isdigit())) or (ends and t[k + size - 1] != "." and not (b == "." and k > 1 and _abbreviated(t, k - 1)))):
            out[k] = SENTENCE
            markers.update(range(k, k + size))
            continue
        if k - 1 in markers or k in markers:
            continue
        if ends and _opens(t, k, one_case, open_quotes) and _ended(t, i, k, one_case):
            out[k] = SENTENCE
        elif b == ";" and _opens(t, k, one_case, open_quotes) and _full(t, k):
            out[k] = SENTENCE
    return out


def _first(t: list[str], k: int) -> int:
    """The first word at or after ``k``, past opening marks."""
    while k < len(t) - 1 and (t[k] in OPENERS or t[k] in QUOTES):
        k += 1
    return k


def _opens(t: list[str], k: int, one_case: bool, open_quotes: set[str]) -> bool:
    if t[k] in QUOTES and t[k] not in open_quotes:  # it closes
        return False
    w = t[_first(t, k)]
    if not w[0].isalpha():
        return False
    return one_case or w[0].isupper()


def _full(t: list[str], k: int) -> bool:
    """Whether a full sentence can begin at ``k``: with a word that opens one, not with a name or an initial."""
    i = _first(t, k)
    w, after = t[i].lower(), t[i + 1] if i + 1 < len(t) else ""
    return w in OPENING and after != "."


def _abbreviated(t: list[str], stop: int) -> bool:
    w = t[stop - 1].lower()
    return t[stop] == "." and (w in LEADING or (len(w) == 1 and w.isalpha() and not _form_before(t, stop)))


def _ended(t: list[str], i: int, k: int, one_case: bool) -> bool:
    """Whether the mark at ``i`` ends a sentence, given that ``k`` can open one."""
    if t[i] != "." or (i > 0 and t[i - 1] in ENDERS):
        return True
    if i == 0:
        return False
    w = t[i - 1]
    low = w.lower()
    if i < k - 1:  # a closing mark follows
        return True
    if _in_address(t, i):
        return False
    if len(w) == 1 and w.isalpha():
        before = t[i - 2] if i >= 2 else ""
        if (before in "/-" and i > 2 and t[i - 3].isdigit()) or before.isdigit() or before.lower() in ("sesso", "lettera", "scala", "interno"):
            return True
        if _form_before(t, i):
            return not _single(t, k)
        return _full(t, k) and before != "." and t[_first(t, k)][0].isupper() and not one_case
    if low in CLOSING or low.rstrip(".") in CLOSING:
        return _full(t, k) if one_case else not _single(t, k)
    return low not in LEADING


def _single(t: list[str], k: int) -> bool:
    """Whether a single letter with a full stop stands at ``k``."""
    return len(t[k]) == 1 and t[k].isalpha() and k + 1 < len(t) and t[k + 1] == "."


def natural(tokens: list[str | None]) -> list[int]:
    """Places of the tokens that open a new sentence or a numbered point, never 0."""
    return [k for k, s in enumerate(strengths(tokens)) if s == SENTENCE]
