"""Personal information in free text: find it and put typed placeholders in its place.

Anchor expansion.  One Aho-Corasick automaton over the text in lower case finds at-signs in
all their disguises, titles, given and family names, words after which a person is named,
street words, dialling schemes, digits and the dots of initials.  From each anchor a
deterministic local parser expands to the left and right, checks the candidate (host names,
digits per country code, the structure of tax codes and personal numbers, house numbers,
the shape of names) and fixes its boundaries.  Where parsers overlap, mail wins over
document numbers, phones, addresses and names.

A name needs no entry in a list: two or three words of a name's shape are one after a
person's cue (a salutation, a greeting at the end, "ask for", "firma:"), before a person's
tail (", tel.", ", nato"), or where one of them is a common given or family name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm import lexicon as lex
from roadweave.runtime import ship

_BLANK = "[ \\u00a0\\t]"
_GAP = "[ \\u00a0\\t]{1,3}"


def lower(text: str) -> str:
    """Lower case that keeps every character at its place."""
    t = text.lower()
    return t if len(t) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    words: dict[str, set] = {}
    for w in ("@", "(at)", "[at]", "{at}", " at ", " (at) ", " [at] ", "\xa0at\xa0", "&#64;", "＠", "chiocciola", "(a)"):
        words.setdefault(w, set()).add("mail")
    for w in lex.GIVEN_NAMES:
        words.setdefault(lower(w), set()).add("given")
        if "ß" in w:
            words.setdefault(lower(w).replace("ß", "ss"), set()).add("given")
    for w in lex.FAMILY_NAMES:
        words.setdefault(lower(w), set()).add("family")
    for w in lex.PERSON_CUES:
        words.setdefault(w, set()).add("cue")
    for w in lex.PERSON_TAILS:
        words.setdefault(w, set()).add("tail")
    for w in (*"0123456789", "+", "(0"):
        words.setdefault(w, set()).add("number")
    words.setdefault(".", set()).add("dot")
    for w in lex.TITLES:
        words.setdefault(w, set()).add("title")
    for w in ("dott.ssa", "prof.ssa", "sig.ra"):
        words.setdefault(w, set()).add("title")
    for w in lex.STREET_BEFORE:
        words.setdefault(w, set()).add("street")
    for w in lex.STREET_AFTER:
        words.setdefault(w.lower(), set()).add("english")
    for w in lex.STREET_ENDINGS:
        words.setdefault(w, set()).add("german")
    for w, kinds in words.items():
        # Numbers are by far the most hits; they carry no kinds and are told by that.
        a.add_word(w, (len(w), None if kinds == {"number"} else tuple(sorted(kinds))))
    a.make_automaton()
    return a


# Mail

_DOT = rf"(?:\.|{_BLANK}?[\[({{]{_BLANK}?(?:dot|punto|punkt|pika){_BLANK}?[\])}}]{_BLANK}?|{_BLANK}(?:dot|punto|DOT|PUNTO){_BLANK})"
_HOST = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*", re.IGNORECASE)
_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ](?:[A-Za-z0-9À-ÿ._%+'-]{0,62}[A-Za-z0-9À-ÿ_-])?$|[A-Za-z0-9]$")
_SPLIT_DOT = re.compile(_DOT, re.IGNORECASE)


def _mail(text: str, start: int, end: int, word: bool) -> tuple[int, int] | None:
    """Mailbox and host around an at-sign at start:end; ``word``: the sign is a bare word."""
    i = start
    while i > 0 and text[i - 1] in " \xa0" and start - i < 2:
        i -= 1
    m = _LOCAL.search(text, max(0, i - 64), i)
    if not m:
        return None
    j = end
    while j < len(text) and text[j] in " \xa0" and j - end < 2:
        j += 1
    h = _HOST.match(text, j)
    if not h:
        return None
    stop = h.end()
    labels = _SPLIT_DOT.split(text[j:stop])
    # A sentence that goes on after the host isn't part of it: the last label must be a top-level domain.
    while len(labels) > 1 and not re.fullmatch("[A-Za-z]{2,24}", labels[-1]):
        cut = [x for x in _SPLIT_DOT.finditer(text, j, stop)][-1].start()
        labels, stop = labels[:-1], cut
    if len(labels) < 2 or lower(labels[-1]) in lex.FILE_ENDINGS:
        return None
    local = m.group()
    if word and not re.search(r"[0-9._+-]", local) and "." not in text[j:stop]:
        return None
    if word and local[0].isupper() and " " in text[m.start() : start] and not re.search(r"[0-9._+-]", local):
        return None
    return m.start(), stop


# Numbers

_SEP = rf"(?:{_BLANK}{{1,2}}|{_BLANK}?[-/.]{_BLANK}?)"
#: Country codes of one digit and of two; every other one has three (fixed values).
_ONE, _TWO = ("1", "7"), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Digits after the country code (and without a bracketed zero), least and most, where they are known more closely.
_COUNTRY = {"39": (9, 11), "43": (7, 13), "44": (9, 10), "49": (7, 13), "41": (9, 9), "33": (9, 9), "385": (8, 9), "386": (8, 8), "1": (10, 10)}
_PHONES = [
    # The country code with the trunk zero in brackets, in any grouping.
    (re.compile(rf"(?:\+|00)[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?(?:\(0?\d{{1,5}}\)|\d{{1,12}})(?:{_SEP}?\d{{1,8}}){{0,5}}"), None),
    (re.compile(rf"\(0\d{{1,4}}\){_SEP}?\d{{2,8}}(?:{_SEP}\d{{2,6}}){{0,3}}"), (9, 12)),
    (re.compile(rf"0[1-9]\d{{0,3}}{_SEP}\d{{3,8}}(?:{_SEP}\d{{2,6}}){{0,3}}"), (9, 11)),
    (re.compile(r"0[1-9]\d{7,9}"), (9, 10)),
    (re.compile(rf"3\d{{2}}{_SEP}\d{{2,7}}(?:{_SEP}\d{{2,6}}){{0,3}}"), (9, 10)),
    (re.compile(r"3\d{9}"), (10, 10)),
]
_NUMBER_START = re.compile(r"(?<![\w+/.,@#-])(?=\+\d|\(0\d|[03]\d)|(?<=[=:(;>\"])(?=\+\d|\(0\d|[03]\d)")


def _country(digits: str) -> str:
    """The country code that digits begin with."""
    return digits[:1] if digits[:1] in _ONE else digits[:2] if digits[:2] in _TWO else digits[:3]


def _national(s: str) -> bool:
    """Whether an international number has a fitting count of digits after its country code."""
    digits = re.sub(r"\D", "", s.replace("(0)", ""))
    plus = not s.startswith("00")
    digits = digits if plus else digits[2:]
    code = _country(digits)
    n = len(digits) - len(code)
    if code in _COUNTRY:
        low, high = _COUNTRY[code]
        return low <= n - (code != "39" and digits[len(code) :].startswith("0")) <= high
    # Elsewhere at most 15 digits in all; after 00 the code must stand apart, as serial numbers begin so too.
    return 7 <= n <= 15 - len(code) and (plus or re.match(rf"00{code}{_SEP}", s) is not None)


def _shrink(text: str, start: int, stop: int) -> Iterator[int]:
    """Ends of a number from the longest to the shortest, cut before a separator."""
    yield stop
    for m in reversed(list(re.finditer(_SEP, text[start:stop]))):
        yield start + m.start()


def _phone(text: str, start: int) -> tuple[int, int] | None:
    best = None
    for pattern, limits in _PHONES:
        m = pattern.match(text, start)
        if not m:
            continue
        for stop in _shrink(text, start, m.end()):
            if stop < len(text) and (text[stop].isalnum() or (text[stop] in ".,/:-" and stop + 1 < len(text) and text[stop + 1].isdigit() and limits is not None)):
                continue
            s = text[start:stop]
            digits = re.sub(r"\D", "", s.replace("(0)", ""))
            if limits is None:
                ok = _national(s)
            else:
                ok = limits[0] <= len(digits) <= limits[1]
                if ok and s[0] == "3" and re.match(r"3\d\d/\d{3}(?!\d)", s) and len(digits) < 9:
                    ok = False
            if ok and (best is None or stop > best[1]):
                best = (start, stop)
                break
    return best


_MONTHS = set("ABCDEHLMPRSTabcdehlmprst")
_MONTH = "[ABCDEHLMPRSTabcdehlmprst]"
_ID = re.compile(
    rf"""(?<![A-Za-z0-9])(?:
      (?P<tax>[A-Za-z]{{3}}[ \u00a0-]?[A-Za-z]{{3}}[ \u00a0-]?[0-9]{{2}}{_MONTH}[0-9]{{2}}[ \u00a0-]?[A-Za-z][0-9]{{3}}[A-Za-z])
    | (?P<licence>[Uu]1[ \u00a0]?[A-Za-z][ \u00a0]?[0-9]{{6}}[ \u00a0]?[A-Za-z])
    | (?P<card>[A-Z]{{2}}[ \u00a0-]{{0,2}}[0-9]{{5}}[ \u00a0-]{{0,2}}[A-Z]{{2}}|[a-z]{{2}}[0-9]{{5}}[a-z]{{2}})
    | (?P<old>[A-Z]{{2}}[ \u00a0]?[0-9]{{7}}[A-Z]?)
    | (?P<emso>[0-9]{{13}})
    )(?![A-Za-z0-9])""",
    re.VERBOSE,
)


def personal_number_ok(s: str) -> bool:
    """Day, month and register (50 to 59) of a 13-digit personal number.

    The check digit isn't asked for: numbers written down wrongly are personal all the same.
    """
    return 1 <= int(s[:2]) <= 31 and 1 <= int(s[2:4]) <= 12 and s[4] in "09" and s[7] == "5"


#: How far the start of a document number may lie before its first digit.
_ID_REACH = 9


def _runs(text: str, marks: list[int]) -> Iterator[int]:
    """Starts of the runs of digits that a document number can have first: a year and its month's letter, the 1 of a licence, or five and more."""
    start = last = -2
    for i in [*marks, len(text) + 9]:
        if i != last + 1 or not text[i : i + 1].isdigit():
            size = last + 1 - start
            if start >= 0 and (size >= 5 or (size == 2 and text[last + 1 : last + 2] in _MONTHS) or (size == 1 and text[start] == "1" and text[start - 1 : start] in ("U", "u"))):
                yield start
            start = i if text[i : i + 1].isdigit() else -2
        last = i


def _ids(text: str, low: str, runs: Iterator[int]) -> list[tuple[int, int]]:
    """Document numbers around runs of digits that begin at ``runs``."""
    out: list[tuple[int, int]] = []
    for run in runs:
        for at in range(max(0, run - _ID_REACH, out[-1][1] if out else 0), run + 1):
            if not text[at].isalnum() or not text[at].isascii():
                continue
            m = _ID.match(text, at)
            if not m:
                continue
            kind = m.lastgroup
            if kind == "emso" and not personal_number_ok(m.group()):
                continue
            if kind == "old" and not any(c in low[max(0, at - 40) : at] for c in lex.ID_CUES):
                continue
            out.append(m.span())
            break
    return out


# Addresses

_LINK = "|".join(sorted(lex.STREET_LINKS, key=len, reverse=True))
_WORD = r"(?:[A-ZÀ-ÝŠŽČĆĐ0-9][\w'’]*\.?|[IVX]+)"
_STREET_NAME = rf"(?:(?:{_LINK})(?:['’]|\s{{1,2}})){{0,2}}{_WORD}(?:[\s-]{{1,2}}(?:(?:{_LINK})(?:['’]|\s{{1,2}})){{0,2}}{_WORD}){{0,3}}?"
_SLOVENE_NAME = r"[^\W\d][\w'’]*(?:\s{1,2}[^\W\d][\w'’]*){0,3}?"
_HOUSE = rf"(?:\s{{0,2}},)?\s{{0,2}}(?:{lex.NUMBER_WORDS}\s{{0,2}})?\d{{1,4}}(?![\d])(?:{_BLANK}?/{_BLANK}?(?:[A-Za-z]|\d{{1,3}})(?!\w)|[A-Za-z](?!\w)|{_BLANK}{{1,2}}(?:bis|ter|quater|BIS|TER)(?!\w))?"
_ITALIAN = re.compile(rf"(?=\s|\S)\s{{0,2}}{_STREET_NAME}(?<![\d]){_HOUSE}", re.IGNORECASE)
_ITALIAN_STRICT = re.compile(rf"\s{{0,2}}{_STREET_NAME}{_HOUSE}")
_ITALIAN_UPPER = re.compile(rf"\s{{0,2}}[A-ZÀ-Ý'’]+(?:\s{{1,2}}[A-ZÀ-Ý'’]+){{0,4}}?{_HOUSE.replace('(?:n', '(?i:n', 1)}")
_SLOVENE = re.compile(rf"\s{{0,2}}{_SLOVENE_NAME}{_HOUSE}(?:{_BLANK}{{1,2}}[a-zA-Z](?!\w))?", re.IGNORECASE)
_GERMAN_HOUSE = re.compile(rf"\.?\s{{0,2}}\d{{1,4}}(?!\d){_BLANK}?(?:[a-zA-Z](?!\w))?(?:{_BLANK}?/{_BLANK}?\d{{1,3}})?")
_ENGLISH_LEFT = re.compile(rf"(?:(?:No\.?|Nr\.?|Number|no\.?|NO\.?|Flat|Unit){_GAP})?\d{{1,4}}[A-Za-z]?,?\s{{1,2}}(?:[A-Z][\w'’]*\.?(?:\s{{1,2}}|-)){{1,4}}$")


def _before(text: str, start: int, end: int, word: str) -> tuple[int, int] | None:
    """An address whose street word at start:end stands first."""
    if start and (text[start - 1].isalnum() or text[start - 1] in "/@._-"):
        return None
    slovene = word in lex.STREET_SLOVENE
    if not word.endswith(".") and not (end < len(text) and text[end].isspace()):
        return None
    patterns = (_SLOVENE,) if slovene else (_ITALIAN_STRICT, _ITALIAN_UPPER)
    for p in patterns:
        m = p.match(text, end)
        if m:
            stop = m.end()
            rest = text[stop : stop + 2]
            if rest[:1] in (":", "%") or (rest[:1] in (".", ",", "/") and rest[1:2].isdigit()):  # a time, a share, a decimal
                continue
            if re.search(r"\d[,.]\d", m.group()) and not re.search(r",\d", m.group()):
                continue
            return start, stop
    return None


def _german(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An address whose street word ends at ``end``: Lindenstr. 108a."""
    i = start
    while i and (text[i - 1].isalpha() or text[i - 1] == "-"):
        i -= 1
    if i == start and not text[i : i + 1].isupper():
        return None
    if not text[i].isupper():
        return None
    m = _GERMAN_HOUSE.match(text, end)
    if not m or (m.end() < len(text) and text[m.end()] in ":%"):
        return None
    words = re.search(rf"((?:{'|'.join(lex.STREET_ADJECTIVES)})(?:{_GAP}(?:der|dem|den))?{_GAP})$", text[max(0, i - 24) : i])
    return (i - len(words.group(1)) if words else i), m.end()


def _english(text: str, start: int, end: int) -> tuple[int, int] | None:
    """An address whose street word comes last: No. 7 Hollow St."""
    if not text[start].isupper() or (end < len(text) and (text[end].isalnum() or text[end] in "'’")):
        return None
    left = text[max(0, start - 70) : start]
    m = _ENGLISH_LEFT.search(left)
    if not m:
        return None
    # The shortest reading: the number nearest to the street.
    while True:
        nearer = _ENGLISH_LEFT.search(left, m.start() + 1)
        if not nearer or not re.match(r"\D", left[nearer.start() - 1]) or re.match(r"(?:No|Nr|Number|Flat|Unit|no|NO)\b", m.group()):
            break
        m = nearer
    at = max(0, start - 70) + m.start()
    if at and (text[at - 1].isalnum() or text[at - 1] in "/.,-+:" and text[at - 2 : at - 1].isdigit()):
        return None
    word, stop = text[start:end], end
    if word.title() in lex.STREET_DOTTED and text[end : end + 1] == "." and (word.title() == "St" or text[end + 1 : end + 2] in (".", ",", ";")):
        stop += 1
    return at, stop


# Names

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NO_NAMES = {w.lower() for w in lex.NO_NAMES}
_PLAIN = set(lex.PLAIN_WORDS)
_GIVEN = {lower(w) for w in lex.GIVEN_NAMES}
_TITLE_WORDS = set(lex.TITLES)


def _shape(word: str) -> str:
    if word.islower():
        return "lower"
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() or c == "ß" for c in letters):
        return "upper"
    return "title" if word[0].isupper() else "mixed"


def _right_token(text: str, at: int) -> re.Match | None:
    """The word after ``at``, if only blanks stand between."""
    m = re.compile(_GAP).match(text, at)
    return _TOKEN.match(text, m.end()) if m else None


def _left_token(text: str, at: int, comma: bool) -> tuple[int, int] | None:
    """Span of the word before ``at``, across blanks and perhaps a comma."""
    m = re.search(rf"({'(?:,' + _BLANK + '{1,3}|' + _GAP + ')' if comma else _GAP})$", text[max(0, at - 4) : at])
    if not m:
        return None
    j = at - len(m.group(1))
    i = j
    while i and (text[i - 1].isalpha() or (text[i - 1] in "'’-" and i > 1 and text[i - 2].isalpha() and i < j)):
        i -= 1
    return (i, j) if i < j and not (i and (text[i - 1].isdigit() or text[i - 1] in "@_")) else None


def _family(word: str, shape: str) -> bool:
    """Whether a word can be a family name beside a given name of this shape."""
    s, low = _shape(word), lower(word)
    if len(word) < 3 or low in _NO_NAMES and s != "lower" or low in _TITLE_WORDS:
        return False
    if shape == "lower":
        return s == "lower" and len(word) > 3 and low not in _PLAIN and low not in _NO_NAMES
    if shape == "upper":
        return s == "upper" and low not in _PLAIN
    return s == "title" and low not in _PLAIN


_INITIAL = r"[A-ZÀ-ÝŠŽČĆĐ]\."


def _given(text: str, start: int, end: int, blocked) -> tuple[int, int] | None:
    """A name around the given name at start:end."""
    shape = _shape(text[start:end])
    lo, hi = start, end
    while (t := _right_token(text, hi)) and lower(t.group()) in _GIVEN and _shape(t.group()) == shape:
        hi = t.end()
    m = re.compile(rf"(?:{_GAP}{_INITIAL})+").match(text, hi)
    after = m.end() if m else hi
    families, at = 0, after
    while families < 2 and (t := _right_token(text, at)) and not blocked(t.start(), t.end()) and _family(t.group(), shape):
        families, at = families + 1, t.end()
    if families:
        return lo, at
    # Nothing to the right: the family names stand before, perhaps with a comma.
    while (s := _left_token(text, lo, False)) and lower(text[s[0] : s[1]]) in _GIVEN and _shape(text[s[0] : s[1]]) == shape:
        lo = s[0]
    at, comma = lo, True
    while families < 2 and (s := _left_token(text, at, comma)) and not blocked(*s) and _family(text[s[0] : s[1]], shape) and lower(text[s[0] : s[1]]) not in _GIVEN:
        families, at, comma = families + 1, s[0], False
    if families:
        return at, hi
    return None


def _titled(text: str, end: int, blocked) -> tuple[int, int] | None:
    """A name after a title that ends at ``end``."""
    m = re.compile(rf"\.?{_BLANK}{{0,3}}").match(text, end)
    at = m.end()
    if at == end or lower(text[end : end + 4]).startswith((".ssa", ".ra")):
        return None
    first, stop, words = at, at, 0
    i = re.compile(rf"(?:{_INITIAL}{_BLANK}{{0,3}})+").match(text, at)
    if i:
        at = i.end()
    t = _TOKEN.match(text, at)
    shape = _shape(t.group()) if t else ""
    if shape not in ("title", "upper"):
        return None
    while t and words < 3 and not blocked(t.start(), t.end()) and (_family(t.group(), shape) or lower(t.group()) in _GIVEN):
        words, stop = words + 1, t.end()
        t = _right_token(text, stop)
    return (first, stop) if words else None


_INITIALS = re.compile(rf"(?<![\w./'’@-])(?:{_INITIAL}{_BLANK}{{0,2}}){{1,3}}(?=[^\W\d_])")


def _initialled(text: str, m: re.Match, blocked) -> tuple[int, int] | None:
    """Initials and the family names after them."""
    if re.search(rf"\d{_BLANK}?\Z", text[max(0, m.start() - 2) : m.start()]):
        return None  # a house number's letter at the end of a sentence
    at, words = m.end(), 0
    t = _TOKEN.match(text, at)
    stop = at
    while t and words < 2 and not blocked(t.start(), t.end()) and (_family(t.group(), _shape(t.group())) and _shape(t.group()) in ("title", "upper")):
        if words and _shape(t.group()) != first:
            break
        first = _shape(t.group())
        words, stop = words + 1, t.end()
        t = _right_token(text, stop)
    return (m.start(), stop) if words else None


_NO_PERSONS = {lower(w) for w in lex.NO_PERSONS} | {lower(w) for w in lex.STREET_AFTER} | {w.strip(".") for w in lex.STREET_BEFORE}
_FAMILIES = {lower(w) for w in lex.FAMILY_NAMES}
_AFTER_CUE = re.compile(rf"(?:{_BLANK}{{0,2}}[:,.])?(?:{_BLANK}{{1,3}}|{_BLANK}*\n{_BLANK}*)")
_BEFORE_TAIL = re.compile(rf"\s{{0,2}}[(,;]?\s{{0,2}}\Z")
_GOES_ON = re.compile(rf"{_BLANK}*(?:\Z|[\n,;.)<(])|{_BLANK}+[a-zà-ÿ]")
_DIGIT_NEAR = re.compile(rf"[.,]?{_BLANK}{{0,2}}(?:n\.?{_BLANK}?)?\d")
_STREET_END = tuple(lex.STREET_ENDINGS)


def _name_word(text: str, t: re.Match | None, blocked, shape: str = "title") -> bool:
    """Whether a word can be part of a name by its shape alone: capitalised, not a place's, body's or sentence's word."""
    if not t or len(t.group()) < 3 or blocked(t.start(), t.end()) or _shape(t.group()) != shape:
        return False
    low = lower(t.group())
    return not (low in _NO_NAMES or low in _PLAIN or low in _NO_PERSONS or low in _TITLE_WORDS or low.endswith(_STREET_END) or low.endswith("str"))


def _after_cue(text: str, start: int, end: int, blocked) -> tuple[int, int] | None:
    """Two or three words of a name's shape after the words at start:end that announce a person.

    After a cue that isn't in capitals itself the name may be.
    """
    if start and (text[start - 1].isalnum() or text[start - 1] in "_@-"):
        return None
    m = _AFTER_CUE.match(text, end)
    if not m:
        return None
    return _shaped(text, m.end(), blocked) or (None if text[start:end].isupper() else _shaped(text, m.end(), blocked, "upper"))


def _shaped(text: str, at: int, blocked, shape: str = "title") -> tuple[int, int] | None:
    t, stop, words = _TOKEN.match(text, at), at, 0
    comma = None
    while words < 3 and _name_word(text, t, blocked, shape):
        words, stop = words + 1, t.end()
        t = _right_token(text, stop)
        if words == 1 and not t:  # family name, given name
            comma = re.compile(rf",{_BLANK}{{1,2}}").match(text, stop)
            t = _TOKEN.match(text, comma.end()) if comma else None
        elif comma:
            break
    number = _DIGIT_NEAR.match(text, stop)
    if words < 2 or (number and not blocked(number.end() - 1, number.end())) or text[stop : stop + 1] in ("@", "_", "-"):
        return None
    return at, stop


#: What joins the entries of a list of persons, and a person to the entry of another kind before them.
_NEXT_PERSON = re.compile(rf",?{_BLANK}{{1,2}}(?:e|ed|and|und|in|sowie)?{_BLANK}{{0,2}}|{_BLANK}?[;,]{_BLANK}{{0,2}}|{_BLANK}?\n(?:[-*•]{_BLANK})?")


def _listed(text: str, end: int, after_name: bool, blocked) -> tuple[int, int] | None:
    """The next person of a list whose entry before ends at ``end``."""
    m = _NEXT_PERSON.match(text, end)
    if not m:
        return None
    capitals = after_name or "\n" in m.group()
    return _shaped(text, m.end(), blocked) or (_shaped(text, m.end(), blocked, "upper") if capitals else None)


def _opens(text: str, at: int) -> str:
    """What stands before a place, blanks and bullets aside; only a few characters are looked at."""
    return text[max(0, at - 8) : at].rstrip(" \xa0\t-*")


def _signed_off(text: str, start: int, blocked) -> tuple[int, int] | None:
    """A line of nothing but a name's words above a line that begins with a phone or mail at ``start``."""
    m = re.search(rf"{_BLANK}*\n{_BLANK}*\Z", text[max(0, start - 8) : start])
    if not m:
        return None
    span = _before_tail(text, start - len(m.group()), blocked)
    return span if span and _opens(text, span[0])[-1:] in ("", "\n") else None


def _before_tail(text: str, tail: int, blocked) -> tuple[int, int] | None:
    """Two or three words of a name's shape that end where a person's tail begins."""
    lo, words = tail, 0
    while words < 3:
        j = lo
        if words:
            m = re.search(rf"{_GAP}$", text[max(0, lo - 3) : lo])
            j = lo - len(m.group()) if m else -1
        i = j
        while i > 0 and (text[i - 1].isalpha() or text[i - 1] in "'’-"):
            i -= 1
        t = _TOKEN.match(text, i) if 0 <= i < j else None
        if not t or t.end() != j or not _name_word(text, t, blocked):
            break
        lo, words = i, words + 1
    return (lo, tail) if words > 1 else None


def _known_family(text: str, start: int, end: int, blocked) -> tuple[int, int] | None:
    """A common family name with a word of a given name's shape before it, or after it and a comma."""
    word = text[start:end]
    if _shape(word) != "title":
        return None
    s = _left_token(text, start, False)
    t = _TOKEN.match(text, s[0]) if s else None
    if s and t and t.end() == s[1] and _name_word(text, t, blocked) and not _DIGIT_NEAR.match(text, end):
        opens = _opens(text, s[0])[-1:] in (".", "!", "?", "\n", "")
        # A first word of a sentence may be any word: there the text must end or go on as after a name.
        if not opens or _GOES_ON.match(text, end):
            return s[0], end
    return None


# All together


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every occurrence, in order, without overlaps."""
    if not text:
        return []
    low = lower(text)
    hits: dict[str, list[tuple[int, int]]] = {}
    marks: list[int] = []
    for end, (n, kinds) in _anchors().iter(low):
        if kinds is None:
            marks.append(end + 1 - n)
            continue
        for k in kinds:
            hits.setdefault(k, []).append((end + 1 - n, end + 1))
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text) + 1)

    def blocked(i: int, j: int) -> bool:
        return 1 in used[i:j]

    def take(span: tuple[int, int] | None, kind: str) -> None:
        if span and span[0] < span[1] and not blocked(*span):
            taken.append((*span, kind))
            used[span[0] : span[1]] = b"\x01" * (span[1] - span[0])

    for i, j in hits.get("mail", ()):
        bare = text[i:j].strip(" \xa0").lower() in ("at", "chiocciola")
        take(_mail(text, i, j, bare), "email")
    for span in _ids(text, low, _runs(text, marks)):
        take(span, "id_number")
    for i in marks:
        if text[i] in "+(03" and not used[i] and _NUMBER_START.match(text, i):
            take(_phone(text, i), "phone")
    word_edge = lambda i, j: (not i or not (text[i - 1].isalnum() or text[i - 1] == "_")) and (j == len(text) or not (text[j].isalnum() or text[j] == "_"))
    addresses = []
    for i, j in hits.get("street", ()):
        addresses.append(_before(text, i, j, low[i:j]))
    for i, j in hits.get("german", ()):
        addresses.append(_german(text, i, j))
    for i, j in hits.get("english", ()):
        if word_edge(i, j):
            addresses.append(_english(text, i, j))
    for span in sorted({a for a in addresses if a}, key=lambda a: (a[0], -a[1])):
        take(span, "address")
    for i, j in sorted(hits.get("title", ()), key=lambda h: (h[0], -h[1])):
        if (not i or not (text[i - 1].isalnum() or text[i - 1] in "_@.")) and (j == len(text) or not text[j].isalnum()):
            take(_titled(text, j, blocked), "name")
    for i, j in hits.get("given", ()):
        if not used[i] and word_edge(i, j) and text[i - 1 : i] not in ("@", "-", "'", "’") and text[j : j + 1] not in ("@", "-", "_"):
            take(_given(text, i, j, blocked), "name")
    for i, _ in hits.get("dot", ()):
        if i and not used[i - 1] and text[i - 1].isupper() and (m := _INITIALS.match(text, i - 1)):
            take(_initialled(text, m, blocked), "name")
    for i, j in sorted(hits.get("cue", ()), key=lambda h: (h[1], h[0])):
        if not used[i]:
            take(_after_cue(text, i, j, blocked), "name")
    for i, j in hits.get("tail", ()):
        if word_edge(i, j) and text[i - 1 : i] not in ("", "@", "-", "."):
            m = _BEFORE_TAIL.search(text, max(0, i - 5), i)
            take(_before_tail(text, m.start(), blocked), "name")
    for i, _, k in list(taken):
        if k in ("phone", "email"):
            take(_signed_off(text, i, blocked), "name")
    persons = [(i, j, k) for i, j, k in taken if k in ("name", "email", "id_number")]
    while persons:  # a list goes on from each person found
        _, j, kind = persons.pop()
        span = _listed(text, j, kind == "name", blocked)
        if span:
            take(span, "name")
            persons.append((*span, "name"))
    for i, j in hits.get("family", ()):
        if not used[i] and word_edge(i, j):
            take(_known_family(text, i, j, blocked), "name")
    return sorted(taken)


def redact_text(text: str | None) -> str | None:
    """The text with every occurrence replaced by its type in angle brackets; the rest as it was."""
    if not text:
        return text
    out, at = [], 0
    for i, j, kind in find(text):
        out += [text[at:i], f"<{kind.upper()}>"]
        at = j
    return "".join([*out, text[at:]])


def find_personal(df: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, start_pos, end_pos, pii_type), one row per occurrence.

    Positions count characters from 0.  Null and empty texts have none; repeated ids and
    repeated texts are searched each for themselves; further columns are ignored.
    """
    kind = df.schema[item_id].dataType.simpleString()
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, j, t) for k, s in zip(pdf["_id"], pdf["_text"]) for i, j, t in find(s)]
            yield pd.DataFrame(rows, columns=[item_id, "start_pos", "end_pos", "pii_type"])

    return df.select(F.col(item_id).alias("_id"), F.col(text).alias("_text")).where("_text <> ''").mapInPandas(run, f"`{item_id}` {kind}, start_pos int, end_pos int, pii_type string")


def redact(df: DataFrame, text: str, into: str | None = None) -> DataFrame:
    """``df`` with the text redacted, in place or in the new column ``into``; nulls stay null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(redact_text)

    ship(df.sparkSession)
    return df.withColumn(into or text, clean(F.col(text)))
