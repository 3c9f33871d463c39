"""Character-level forms of a text: its *look* and its *words*.

The look (`skeleton`) follows the confusables-skeleton method: decompose,
replace every character by the prototype of its look-alike class, decompose
again.  `words` reads every letter in the script its word belongs to.
Both are plain functions over one string; the operators call them in Arrow
batches.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of the same shape, Latin prototype first, then the
# Cyrillic and Greek letters that look like it.
LOOKALIKES = [
    "AА", "AΑ", "BВ", "BΒ", "CС", "EЕ", "EΕ", "HН", "HΗ", "IІ", "IΙ", "IӀ", "JЈ", "KК", "KΚ",
    "MМ", "MΜ", "NΝ", "OО", "OΟ", "PР", "PΡ", "SЅ", "TТ", "TΤ", "XХ", "XΧ", "YΥ", "YҮ", "ZΖ",
    "aа", "cс", "eе", "hһ", "iі", "jј", "oо", "oο", "pр", "sѕ", "vν", "xх", "yу", "dԁ", "qԛ", "wԝ",
]

# Further letters of one shape, which only the look counts (no script is told by them).
MORE_LOOKALIKES = [
    "aα", "aɑ", "cϲ", "cᴄ", "gɡ", "iι", "jϳ", "kκ", "lӏ", "oᴏ", "pρ", "uυ", "uᴜ", "vѵ", "vᴠ", "wԝ", "wᴡ", "xχ", "yү", "yγ", "zᴢ",
    "CϹ", "JͿ", "QԚ", "VѴ", "WԜ", "æӕ", "ÆӔ",
]

# Invisible characters: soft hyphen, grapheme joiner, zero-width and joiner
# characters, direction and byte-order marks, variation selectors.
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F),
              *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10)]
_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]

_PLAIN: dict[int, int | str | None] = {c: None for c in _INVISIBLE}
_PLAIN |= {c: 0x20 for c in _SPACES}
_PLAIN |= {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}

_TO_LATIN = {ord(x[1]): ord(x[0]) for x in LOOKALIKES}
_PROTOTYPE = _PLAIN | _TO_LATIN | {ord(x[1]): ord(x[0]) for x in MORE_LOOKALIKES}


def _forms() -> dict[int, str]:
    """Wide forms, letters of mathematical and other fonts, ligatures and Roman numerals, by their decompositions."""
    out = {}
    for c in (*range(0x2100, 0x2190), *range(0xFB00, 0xFB07), *range(0xFFE0, 0xFFE7), *range(0x1D400, 0x1D800)):
        kind = unicodedata.decomposition(chr(c)).split(" ")[0]
        if kind in ("<font>", "<wide>") or kind == "<compat>" and (c >= 0xFB00 or 0x2160 <= c < 0x2180):
            out[c] = unicodedata.normalize("NFKD", chr(c)).translate(_PROTOTYPE)
    return out


_PROTOTYPE |= _forms()


def _is_cyrillic(c: int) -> bool:
    return 0x400 <= c < 0x530


_TO_CYRILLIC = {ord(x[0]): ord(x[1]) for x in reversed(LOOKALIKES) if _is_cyrillic(ord(x[1]))}
_TO_GREEK = {ord(x[0]): ord(x[1]) for x in LOOKALIKES if 0x370 <= ord(x[1]) < 0x400}
# letters of one script written with those of the two others
_READ = {
    "L": _TO_LATIN,
    "C": _TO_CYRILLIC | {g: _TO_CYRILLIC[l] for g, l in _TO_LATIN.items() if not _is_cyrillic(g) and l in _TO_CYRILLIC},
    "G": _TO_GREEK | {c: _TO_GREEK[l] for c, l in _TO_LATIN.items() if _is_cyrillic(c) and l in _TO_GREEK},
}
_SHARED = {*_TO_LATIN, *_TO_LATIN.values()}

_LATIN = frozenset(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250), *range(0x1E00, 0x1F00)]))
_CYR_GREEK = frozenset(map(chr, range(0x370, 0x530)))
_ODD = frozenset(map(chr, [*_PLAIN, *range(0x300, 0x370)]))
_TOKEN_RE = re.compile(r"[^\W_]+")
_MARKED_RE = re.compile("(?:[^\\W_]|[\u0300-\u036f])+")
_MARKS_RE = re.compile("[\u0300-\u036f]")
#: Tokens read so far by this process; emptied when full, so memory stays bounded.
_READ_SO_FAR: dict[str, str | None] = {}
_MOST_KEPT = 200_000


def _closure() -> dict[str, str]:
    """Prototype of every character, composed letters included: decompose, replace, decompose again, compose."""
    table = {chr(c): "" if p is None else p if isinstance(p, str) else chr(p) for c, p in _PROTOTYPE.items()}
    for c in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0] in table:
            table[chr(c)] = unicodedata.normalize("NFC", table[parts[0]] + parts[1:])
    return table


_SKELETON = _closure()
_CHANGED = frozenset(_SKELETON)
_SHOWN = {chr(c): "" if p is None else chr(p) for c, p in _PLAIN.items()}


def skeleton(text: str) -> str:
    """The look of a text: equal for texts that look alike, case, accents, punctuation and space runs kept."""
    if text.isascii():
        return text
    for c in _CHANGED.intersection(text):
        text = text.replace(c, _SKELETON[c])
    return unicodedata.normalize("NFC", text)


def shown(text: str) -> str:
    """The text without invisible characters, with plain spaces and full-width forms made plain."""
    for c in _SHOWN.keys() & set(text):
        text = text.replace(c, _SHOWN[c])
    return text


def _script(c: str) -> str:
    n = ord(c)
    if n < 0x370:
        return "L"
    if n < 0x400:
        return "G"
    if n < 0x530:
        return "C"
    return "L" if 0x1E00 <= n < 0x1F00 else ""


_OWN = {c: s for s, r in (("L", _LATIN), ("C", map(chr, range(0x400, 0x530))), ("G", map(chr, range(0x370, 0x400)))) for c in r if ord(c) not in _SHARED}


def _majority(letters: str) -> str:
    """The script of most letters that only one script has; empty if there are none."""
    n = {"L": 0, "C": 0, "G": 0}
    for s in map(_OWN.get, letters):
        if s:
            n[s] += 1
    best = max(n, key=n.get)
    return best if n[best] else ""


def _majority_shared(text: str) -> str:
    """Where no letter tells scripts apart: the script most letters are written in."""
    n = {"L": 0, "C": 0, "G": 0}
    for c in text:
        if c.isalpha() and (s := _script(c)):
            n[s] += 1
    return max(n, key=n.get)


def _lower(word: str) -> str:
    return word.replace("\u0130", "i").lower()


def _read(token: str) -> str | None:
    """The token in the script of its letters, lower-cased; None if every letter is common to several scripts."""
    word = unicodedata.normalize("NFD", token)
    script = _majority(word)
    if not script and any(ord(c) in _SHARED for c in word):
        return None
    if script:
        word = word.translate(_READ[script])
    return _lower(_MARKS_RE.sub("", unicodedata.normalize("NFC", word)))


def _read_as(token: str, script: str) -> str:
    word = unicodedata.normalize("NFD", token).translate(_READ[script])
    return _lower(_MARKS_RE.sub("", unicodedata.normalize("NFC", word)))


_ASCII_WORDS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def _runs(text: str, chars: set[str]) -> list[str]:
    for c in chars:
        if not c.isalnum():
            text = text.replace(c, " ")
    return text.split()


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, each in the script of its word, lower-cased.

    Invisible characters count as nothing, full-width letters as plain ones and
    a letter with a combining mark as the composed letter.  A word made only of
    letters common to several scripts is read in the script of the whole text.
    """
    if text.isascii():
        return text.lower().translate(_ASCII_WORDS).split()
    chars = set(text)
    if odd := not chars.isdisjoint(_ODD):
        text = unicodedata.normalize("NFC", shown(text))
        chars = set(text)
    if chars.isdisjoint(_CYR_GREEK) or chars.isdisjoint(_LATIN):
        if odd:
            text = _MARKS_RE.sub("", text)
        if "\u0130" in chars:
            text = text.replace("\u0130", "i")
        return _runs(text.lower(), set(text.lower()) if odd else {c for c in chars if not c.isalnum()})
    known = _READ_SO_FAR
    if len(known) > _MOST_KEPT:
        known.clear()
    out, whole = [], None
    for token in _MARKED_RE.findall(text) if odd else _runs(text, chars):
        word = known.get(token, "")
        if word == "":
            word = known[token] = _read(token)
        if word is None:
            if whole is None:
                whole = _majority(text) or _majority_shared(text)
            word = _read_as(token, whole)
        if word:
            out.append(word)
    return out
