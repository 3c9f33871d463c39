"""Stemming by the published Snowball algorithms of English, Russian, Spanish, French, Italian and Portuguese, and Turkish by its commonest endings.

Regions: R1 is what follows the first non-vowel after a vowel, R2 the same
within R1, RV a region of its own in each language.  A step takes the longest
ending of its list that the word (or the region it searches) has; if that one
does not meet its condition, the step does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _regions(word: str, vowels: str) -> tuple[int, int]:
    r1 = _after(word, vowels)
    return r1, _after(word, vowels, r1)


def _rv(word: str, vowels: str) -> int:
    """The region RV of Spanish, Italian and Portuguese."""
    if len(word) < 2:
        return len(word)
    if word[1] not in vowels:
        want, at = True, 2
    elif word[0] in vowels:
        want, at = False, 2
    else:
        return min(3, len(word))
    while at < len(word) and (word[at] in vowels) != want:
        at += 1
    return min(at + 1, len(word))


class _Endings:
    """A list of endings; finds the longest a word has at or after a position."""

    def __init__(self, endings: Iterable[str]):
        self.all = frozenset(endings)
        self.longest = max(map(len, self.all))

    def __call__(self, word: str, start: int = 0) -> str:
        for i in range(max(start, len(word) - self.longest), len(word)):
            if word[i:] in self.all:
                return word[i:]
        return ""


def _list(text: str) -> _Endings:
    return _Endings(text.split())


def _cut(word: str, end: str, by: str = "") -> str:
    return word[: len(word) - len(end)] + by


def _also(word: str, region: int, *ends: str) -> str:
    """The word without the first of `ends` it has, if that lies in the region."""
    for e in ends:
        if word.endswith(e):
            return _cut(word, e) if len(word) - len(e) >= region else word
    return word


def _between_vowels(word: str, letters: str, vowels: str) -> str:
    """Letters that stand between vowels written as capitals, so that they count as consonants."""
    out = list(word)
    for i in range(1, len(out) - 1):
        if out[i] in letters and out[i - 1] in vowels and out[i + 1] in vowels:
            out[i] = out[i].upper()
    return "".join(out)


# --- English -----------------------------------------------------------------

_EN_VOWELS = "aeiouy"
# Fixed values of the published algorithm, here and below: exceptions, endings and what replaces them.
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_2, _EN_3 = _Endings(_EN_STEP_2), _Endings(_EN_STEP_3)
_EN_4 = _list("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")
_EN_1B = _list("eed eedly ed edly ing ingly")


def _short(word: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _EN_VOWELS and word[1] not in _EN_VOWELS
    return len(word) > 2 and word[-1] not in _EN_VOWELS + "wxY" and word[-2] in _EN_VOWELS and word[-3] not in _EN_VOWELS


def english(word: str) -> str:
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    if len(word) <= 2:
        return word
    w = word[1:] if word.startswith("'") else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _EN_VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if r1 is None:
        r1 = _after(w, _EN_VOWELS)
    r2 = _after(w, _EN_VOWELS, r1)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = _cut(w, e)
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = _cut(w, "ied", "i" if len(w) > 4 else "ie")
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _EN_VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _EN_AFTER_PLURAL:
        return w
    e = _EN_1B(w)
    if e.startswith("eed"):
        if len(w) - len(e) >= r1:
            w = _cut(w, e, "ee")
    elif e and any(c in _EN_VOWELS for c in _cut(w, e)):
        w = _cut(w, e)
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    e = _EN_2(w)
    if e and len(w) - len(e) >= r1:
        before = _cut(w, e)
        if e == "ogi":
            w = before + "og" if before.endswith("l") else w
        elif e == "li":
            w = before if before[-1:] and before[-1] in "cdeghkmnrt" else w
        else:
            w = before + _EN_STEP_2[e]
    e = _EN_3(w)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = _cut(w, e, _EN_STEP_3[e])
    e = _EN_4(w)
    if e and len(w) - len(e) >= r2 and (e != "ion" or _cut(w, e).endswith(("s", "t"))):
        w = _cut(w, e)
    at = len(w) - 1
    if w.endswith("e") and (at >= r2 or at >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and at >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- Russian -----------------------------------------------------------------

_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND_A, _RU_GERUND = "в вши вшись", "ив ивши ившись ыв ывши ывшись"
_RU_PARTICIPLE_A, _RU_PARTICIPLE = "ем нн вш ющ щ", "ивш ывш ующ"
_RU_VERB_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
_RU_VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
_RU_ADJECTIVE = _list("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_NOUN = _list("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def _after_a(with_a: str, others: str) -> Callable[[str, int], str | None]:
    """Takes off an ending of `others`, or of `with_a` where а or я stands before it in the region; None if there is none."""
    ends, need = _list(with_a + " " + others), frozenset(with_a.split())

    def take(w: str, rv: int) -> str | None:
        e = ends(w, rv)
        if not e:
            return None
        rest = _cut(w, e)
        return None if e in need and not (len(rest) > rv and rest[-1] in "ая") else rest

    return take


_ru_gerund, _ru_participle, _ru_verb = _after_a(_RU_GERUND_A, _RU_GERUND), _after_a(_RU_PARTICIPLE_A, _RU_PARTICIPLE), _after_a(_RU_VERB_A, _RU_VERB)


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), len(w))
    r2 = _regions(w, _RU_VOWELS)[1]
    gerund = _ru_gerund(w, rv)
    if gerund is not None:
        w = gerund
    else:
        w = _also(w, rv, "ся", "сь")
        if e := _RU_ADJECTIVE(w, rv):
            w = _cut(w, e)
            w = next((x for x in (_ru_participle(w, rv),) if x is not None), w)
        elif (verb := _ru_verb(w, rv)) is not None:
            w = verb
        elif e := _RU_NOUN(w, rv):
            w = _cut(w, e)
    w = _also(w, rv, "и")
    w = _also(w, max(rv, r2), "ость", "ост")
    if w.endswith("ь") and len(w) > rv:
        return w[:-1]
    w = _also(w, rv, "ейше", "ейш")
    return w[:-1] if w.endswith("нн") and len(w) - 2 >= rv else w


# --- Spanish -----------------------------------------------------------------

_ES_VOWELS = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_PRONOUN = _list("me se sela selo selas selos la le lo las les los nos")
_ES_DELETE = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
_ES_IC = "adora ador ación adoras adores aciones ante antes ancia ancias"
_ES_REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
_ES_1 = _list(_ES_DELETE + " " + _ES_IC + " amente mente idad idades iva ivo ivas ivos " + " ".join(_ES_REPLACED))
_ES_2A = _list("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_GU = {"en", "es", "éis", "emos"}
_ES_2B = _list(
    "en es éis emos arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré "
    "aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
)
_ES_3 = _list("os a o á í ó e é")


def _adverb(w: str, r2: int, others: tuple[str, ...]) -> str:
    """What goes with an adverb's ending: iv and at before it, or one of `others`."""
    cut = _also(w, r2, "iv")
    if cut != w:
        return _also(cut, r2, "at")
    return _also(w, r2, *others)


def spanish(word: str) -> str:
    w = word
    rv = _rv(w, _ES_VOWELS)
    r1, r2 = _regions(w, _ES_VOWELS)
    if e := _ES_PRONOUN(w, rv):
        rest = _cut(w, e)
        stem = next((x for x in ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo") if rest.endswith(x)), "")
        if stem and len(rest) - len(stem) >= rv and (stem != "yendo" or rest[: -len(stem)].endswith("u")):
            w = _cut(rest, stem, stem.translate(_ES_PLAIN))
    start = w
    e = _ES_1(w)
    at = len(w) - len(e)
    if e == "amente":
        w = _adverb(_cut(w, e), r2, ("os", "ic", "ad")) if at >= r1 else w
    elif e and at >= r2:
        if e in _ES_REPLACED:
            w = _cut(w, e, _ES_REPLACED[e])
        else:
            w = _cut(w, e)
            if e in _ES_IC.split():
                w = _also(w, r2, "ic")
            elif e == "mente":
                w = _also(w, r2, "ante", "able", "ible")
            elif e.startswith("idad"):
                w = _also(w, r2, "abil", "ic", "iv")
            elif e.startswith("iv"):
                w = _also(w, r2, "at")
    if w == start:
        e = _ES_2A(w, rv)
        if e and _cut(w, e).endswith("u"):
            w = _cut(w, e)
        elif e := _ES_2B(w, rv):
            w = _cut(w, e)
            if e in _ES_GU and w.endswith("gu"):
                w = w[:-1]
    if e := _ES_3(w, rv):
        w = _cut(w, e)
        if e in "eé" and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_PLAIN)


# --- French ------------------------------------------------------------------

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
_FR_IC = "atrice ateur ation atrices ateurs ations"
_FR_REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
_FR_1 = _list(_FR_DELETE + " " + _FR_IC + " " + " ".join(_FR_REPLACED) + " ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments")
_FR_2A = _list(
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
)
_FR_2B_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
_FR_2B_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
_FR_2B = _list("ions " + _FR_2B_E + " " + _FR_2B_A)
_FR_4 = _list("ion ier ière Ier Ière e ë")


def _fr_suffix(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the first step, and whether the verb steps follow even so."""
    e = _FR_1(w)
    if not e:
        return w, False
    at, rest = len(w) - len(e), _cut(w, e)

    def ic(x: str) -> str:
        return x if not x.endswith("ic") else _cut(x, "ic") if len(x) - 2 >= r2 else _cut(x, "ic", "iqU")

    if e in ("amment", "emment"):
        return (rest + ("ant" if e[0] == "a" else "ent"), True) if at >= rv else (w, False)
    if e in ("ment", "ments"):
        return (rest, True) if at - 1 >= rv and rest[-1] in _FR_VOWELS else (w, False)
    if e in ("issement", "issements"):
        return (rest, False) if at >= r1 and rest[-1:] not in _FR_VOWELS else (w, False)
    if e in ("ement", "ements"):
        if at < rv:
            return w, False
        if rest.endswith("iv"):
            cut = _also(rest, r2, "iv")
            return (_also(cut, r2, "at") if cut != rest else rest), False
        if rest.endswith("eus"):
            return (_cut(rest, "eus") if len(rest) - 3 >= r2 else _cut(rest, "eus", "eux") if len(rest) - 3 >= r1 else rest), False
        if rest.endswith(("abl", "iqU")):
            return _also(rest, r2, "abl", "iqU"), False
        if rest.endswith(("ièr", "Ièr")) and len(rest) - 3 >= rv:
            return _cut(rest, "ièr", "i"), False
        return rest, False
    if e == "eaux":
        return rest + "eau", False
    if e == "aux":
        return (rest + "al" if at >= r1 else w), False
    if e in ("euse", "euses"):
        return (rest if at >= r2 else rest + "eux" if at >= r1 else w), False
    if at < r2:
        return w, False
    if e in _FR_REPLACED:
        return rest + _FR_REPLACED[e], False
    if e in _FR_IC.split():
        return ic(rest), False
    if e in ("ité", "ités"):
        if rest.endswith("abil"):
            return (_cut(rest, "abil") if len(rest) - 4 >= r2 else _cut(rest, "abil", "abl")), False
        return (ic(rest) if rest.endswith("ic") else _also(rest, r2, "iv")), False
    if e in ("if", "ive", "ifs", "ives"):
        cut = _also(rest, r2, "at")
        return (ic(cut) if cut != rest else rest), False
    return rest, False


def french(word: str) -> str:
    w = list(word)
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", word[i + 1] if i + 1 < len(w) else ""
        v = lambda x: bool(x) and x in _FR_VOWELS
        if c == "u" and (before == "q" or v(before) and v(after)) or c == "i" and v(before) and v(after) or c == "y" and (v(before) or v(after)):
            w[i] = c.upper()
    w = "".join(w)
    if w[:2] and len(w) > 1 and w[0] in _FR_VOWELS and w[1] in _FR_VOWELS or w.startswith(("par", "col", "tap")):
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR_VOWELS), len(w))
    r1, r2 = _regions(w, _FR_VOWELS)
    before = w
    w, more = _fr_suffix(w, rv, r1, r2)
    stripped = w != before and not more
    if not stripped:
        done = w
        e = _FR_2A(w, rv)
        if e and len(w) - len(e) - 1 >= rv and w[-len(e) - 1] not in _FR_VOWELS:
            w = _cut(w, e)
        elif e := _FR_2B(w, rv):
            if e == "ions":
                w = _cut(w, e) if len(w) - 4 >= r2 else w
            else:
                w = _cut(w, e)
                if e in _FR_2B_A.split() and w.endswith("e") and len(w) - 1 >= rv:
                    w = w[:-1]
        stripped = w != done
    if stripped:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        e = _FR_4(w, rv)
        if e == "ion":
            w = _cut(w, e) if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st" else w
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = _cut(w, e, "i")
        elif e == "e":
            w = w[:-1]
        elif e == "ë" and w.endswith("guë"):
            w = w[:-1]
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i and w[i - 1] not in _FR_VOWELS:
        i -= 1
    if i and i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.lower()


# --- Italian -----------------------------------------------------------------

_IT_VOWELS = "aeiouàèìòù"
_IT_GRAVE = str.maketrans("áéíóú", "àèìòù")
_IT_PRONOUN = _list("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_DELETE = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
_IT_IC = "azione azioni atore atori"
_IT_REPLACED = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
_IT_1 = _list(_IT_DELETE + " " + _IT_IC + " " + " ".join(_IT_REPLACED) + " amento amenti imento imenti amente ità ivo ivi iva ive")
_IT_2 = _list(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero "
    "ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano "
    "ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    w = word.translate(_IT_GRAVE).replace("qu", "qU")
    w = _between_vowels(w, "ui", _IT_VOWELS)
    rv = _rv(w, _IT_VOWELS)
    r1, r2 = _regions(w, _IT_VOWELS)
    if e := _IT_PRONOUN(w, rv):
        rest = _cut(w, e)
        if rest.endswith(("ando", "endo")) and len(rest) - 4 >= rv:
            w = rest
        elif rest.endswith(("ar", "er", "ir")) and len(rest) - 2 >= rv:
            w = rest + "e"
    start = w
    e = _IT_1(w)
    at = len(w) - len(e)
    if e == "amente":
        w = _adverb(_cut(w, e), r2, ("os", "ic", "abil")) if at >= r1 else w
    elif e in ("amento", "amenti", "imento", "imenti"):
        w = _cut(w, e) if at >= rv else w
    elif e and at >= r2:
        if e in _IT_REPLACED:
            w = _cut(w, e, _IT_REPLACED[e])
        else:
            w = _cut(w, e)
            if e in _IT_IC.split():
                w = _also(w, r2, "ic")
            elif e == "ità":
                w = _also(w, r2, "abil", "ic", "iv")
            elif e in ("ivo", "ivi", "iva", "ive"):
                cut = _also(w, r2, "at")
                w = _also(cut, r2, "ic") if cut != w else w
    if w == start and (e := _IT_2(w, rv)):
        w = _cut(w, e)
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) > rv:
        w = w[:-1]
        w = _also(w, rv, "i")
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.replace("I", "i").replace("U", "u")


# --- Portuguese --------------------------------------------------------------

_PT_VOWELS = "aeiouáéíóúâêô"
_PT_DELETE = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
_PT_REPLACED = {"logia": "log", "logias": "log", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
_PT_1 = _list(_PT_DELETE + " " + " ".join(_PT_REPLACED) + " amente mente idade idades iva ivo ivas ivos ira iras")
_PT_2 = _list(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o "
    "era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis "
    "éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu "
    "iu ou ira iras"
)


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv = _rv(w, _PT_VOWELS)
    r1, r2 = _regions(w, _PT_VOWELS)
    start = w
    e = _PT_1(w)
    at = len(w) - len(e)
    if e == "amente":
        w = _adverb(_cut(w, e), r2, ("os", "ic", "ad")) if at >= r1 else w
    elif e in ("ira", "iras"):
        w = _cut(w, e, "ir") if at >= rv and _cut(w, e).endswith("e") else w
    elif e and at >= r2:
        if e in _PT_REPLACED:
            w = _cut(w, e, _PT_REPLACED[e])
        else:
            w = _cut(w, e)
            if e == "mente":
                w = _also(w, r2, "ante", "avel", "ível")
            elif e.startswith("idade"):
                w = _also(w, r2, "abil", "ic", "iv")
            elif e in ("iva", "ivo", "ivas", "ivos"):
                w = _also(w, r2, "at")
    if w == start and (e := _PT_2(w, rv)):
        w = _cut(w, e)
    if w != start:
        if w.endswith("ci") and len(w) > rv:
            w = w[:-1]
    else:
        w = _also(w, rv, "os", "a", "i", "o", "á", "í", "ó")
    if w[-1:] and w[-1] in "eéê" and len(w) > rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) > rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# --- Turkish -----------------------------------------------------------------

#: The commonest endings; the longest that leaves three letters is taken off.  No published algorithm.
_TR_ENDINGS = _list(
    "larından lerinden larının lerinin ları leri ların lerin lardan lerden lar ler ından inden ının inin dan den tan ten da de ta te ın in un ün ı i u ü"
)


def turkish(word: str) -> str:
    e = _TR_ENDINGS(word, 3)
    return _cut(word, e) if e else word


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "ru": russian, "es": spanish, "fr": french, "it": italian, "pt": portuguese, "tr": turkish}


def stem(word: str, lang: str | None) -> str:
    """The stem of a lower-case word; unchanged in other languages."""
    f = STEMMERS.get(lang or "")
    return f(word) if f and word else word


@F.pandas_udf(ArrayType(StringType()))
def _stemmed(words: pd.Series, lang: pd.Series) -> pd.Series:
    known: dict[tuple, str] = {}

    def one(w: str, x: str | None) -> str:
        if (w, x) not in known:
            known[w, x] = stem(w, x)
        return known[w, x]

    return pd.Series([None if ws is None else [one(w, x) for w in ws] for ws, x in zip(words, lang)])


def stemmed(words: Column, lang: Column) -> Column:
    return _stemmed(words, lang)
