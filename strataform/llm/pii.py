"""Problem 8, personal information inside free text.

Regular expressions propose spans, validators confirm or doubt them, words nearby move the score, and what reaches the threshold is
reported with its text exactly as it stands, or replaced by a typed placeholder. Scores: what a pattern alone says, what a label or a
cue word before or behind adds, what a checksum adds, what a contrary word takes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.operators.skew import is_within, spread

THRESHOLD = 0.6
#: Bytes of name parts that travel to every task; a larger lexicon meets the words of each text in a join.
LEXICON_BYTES = 8 << 20


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


# Folding: patterns see composed letters, plain blanks and no format characters; spans are carried back to the text itself.

_KIND = {c: k for c in map(chr, range(0x80, 0x110000)) if (k := unicodedata.category(c)) in ("Cf", "Mn", "Zs")}
_ODD = frozenset(_KIND)


def fold(text: str) -> tuple[str, list[int] | None]:
    """The folded text and, unless it is the text itself, the offset in the text of every folded character and of the end."""
    if text.isascii() or _ODD.isdisjoint(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(text):
        kind = _KIND.get(ch)
        if kind == "Cf":
            continue
        if kind == "Mn" and out and len(one := unicodedata.normalize("NFC", out[-1] + ch)) == 1:
            out[-1] = one
            continue
        out.append(" " if kind == "Zs" else ch)
        at.append(i)
    return "".join(out), [*at, len(text)]


# Validators: True or False where the kind has a check digit or an impossible range, None where it has not.


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97_key(digits: str) -> bool:
    """French numbers: the last two digits are 97 less the rest modulo 97."""
    return int(digits[-2:]) == 97 - int(digits[:-2]) % 97


def cpf(digits: str) -> bool:
    """Brazilian tax numbers: two check digits modulo 11."""
    for n in (9, 10):
        r = sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10
        if r != int(digits[n]):
            return False
    return True


def mod11_10(digits: str) -> bool:
    """German tax numbers (ISO 7064 MOD 11,10)."""
    p = 10
    for d in digits[:-1]:
        s = (int(d) + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == int(digits[-1])


def dni_letter(code: str) -> bool:
    """Spanish numbers: the letter is the number modulo 23."""
    number = code[:-1].translate(str.maketrans("XYZ", "012"))
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == code[-1]


def ssn_range(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


#: What judges a number: by the words of its label, and for a number without one by its form.
_BY_LABEL = [
    (re.compile(r"ssn|social security"), re.compile(r"\d{9}"), ssn_range),
    (re.compile(r"nir|sécurité sociale"), re.compile(r"[12]\d{14}"), mod97_key),
    (re.compile(r"steuer"), re.compile(r"\d{11}"), mod11_10),
    (re.compile(r"dni|nie|nif"), re.compile(r"(?:\d{8}|[XYZ]\d{7})[A-Z]"), dni_letter),
    (re.compile(r"cpf"), re.compile(r"\d{11}"), cpf),
    (re.compile(r"social insurance|personnummer"), re.compile(r"\d{9,10}"), luhn),
]
_BY_FORM = [
    (re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}"), ssn_range),
    (re.compile(r"[12](?: ?\d){14}"), mod97_key),
    (re.compile(r"\d{3}\.\d{3}\.\d{3}-\d{2}"), cpf),
    (re.compile(r"(?:\d{8}|[XYZ]\d{7})-?[A-Z]"), dni_letter),
]


def verdict(value: str, label: str = "") -> bool | None:
    """What the checksum (or, where there is none, the range) of a person's number says; None where its kind has neither."""
    code = re.sub(r"[^0-9A-Z]", "", value.upper())
    if len(set(code)) == 1:
        return False
    label = label.lower()
    for words, form, check in _BY_LABEL:
        if words.search(label):
            return check(code) if form.fullmatch(code) else None
    if not label:
        for form, check in _BY_FORM:
            if form.fullmatch(value):
                return check(code)
    return None


# E-mail

_LOCAL = r"(?<![\w@/+%-])(?<!\w\.)[\w](?:[\w+%-]|\.(?=[\w+%-]))*+"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
EMAIL = regex.compile(
    rf"(?i){_LOCAL}(?:"
    rf"[@＠﹫]{_LABEL}(?:\.{_LABEL})*+(?<=\.\p{{L}}{{2,24}})(?![\w@]|:[\w/~])"
    rf"|\ ?[\[({{<]\ ?(?:at|[@＠﹫])\ ?[\])}}>]\ ?{_LABEL}(?:(?:\ ?[\[({{<]\ ?dot\ ?[\])}}>]\ ?|\.){_LABEL})+(?<=\p{{L}}{{2,24}})"
    rf"|\ at\ {_LABEL}(?:\ dot\ {_LABEL})+(?<=\p{{L}}{{2,24}})"
    rf"|\ ?[@＠﹫]\ {_LABEL}(?:\.{_LABEL})+(?<=\.\p{{L}}{{2,24}})"
    rf"|&\#64;{_LABEL}(?:\.{_LABEL})+(?<=\.\p{{L}}{{2,24}})"
    rf")"
)
_REMOTE = regex.compile(r"(?:git clone |git remote add \S+ |\w+://)$")


#: What stands between the local part and the host; only around it an address is looked for.
_AT = regex.compile(r"(?i)[@＠﹫]|&\#64;|(?<=[\[({<]\ ?)at(?=\ ?[\])}>])|(?<=\ )at(?=\ [\p{L}\p{N}][\p{L}\p{N}-]*\ dot\ )")
_BEFORE_AT = regex.compile(r"(?r)[\w.+%-]+\ ?[\[({<]?\ ?")


def emails(t: str) -> Iterator[Span]:
    last = 0
    for at in _AT.finditer(t):
        run = _BEFORE_AT.match(t, last, at.start())
        if not run:
            continue
        for start in range(run.start(), at.start()):
            if m := EMAIL.match(t, start):
                before = t[max(0, m.start() - 24) : m.start()]
                yield Span(m.start(), m.end(), "email", 0.8 - 0.6 * bool(_REMOTE.search(before)))
                last = m.end()
                break


# Street addresses

_W = r"\p{L}[\p{L}\-]*(?:['’]\p{L}+)*"
_CAP = r"\p{Lu}[\p{L}\-]*(?:['’]\p{L}+)*\.?"
_CITY = r"\p{Lu}\p{Ll}+(?:['’-]\p{Lu}?\p{Ll}+)*"
_TYPE_EN = "Street|St|Lane|Ln|Court|Ct|Loop|Mews|Boulevard|Blvd|Road|Rd|Avenue|Ave|Row|Drive|Dr|Way|Place|Pl|Square|Sq|Terrace|Close|Crescent|Parkway|Pkwy|Highway|Hwy|Circle|Trail|Alley|Walk|Grove|Hill|Green|Quay|Wharf|Yard"
_POST_EN = r"(?:,?\ [A-Z]{2}\ \d{5}(?:-\d{4})?|,?\ [A-Z]{1,2}\d[\dA-Z]?\ \d[A-Z]{2})\b"
_TYPE_FR = "rue|avenue|allée|impasse|boulevard|place|chemin|quai|cours|square|route|passage|sentier|ruelle|esplanade|faubourg|villa|cité|montée"
_TYPE_ES = r"Calle|C/|Avda\.|Av\.|Avenida|Plaza|Pza\.|Pl\.|Camino|Paseo|P\.º|Ronda|Travesía|Carretera|Glorieta|Cuesta|Callejón|Rua|Travessa|Largo|Praça|Estrada|Alameda"
ADDRESS = [
    regex.compile(
        rf"(?<![\w.#/-])\d{{1,5}}[A-Za-z]?\ (?:{_CAP}\ ){{1,4}}?(?:{_TYPE_EN})\b\.?(?:\ \#\w+|,?\ (?:Apt|Suite|Ste|Unit|Flat|Floor|Room)\.?\ [\w-]+)?,\ {_CITY}(?:\ {_CITY})?(?:{_POST_EN})?"
    ),
    regex.compile(rf"(?<![\w-])(?:{_CAP}\ ){{1,4}}?\d{{1,4}}\ ?[a-z]?(?:,|\ in)\ (?:D-)?\d{{5}}\ (?:(?:Bad|Sankt|St\.|Markt|Neu|Alt)\ )?{_CITY}(?:\ (?:am|an\ der|im|ob\ der)\ {_CITY})?"),
    regex.compile(rf"(?<![\w-])\d{{1,4}}(?:\ ?(?:bis|ter|quater)\b)?,?\ (?i:{_TYPE_FR})(?:\ {_W}){{1,6}}?,?\ (?:F-)?\d{{5}}\ {_CITY}(?:\ (?:sur|en|lès|le|la|les)\ {_CITY})?"),
    regex.compile(
        rf"(?<![\w-])(?:{_TYPE_ES})(?:\ {_W}\.?){{1,5}}?,?\ (?:n\.?º\ ?)?\d{{1,4}}(?:,\ (?:\d{{1,2}}\.?[ºª]?(?:\ ?\p{{L}}{{1,4}})?|bajo|ático|entresuelo|piso\ \d+))*,\ \d{{4,5}}(?:-\d{{3}})?\ {_CITY}(?:\ (?:de|del|de\ la)\ {_CITY})?"
    ),
]
_ADDRESS_CUE = regex.compile(r"(?i)(?:lives at|signed from|device to|addr(?:ess)?\W{1,4}|wohnt|post geht an|est chez|port[áa]til a|anschrift|adresse|direcci[oó]n|domicilio|endereço|from|to|at|an|chez|a)\s*$")


#: What every address of the pattern holds, quick to look for.
_IN_ADDRESS = [re.compile(r"\d[A-Za-z]? [A-Z]"), re.compile(r"\d ?[a-z]?(?:,| in) (?:D-)?\d{5} "), re.compile(r" (?:F-)?\d{5} "), re.compile(r", \d{4,5}(?:-\d{3})? ")]


def addresses(t: str) -> Iterator[Span]:
    for hint, p in zip(_IN_ADDRESS, ADDRESS, strict=True):
        if not hint.search(t):
            continue
        for m in p.finditer(t):
            cue = bool(_ADDRESS_CUE.search(t[max(0, m.start() - 24) : m.start()]))
            yield Span(m.start(), m.end(), "address", 0.65 + 0.2 * cue)


# Numbers of a person's document

_LABELS = (
    r"SSN|social\ security(?:\ (?:no|number|\#))?|NINO|NI\ (?:number|no)|national\ insurance(?:\ (?:no|number))?|national\ id|identity\ (?:card|no|number)|passport(?:\ (?:no|number))?"
    r"|driv(?:er|ing)(?:'?s)?\ licen[cs]e(?:\ (?:no|number))?|tax\ id|NIR|n°\ de\ sécurité\ sociale|numéro\ de\ sécurité\ sociale|sécurité\ sociale|passeport|carte\ d['’]identité|CNI"
    r"|Steuer-?\ ?Id(?:Nr|-Nr|entifikationsnummer)?|Ausweis(?:-?Nr|nummer)?|Personalausweis(?:-?Nr|nummer)?|Reisepass(?:-?Nr)?|Sozialversicherungsnummer|DNI|NIE|NIF|pasaporte|CPF|RG|CURP|passaporte|social\ insurance(?:\ (?:no|number))?|personnummer|паспорт|ИНН|СНИЛС|身份证号?|マイナンバー|護照|旅券番号"
)
_BODY = (
    r"\d\ \d{2}\ \d{2}\ \d{2}\ \d{3}\ \d{3}\ \d{2}|[12]\d{14}|\d{2}\ \d{3}\ \d{3}\ \d{3}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}|\d{3}[-\ ]\d{2}[-\ ]\d{4}|[A-Z]\d{3}-\d{4}-\d{4}"
    r"|[A-Z]{2}\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-Z]|\d{1,2}\.\d{3}\.\d{3}\ ?-?\ ?[A-Z]|\d{8}\ ?-?\ ?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{3}[A-Z]\d{4}\d?|[A-Z]{1,3}\d{6,9}[A-Z]?|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}|\d{9}|\d{10}"
)
_ID_SEP = r"\.?\s*(?:n\.?\s?[º°]|no\.?|Nr\.?)?\s*[:=#：]?\s*[#'\"]?\s*"
LABELLED_ID = regex.compile(rf"(?P<label>(?i:(?<!\w)(?:{_LABELS}))){_ID_SEP}(?P<v>{_BODY})(?![\w])(?!-\w)")
FIELD_ID = regex.compile(rf"(?i:holder\W{{1,4}})[^\n]{{2,60}}?\bid\W{{1,3}}(?P<v>{_BODY})(?![\w])(?!-\w)")
BARE_ID = re.compile(rf"(?<![\w.+#/@-])(?<![+(]\d)(?P<v>\d{{3}}-\d{{2}}-\d{{4}}|[A-CEGHJ-PR-TW-Z]{{2}}\ ?\d{{2}}\ ?\d{{2}}\ ?\d{{2}}\ ?[A-D]|[12]\ \d{{2}}\ \d{{2}}\ \d{{2}}\ \d{{3}}\ \d{{3}}\ \d{{2}}|[12]\d{{14}}|\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}})(?![\w])(?!-\w)")
_NO_ID = regex.compile(r"(?i)\b(?:took|ticket|version|seed|run|build|port|commit|checksum|uuid|slot|issue|ticks)\W*$")
_NO_ID_AFTER = regex.compile(r"(?i)^\W*(?:ticks|ms|bytes|lines|files)\b")
_ID_CUE = regex.compile(r"(?i)\b(?:holder|identity|citizen|person|employee|born|document)\b")


#: How each kind of label begins; a label's pattern is tried there only.
_LABEL_HEADS = (
    "ssn|social|nino|ni |national|identity|passport|driver|driving|tax|nir|n°|numéro|sécurité|passeport|carte|cni|steuer|ausweis|personalausweis|reisepass|sozialversicherungsnummer|dni|nie|nif|pasaporte|cpf|rg|curp"
    "|passaporte|personnummer|паспорт|инн|снилс|身份证|マイナンバー|護照|旅券番号"
).split("|")


@lru_cache(maxsize=1)
def _heads():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for head in _LABEL_HEADS:
        automaton.add_word(head, len(head))
    automaton.make_automaton()
    return automaton


def _labelled(t: str) -> Iterator:
    """Labels with their numbers, from left to right, not overlapping."""
    low = t.lower()
    if len(low) != len(t):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    last = 0
    for start in sorted({end - n + 1 for end, n in _heads().iter(low)}):
        if start >= last and (m := LABELLED_ID.match(t, start)):
            yield m
            last = m.end()


#: A label says that a number is meant whatever its check digit, since invented numbers are made to fail theirs. ``strict`` lets the
#: check decide there too. Without a label a checksum confirms and rejects; a range only rejects.
LABELLED, IN_FIELD, BARE = 0.8, 0.7, 0.3


def national_ids(t: str, strict: bool = False) -> Iterator[Span]:
    if not _DIGITS.search(t):
        return
    for pattern, base in ((LABELLED_ID, LABELLED), (FIELD_ID, IN_FIELD), (BARE_ID, BARE)):
        for m in _labelled(t) if pattern is LABELLED_ID else pattern.finditer(t):
            a, b = m.span("v")
            label = m["label"] if pattern is LABELLED_ID else ""
            good = verdict(m["v"], label)
            blank = len(set(re.sub(r"\W", "", m["v"]))) == 1
            if base == BARE:
                ranged = _SSN_FORM.fullmatch(m["v"])
                score = base + {True: 0.2 if ranged else 0.4, False: -0.3, None: 0.0}[good]
            else:
                score = base + {True: 0.1, False: -0.8 if strict or blank else -0.1, None: 0.0}[good]
            score += 0.2 * bool(_ID_CUE.search(t[max(0, a - 40) : a]))
            score -= 0.6 * bool(_NO_ID.search(t[max(0, a - 12) : a]) or _NO_ID_AFTER.search(t[b : b + 10]))
            yield Span(a, b, "national_id", score)


_DIGITS = re.compile(r"\d")
_SSN_FORM = re.compile(r"\d{3}-\d{2}-\d{4}")


# Phones

PHONE = regex.compile(r"(?<![\w#/@:])(?<![.\-]\d*)(?<!\d[.,])(?:\+|\((?=\+?\d))?\d(?:[\d]|[ .\-/](?=[\d(])|[()]\ ?(?=[\d(])|\)\ ?(?=\d))*(?<=\d)(?![\w])(?![:\-/.]\d|%)")
_PHONE_FORM = regex.compile(
    r"\+\d{1,3}(?:[\ .\-]?\(?\d{1,5}\)?){1,7}|\(\d{2,5}\)\ ?\d{2,5}(?:[\ .\-]\d{2,5}){0,3}|\d{3}[\-.]\d{3}[\-.]\d{4}|\d{3}-\d{4}|0\d{1,4}(?:[\ .\-/]\d{2,8}){1,4}|00\d{1,3}(?:[\ .\-]\d{1,8}){1,5}|0\d(?:[\ .]\d{2}){4}|[6-9]\d{2}(?:\ \d{2}){3}|[0-9]{3}(?:\ \d{3}){2}|\d{3}(?:\ \d{2}){3}|\d{3}/\d{4,6}-\d{2,4}"
)
_PHONE_CUE = regex.compile(
    r"(?i)(?:tel|phone|mobile|cell|fax|call|page|ring|dial|whatsapp|telefon|rückfragen|unter|questions à|au|teléfono|móvil|dudas|telefone|тел|電話|电话|came from|\bon)\b[^\n\d+(]{0,40}$|<td>$|\|\ ?$"
)
_NO_PHONE = regex.compile(r"(?i)\b(?:took|ticket|tickets|version|seed|run|build|port|commit|checksum|uuid|slot|issue|order|invoice|rev|ticks|sha\w*|id)\W{0,2}$")


def phones(t: str) -> Iterator[Span]:
    for m in PHONE.finditer(t):
        if len(m[0]) < 7 or not 7 <= sum(c.isdecimal() for c in m[0]) <= 15:
            continue
        before = t[max(0, m.start() - 60) : m.start()]
        form = bool(_PHONE_FORM.fullmatch(m[0]))
        score = 0.3 + 0.35 * form + 0.35 * bool(_PHONE_CUE.search(before))
        # The form of a social security number is no phone's.
        score -= 0.7 * bool(_NO_PHONE.search(before) or _SSN_FORM.fullmatch(m[0]))
        score -= 0.4 * bool(regex.fullmatch(r"(?:19|20)\d{2}-\d{2}-\d{2}|\d+", m[0]) and not _PHONE_CUE.search(before))
        yield Span(m.start(), m.end(), "phone", score)


# Persons

TOKEN = regex.compile(r"(?<![\p{L}\p{N}_@/.\-])(?:\p{Lu}\.|\p{Lu}\p{L}+(?:['’-]\p{L}+)*)(?![\p{L}\p{N}_@/\\]|[.\-]\p{L})")
_TITLES = "frau herr mr mrs ms miss dr prof mme mlle señor señora sr sra dona dom sir madam fräulein"
_NOT_NAMES = frozenset(
    (
        _TITLES + " call page rule deliver questions thanks merci gracias ask dudas reviewed signed co developed info warn debug error trace fatal the pilot user im en le la"
        " rückfragen ship post leaked name contact holder maintainer cc by for from to at on of and is we she he it in this that note see when since before after while during"
        " ssn nino passport driver api app main module region node next react django laravel flutter java go rust python nestjs"
    ).split()
)
#: Words before a name that are enough for one no list has.
_STRONG_CUE = regex.compile(
    r"(?i)(?:\bthanks|\bcc|\bask(?:ed)?|\bcall|[\w-]+-by:|deliver to:|\bname:|\bgo to|\bmerci à|\bgracias a|\bbitte an|questions à|\bdudas:|holder\W{1,4}|maintainer\W{1,5}|\bwritten by|//|\buser,|\bfrau|\bherr|\bmr\.?|\bmrs\.?|\bms\.?|\bdr\.?)\s?$"
)
#: Words that help, or are enough behind a number just told.
_WEAK_CUE = regex.compile(r"(?i)(?:(?P<number>\d[\d\W]*[A-Z]?)?\ (?:von|de|for)|<td>|\|\ ?|@[\w-]+:)\s?$")
_STRONG_AFTER = regex.compile(r"(?i)^\ (?:wohnt|lives at|is out, use)\b")
_PERSON_AFTER = regex.compile(r"(?i)^(?:\s?[(<][\w.+-]+(?:[@＠]|\W{1,3}at)|\ (?:twice|unter|au|and whoever)|,?\ (?:tel|mobile|signed)|</td>|\ \|)")
_CODE_NAME = regex.compile(r"(?i)^[^\n]{0,12}\bcode ?name\b")


def persons(t: str, given: frozenset[str], family: frozenset[str]) -> Iterator[Span]:
    tokens = [(*m.span(), m[0]) for m in TOKEN.finditer(t)]

    @lru_cache(maxsize=None)
    def kind(i: int) -> tuple[bool, bool, bool, bool]:
        """Of a token: initial, given name, family name, may be a name."""
        w = tokens[i][2]
        low = w.lower()
        initial = w[-1] == "."
        usable = not initial and low not in _NOT_NAMES and len(w) > 2 and (w.isupper() or not _CAMEL.search(w))
        return initial, low in given, low in family, usable

    for i, (a, _, _) in enumerate(tokens):
        for last, comma in _shapes(t, tokens, kind, i):
            first, end = kind(i), kind(last)
            # Which token is the given and which the family name.
            g, f = (end, first) if comma else (first, end)
            if f[0] or not f[3] or not (g[0] or g[3]):
                continue
            score = 0.1 + 0.4 * f[2] + 0.4 * g[1] + 0.2 * (g[0] and f[2])
            # A first name before a middle initial belongs to the name, however well the rest scores alone.
            score += 0.25 * (last == i + 2)
            # Parts of the wrong kind, as in two family names, speak against.
            score -= 0.2 * (f[1] and not f[2]) + 0.2 * (g[2] and not g[1])
            b = tokens[last][1]
            before = t[max(0, a - 32) : a]
            weak = _WEAK_CUE.search(before)
            strong = bool(_STRONG_CUE.search(before) or _STRONG_AFTER.search(t[b : b + 16]) or (weak and weak["number"]))
            score += 0.5 * strong + 0.25 * (bool(weak) and not strong) + 0.25 * bool(_PERSON_AFTER.search(t[b : b + 40]))
            score += 0.1 * bool((f[2] or g[1]) and not comma)
            score -= 0.6 * bool(_CODE_NAME.search(t[b : b + 30]))
            yield Span(a, b, "person", score)


_CAMEL = regex.compile(r"\p{Ll}\p{Lu}")


def _shapes(t, tokens, kind, i) -> Iterator[tuple[int, bool]]:
    """Ends of candidates that start at token i: given family, given X. family, X. family; family, given; family, X."""
    if i + 1 >= len(tokens):
        return
    end, start = tokens[i][1], tokens[i + 1][0]
    if start == end + 1 and t[end] == " ":
        if not kind(i + 1)[0]:
            yield i + 1, False
        elif not kind(i)[0] and i + 2 < len(tokens) and t[tokens[i + 1][1] : tokens[i + 2][0]] == " " and not kind(i + 2)[0]:
            yield i + 2, False
    elif start == end + 2 and t[end:start] == ", " and not kind(i)[0]:
        yield i + 1, True
        if i + 2 < len(tokens) and kind(i + 2)[0] and not kind(i + 1)[0] and t[tokens[i + 1][1] : tokens[i + 2][0]] == " ":
            yield i + 2, True


ORDER = {"address": 0, "email": 1, "national_id": 2, "phone": 3, "person": 4}


def find_spans(text: str, given: frozenset[str], family: frozenset[str], threshold: float = THRESHOLD, strict: bool = False) -> list[Span]:
    """Spans of the text, in order, that reach the threshold and don't overlap; of overlapping ones the kind first in ORDER, then the higher score, then the longer."""
    folded, at = fold(text)
    found: list[Span] = []
    taken: list[tuple[int, int]] = []
    proposals = [*addresses(folded), *emails(folded), *national_ids(folded, strict), *phones(folded), *persons(folded, given, family)]
    for s in sorted((s for s in proposals if s.score >= threshold - 1e-9), key=lambda s: (ORDER[s.kind], -round(s.score, 3), s.start - s.end, s.start)):
        if all(s.end <= a or b <= s.start for a, b in taken):
            taken.append((s.start, s.end))
            found.append(s)
    if at is not None:
        # Up to and with the last character, so marks that compose with it stay inside and format characters behind it out.
        found = [Span(at[s.start], _end(text, at, s.end), s.kind, s.score) for s in found]
    return sorted(found, key=lambda s: s.start)


def _end(text: str, at: list[int], end: int) -> int:
    stop = at[end]
    while stop > at[end - 1] + 1 and unicodedata.category(text[stop - 1]) == "Cf":
        stop -= 1
    return stop


def redact(text: str, spans: list[Span]) -> str:
    out, last = [], 0
    for s in spans:
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]])


def _of_kind(rows: Iterable, kind: str) -> frozenset[str]:
    return frozenset(unicodedata.normalize("NFC", n.strip()) for n, k in rows if k == kind and n.strip())


def parts_of(name_parts: DataFrame) -> DataFrame:
    """part, kind: the distinct name parts in lower case; nulls take no part."""
    return name_parts.select(F.lower("name_part").alias("part"), F.lower(F.trim("part_kind")).alias("kind")).dropna().distinct()


def _with_names(docs: DataFrame, name_parts: DataFrame, key: str, text: str, limit: int) -> tuple[DataFrame, tuple | None]:
    """The texts, and the lexicon as sets of given and family names if it is small.

    A lexicon beyond ``limit`` bytes stays a table: the distinct words of every text meet it in a join, and the texts come with a column
    ``__names`` of the name parts that occur in them, which is all that can matter to them.
    """
    parts = parts_of(name_parts)
    if is_within(parts, limit):
        rows = [tuple(r) for r in parts.collect()]
        return docs, (_of_kind(rows, "given"), _of_kind(rows, "family"))

    def words(batches: Iterable) -> Iterator:
        for pdf in batches:
            rows = [(k, w) for k, t in zip(pdf[key], pdf[text], strict=True) if isinstance(t, str) for w in {m[0].lower() for m in TOKEN.finditer(fold(t)[0])}]
            yield pd.DataFrame(rows, columns=[key, "part"])

    kind = docs.schema[key].dataType.simpleString()
    told = docs.where(F.col(text).isNotNull()).mapInPandas(words, f"{key} {kind}, part string").distinct()
    composed = parts.withColumn("part", _nfc("part"))
    found = told.join(composed, "part").groupBy(key).agg(F.collect_set(F.concat_ws("|", "kind", "part")).alias("__names"))
    return docs.join(found, key, "left"), None


@F.pandas_udf(T.StringType())
def _nfc(parts: pd.Series) -> pd.Series:
    return parts.map(lambda n: unicodedata.normalize("NFC", n.strip()), na_action="ignore")


def _lexicons(pdf, names: tuple | None) -> Iterator[tuple[frozenset[str], frozenset[str]]]:
    for told in [None] * len(pdf) if names else pdf["__names"]:
        if names:
            yield names
        else:
            rows = [x.split("|", 1)[::-1] for x in told] if told is not None else []
            yield _of_kind(rows, "given"), _of_kind(rows, "family")


def find_pii(docs: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text", strict: bool = False, limit: int = LEXICON_BYTES) -> DataFrame:
    """key, pii_type, found_value, score: every distinct value of each document. Null, empty and blank texts give no rows.

    One pass over whole texts in Arrow batches, without a shuffle while the lexicon is within ``limit`` bytes. ``strict``: a labelled
    number whose check fails is none.
    """
    texts, names = _with_names(docs.select(key, text).where(F.col(text).isNotNull()), name_parts, key, text, limit)

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            rows = []
            for k, t, (given, family) in zip(pdf[key], pdf[text], _lexicons(pdf, names), strict=True):
                best: dict[tuple[str, str], float] = {}
                for s in find_spans(t, given, family, strict=strict):
                    v = (s.kind, t[s.start : s.end])
                    best[v] = max(best.get(v, 0.0), s.score)
                rows += [(k, kind, value, round(score, 3)) for (kind, value), score in best.items()]
            yield pd.DataFrame(rows, columns=[key, "pii_type", "found_value", "score"])

    return spread(texts, key).mapInPandas(run, f"{key} bigint, pii_type string, found_value string, score double")


def redact_pii(docs: DataFrame, name_parts: DataFrame, key: str = "doc_id", text: str = "text", strict: bool = False, limit: int = LEXICON_BYTES) -> DataFrame:
    """key, text with placeholders, n_redacted: one row per document, null for a null text."""
    texts, names = _with_names(docs.select(key, text), name_parts, key, text, limit)

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            spans = [find_spans(t, *lex, strict=strict) if isinstance(t, str) else [] for t, lex in zip(pdf[text], _lexicons(pdf, names), strict=True)]
            texts = [redact(t, s) if isinstance(t, str) else None for t, s in zip(pdf[text], spans, strict=True)]
            yield pd.DataFrame({key: pdf[key], text: texts, "n_redacted": [len(s) for s in spans]})

    return spread(texts, key).mapInPandas(run, f"{key} bigint, {text} string, n_redacted int")
