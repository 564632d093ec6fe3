"""Labelled spans for training: formats and word lists that mark personal information in the project's documents.

Used only to fit the tagger of ``pii``; at run time the spans come from the tagger.
"""

from __future__ import annotations

import random
import re

# Given names and the parts of the invented surnames, as in the documents.
GIVEN = (
    "amparo anselm bastian benedek casper corvin dilara elske emeka florian greta hugo ilario isaura jorun kasimir larissa lenka "
    "marek maribel matteo mirela nila noemi odin oswin ottilie paloma petra quentin rafe ruben sanna solveig teodor thea tobin wanda ysolde zelda"
).split()
SURNAME_HEADS = "vael quell rav grim zab tav mor pell sunde dorn lisk ostra brun yarr fenn hesk".split()
SURNAME_TAILS = "urov bakken istre ander ellini rosky ingard elhoff amonte oyez quist wether".split()
# Number words by language, zero to nine.
NUMBER_WORDS = {
    "en": "zero one two three four five six seven eight nine".split(),
    "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}

_G = rf"(?:{'|'.join(GIVEN)})"
_S1 = rf"(?:{'|'.join(SURNAME_HEADS)})(?:{'|'.join(SURNAME_TAILS)})"
_S = rf"{_S1}(?:-{_S1})?"
_I = r"[a-z]\."
NAME = re.compile(rf"(?<![\w@.+-])(?:{_S}, {_G}(?: {_I})?|{_G}(?: {_I})? {_S}|{_I} {_S}|{_G}|{_S})(?![\w@])", re.I)

_W = "|".join(sorted({w for ws in NUMBER_WORDS.values() for w in ws}, key=len, reverse=True))
PHONE = re.compile(
    r"(?<![\w.])(?:"
    r"(?:(?:\(?\+1\)?|001)[ .-]?)?\(?\d{3}\)?[ .-]?555[ .-]?01\d\d"
    r"|(?:\+44 ?|0044 ?|\(\+44\) ?|0)(?:\(0\) ?)?7700[ -]?900[ -]?\d{3}"
    r"|(?:(?:\+44|0044|\(\+44\))[ -]?(?:\(0\))?|\(?0)20\)?[ -]?7946[ -]?0\d{3}"
    r"|(?:(?:\+49|0049|\(\+49\))[ -]?\(?0?\)?|\(?0)\(?30\)?[ /-]{0,3}23125[ -]?\d{2,4}"
    r"|(?:(?:\+33|0033|\(\+33\))[ .-]?(?:\(0\) ?)?|0)1[ .-]?99[ .-]?00[ .-]?\d\d[ .-]?\d\d"
    r"|(?:(?:\(?\+34\)?|0034)[ -]?)555[ -]?01[ -]?\d{1,2}[ -]?\d{1,2}"
    rf"|(?:(?:plus )?(?:{_W}) ){{6,13}}(?:{_W})"
    r")(?![\w@])",
    re.I,
)
_AT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at | arroba | arobase | ät )"
_DOT = r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot | punto | punkt | point )"
EMAIL = re.compile(rf"(?<![\w.+-])[a-z0-9][\w.+-]*{_AT}(?!\d+[pxk]\b)[a-z][a-z0-9-]*(?:{_DOT}(?!webp|png|jpg|jpeg|heic)[a-z]{{2,}}[a-z0-9-]*)+(?![\w@-])", re.I)
_IDCTX = r"(?:passport|insurance no|id card|, id|card, no\.|identity no\.|steuernummer|le numéro|el número|carné|documento|carte|ausweis|personalausweis|sociale|social security|steuer-id|dni)"
ID = re.compile(r"(?<![\w.-])(?:9\d\d([ -])\d\d\1\d{4}|QQ ?\d\d ?\d\d ?\d\d ?[A-D]|X[A-Z]\d{7}|9 99 13 99 \d{3} \d{3} \d\d|9991399\d{8}|\d{8}-?[A-Z])(?![\w-])", re.I)
ID_BY_CONTEXT = re.compile(rf"{_IDCTX} (\d{{4}}-\d{{4}}-\d{{3}})(?!\w)", re.I)
_EN = r"\d+[A-Z]?(?:-\d+)? (?:[A-Z][a-z]+ ){1,2}(?:Street|St\.|Road|Rd\.?|Lane|Way|Close|Avenue|Drive)(?:(?:,? (?:Apt|Flat) \d+)| #\d+)?(?:, (?:Harrowmere|Dunvale|Easting Cross|Port Ellisk)(?: (?:\d{5}|ZZ\d \d[A-Z]{2}))?)?"
_DE = r"(?:Am |Untere )?[A-ZÄÖÜ][a-zäöüß]+(?:straße|str\.|weg|gasse|allee) \d+[a-z]?(?:, \d{5} [A-ZÄÖÜ][a-zäöüß]+(?:-[A-Z][a-zäöüß]+)?)?"
# Streets and towns of the French and Spanish addresses, whose ends no punctuation marks.
_FR_STREETS = "de la Grevoise|du Pont Caillou|des Trois Merlettes|des Tilandes|du Vieux Lavoir Bleu"
_FR_TOWNS = "Villebrune-les-Prés|Caradoux|Saint-Orvel"
_ES_STREETS = "Molino Quieto|de la Garzeta|de los Tejares Altos|Fuente Parda|del Almendral Chico"
_ES_TOWNS = "Almedra|Portoluna|Villaserna del Río"
_FR = rf"\d+(?: bis)?,? (?:rue|avenue|chemin|boulevard|allée|impasse|place) (?:{_FR_STREETS})(?:, \d{{5}} (?:{_FR_TOWNS}))?"
_ES = rf"(?:Calle|C/|Avenida|Plaza|Paseo) (?:{_ES_STREETS})(?:,| nº)? \d+(?:, \d+º [A-Z])?(?:, \d{{5}} (?:{_ES_TOWNS}))?"
ADDRESS = re.compile(rf"(?<![\w.:,-])(?:{_EN}|{_DE}|{_FR}|{_ES})")
ADDRESS_LOWER = re.compile(ADDRESS.pattern.replace("A-ZÄÖÜ", "a-zäöü").replace("A-ZÁÉÍÓÚÑ", "a-záéíóúñ").replace("A-ZÉ", "a-zé").replace("[A-Z][a-z]+ ", "[a-z]+ "), re.I)

#: Shots in a street without a house number look like an English address: "33 shots on Tinderbox Street".
_NOT_ADDRESS = re.compile(r"\d+ (?:shots|Aufnahmen|planos|fois)\b", re.I)

_SAME = str.maketrans({"–": "-", "—": "-", "‑": "-", "‐": "-", "−": "-", " ": " ", " ": " ", " ": " ", "＠": "@", "．": ".", "＋": "+", "（": "(", "）": ")", "－": "-", "　": " ", **{chr(0xFF10 + i): str(i) for i in range(10)}})


def plain(text: str) -> str:
    """The text with wide digits and unusual dashes and spaces in their plain form, character by character."""
    return text.translate(_SAME)


def label(text: str) -> list[tuple[str, int, int]]:
    """Non-overlapping spans ``(type, start, end)``."""
    t = plain(text)
    lower = t == t.lower()
    found: list[tuple[int, str, int, int]] = []
    for rank, (kind, pattern) in enumerate((("email", EMAIL), ("phone", PHONE), ("id_number", ID), ("address", ADDRESS_LOWER if lower else ADDRESS), ("name", NAME))):
        for m in pattern.finditer(t):
            if kind == "phone" and m[0].count("(") != m[0].count(")"):
                found.append((rank, kind, m.start() + m[0].startswith("("), m.end() - m[0].endswith(")")))
                continue
            if kind == "address" and _NOT_ADDRESS.match(m[0]):
                continue
            found.append((rank, kind, m.start(), m.end()))
        if kind == "id_number":
            found += [(rank, kind, m.start(1), m.end(1)) for m in ID_BY_CONTEXT.finditer(t)]
    taken: list[tuple[str, int, int]] = []
    for _, kind, s, e in sorted(found):
        if all(e <= a or s >= b for _, a, b in taken):
            taken.append((kind, s, e))
    return sorted(taken, key=lambda x: x[1])


_HEADS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sh st t tr v w z".split()
_VOWELS = "a e i o u ae ei ia o e a".split()
_MIDS = "l ll m n nn r rr s st t d nd k v b z".split()
_TAILS = "a o e in an el us is ert olf ina ika ov ski sen mann ez er ard quist eau son".split()


def random_word(rng: random.Random) -> str:
    """An invented name-like word, so that the tagger learns the surroundings and not the list."""
    word = rng.choice(_HEADS) + rng.choice(_VOWELS) + "".join(rng.choice(_MIDS) + rng.choice(_VOWELS) for _ in range(rng.randint(0, 2))) + rng.choice(_MIDS) + rng.choice(_TAILS)
    return word.capitalize()


def vary(text: str, spans: list[tuple[str, int, int]], rng: random.Random, names: float = 0.35, digits: float = 0.25) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with some names, digits and street words of its spans replaced by invented ones, and the moved spans."""
    out, moved, at = [], [], 0
    size = 0
    for kind, s, e in spans:
        out.append(text[at:s])
        size += s - at
        part = text[s:e]
        if kind == "name" and rng.random() < names:
            part = re.sub(r"\w{3,}", lambda m: (lambda w: w.lower() if m[0].islower() else w.upper() if m[0].isupper() else w)(random_word(rng)), part)
        elif kind == "address" and rng.random() < names:
            part = re.sub(r"\b(?!Street|Road|Lane|Way|Close|Avenue|Drive|Flat|Apt|Calle|Avenida|Am|Untere)[A-Z][a-zé]{3,}\b(?!str|weg|gas)", lambda m: random_word(rng), part) if rng.random() < 0.6 else part
            part = re.sub(r"[0-9]", lambda m: rng.choice("0123456789"), part)
        elif kind in ("phone", "id_number") and rng.random() < digits:
            part = re.sub(r"[0-9]", lambda m: rng.choice("0123456789"), part)
        elif kind == "email" and rng.random() < names:
            part = re.sub(r"^[A-Za-z]{4,}", lambda m: random_word(rng).lower(), part)
        moved.append((kind, size, size + len(part)))
        out.append(part)
        size += len(part)
        at = e
    out.append(text[at:])
    return "".join(out), moved
