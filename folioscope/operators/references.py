"""Offset-based search for references in one text."""

from __future__ import annotations

import re

from ..functions.text import MARKED, PLAIN

_NUMBER = re.compile(r"(?<![\d/])(\d{1,4})/(\d{4}|\d{2})(?![\d/])")
_FOLD = str.maketrans(MARKED, PLAIN)

#: Months in Spanish and in Valencian, folded; place by place the same month.
MONTHS = ("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), "gener febrer marc abril maig juny juliol agost setembre octubre novembre desembre".split())
_MONTH = {name: n for names in MONTHS for n, name in enumerate(names, 1)}
_DATE = re.compile(rf"\b(\d{{1,2}})\s+(?:de\s+|d')({'|'.join(sorted(_MONTH))})\b(?:\s+de\s+(\d{{4}}))?")
#: What may name the issuer after a date: up to the next comma or bracket.
_ISSUER = re.compile(r"[,\s]*\bde\s+(?:(?:la|los|las)\s+|l')?([^,()]{5,61})")

Reference = tuple[str, int | None, int | None, str, int | None, int | None, str | None]


def flat(text: str) -> str:
    """Lower case without accents; place by place the same text."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)).translate(_FOLD)


def find_references(title: str, text: str, types: tuple[str, ...], kinds: dict[str, str], around: int, before: int, most: int | None = None) -> list[Reference]:
    """Distinct (type, number, year, kind, day, month, issuer), those of the title first, in order of appearance.

    N/YYYY with a type named within ``before`` characters before it (the last one named), or a resolution by its date,
    named within 20 characters before that, with its issuer. The kind comes from the first verb stem within ``around``
    characters on either side, cita without one. Years outside 1980-2100 are no references, nor is what the head of the
    title says of the document itself. Of the text ``most`` characters are read.
    """
    own = _identity(flat(title), types)
    out: dict[Reference, None] = {}
    for part in (title, text[:most]):
        low = flat(part)

        def kind(lo: int, hi: int, low: str = low) -> str:
            near = low[max(0, lo - around) : hi + around]
            found = [(near.find(stem), name) for stem, name in kinds.items() if stem in near]
            return min(found)[1] if found else "cita"

        for m in _NUMBER.finditer(low):
            number, year, head = int(m[1]), _year(m[2]), low[max(0, m.start() - before) : m.start()]
            named = [(head.rfind(t) + len(t), len(t), t) for t in types if t in head]
            if not named or not 1980 <= year <= 2100 or (number, year) == own[1:3] and own[0] in (None, max(named)[2]):
                continue
            out.setdefault((max(named)[2], number, year, kind(*m.span()), None, None, None))
        for m in _DATE.finditer(low):
            day, month, year = int(m[1]), _MONTH[m[2]], int(m[3]) if m[3] else None
            if "resoluci" not in low[max(0, m.start() - 20) : m.start()] or (day, month, year) == own[3:]:
                continue
            named = _ISSUER.match(part, m.end(), m.end() + 90)
            issuer = named[1].strip() if named and named[1][0].isupper() else None
            out.setdefault(("resolucion", None, year, kind(*m.span()), day, month, issuer))
    return list(out)


def _identity(title: str, types: tuple[str, ...]) -> tuple:
    """(type, number, year, day, month, year of the date) that the head of a folded title states."""
    number, day = _NUMBER.search(title[:60]), _DATE.search(title[:90])
    named = [(title[:60].find(t), -len(t), t) for t in types if t in title[:60]]
    return (min(named)[2] if named else None, *((int(number[1]), _year(number[2])) if number else (None, None)), *((int(day[1]), _MONTH[day[2]], int(day[3]) if day[3] else None) if day else (None, None, None)))


def _year(raw: str) -> int:
    year = int(raw)
    return year if year >= 100 else year + (2000 if year < 80 else 1900)
