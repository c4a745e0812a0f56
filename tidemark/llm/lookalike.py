"""One consistent form for texts that look the same (problem 3).

The form is a function of the *look* alone, so two texts get the same form
exactly if they look the same:

1. characters that draw nothing are dropped, width forms and the styled letters of
   mathematics become their ordinary characters, every kind of one-character space
   becomes U+0020, and letters with their accents are composed (NFC);
2. every letter belongs to a *look class*, the letters that are drawn alike.  The
   script sets of a token's letters are intersected; if one script can spell the
   whole token, the token is spelt in it (Cyrillic before Latin before Greek before
   the others, so a token that several scripts can spell has one spelling); if none
   can, the token is genuinely mixed and every letter is replaced by the first
   spelling its class has.

Nothing else is folded: case, punctuation, digits against letters, and
``ё`` against ``е`` keep their difference here (``folded`` goes further).

Look classes are made by a rule from the public Unicode confusables data (UTS 39)
in the binary form in which the ICU library ships it, and ICU comes with Spark:
letters with one prototype and of one case are a class.  Prototypes of several
characters, digits and marks are left out, and of the letters of one everyday alphabet
only one is in a class, so that no two of them are taken for each other.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import unicodedata
import zipfile
from functools import lru_cache
from pathlib import Path

#: Scripts in the order of preference; others follow by name.
SCRIPTS = ("CYRILLIC", "LATIN", "GREEK")
#: Everyday alphabets, as ranges of code points.
_EVERYDAY = {"CYRILLIC": "А-Яа-я", "LATIN": "A-Za-z", "GREEK": "Α-Ωα-ω"}
_BASIC = re.compile("[" + "".join(_EVERYDAY.values()) + "]")
#: Where the confusables are in the jar of the library.
_DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"

#: Runs of characters that the first step may change; most texts have none.
_UNUSUAL = re.compile("[^\t\n -~А-яЁё«»–—…•№]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_BASIC_LATIN = re.compile("[A-Za-z]+")
#: Marks that combine with the letter before them.
_MARKS = "\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
#: Letters that are neither basic Cyrillic nor basic Latin, and marks that made no letter.
_FOREIGN = re.compile(rf"(?![A-Za-zА-яЁё])[^\W\d_]|[{_MARKS}]")
#: Tokens without rare letters, decomposed.
_COMMON = re.compile("|".join(f"[{letters}{_MARKS}]+" for letters in _EVERYDAY.values()))
#: A token with its letters decomposed.
_DECOMPOSED = re.compile(rf"(?:[^\W\d_]|[{_MARKS}])+")


def _draws_nothing(ch: str) -> bool:
    cp = ord(ch)
    if ch in "\t\n":
        return False
    if unicodedata.category(ch) in ("Cf", "Cc"):
        return True
    # Default-ignorable characters outside Cf: fillers, joiners and variation selectors.
    return cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or (
        0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF
    )


@lru_cache(maxsize=1 << 17)
def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return name.split(" ", 1)[0].split("-", 1)[0]


def _is_letter(ch: str) -> bool:
    return unicodedata.category(ch) in ("Lu", "Ll", "Lt", "Lo")


def _case(ch: str) -> str:
    return "upper" if ch.isupper() else "lower" if ch.islower() else ""


def confusables(data: bytes) -> dict[str, str]:
    """Prototype of every character, from the binary form of the data.

    After a header that gives its own size there are 32-bit keys (the code point, and
    above it the prototype's length less one), for each key a 16-bit value (the
    prototype itself or its place in the text that follows), and that text.
    """
    data = data[int.from_bytes(data[:2], "big") :]
    _, _, _, keys_at, n, values_at, _, text_at, units = struct.unpack(">9I", data[:36])
    keys = struct.unpack(f">{n}I", data[keys_at : keys_at + 4 * n])
    values = struct.unpack(f">{n}H", data[values_at : values_at + 2 * n])
    out = {}
    for key, value in zip(keys, values):
        size = (key >> 24) + 1
        at = text_at + 2 * value
        out[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else data[at : at + 2 * size].decode("utf-16-be", "surrogatepass")
    return out


def _jar() -> Path:
    import pyspark

    for folder in (Path(pyspark.__file__).parent / "jars", Path(os.environ.get("SPARK_HOME", "/nowhere")) / "jars"):
        found = sorted(folder.glob("icu4j-*.jar"))
        if found:
            return found[-1]
    raise FileNotFoundError("no jar of the ICU library; give the path of one")


@lru_cache(maxsize=4)
def load(jar: str | None = None) -> Alike:
    """The look classes; read on the driver and shipped with the functions that use them."""
    with zipfile.ZipFile(jar or _jar()) as z:
        prototype = confusables(z.read(_DATA))
    # Of more than one character there is nothing to be spelt in another script; what decomposes is compared by its parts,
    # and styled letters and width forms by what they become.
    own = [c for c, p in prototype.items() if len(p) == 1 and _is_letter(c) and unicodedata.normalize("NFD", c) == c]
    pairs = sorted((c, prototype[c]) for c in own if not unicodedata.decomposition(c).startswith(("<font>", "<wide>", "<narrow>")))
    return _shared("".join(c for c, _ in pairs), "".join(p for _, p in pairs))


@lru_cache(maxsize=4)
def _shared(letters: str, prototypes: str) -> Alike:
    return Alike(letters, prototypes)


class Alike:
    """Look classes, and the forms of texts they give.  A worker process makes them once."""

    def __init__(self, letters: str, prototypes: str):
        self._key = (letters, prototypes)
        members: dict[tuple[str, str], set[str]] = {}
        for c, p in zip(letters, prototypes):
            members.setdefault((p, _case(c) or _case(p)), set()).add(c)
        for (p, case), group in members.items():
            if _is_letter(p) and _case(p) in (case, ""):
                group.add(p)
        #: Letter -> class, a class by its first letter; class -> {script: letter}.
        self.class_of: dict[str, str] = {}
        self.spellings: dict[str, dict[str, str]] = {}
        for group in members.values():
            spelt: dict[str, str] = {}
            kept = []
            for c in sorted(group, key=lambda c: (not _BASIC.match(c), c)):
                if script_of(c) not in spelt or not _BASIC.match(c):
                    kept.append(c)
                    spelt.setdefault(script_of(c), c)
            spelt = {s: spelt[s] for s in sorted(spelt, key=lambda s: (SCRIPTS.index(s) if s in SCRIPTS else len(SCRIPTS), s))}
            name = next(iter(spelt.values()))
            self.spellings[name] = spelt
            self.class_of.update(dict.fromkeys(kept, name))
        self._clean = lru_cache(maxsize=1 << 16)(self._cleaned)
        self.resolve = lru_cache(maxsize=1 << 16)(self._resolved)

    def __reduce__(self):
        return _shared, self._key

    def _cleaned(self, run: str) -> str:
        """What step 1 makes of a run of unusual characters, before composition."""
        out = []
        for ch in run:
            if _draws_nothing(ch):
                continue
            kind = unicodedata.category(ch)
            if kind == "Zs":
                ch = " "
            elif "\uff00" <= ch <= "\uffef":
                ch = unicodedata.normalize("NFKC", ch)
            elif kind == "Nl" or unicodedata.decomposition(ch).startswith("<font>"):
                # Styled letters and the letters of Roman numerals are letters of no script of their own.
                plain = unicodedata.normalize("NFKC", ch)
                if len(plain) == 1 and _is_letter(plain):
                    ch = plain
            out.append(ch)
        return "".join(out)

    def script_set(self, ch: str) -> set[str]:
        """The scripts that have a letter drawn like ``ch``."""
        cls = self.class_of.get(ch)
        return set(self.spellings[cls]) if cls else {script_of(ch)}

    def _resolved(self, token: str) -> str:
        """The one spelling of all tokens that look like ``token``."""
        scripts: set[str] | None = None
        for ch in filter(str.isalpha, token):
            scripts = self.script_set(ch) if scripts is None else scripts & self.script_set(ch)
        of = self.class_of
        if scripts:
            order = [s for s in SCRIPTS if s in scripts] or sorted(scripts)
            spelt = ["".join(self.spellings[of[c]][s] if c in of else c for c in token) for s in order]
            return next((t for t in spelt if _COMMON.fullmatch(t)), spelt[0])
        return "".join(of.get(c, c) for c in token)

    def token_kind(self, token: str) -> str:
        """``single``, ``whole`` (other everyday scripts can spell all of it) or ``mixed``.

        ``mixed`` tokens use letters of several scripts: ``mixed_resolved`` if one
        script can spell the look, ``mixed`` if none can.
        """
        used = {script_of(c) for c in token}
        possible = set.intersection(*(self.script_set(c) for c in token)) if token else set()
        if len(used) > 1:
            return "mixed_resolved" if possible else "mixed"
        return "whole" if len(possible.intersection(SCRIPTS)) > 1 else "single"

    def _respelt(self, text: str) -> str:
        """Every token resolved; accents are kept apart from their letters meanwhile."""
        return unicodedata.normalize("NFC", _DECOMPOSED.sub(lambda m: self.resolve(m[0]), unicodedata.normalize("NFD", text)))

    def look(self, text: str | None) -> str | None:
        """The consistent form of ``text``; null stays null, empty stays empty."""
        if text is None:
            return None
        if _UNUSUAL.search(text):
            text = unicodedata.normalize("NFC", _UNUSUAL.sub(lambda m: self._clean(m[0]), text))
            if _FOREIGN.search(text):
                return self._respelt(text)
        out, at, end = [], 0, len(text)
        for m in _BASIC_LATIN.finditer(text):
            i, j = m.span()
            if i and text[i - 1].isalpha() or j < end and text[j].isalpha():
                return self._respelt(text)
            out += text[at:i], self.resolve(m[0])
            at = j
        return "".join(out) + text[at:] if out else text

    def folded(self, text: str | None) -> str | None:
        """``look`` in lower case with ``ё`` as ``е``."""
        return None if text is None else self.look(text).lower().replace("ё", "е")

    def words(self, text: str | None) -> list[str]:
        """Maximal runs of letters and digits (categories L, N) of the folded text."""
        return [] if text is None else WORD.findall(self.folded(text))


def _number_like() -> str:
    """Characters of category N that ``\\w`` leaves out, and marks it takes in."""
    extra = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "N" and not chr(c).isalnum()]
    return "".join(map(re.escape, extra))


WORD = re.compile(r"(?:[^\W_]%s)+" % (f"|[{x}]" if (x := _number_like()) else ""))
