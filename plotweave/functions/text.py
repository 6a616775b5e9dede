"""Text expressions. All are built-in column expressions, so they stay in generated code."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words per token in the size estimate.
TOKENS_PER_WORD = 1.35

# The Hangul syllables, and the first letter of each kind that they are made of.
HANGUL, _LEAD, _VOWEL, _TAIL = range(0xAC00, 0xD7A4), 0x1100, 0x1161, 0x11A7
_SYLLABLES = "[\\x{AC00}-\\x{D7A3}]"


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _ranges(characters: str) -> str:
    """The characters as a class of a regular expression."""
    out, points = [], sorted(map(ord, characters))
    start = before = points[0]
    for c in [*points[1:], -1]:
        if c != before + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{before:X}}}")
            start = c
        before = c
    return "[" + "".join(out) + "]"


def _tables() -> tuple[str, str, str, list[tuple[str, str, str]]]:
    """By the rule of NFKD over all of Unicode: characters to one other (or, behind those, to none); the class of characters
    to several; and for the first, second and further of these the class, the characters and what stands there."""
    every = (chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c not in HANGUL)
    spelled = {c: _plain(c) for c in every if unicodedata.combining(c) or not unicodedata.is_normalized("NFKD", c)}
    one, none = [c for c, p in spelled.items() if len(p) == 1], [c for c, p in spelled.items() if not p]
    several, parts = [c for c, p in spelled.items() if len(p) > 1], []
    while have := [c for c in several if len(spelled[c]) > len(parts)]:
        parts.append((_ranges("".join(have)), "".join(have), "".join(spelled[c][len(parts)] for c in have)))
    return "".join([*one, *none]), "".join(spelled[c] for c in one), _ranges("".join([*several, *map(chr, HANGUL)])), parts


_FROM, _TO, _SEVERAL, _PARTS = _tables()


def strip(text: Column) -> Column:
    """Without white space (Unicode, and the separators of ASCII) at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def _letters(c: Column) -> Column:
    """The letters of a Hangul syllable, by its place among them."""
    n = F.ascii(c) - HANGUL.start
    letter = lambda point: F.decode(F.unhex(F.hex(point.cast("long"))), "UTF-16BE")
    tail = F.when(n % 28 > 0, letter(_TAIL + n % 28)).otherwise("")
    return F.concat(letter(_LEAD + F.floor(n / 588)), letter(_VOWEL + F.floor(n % 588 / 28)), tail)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain(text: Column) -> Column:
    """NFKD without combining marks, lower-cased.

    The rules are looked up for the distinct characters beyond ASCII only, which are few; a character that becomes several is
    then replaced in the whole text at once.
    """
    spell = lambda c: F.when(c.rlike(_SYLLABLES), _letters(c)).otherwise(F.concat(*[F.when(c.rlike(kind), F.translate(c, a, b)).otherwise("") for kind, a, b in _PARTS]))
    other = F.array_join(F.array_distinct(F.split(F.regexp_replace(text, r"[\x00-\x7F]+", ""), "")), "")

    def spelled(kinds: Column) -> Column:
        several = F.split(F.regexp_replace(kinds, f"[^{_SEVERAL[1:]}", ""), "")
        return F.when(kinds.rlike(_SEVERAL), F.aggregate(several, text, lambda t, c: F.replace(t, c, spell(c)))).otherwise(text)

    return F.lower(_once(other, lambda kinds: F.when(kinds == "", text).otherwise(F.translate(spelled(kinds), _FROM, _TO))))


def normalize(text: Column) -> Column:
    """NFKD without combining marks, lower-cased, stripped."""
    return strip(plain(text))


def holds_each(text: Column, names: Column) -> Column:
    """Those of an array of names that the text contains, accents and case ignored; the text is looked through once a name, but made plain once."""
    # a stripped name begins and ends with what stripping the text would leave
    return _once(plain(text), lambda t: F.filter(names, lambda k: F.contains(t, normalize(k))))


def _quoted(text: str) -> str:
    return "'" + "".join("\\" + c if c in "'\\" else c for c in text) + "'"


def normalize_sql(t: str) -> str:
    """``normalize`` as SQL text over the expression ``t``."""
    spell = "concat(" + ", ".join(f"CASE WHEN c RLIKE {_quoted(kind)} THEN translate(c, {_quoted(a)}, {_quoted(b)}) ELSE '' END" for kind, a, b in _PARTS) + ")"
    letter = lambda point: f"decode(unhex(hex(CAST({point} AS BIGINT))), 'UTF-16BE')"
    n = f"(ascii(c) - {HANGUL.start})"
    hangul = f"concat({letter(f'{_LEAD} + floor({n} / 588)')}, {letter(f'{_VOWEL} + floor({n} % 588 / 28)')}, CASE WHEN {n} % 28 > 0 THEN {letter(f'{_TAIL} + {n} % 28')} ELSE '' END)"
    spelled = f"array_join(transform(split({t}, ''), c -> CASE WHEN c RLIKE {_quoted(_SYLLABLES)} THEN {hangul} WHEN c RLIKE {_quoted(_SEVERAL)} THEN {spell} ELSE c END), '')"
    edges = _quoted(r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$")
    return f"regexp_replace(lower(translate(CASE WHEN {t} RLIKE {_quoted(_SEVERAL)} THEN {spelled} ELSE {t} END, {_quoted(_FROM)}, {_quoted(_TO)})), {edges}, '')"


def slugify(name: Column) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between."""
    return F.regexp_replace(F.regexp_replace(normalize(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(text: Column) -> Column:
    """Runs without white space (Unicode), as an array without empty strings."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(TOKENS_PER_WORD)).cast("int")


def null_if_blank(text: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), text)


def era_to_date(era: Column) -> Column:
    """First of January of the first four digits in an era; ``unknown`` if it has fewer."""
    digits = F.regexp_replace(F.coalesce(era, F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 4), F.lit("-01-01"))).otherwise("unknown")


def excerpt(text: Column, name: Column, size: int = 120) -> Column:
    """First line that holds the name (case ignored), cut to ``size`` characters; null if there is none."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lower(name))), F.lit(0))
    line = strip(line)
    return F.when(F.length(line) > size, F.concat(F.substring(line, 1, size), F.lit("…"))).otherwise(line)


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines, stripped, without empty ones; lines if there is at most one paragraph."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    clean = lambda parts: F.filter(F.transform(parts, strip), lambda b: b != "")
    paragraphs = clean(F.split(unix, "\n{2,}"))
    return F.when(F.size(paragraphs) <= 1, clean(F.split(unix, "\n"))).otherwise(paragraphs)


def parse_aliases(text: Column) -> Column:
    """A JSON list as an array; null and malformed text as an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def scene_id(stem: Column, index: Column, total: Column) -> Column:
    """``scene-stem``, with the chunk's number if the file has several."""
    return F.when(total <= 1, F.concat(F.lit("scene-"), stem)).otherwise(F.concat(F.lit("scene-"), stem, F.lit("-chunk-"), F.lpad(index.cast("string"), 2, "0")))
