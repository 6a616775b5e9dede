"""Evaluation of scene analyses and of chat answers, as columns over one row per case.

Scene cases: ``expected`` (text), ``characters`` (array of structs with name, role, description, character_type), ``era``,
``location_name``. Names and words are compared without accents and case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions import text as T

# What an answer says that admits not knowing (after normalisation), and the share of facts that passes.
REFUSALS = ["je ne trouve pas", "je n'ai pas", "pas d'information", "aucune information", "n'est pas mentionn", "introuvable", "ne figure pas", "pas dans", "aucune mention"]
LEAST_FACTS = 0.5
#: Offending entries that a report names.
SHOWN = 3


def listed(text: Column) -> Column:
    """The entries between commas, stripped, without empty ones; null text has none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), T.strip), lambda x: x != "")


def last_colon(entry: Column) -> Column:
    """``name`` and ``value`` before and behind an entry's last colon; null if it has none."""
    value = F.substring_index(entry, ":", -1)
    name = F.substring(entry, F.lit(1), F.length(entry) - F.length(value) - 1)
    return F.when(F.contains(entry, F.lit(":")), F.struct(T.normalize(name).alias("name"), T.normalize(value).alias("value")))


def alike(a: Column, b: Column) -> Column:
    """One holds the other."""
    return F.contains(a, b) | F.contains(b, a)


def _plain(characters: Column) -> Column:
    return F.transform(characters, lambda c: F.struct(T.normalize(c["name"]).alias("name"), T.normalize(F.coalesce(c["role"], F.lit(""))).alias("role"), c["description"].alias("description"), c["character_type"].alias("type")))


def _found(characters: Column, name: Column) -> Column:
    """The first extracted character whose name holds the given one or is held by it; null if there is none."""
    return F.get(F.filter(characters, lambda c: alike(c["name"], name)), F.lit(0))


def role_accuracy(expected: Column, characters: Column) -> Column:
    """Of expected ``name:role`` entries: ``accuracy``, the names ``missing`` and those with ``wrong`` roles."""
    pairs, got = F.filter(F.transform(listed(expected), last_colon), lambda p: p.isNotNull()), _plain(characters)
    right = F.filter(pairs, lambda p: F.coalesce(alike(_found(got, p["name"])["role"], p["value"]), F.lit(False)))
    missing = F.transform(F.filter(pairs, lambda p: _found(got, p["name"]).isNull()), lambda p: p["name"])
    wrong = F.transform(F.filter(pairs, lambda p: ~F.coalesce(alike(_found(got, p["name"])["role"], p["value"]), F.lit(True))), lambda p: p["name"])
    return F.struct(F.when(F.size(pairs) == 0, 1.0).otherwise(F.size(right) / F.size(pairs)).alias("accuracy"), missing.alias("missing"), wrong.alias("wrong"))


def extraction_recall(expected: Column, characters: Column) -> Column:
    """Share of the expected names that were extracted, and those ``missing``."""
    names, got = F.transform(listed(expected), T.normalize), _plain(characters)
    missing = F.filter(names, lambda n: _found(got, n).isNull())
    return F.struct(F.when(F.size(names) == 0, 1.0).otherwise(1 - F.size(missing) / F.size(names)).alias("recall"), missing.alias("missing"))


def era_matches(expected: Column, era: Column) -> Column:
    return F.coalesce(F.lower(T.strip(expected)) == F.lower(T.strip(era)), F.lit(False))


def location_matches(expected: Column, location_name: Column) -> Column:
    return F.coalesce(alike(T.normalize(expected), T.normalize(location_name)), F.lit(False))


def absent(expected: Column, characters: Column) -> Column:
    """None of the listed names was extracted."""
    got = _plain(characters)
    return F.size(F.filter(F.transform(listed(expected), T.normalize), lambda n: _found(got, n).isNotNull())) == 0


def description_contains(name: Column, words: Column, characters: Column) -> Column:
    """Share of the listed words in the named character's description; 0 if there is no such character."""
    of = T.normalize(F.coalesce(_found(_plain(characters), T.normalize(name))["description"], F.lit("")))
    wanted = F.transform(listed(words), T.normalize)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda w: F.contains(of, w))) / F.size(wanted))


def type_matches(name: Column, kind: Column, characters: Column) -> Column:
    return F.coalesce(_found(_plain(characters), T.normalize(name))["type"] == kind, F.lit(False))


def fleeting(markers: list[str], characters: Column) -> Column:
    """Up to ``SHOWN`` descriptions that hold one of the markers of a passing state."""
    texts = F.filter(F.transform(characters, lambda c: F.coalesce(c["description"], F.lit(""))), lambda d: F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(T.normalize(d), T.normalize(m))))
    return F.slice(F.transform(texts, lambda d: F.substring(d, 1, 80)), 1, SHOWN)


def facts(expected: Column, answer: Column, least: float = LEAST_FACTS) -> Column:
    """Of a chat answer: ``score``, the share of the listed facts that it holds, whether that is enough, and those ``missing``."""
    wanted, got = listed(expected), T.normalize(F.coalesce(answer, F.lit("")))
    missing = F.filter(wanted, lambda k: ~F.contains(got, T.normalize(k)))
    score = F.when(F.size(wanted) == 0, 1.0).otherwise(1 - F.size(missing) / F.size(wanted))
    return F.struct(score.alias("score"), (score >= least).alias("passed"), missing.alias("missing"))


def refuses(answer: Column, markers: list[str] = REFUSALS) -> Column:
    """The answer admits not knowing."""
    got = T.normalize(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(got, m))
