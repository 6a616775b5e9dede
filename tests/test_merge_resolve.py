import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotweave.functions import similarity as S
from plotweave.operators import extract
from plotweave.operators import merge as M
from plotweave.operators import resolve as E

OLD = [(1, "a", None, "b1", ["x"]), (2, "b", "e", None, None), (None, "n", "e", None, None)]
NEW = [(1, "A", "f", " ", ["x", "y"]), (2, None, "g", "b2", ["z"]), (3, "c", "h", "", None), (None, "N", "q", None, None)]
SCHEMA = "id INT, name STRING, era STRING, note STRING, aliases ARRAY<STRING>"
KEEP = {"name": "keep", "era": "keep", "note": "keep", "aliases": "keep"}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize(
    ("rules", "one", "two"),
    [
        (KEEP, ("a", None, "b1", ["x"]), ("b", "e", None, None)),
        (dict.fromkeys(("name", "era", "note"), "fill"), ("a", "f", "b1", ["x"]), ("b", "e", "b2", None)),
        (dict.fromkeys(("name", "era", "note"), "overwrite"), ("A", "f", " ", ["x"]), (None, "g", "b2", None)),
        ({"note": "patch", "aliases": "union"}, ("a", None, "b1", ["x", "y"]), ("b", "e", "b2", ["z"])),
        ({"note": "append"}, ("a", None, "b1", ["x"]), ("b", "e", "b2", None)),
    ],
)
def test_policies_and_idempotence(spark, rules, one, two):
    old, new = table(spark, OLD), table(spark, NEW)
    out = M.upsert(old, new, ["id"], rules)
    found = by_id(out)
    assert found[1] == one and found[2] == two and found[3][:3] == ("c", "h", "") and len(found) == 4
    if "append" not in rules.values():
        assert by_id(M.upsert(out, new, ["id"], rules)) == found


def test_append_joins_and_partial_batches(spark):
    old, new = table(spark, OLD), table(spark, [(1, None, None, "more", None)])
    assert by_id(M.upsert(old, new, ["id"], {"note": "append"}))[1][2] == "b1. more"
    assert by_id(M.upsert(old, new.select("id", "note"), ["id"], {"note": "overwrite"}))[1] == ("a", None, "more", ["x"])


def test_extend_and_profile_rules(spark):
    old = spark.createDataFrame([(1, "30", "born. raised", None)], "id INT, age STRING, background STRING, arc STRING")
    new = lambda *r: spark.createDataFrame([(1, *r)], "id INT, age STRING, background STRING, arc STRING")
    rules = {k: v for k, v in extract.PROFILE_RULES.items() if k in old.columns}
    one = M.upsert(old, new("31", "taught", "falls"), ["id"], rules)
    assert tuple(one.first()) == (1, "31", "born. raised. taught", "falls")
    assert tuple(M.upsert(one, new("31", "taught", "falls"), ["id"], rules).first()) == tuple(one.first())
    assert tuple(M.upsert(one, new(" ", "raised", ""), ["id"], rules).first()) == tuple(one.first())
    assert tuple(M.upsert(one, new(None, "taug", None), ["id"], rules).first())[2] == "born. raised. taught. taug"


def test_overwrite_present_and_deletes(spark):
    changes = spark.createDataFrame([(1, {"era": None, "name": "z"}), (9, {"name": "q"})], "id INT, changes MAP<STRING, STRING>")
    out = by_id(M.overwrite_present(table(spark, OLD), changes, "id", ["name", "era"]))
    assert out[1] == ("z", None, "b1", ["x"]) and out[2] == ("b", "e", None, None) and 9 not in out
    assert set(by_id(M.delete_where(table(spark, OLD), spark.createDataFrame([(1,)], "id INT"), ["id"]))) == {2, None}
    scenes = spark.createDataFrame([(f"scene-{s}",) for s in ("1", "10", "1-chunk-00", "1-chunk-01", "2")], "id STRING")
    assert {r.id for r in M.scenes_of_stem(scenes, "1").collect()} == {"scene-1", "scene-1-chunk-00", "scene-1-chunk-01"}
    assert {r.id for r in M.scenes_of_stem(scenes, "1", exact=False).collect()} == {"scene-1", "scene-10", "scene-1-chunk-00", "scene-1-chunk-01"}


REGISTRY = [("jean-dupont", "Jean Dupont", ["Jeannot"]), ("marie-dupont", "Marie Dupont", []), ("lena-voss", "Léna Voss", ["the Doctor"]), ("jakes-milton", "Jakes Milton", []), ("vaisseau-elysium-7", "Vaisseau Elysium-7", [])]
MENTIONS = {
    "jean DUPONT": ("exact", "jean-dupont"), "Jeannot": ("exact", "jean-dupont"), "lena voss": ("exact", "lena-voss"), "Marie Dupon": ("resolved", "marie-dupont"), "Jean Dupond": ("resolved", "jean-dupont"),
    "Voss": ("ambiguous", "lena-voss"), "Elias Milton": ("new", "elias-milton"), "Vaisseau spatial": ("ambiguous", "vaisseau-elysium-7"), "Napoleon Bonaparte": ("new", "napoleon-bonaparte"),
}


@pytest.mark.parametrize("blocking", [False, True])
def test_resolution(spark, blocking):
    registry = spark.createDataFrame(REGISTRY, "id STRING, name STRING, aliases ARRAY<STRING>")
    mentions = spark.createDataFrame([(n,) for n in [*MENTIONS, None]], "name STRING")
    out = {r.name: (r.status, r.entity_id) for r in E.resolve(mentions, registry, blocking).collect()}
    assert out == MENTIONS


def test_growing_registry_policy_groups_relations(spark):
    registry = spark.createDataFrame(REGISTRY, "id STRING, name STRING, aliases ARRAY<STRING>")
    mentions = spark.createDataFrame([(1, "Karl Anders"), (2, "Karl Andres"), (3, "Voss"), (4, "Karl Anders")], "at INT, name STRING")
    out = {r["at"]: (r.status, r.entity_id) for r in E.resolve_in_order(mentions, registry, "at").collect()}
    assert out == {1: ("new", "karl-anders"), 2: ("resolved", "karl-anders"), 3: ("ambiguous", "lena-voss"), 4: ("exact", "karl-anders")}
    resolved = spark.createDataFrame([("a", "ambiguous"), ("b", "ambiguous"), ("c", "ambiguous"), ("d", "new")], "name STRING, status STRING")
    answers = spark.createDataFrame([("a", "link"), ("b", "new")], "name STRING, answer STRING")
    found = {r.name: (r.action, r.issue_severity, r.issue_resolved) for r in E.apply_policy(resolved, answers).collect()}
    assert found == {"a": ("link_alias", "warning", True), "b": ("create", "info", False), "c": ("link", "warning", False), "d": ("new", None, None)}
    groups = spark.createDataFrame([("g1", "Harbour Guild")], "id STRING, name STRING")
    found = {r.name: (r.group_id, r.is_new) for r in E.resolve_groups(spark.createDataFrame([("harbour GUILD ",), ("New Guild",)], "name STRING"), groups).collect()}
    assert found == {"harbour GUILD ": ("g1", False), "New Guild": ("new-guild", True)}
    new = spark.createDataFrame([("p", "works for"), ("q", "loves"), ("r", "x")], "pair STRING, relation STRING")
    known = spark.createDataFrame([("p", "Works for"), ("p", "hates"), ("q", "lives with")], "pair STRING, relation STRING")
    found = {r.pair: r.band for r in E.relation_duplicates(new, known, ["pair"]).collect()}
    assert found == {"p": "duplicate", "q": "unsure", "r": "distinct"}


def brute(name, registry):
    """The rule for one name, entity by entity."""
    norm = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()
    q, best = norm(name), None
    for by_alias in (False, True):
        for i, n, aliases in sorted(registry):
            if q in ([norm(a) for a in aliases] if by_alias else [norm(n)]):
                return "exact", i
    for i, n, aliases in sorted(registry):
        own = norm(n)
        if S.first_name_differs(q, own):
            continue
        by_alias = [x for x in (S.acceptable(q, norm(a)) for a in aliases) if x is not None and x > S.coverage(q, own)]
        scores = [x for x in [S.acceptable(q, own), *by_alias] if x is not None]
        if scores and (best is None or max(scores) > best[0]):
            best = max(scores), i
    return ("new", None) if best is None else ("resolved" if best[0] >= S.AUTO else "ambiguous", best[1])


def test_resolution_against_the_rule_of_one_name(spark):
    """Blocks and native filters lose nothing, vetoes are by the entity's own name, aliases must beat it."""
    rng = random.Random(2)
    first, last = ["Elias", "Jakes", "Anna", "Jo", "Léna", "Marie-Ann", "X", "Åsa"], ["Milton", "Melton", "Voss", "Vos", "de la Cruz", "O", "Karlsson"]
    name = lambda: " ".join([rng.choice(first), *([rng.choice(last)] if rng.random() < 0.8 else [])])

    def typo(x):
        at = rng.randrange(len(x))
        return rng.choice([x, x[:at] + x[at + 1 :], x[:at] + rng.choice("aeiou") + x[at:], x.upper(), x.split()[-1]]) or "q"

    registry = [(f"e{i:02d}", name(), [typo(name()) for _ in range(rng.randint(0, 2))]) for i in range(25)] + [("jakes", "Jakes Milton", ["Eliass Miltons"])]
    names = sorted({typo(name()) for _ in range(150)} | {"Elias Milton"})
    table = spark.createDataFrame(registry, "id STRING, name STRING, aliases ARRAY<STRING>")
    for blocking in (True, False):
        out = {r.name: (r.status, None if r.status == "new" else r.entity_id) for r in E.resolve(spark.createDataFrame([(n,) for n in names], "name STRING"), table, blocking).collect()}
        assert out == {n: brute(n, registry) for n in names}


def test_new_names_make_entities_in_order(spark):
    none = spark.createDataFrame([], "id STRING, name STRING, aliases ARRAY<STRING>")
    names = ["Karl Karlsson Anders", "Karlsson Andersson", "Karlsson Anderssen", "Karlsson Andersse", "Karlsson Andersson", "Mia"]
    out = {r["at"]: r for r in E.resolve_in_order(spark.createDataFrame(list(enumerate(names)), "at INT, name STRING"), none, "at").collect()}
    made = {r.entity_id for r in out.values() if r.status == "new"}
    assert {r.entity_id for r in out.values()} == made and out[5].status == "new"
    assert out[4].entity_id == out[1].entity_id
    answers = spark.createDataFrame([("Voss", "new")], "name STRING, answer STRING")
    known = spark.createDataFrame([("lena-voss", "Lena Voss", [])], "id STRING, name STRING, aliases ARRAY<STRING>")
    out = {r["at"]: (r.status, r.entity_id, r.told_apart) for r in E.resolve_in_order(spark.createDataFrame([(1, "Voss"), (2, "Voss"), (3, "Lena Voss")], "at INT, name STRING"), known, "at", answers).collect()}
    assert out == {1: ("new", "voss", True), 2: ("exact", "voss", False), 3: ("exact", "lena-voss", False)}


def test_relation_targets(spark):
    people = spark.createDataFrame(REGISTRY, "id STRING, name STRING, aliases ARRAY<STRING>")
    groups = spark.createDataFrame([("guild", "Harbour Guild")], "id STRING, name STRING")
    told = spark.createDataFrame([(1, "Voss"), (2, "harbour guild"), (3, "Nobody Known"), (4, None)], "n INT, target STRING")
    assert sorted((r.n, r.target_id, r.kind) for r in E.relation_targets(told, people, groups).collect()) == [(1, "lena-voss", "character"), (2, "guild", "group")]
