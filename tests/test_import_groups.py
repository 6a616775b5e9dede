from plotweave.sources import schemas
from plotweave.sources.store import Store
from plotweave.streaming import imports


def extractor(texts):
    who = lambda name, kind: {"name": name, "role": "present", "description": None, "context": None, "character_type": kind}
    return [{"title": "t", "summary": "s", "era": "1910s", "approximate_date": "1913-05-02", "characters": [who("Ada Brandt", None), who("The Guild", "group"), who("the guild", "group")], "location": None, "mood": None} for _ in texts]


def test_groups_and_mentions_without_a_type_are_loaded(spark, tmp_path):
    store = Store(spark, "file://" + str(tmp_path / "store"))
    files = spark.createDataFrame([("001.txt", "001", "one"), ("002.txt", "002", "two")], "filename string, stem string, text string")
    for _ in range(2):
        imports.import_batch(store, files, extractor)
        assert [r.id for r in store.read("groups").collect()] == ["the-guild"]
        assert sorted((r.group_id, r.scene_id) for r in store.read("group_presence").collect()) == [("the-guild", "scene-001"), ("the-guild", "scene-002")]
        assert [r.id for r in store.read("characters").collect()] == ["ada-brandt"]
    schemas.assert_key(store.read("group_presence"), schemas.key_of("group_presence"))
