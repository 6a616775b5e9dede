from plotweave.llm import decontaminate
from tests.llm.helpers import documents


def test_items_without_an_id_hit_but_are_not_named(spark):
    items = spark.createDataFrame([(None, "one two three"), (4, "seven eight")], "item_id long, text string")
    docs = documents(spark, ["zero one two three four", "six seven eight", "nothing here"])
    rows = sorted(decontaminate.find_contamination(docs, items).collect())
    assert [(r.n_hit, r.item_ids) for r in rows] == [(3, []), (2, [4]), (0, [])]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]
