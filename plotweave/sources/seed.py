"""A small story for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.operators import search
from plotweave.sources import schemas
from plotweave.sources.store import Store

ROWS = {
    "characters": [
        ("ada-brandt", "Ada Brandt", "1910s", ["the surveyor"], "31 in 1913", None, "Maps the northern coast", None, "patient", None),
        ("jonas-weil", "Jonas Weil", "1910s", ["Weil", "old Jonas"], None, "tall", None, None, None, None),
        ("mira-okonjo", "Mira Okonjo", "1950s", [], None, None, "Reads the maps again", None, None, None),
        ("pavel-orlov", "Pavel Orlov", None, None, None, None, None, None, None, None),
    ],
    "groups": [("harbour-guild", "Harbour Guild", "1910s")],
    "locations": [("lighthouse", "Lighthouse", "1910s", "White tower", "North Mole", ["the tower"]), ("archive", "City Archive", "1950s", None, None, None)],
    "scenes": [
        ("scene-1", "1.txt", "Arrival", "Ada arrives", "1910s", "1913-04", None, "lighthouse"),
        ("scene-10", "10.txt", "Storm", "A storm", "1910s", "1913-05-02", None, "lighthouse"),
        ("scene-1-chunk-01", "1.txt", "Arrival, later", None, "1910s", "unknown", None, None),
        ("scene-2", "2.txt", "The same day", "Ada is seen in town", "1910s", "1913-05-02", None, "archive"),
    ],
    "presence": [("ada-brandt", "scene-1", "participant", None, None), ("ada-brandt", "scene-10", "participant", None, None), ("ada-brandt", "scene-2", "participant", None, None), ("jonas-weil", "scene-10", "mentioned", None, None), ("jonas-weil", "scene-2", "participant", None, None)],
    "relations": [("ada-brandt", "jonas-weil", "employs", None, "1910s")],
    "members": [("jonas-weil", "harbour-guild")],
    "events": [(f"evt-{s}", d, "1910s", t, None) for s, d, t in (("scene-1", "1913-04", "Arrival"), ("scene-10", "1913-05-02", "Storm"), ("scene-2", "1913-05-02", "The same day"))],
    "event_scenes": [(f"evt-{s}", s) for s in ("scene-1", "scene-10", "scene-2")],
    "event_locations": [("evt-scene-1", "lighthouse"), ("evt-scene-10", "lighthouse"), ("evt-scene-2", "archive")],
    "participants": [("ada-brandt", "evt-scene-1", "participant"), ("ada-brandt", "evt-scene-10", "participant"), ("jonas-weil", "evt-scene-2", "participant")],
}


def load(store: Store) -> None:
    """All tables, and a vector for each scene; loading again gives the same."""
    with store.transaction():
        for table, rows in ROWS.items():
            store.write(table, store.spark.createDataFrame(rows, schemas.TABLES[table]))
        scenes, present = store.read("scenes"), store.read("presence")
        cast = present.groupBy(F.col("scene_id").alias("id")).agg(F.sort_array(F.collect_set("character_id")).alias("characters"))
        text = F.concat_ws(". ", "title", "summary")
        vectors = scenes.join(cast, "id", "left").select("id", text.alias("document"), search.embed(text).alias("embedding"), "era", "location_id", F.coalesce("characters", F.array().cast("array<string>")).alias("characters"))
        store.write("vectors", vectors)
