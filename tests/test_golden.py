"""A whole response as a fixture: its places, its first place's fields, and the ring that holds its centre."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from atlasmill import sources as Z
from atlasmill.functions import geometry as G
from atlasmill.functions import responses as P
from atlasmill.sources.folders import scratch
from atlasmill.sources.store import ResponseStore

FIXTURE = Path(__file__).parent / "fixtures" / "response.json"


def test_fields_of_the_golden_response(spark):
    raw = Z.golden_response(spark, "/nowhere/response.json", str(FIXTURE))
    store = ResponseStore(spark, scratch(spark, "golden"), buckets=1)
    store.append(raw)
    for rows in (raw.select(P.envelope(F.col("raw")).alias("o")), store.lookup().select(F.col("outcome").alias("o"))):
        first = F.get("o.candidates", 0)
        chosen = G.chosen_footprint(first["polygons"], first["center"]["x"], first["center"]["y"])
        (r,) = rows.select("o", chosen.alias("ring"), G.contains(chosen, first["center"]["x"], first["center"]["y"]).alias("holds")).collect()
        assert not r.o.auth_error and len(r.o.candidates) == 7
        c = r.o.candidates[0]
        assert (c.name, c.std_tag, c.center.x, c.center.y, len(c.polygons)) == ("示例城·秀园-E栋", "房地产;内部楼栋", 12675065.0, 2569406.75, 8)
        assert "示例路" in c.addr and r.holds and r.ring == c.polygons[4]
    with pytest.raises(FileNotFoundError):
        Z.golden_response(spark, "/nowhere/a.json", "/nowhere/b.json")
