import uuid
import zlib
from collections import Counter, defaultdict

import pytest

from postlens.llm import sharding
from postlens.llm.queries import QUERIES
from postlens.workspace import new_folder


def test_query(spark, sf_dir, texts):
    rows = QUERIES["op10_sharding"](spark, sf_dir).collect()
    text = {i: (t or "").encode() for i, t in texts}
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        data = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
        held[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(held) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(held.values()) / 24
    assert max(held.values()) < 1.02 * mean and min(held.values()) > 0.98 * mean
    assert len({(r["virtual_slot"], r["shard"]) for r in rows}) == len({r["virtual_slot"] for r in rows})
    again = QUERIES["op10_sharding"](spark, sf_dir).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_map_versions(spark):
    sizes = {slot: (slot * 37) % 101 for slot in range(512)}
    placed = sharding.first_map(sizes, 8)
    folder = new_folder(spark, f"maps-{uuid.uuid4().hex}")
    sharding.save_map(spark, folder, 1, placed, sizes)
    with pytest.raises(Exception, match="already exists"):
        sharding.save_map(spark, folder, 1, placed, sizes)
    loaded = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, folder, 1).collect()}
    assert loaded == placed
    grown = sharding.edited_map(placed, sizes, 9)
    moved = {s for s in placed if placed[s] != grown[s]}
    assert len(moved) < len(placed) / 5 and sum(grown[s] == 8 for s in moved) >= 0.9 * len(moved)
    held = Counter()
    for slot, shard in grown.items():
        held[shard] += sizes[slot]
    assert max(held.values()) <= 1.05 * sum(sizes.values()) / 9
    shrunk = sharding.edited_map(placed, sizes, 7)
    assert set(shrunk.values()) <= set(range(7))
    assert sharding.edited_map(placed, sizes, 8) == placed


def test_odd_rows(spark, odd, nothing):
    def sized(df):
        return df.selectExpr("doc_id", "text", "source AS _slot_offset", "score AS shard", "cast(coalesce(octet_length(text), 0) + 8 AS bigint) AS size")

    rows = sharding.shard_records(sized(odd), new_folder(spark, "m"), 3, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_records(sized(nothing), new_folder(spark, "m"), 3, ["doc_id"]).count() == 0
