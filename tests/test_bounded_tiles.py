"""Tables that a task of the entity search holds at once stay small, whatever the number of queries and items."""

from __future__ import annotations

from entrack.operators import vectors as V


def test_a_tile_of_the_entity_search_is_small():
    assert (V.BLOCK_ROWS + V.SHARD_ROWS) * 64 * 8 * 4 < 16 * 2**20  # both sides, four copies
