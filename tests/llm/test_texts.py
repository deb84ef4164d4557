"""What workers keep between batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from groundq.llm import texts


def test_large_tables_of_powers_are_forgotten_and_hashes_stay_the_same():
    before = texts.Words(["one two three"]).hashes
    texts.powers(texts.BASE, texts.POWERS_KEPT + 1)
    texts.give_back()
    assert all(len(table) <= texts.POWERS_KEPT for table in texts._powers.values())
    assert np.array_equal(texts.Words(["one two three"]).hashes, before)


def test_without_glibc_nothing_is_trimmed(monkeypatch):
    monkeypatch.setattr(texts, "_trim", None)
    texts.give_back()


def test_blocks_cover_nulls_empty_and_long_texts():
    column = pa.array([None, "", "a" * (texts.BLOCK_BYTES + 1), "b"])
    blocks = list(texts.text_blocks(column))
    assert [t for _, _, some in blocks for t in some] == ["", "", "a" * (texts.BLOCK_BYTES + 1), "b"]
    assert [lo for lo, _, _ in blocks] == [0, *(hi for _, hi, _ in blocks[:-1])]
    assert list(texts.text_blocks(pa.array([], pa.string()))) == []
