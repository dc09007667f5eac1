import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import packing


def best_fit_decreasing(histogram, capacity):
    """The number of sequences when piece after piece takes the least room that fits."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fitting = [k for k, free in enumerate(rooms) if free >= length]
            if fitting:
                rooms[min(fitting, key=rooms.__getitem__)] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def filled(histogram, capacity):
    """How many sequences a plan opens; it must be gapless, whole and within the capacity."""
    parts, ranks = {}, {}
    for length, first, count, sequence, offset in packing.plan_slots(histogram, capacity):
        for k in range(count):
            parts.setdefault(sequence + k, []).append((offset, length))
            ranks.setdefault(length, []).append(first + k)
    for pieces in parts.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    return len(parts)


def test_plan_equals_best_fit_decreasing():
    @settings(max_examples=200, deadline=None)
    @given(st.integers(1, 64), st.data())
    def check(capacity, data):
        histogram = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 12), min_size=1, max_size=20))
        assert filled(histogram, capacity) == best_fit_decreasing(histogram, capacity)

    check()
    assert filled({2: 1, 1: 2}, 4) == 1
    rng = np.random.default_rng(3)
    for _ in range(5):
        lengths, counts = np.unique(np.minimum(1024, rng.lognormal(5, 1.2, 600).astype(int) + 1), return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist()))
        assert filled(histogram, 1024) == best_fit_decreasing(histogram, 1024)


def test_plan_does_not_grow_with_counts():
    few, many = ({k: n * (k % 7 + 1) for k in range(1, 1025)} for n in (10, 10_000_000))
    assert len(packing.plan_slots(many)) < 3 * len(packing.plan_slots(few)) < 300_000


def test_pack(documents, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    rows = [(1, None, "a"), (2, "", "a"), (3, "word " * 3000, "b"), (4, "word " * 1023, "b"), (5, "word " * 1022 + "word", "b"), (6, "same", "a"), (6, "same", "a"), (None, "no id", None)]
    out = packing.pack(documents(rows), tokenizer_path).toPandas()
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    assert out["length"].sum() == sum(len(ids) for _, ids in expected)
    for i, ids in expected:
        mine = out[out.doc_id.isna() if i is None else out.doc_id == i].sort_values(["piece", "sequence_id"]).drop_duplicates("piece")
        assert (mine["length"].iloc[1:] == 1024).all() and mine["length"].sum() == len(ids)
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    ordered = out.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packing.pack(documents([]), tokenizer_path).count() == 0
