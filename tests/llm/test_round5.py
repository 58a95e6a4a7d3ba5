"""Substring dedup's last step: only documents that can hold an alike window meet."""

import random

import numpy as np
import pyarrow as pa

from barspark.llm import passages


def test_lines_that_many_share_in_other_neighbours_make_no_pairs(spark, monkeypatch):
    """Each window over two lines has 42 of 46 shingles that others have, but no other document has both lines in a row."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = [fresh(25) for _ in range(9)]
    texts = [" ".join(fresh(60) + a + b + fresh(60)) for k, a in enumerate(lines) for b in lines[:k]]
    last, kept = [], passages._rest
    monkeypatch.setattr(passages, "_rest", lambda *args: last.append(kept(*args)) or last[-1])
    assert passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() == []
    assert last[0].where("doc <> hub").count() == 0


def test_who_asks_meets_only_rows_with_enough_of_a_window(monkeypatch):
    ask = np.arange(60)
    rows = [  # doc, root, ask, shingles, open
        (1, 1, True, ask, np.arange(15) == 3),
        (2, 1, False, np.arange(3, 44), None),  # 41 of the open window
        (3, 1, False, np.arange(4, 44), None),  # 40 of it
        (4, 1, False, np.arange(10, 60), None),  # 46 of another, which is not open
        (5, 5, False, np.arange(10, 60), None),  # the same in another component
        (1, 1, False, ask, None),
    ]
    cols = list(zip(*rows))
    made = pa.table({"key": [7] * 6, "doc": cols[0], "root": cols[1], "ask": cols[2], "shingles": [x.astype(np.uint32).tobytes() for x in cols[3]], "open": [b"" if x is None else x.tobytes() for x in cols[4]]})
    for size in (passages.TABLE, 1):
        monkeypatch.setattr(passages, "TABLE", size)
        assert passages._asked(46, 41)(made).to_pydict() == {"doc": [2, 5], "hub": [1, 1]}


def test_compact_windows_of_one_shingle_that_touch_are_one():
    tokens = np.array([5, 6, 5, 6, 5, 9, 5], np.uint64)
    c, lo, hi = passages.joined(tokens, np.array([0, 1, 2, 4, 6]), np.array([0, 0, 1, 3, 9]), np.array([2, 1, 3, 5, 9]))
    assert list(zip(tokens[c].tolist(), lo.tolist(), hi.tolist())) == [(5, 0, 5), (5, 9, 9), (6, 0, 1)]
    assert [len(x) for x in passages.joined(tokens, *(np.empty(0, np.int64),) * 3)] == [0, 0, 0]
