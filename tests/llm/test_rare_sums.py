"""Sums over packed postings."""

import time

import numpy as np
import pyarrow as pa
from lumenry.llm import maxent


def _postings(rng, batches, rows):
    """(batch, data, c) rows sorted by batch: one to three words of place and count each."""
    out = []
    for b in range(batches):
        for n, c in zip(rng.integers(1, 4, rows), rng.integers(0, 9, rows), strict=True):
            words = (rng.integers(0, 50, n) << 16 | rng.integers(1, 9, n)).astype("<u4")
            out.append((b << 32, words.tobytes(), int(c)))
    return out


def _arrow(rows, size):
    whole = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["batch", "data", "c"])
    return [whole.slice(0, 0), *(whole.slice(at, size) for at in range(0, len(rows), size))]


def test_sums_equal_a_walk_whatever_the_arrow_batches():
    rows = _postings(np.random.default_rng(5), 7, 40)
    for size in (1, 13, 40, 1000):
        got = {}
        for r in maxent._add_up(iter(_arrow(rows, size))):
            assert r["batch"][0] not in got
            got[r["batch"][0]] = {int(i): (k, s) for i, k, s in zip(np.frombuffer(r["i"][0], "<u2"), np.frombuffer(r["known"][0], "<f8"), np.frombuffer(r["logs"][0], "<f8"), strict=True)}
        want = {}
        for b, data, c in rows:
            for x in np.frombuffer(data, "<u4").tolist():
                k, s = want.setdefault(b, {}).get(x >> 16, (0.0, 0.0))
                want[b][x >> 16] = k + (x & 0xFFFF) * (c > 0), s + (x & 0xFFFF) * np.log10(c + 1)
        assert {b: set(x) for b, x in got.items()} == {b: set(x) for b, x in want.items()}
        assert all(np.allclose(got[b][i], want[b][i]) for b in want for i in want[b])
    assert not list(maxent._add_up(iter([])))


def test_postings_cost_no_python_step_each():
    n = 600_000
    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, 4 * n + 1, 4, dtype=np.int32).tobytes()), pa.py_buffer(np.full(n, 3 << 16 | 2, "<u4").tobytes())])
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), data, pa.array(np.ones(n, np.int64))], names=["batch", "data", "c"])
    before = time.process_time()
    (got,) = maxent._add_up(iter([rows.slice(at, 1000) for at in range(0, n, 1000)]))
    assert time.process_time() - before < 1.0
    assert np.frombuffer(got["known"][0], "<f8").tolist() == [2.0 * n]
