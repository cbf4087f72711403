"""Contexts of repeated runs are unpacked together."""

import numpy as np
import pyarrow as pa

from fieldloom.llm.substrings import _packed, _unpacked, _windows_of


def test_contexts_are_unpacked_as_one_by_one():
    rng = np.random.default_rng(3)
    rows, want, sizes = [], [], [0]
    for count in (1, 3, 0, 5):
        own = []
        for most in rng.choice([3, 200, 3000, 90_000], count):
            n = int(rng.integers(1, 36))
            start = np.cumsum(rng.integers(1, most, n))
            end, marks = start + 40, rng.integers(0, 3, n).astype(np.uint8)
            c = {"begin": int(rng.integers(0, 99)), "pick": int(rng.integers(-99, 99)), "start": int(start[0]), "end": int(end[0]), "marks": marks.tobytes(), "starts": _packed(start), "ends": _packed(end)}
            own.append(c)
            assert (_unpacked(c["start"], c["starts"], n) == start).all()
            want += [(c["begin"] + k, start[k], end[k], c["pick"], marks[k] == 2) for k in np.flatnonzero(marks)]
        rows.append(own)
        sizes.append(len(want))
    kind = pa.struct([("begin", pa.int32()), ("pick", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("marks", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
    column = pa.array([[], *rows], pa.list_(kind)).slice(1)
    got, cuts = _windows_of(column)
    assert list(zip(*got, strict=True)) == want and cuts.tolist() == sizes
