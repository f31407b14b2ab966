"""Two blocks of a bucket against a plain loop over pairs."""

import numpy as np
import pyarrow as pa

from contactweave.llm import neardup


def test_blocks_meet_every_pair_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, np.uint64)
    sets = []
    for i in range(60):
        own = rng.integers(0, 2**64, int(rng.integers(5, 90)), np.uint64)
        sets.append(np.unique(np.concatenate([base[len(own) // 2 :], own])))
    registers = [neardup.sketch(s) for s in sets]
    split = [x.reshape(neardup.BANDS, neardup.ROWS) for x in registers]
    block = [i % 2 for i in range(60)]
    root = [i // 3 for i in range(60)]
    got = set()
    for band in range(neardup.BANDS):
        buckets: dict = {}
        for i in range(60):
            buckets.setdefault(split[i][band].tobytes(), []).append(i)
        for members in buckets.values():
            for one, two in ((0, 0), (0, 1), (1, 1)):
                m = [i for i in members if block[i] in (one, two)]
                if len(m) < 2:
                    continue
                table = pa.table({
                    "node": pa.array(m, pa.int64()), "root": pa.array([root[i] for i in m], pa.int64()), "top": pa.array([-1] * len(m), pa.int64()),
                    "n_shingles": pa.array([len(sets[i]) for i in m], pa.int64()), "block": pa.array([block[i] for i in m], pa.int32()),
                    "registers": [registers[i].tobytes() for i in m], "fine": pa.array([neardup.fine_sketch(sets[i]) for i in m], pa.list_(pa.int32())),
                    "band": pa.array([band] * len(m), pa.int32()), "i": pa.array([one] * len(m), pa.int32()), "j": pa.array([two] * len(m), pa.int32()),
                })
                for r in neardup.close_pairs(table).to_pylist():
                    assert (r["a"], r["b"]) not in got
                    got.add((r["a"], r["b"]))
    want = set()
    for a in range(60):
        for b in range(a + 1, 60):
            common = len(np.intersect1d(sets[a], sets[b]))
            if root[a] != root[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                want.add((a, b))
    assert len(want) > 100
    assert want <= got
    assert len(got) < 60 * 59 // 2
