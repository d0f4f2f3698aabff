"""Lists that are split into blocks give the same pairs as a loop over all pairs."""

import random

import numpy as np
import pandas as pd

from mnemolake.llm import minhash_dedup as m


def _rows():
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(80)]
    rows = []
    for node in range(70):
        changed = rng.sample(range(80), rng.choice((2, 6, 12, 20)))
        shingles = [rng.getrandbits(62) if i in changed else s for i, s in enumerate(base)][: rng.choice((80, 80, 76, 62))]
        keys = rng.sample(range(1, 5), 2)
        bits = m.long_signature(pd.Series([np.array(shingles, np.int64)]))[0].tolist()
        rows.append((node, node % 50, len(shingles), len(shingles), keys, bits))
    return rows


def _expected(rows):
    pairs = set()
    for a in rows:
        for b in rows:
            differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[5], b[5]))
            first = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[5][: m.FIRST // 64], b[5]))
            if (
                (a[2], a[0]) < (b[2], b[0]) and a[1] != b[1] and a[2] * 100 >= b[2] * m.PERCENT and set(a[4]) & set(b[4])
                and min(a[3], b[3]) * 175 >= (a[2] + b[2]) * 75 and differ <= m.LONG_DIFFER and first <= m.FIRST_DIFFER
            ):
                pairs.add((a[0], b[0]))
    return pairs


def test_blocks_of_lists(spark, monkeypatch):
    rows = _rows()
    able = spark.createDataFrame(rows, "node long, root long, n int, mass long, keys array<long>, long array<long>")
    expected = _expected(rows)
    assert len(expected) > 20
    for block in (7, 2048):
        monkeypatch.setattr(m, "BLOCK", block)
        got = [tuple(r) for r in m._met(able).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_no_lists(spark):
    able = spark.createDataFrame([], "node long, root long, n int, mass long, keys array<long>, long array<long>")
    assert m._met(able).count() == 0
