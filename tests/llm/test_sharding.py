"""Sharding against a direct version: shuffle, fractional ranks, cuts."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from assay.llm.sharding import SEED, interleave
from tests.llm.frames import ODD, documents


def direct(rows, shards=24):
    by = defaultdict(list)
    for r in rows:
        body = (r[1] or "").encode()
        size, crc = len(body) + 8, zlib.crc32(body)
        name = f"{SEED}|{'' if r[0] is None else r[0]}|{size}|{crc}"
        drawn = int(hashlib.md5(name.encode()).hexdigest()[:15], 16)
        by[r[3] if len(r) > 3 else "s"].append((drawn, r[0] is None, r[0] or 0, size, crc, r[0]))
    order, bins = [], 4 << math.ceil(math.log2(max(len(rows), 1)) / 2)
    for source, held in by.items():
        name = f"{SEED}|phase|" + ("0|" if source is None else f"1|{source}")
        phase = Fraction(int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % bins, bins)
        for rank, (*_, size, crc, key) in enumerate(sorted(held, key=lambda h: h[:5])):
            order.append(((rank + phase) / len(held), source is None, source or "", key, size, crc))
    out, filled = [], Counter()
    for place, (*_, key, size, crc) in enumerate(sorted(order, key=lambda o: o[:3])):
        shard = place * shards // len(order)
        out.append((key, size, crc, shard, filled[shard]))
        filled[shard] += 1
    return sorted(out, key=str)


def run(docs, shards=24):
    got = interleave(docs, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    return sorted(map(tuple, got), key=str)


@pytest.fixture(scope="module")
def hot():
    """A source with a third of the rows, copies of one row by the hundred, one key with many texts, tiny sources."""
    rows = [(n, f"text {n}", "en", "hot" if n % 3 == 0 else f"s{n % 7}") for n in range(2400)]
    rows += [(7, "the same row", "en", "hot")] * 900 + [(8, f"other {n}", "en", None) for n in range(300)]
    return rows + [(5000 + n, None, "en", f"tiny{n}") for n in range(40)]


def test_against_direct(spark, hot):
    docs = documents(spark, hot)
    assert run(docs) == direct(hot)
    assert run(docs.repartition(9), 7) == direct(hot, 7)


def test_shards_hold_the_mixture(spark, hot):
    got = interleave(documents(spark, hot)).collect()
    rows, of = Counter(r.shard for r in got), Counter(r.source for r in got)
    assert set(rows) == set(range(24)) and max(rows.values()) - min(rows.values()) <= 1
    held = Counter((r.shard, r.source) for r in got)
    for source, n in of.items():
        assert all(abs(held[s, source] - n / 24) <= 2 for s in range(24))
    tiny = Counter(r.shard for r in got if (r.source or "").startswith("tiny"))
    assert len(tiny) > 12 and max(tiny.values()) < 8
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(rows[s]))


def test_odd_rows(spark):
    assert run(documents(spark, ODD)) == direct(ODD)
    assert run(documents(spark, [])) == [] and run(documents(spark, [(None, None)])) == [(None, 8, 0, 0, 0)]
    assert run(documents(spark, ODD), 1) == direct(ODD, 1)


def test_plan_has_no_python_and_one_small_window(spark, hot):
    plan = interleave(documents(spark, hot))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
