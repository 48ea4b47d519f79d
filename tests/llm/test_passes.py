"""Facts and shards by passes, packed numbers, hashes."""

import numpy as np

from quillforge.llm import ngrams
from quillforge.llm import textkernel as tk
from tests.llm.test_quality_whole import SCHEMA, make, rows_of


def test_facts_go_with_the_pass_that_used_them(spark, monkeypatch):
    told = []
    by_shard, drop = ngrams._by_shard, ngrams.drop_part
    monkeypatch.setattr(ngrams, "_by_shard", lambda a, s, f, name: (told.append(name), by_shard(a, s, f, name))[1])
    monkeypatch.setattr(ngrams, "drop_part", lambda s, t, part: (told.append(part), drop(s, t, part))[1])
    ngrams.perplexities(rows_of(spark, [(i, t, True) for i, t in enumerate(make(7, 20, 30))]), SCHEMA, "t")
    at = [i for i, x in enumerate(told) if x == "kn-2"]
    assert len(at) == ngrams.PASSES > 1
    for k, (a, b) in enumerate(zip(at, [*at[1:], told.index("kn-1")])):
        assert set(told[a + 1 : b]) == {f"kind={ngrams.FACT + k}"}


def test_shards_of_passes():
    mixed = [tk.mix(np.arange(i, 20000 + i, dtype=np.uint64)) for i in range(3)]
    own = ngrams._pass_of([ngrams._share(c) for c in mixed])
    for shards in (12, 13, 51, 211):
        got = ngrams._shard_of(mixed, own, shards)
        assert (got % ngrams.PASSES == own).all() and set(got.tolist()) == set(range(shards))
        for k in range(ngrams.PASSES):
            some = own == k
            assert (ngrams._shard_of([c[some] for c in mixed], k, shards) == got[some]).all()


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for kind in (np.int32, np.int64, np.uint64):
        for n in (0, 1, 1000):
            for most in (1, 200, 70000, 1 << 30):
                x = rng.integers(0, most, n).astype(kind)
                assert (tk.unsqueeze(tk.squeeze(x), n, kind) == x).all()
    x = np.array([3, -1, -(1 << 40)])
    assert (tk.unsqueeze(tk.squeeze(x), 3, np.int64) == x).all()


def test_hashes_across_pieces():
    """A word's hash is that of its bytes alone, wherever it stands."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in [*rng.integers(1, 12, 60000), tk.PIECE + 5, 3]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    assert data.size > 3 * tk.PIECE
    got = tk.Words(data, np.array([0, data.size]), tk.SPACED).hashes()
    code, base, rest = tk._CODE.tolist(), int(tk._BASE), (1 << 64) - 1
    for i in [*range(0, len(words) - 2, 997), len(words) - 2, len(words) - 1]:
        total, power = 0, 1
        for b in words[i]:
            total, power = (total + code[b] * power) & rest, power * base & rest
        assert got[i] == tk.mix(np.array([total ^ (len(words[i]) * int(tk._MULT) & rest)], np.uint64))[0]
