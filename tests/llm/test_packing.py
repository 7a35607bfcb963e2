import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P

SCHEMA = "doc_id long, text string, sequence_id string"


@pytest.mark.parametrize("seed", range(40))
def test_plan_keeps_every_item_and_fits(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    counts = Counter(int(x) for x in rng.integers(1, capacity + 1, rng.integers(1, 80)))
    first = P.best_fit(counts, capacity)
    last = P.improve(first, capacity)
    held = Counter()
    for pattern, n in last.items():
        assert sum(pattern) <= capacity and n > 0
        for length in pattern:
            held[length] += n
    assert held == counts and sum(last.values()) <= sum(first.values())
    squares = [sum(n * sum(p) ** 2 for p, n in bins.items()) for bins in (first, last)]
    assert squares[1] >= squares[0]


def test_swaps_empty_a_bin():
    bins = Counter({(6, 3): 1, (5, 4): 1, (2,): 1})  # 20 tokens, 10 a bin: two bins hold them all
    assert sum(P.improve(bins, 10).values()) == 2


def test_many_tiny_pieces():
    """Donors of far more than 64 pieces give two for one, too."""
    bins = P.improve(Counter({(1,) * 90: 1, (51, 50) : 3, (2,) * 49: 1}), 128)
    held = Counter()
    for pattern, n in bins.items():
        held.update({length: count * n for length, count in Counter(pattern).items()})
        assert sum(pattern) <= 128
    assert held == Counter({1: 90, 51: 3, 50: 3, 2: 49}) and sum(bins.values()) == 4  # 491 tokens
    assert sum(P.improve(Counter({(3,) * 70 + (2,): 1, (250,): 1, (6, 1) : 1}), 256).values()) == 2


@pytest.mark.parametrize("seed", range(12))
def test_no_bin_more_than_the_best(seed):
    """Against the least number of bins by exhaustive search on small inputs."""
    rng = np.random.default_rng(100 + seed)
    items = sorted((int(x) for x in rng.integers(1, 11, 9)), reverse=True)

    def least(left, gaps):
        if not left:
            return len(gaps)
        fits = [least(left[1:], tuple(sorted((*gaps[:i], g - left[0], *gaps[i + 1 :])))) for i, g in enumerate(gaps) if g >= left[0] and g not in gaps[:i]]
        return min([*fits, least(left[1:], tuple(sorted((*gaps, 10 - left[0]))))])

    counts = Counter(items)
    assert sum(P.improve(P.best_fit(counts, 10), 10).values()) <= least(items, ()) + 1


def test_cut():
    assert P.cut(1024, 1024) == [(0, 1024)]
    assert P.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_against_tokenizers(spark):
    documents = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    odd = ["", None, "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y" * 400, "<|endoftext", "<|pad|> é <|endoftext|>", "日本語 text wide   nbsp", "a" * 5000, "tab\t\n\r\n  end  ", "\x1c\x85é", documents[0]["text"], "word " * 30000]
    rows = [(d["doc_id"], d["text"], "x") for d in documents] + [(None if i == 1 else 10_000 + i // 2, t, "y") for i, t in enumerate(odd)]
    got = P.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted.update((doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(P.cut(len(ids), 1024)))
    assert Counter(tuple(r)[:5] for r in got) == wanted
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 1024) * 1.25 + 5


def test_empty_and_sequences(spark):
    assert P.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    out = P.packed_sequences(spark.createDataFrame([(1, "ab cd", "s"), (2, None, "s"), (2, "ab cd", "s")], SCHEMA)).collect()
    assert len(out) == 1 and sorted(out[0].doc_ids) == [1, 2, 2] and sum(i == 2 for i in out[0].ids) == 3
