"""What a step of a task costs: memory for each byte of text, and how often pieces are replayed."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from tracewell.llm import bpe, suffix_dedup, token_shards
from tracewell.llm.common import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_runs_and_buckets_take_few_bytes_for_each_byte_of_text():
    data = np.random.default_rng(5).integers(97, 123, 1 << 20).astype(np.uint8)
    data[600_000:601_000] = data[:1_000]
    bounds = np.r_[0 : len(data) : 4096, len(data)]
    suffix_dedup.anchor_runs(data, bounds, 400)  # powers are made once a worker
    assert peak(lambda: suffix_dedup.anchor_runs(data, bounds, 400)) < 64 * len(data)
    assert peak(lambda: suffix_dedup.repeated_starts(data.astype(np.int16), 400)) < 80 * len(data)


def test_new_pieces_of_many_texts_are_replayed_at_once():
    r = random.Random(8)
    values = [" ".join("".join(r.choices("abcdefghijé", k=r.randint(1, 14))) for _ in range(400)) for _ in range(1000)]
    coder, calls = bpe.Encoder(bpe.read_ranks(RANKS)), []
    replay = coder.vocabulary.replay
    coder.vocabulary.replay = lambda words: calls.append(len(words)) or replay(words)
    data = "".join(values).encode()
    bounds = np.r_[0, np.cumsum([len(v.encode()) for v in values])]
    ids, first = coder.encode(np.frombuffer(data, np.uint8), bounds)
    assert len(data) > 3 << 20 and len(calls) == 1 and first[-1] == len(ids)
    assert list(coder.decode(ids, first)[1]) == list(bounds)
    one = bpe.Encoder(bpe.read_ranks(RANKS))
    for i in (0, 500, 999):
        text = np.frombuffer(values[i].encode(), np.uint8)
        assert one.encode(text, np.r_[0, len(text)])[0].tolist() == ids[first[i] : first[i + 1]].tolist()


def test_training_order_encodes_in_steps_of_many_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["some words " * 400] * 850)], names=["text"])
    assert batch.nbytes > 3 << 20 and len(list(slices(batch, "text", token_shards.STEP))) == 1


def test_text_ranges():
    assert list(bpe.text_ranges(np.array([0, 3, 3, 9, 10, 30, 30]), 9)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(bpe.text_ranges(np.array([0]), 9)) == []
