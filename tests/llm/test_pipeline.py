"""The pipeline's stages, one after the other, on the smallest tables."""

import os

import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tracewell.llm.common import stored
from tracewell.llm.queries import rank_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def shingle_set(text, k=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_stages(spark):
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stored(stage(spark, docs, SF), f"test{k}")
        assert docs.columns == columns
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert set(texts[-1]) <= set(texts[-2]) and texts[-1]
    # nothing but the passages changes texts
    assert all(texts[i][d] == t for i in (0, 1, 3) for d, t in texts[i + 1].items())
    # one document of each component: what went has a kin in the input, and what stays has none
    sets = {d: shingle_set(t) for d, t in texts[1].items()}
    alike = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    stay = sorted(texts[2])
    assert all(any(alike(sets[d], s) for e, s in sets.items() if e != d) for d in set(sets) - set(stay))
    assert not any(alike(sets[a], sets[b]) for i, a in enumerate(stay) for b in stay[:i])
    # no repeated passage is left that was in the input of that stage
    n = corpus_pipeline.PASSAGE_BYTES
    seen = set()
    for t in texts[3].values():
        raw = t.encode()
        windows = {raw[i : i + n] for i in range(len(raw) - n + 1)}
        assert not windows & seen
        seen |= windows
    # the ids are those of the tiktoken library
    coder = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(rank_path()), special_tokens={})
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts[4])
    for r in rows:
        want = coder.encode_ordinary(texts[4][r["doc_id"]])
        assert r["n_tokens"] == len(want) and bytes(r["token_ids"]) == b"".join(i.to_bytes(4, "little") for i in want)
