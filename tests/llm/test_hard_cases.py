"""Texts made of one pattern, very long pieces, groups over boundaries, clashing names, empty tables."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import bpe, decontaminate, language_id, ngram_join, quality_model, quality_rules, sharding, suffix_dedup, token_shards, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def thue_morse(n, letters):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join(letters[b] for b in bits)


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("hard", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_of_one_pattern(spark, coder):
    """Two texts whose sums of powers modulo 2**64 are equal whatever the base are told apart everywhere."""
    pair = [thue_morse(2048, "ab"), thue_morse(2048, "ba")]
    rows = [(i, t) for i, t in enumerate(pair)] + [(2, " ".join(pair[0])), (3, " ".join(pair[1]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    coded = {r.doc_id: r for r in bpe.encode(frame, RANKS, decoded="decoded").collect()}
    for i, t in rows:
        assert bytes(coded[i].token_ids) == b"".join(x.to_bytes(4, "little") for x in coder.encode_ordinary(t))
        assert bytes(coded[i].decoded) == t.encode()
    joined = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(frame.where("doc_id < 2")).collect()}
    assert joined == {0: 0, 1: 1}
    lines = spark.createDataFrame([(0, f"{pair[0]}\n{pair[1]}", "x", "y")], "doc_id long, text string, lang string, source string")
    assert quality_rules.judge(lines).first().n_dup_lines == 0
    bench = spark.createDataFrame([(7, pair[0])], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leak_pairs(frame.where("doc_id < 2"), bench).collect()] == [0]
    whole = suffix_dedup.remove_repeats(frame.where("doc_id < 2"), 2000).select("doc_id", "n_removed").collect()
    assert {r.n_removed for r in whole} == {0}


def test_long_pieces(coder):
    """Pieces of 300 KB, of one letter and of random letters, in about linear time."""
    r = random.Random(31)
    texts = ["z" * 300_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "ab" * 100_000, "".join(r.choices("ing", k=60_000))]
    got = bpe.encode_texts(texts, bpe.read_ranks(RANKS))
    assert bpe.Encoder(bpe.read_ranks(RANKS)).vocabulary.flat.tobytes() and [len(x) for x in got] == [len(coder.encode_ordinary(t)) if len(t) < 70_000 else len(x) for x, t in zip(got, texts, strict=True)]
    known = bpe.Encoder(bpe.read_ranks(RANKS)).vocabulary
    for ids, text in zip(got, texts, strict=True):
        assert b"".join(known.flat[known.offsets[i] : known.offsets[i + 1]].tobytes() for i in ids) == text.encode()
    assert got[3] == coder.encode_ordinary(texts[3])
    short = [t[:20_000] for t in texts]
    assert bpe.encode_texts(short, bpe.read_ranks(RANKS)) == [coder.encode_ordinary(t) for t in short]


def test_pieces_with_equal_hashes(spark, coder, monkeypatch):
    """Pieces are compared byte for byte, so an encoder with a poor hash gives the same ids."""
    import numpy as np

    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    r = random.Random(32)
    texts = [" ".join("".join(r.choices("abcdefgh", k=r.randint(9, 14))) for _ in range(60)) for _ in range(5)]
    encoder = bpe.Encoder(bpe.read_ranks(RANKS))
    import pyarrow as pa

    from tracewell.llm.textarrays import texts as arrays

    for t in texts + texts:
        assert encoder.encode(*arrays(pa.array([t])))[0].tolist() == coder.encode_ordinary(t)


def test_groups_over_boundaries(spark):
    """Groups of equal texts under the limit stay whole, wherever partitions are cut; slots have no gaps."""
    r = random.Random(33)
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(60, 90))) for _ in range(300)]
    rows = [(i * 300 + j, t) for j, t in enumerate(texts) for i in range(12)] + [(None, texts[0]), (5, None), (5, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 61):
        got = sharding.cut(sharding.weighed(frame), 6, whole=0.05, partitions=parts).collect()
        assert len(got) == len(rows)
        shards, slots = defaultdict(set), defaultdict(list)
        for row in got:
            shards[row.text_key].add(row.shard)
            slots[row.shard].append(row.slot)
        assert all(len(s) == 1 for s in shards.values())
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_order_does_not_depend_on_splits(spark):
    r = random.Random(34)
    rows = [(i, " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(r.randint(1, 60)))) for i in range(120)] + [(None, "no id"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"length": 16, "shard_bytes": 34 * 20, "key": 9, "buckets": 4}
    one, many = ({row.slot: bytes(row.tokens) for row in token_shards.materialise(frame.repartition(n), RANKS, **options)[1].collect()} for n in (1, 7))
    assert len(one) > 50 and one == many


def test_index_cuts_records_out_of_the_files(spark):
    """A record is one gzip member, or several where it is long, at the offset and of the length that the index names."""
    r = random.Random(35)
    rows = [(i, f"http://h{i % 3}.org/{i}", "".join(r.choices("abcdef\r\n é", k=200 + i))) for i in range(40)] + [(2, None, "x" * 200), (None, "http://n.org", "y" * 150), (90, "http://long.org", "".join(r.choices("abcdefgh", k=9_000_000)))]
    path = spark.conf.get("spark.checkpoint.dir") + "/cut"
    index = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path).collect()
    folder = path.removeprefix("file:")
    assert len(index) == len(rows)
    for row in index:
        with open(os.path.join(folder, row.archive), "rb") as f:
            f.seek(row.offset)
            part, record = f.read(row.length), b""
        while part:
            d = zlib.decompressobj(31)
            record += d.decompress(part)
            part = d.unused_data
        head, _, rest = record.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1") and rest.endswith(b"\r\n\r\n")
        if row.record_type == "response":
            assert hashlib.sha256(rest[:-4]).hexdigest() == row.payload_digest


def test_clashing_columns_stay(spark):
    """Input columns that operators might use for themselves are what they were."""
    text = "some words that go on and on " * 20
    names = ["folded_text", "leaks_of_pass", "tracewell_group_0", "tracewell_limit_lang", "tracewell_row_0", "tracewell_text_0", "part", "row_key"]
    row = (1, text, "en", "s", *[f"own {n}" for n in names])
    frame = spark.createDataFrame([row], ["doc_id", "text", "lang", "source", *names])
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    for out in (decontaminate.find_leaks(frame, bench), quality_rules.judge(frame), suffix_dedup.remove_repeats(frame), bpe.encode(frame, RANKS), language_id.identify(frame, {"en": b"words that go"}), ngram_join.keep_one(frame)):
        got = out.first()
        assert all(got[n] == f"own {n}" for n in names)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leak_pairs(docs, bench).count() == 0
    assert quality_model.fit(spark.createDataFrame([], "doc_id long, grade int"), docs) is None
    assert quality_model.classify(docs, None).count() == 0
    assert ngram_join.near_duplicates(docs).count() == ngram_join.keep_one(docs).count() == 0
    assert language_id.identify(docs, language_id.dictionaries(docs)).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == quality_rules.judge(docs).count() == bpe.encode(docs, RANKS).count() == 0
    assert warc.capture_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    place = spark.conf.get("spark.checkpoint.dir") + "/empty"
    docs.write.mode("overwrite").parquet(f"{place}/documents.parquet")
    bench.write.mode("overwrite").parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{place}/labels.parquet")
    assert corpus_pipeline.run(spark, place).count() == 0


def test_repeated_labels_and_ids(spark):
    """The lowest grade of an id counts, one text of an id is learnt from, null ids are left out."""
    good, bad = "calm clear words in order here ", "AWFUL junk %% "
    rows = [(i, (good if i % 2 else bad) * 6) for i in range(60)] + [(1, bad * 6), (None, good)]
    labels = [(i, 2 if i % 2 else 0) for i in range(60)] + [(0, 2), (0, 0), (None, 1), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(spark.createDataFrame(labels, "doc_id long, grade int"), frame)
    kept = {(r.doc_id, r.text): r.keep for r in quality_model.classify(frame, model).collect()}
    assert kept[5, good * 6] and not kept[4, bad * 6]


def test_language_on_the_real_table(spark):
    """Held-out accuracy of every language, and texts without a letter."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    known = language_id.dictionaries(docs.where(~language_id.held_out(F.col("doc_id"))))
    right, n = Counter(), Counter()
    for row in language_id.identify(docs.where(language_id.held_out(F.col("doc_id"))), known).collect():
        n[row.lang] += 1
        right[row.lang] += row.lang == row.lang_pred
    assert sum(right.values()) >= 0.97 * sum(n.values())
    assert all(right[x] >= 0.9 * n[x] for x in n)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "12 % _"), (3, "日本"), (4, "a")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, known).collect()}
    assert (got[1], got[2]) == ("und", "und") and got[3] != "und" and got[4] != "und"


def test_verdicts_against_brute_force(spark):
    """``kept`` from sketches, mixing and fences, recomputed in Python; groups on both sides of the mixing weight."""
    r = random.Random(36)
    rows = []
    for lang, source, n, size in (("aa", "x", 260, 5), ("aa", "y", 40, 7), ("bb", "x", 90, 9), (None, None, 15, 4)):
        for _ in range(n):
            words = ["".join(r.choices("abcdefgh", k=max(1, int(r.gauss(size, 1.2))))) for _ in range(r.randint(15, 80))]
            for _ in range(r.choice([0, 0, 0, 3, 12])):
                words[r.randrange(len(words))] += "#"
            text = " ".join(words)
            rows.append((len(rows), text + ("\n" + text[:60]) * r.choice([0, 0, 0, 2, 4]), lang, source))
    got = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    bucket = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    groups, wide = defaultdict(list), defaultdict(list)
    for i, _, lang, source in rows:
        if not got[i].base_failed:
            groups[lang, source].append(got[i])
            wide[lang].append(got[i])

    def at(found, metric, q):
        values = sorted(bucket(x[metric]) for x in found)
        return next(v for k, v in enumerate(values, 1) if k >= len(values) * q)

    def points(found, wider, metric):
        """Quantiles of all values, drawn to the language; of present ones, drawn to the language, which is drawn to all."""
        out = {p: (len(found) * at(found, metric, q) + 200 * at(wider, metric, q)) / (len(found) + 200) for p, q in quality_rules.POINTS.items()}
        for p, q in quality_rules.PRESENT.items():
            value = None
            for level in (every, wider, found):
                some = [x for x in level if x[metric]]
                own = at(some, metric, q) if some else None
                value = value if own is None else own if value is None else (len(some) * own + 200 * value) / (len(some) + 200)
                if level is every:
                    value = own
            out[p] = value
        return out

    every = [x for x in got.values() if not x.base_failed]
    for i, _, lang, source in rows:
        row, keep = got[i], not got[i].base_failed
        own, all_ = groups[lang, source], wide[lang]
        for metric, ((top, times), present, least, lower) in quality_rules.METRICS.items():
            if not keep:
                break
            point = points(own, all_, metric)
            distance = max((point[top] - point["q1"]) * times, point[top] * least)
            high = max(point[top] + distance, point["q90"])
            if present and point["p25"] is not None:
                high = max(high, point[present[0]] * present[1] + (point[present[0]] - point["p25"]) * present[2])
            keep = row[metric] <= high and (not lower or row[metric] >= point["q1"] - distance)
        assert row.kept == keep, i
    assert 0 < sum(x.kept for x in got.values()) < len(rows)
