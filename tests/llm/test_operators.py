"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewell.llm import bpe, decontaminate, language_id, ngram_join, quality_model, quality_rules, sharding, suffix_dedup, token_shards, warc
from tracewell.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnopqrst", k=3 + i % 6)) for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): families of copies, shared passages, junk, nulls and a very long text."""
    r = random.Random(7)
    passage, rows = prose(r, 90), []
    for _ in range(40):
        rows.append(prose(r, r.randint(1, 200)))
    base = prose(r, 150)
    for _ in range(15):
        words = base.split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        rows.append(" ".join(words))
    rows += [rows[3]] * 4 + [f"{prose(r, 30)} {passage} {prose(r, 40)}" for _ in range(6)]
    rows += [None, "", " \n\t ", "one", "Two words", "one", "A b C\nA b C\n\n!!! $$$ | # é ß 日本", prose(r, 6000), "x" * 3000, "ab" * 900, base.upper(), "''s it's x  y"]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, f"src{i % 3}" if i % 7 else None, "kept") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(5).cache()


def plain(frame, *keys):
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row for row in frame.collect()}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(60)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(corpus, k):
    out = {}
    for i, text in corpus:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(k, len(words))
        out[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} if n else set()
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (3, 50)])
def test_ngram_join(docs, corpus, k, num):
    sets = brute_sets(corpus, k)
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = plain(ngram_join.near_duplicates(docs, k, num), "doc_id")
    assert {i: (row.n_shingles, row.component_id) for i, row in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    kept = ngram_join.keep_one(docs, k, num)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == sorted({find(i) for i in sets})


def brute_removed(corpus, length):
    where = defaultdict(list)
    for n, (i, text) in enumerate(corpus):
        data = (text or "").encode()
        for a in range(len(data) - length + 1):
            where[data[a : a + length]].append((n, a))
    gone = [bytearray(len((t or "").encode())) for _, t in corpus]
    for places in where.values():
        if len(places) > 1:
            for n, a in places:
                gone[n][a : a + length] = b"\1" * length
    return gone


@pytest.mark.parametrize(("length", "hot"), [(60, 2_000), (400, 2_000), (60, 1)])
def test_suffix_dedup(spark, docs, corpus, length, hot):
    gone = brute_removed(corpus, length)
    got = plain(suffix_dedup.remove_repeats(docs, length, hot=hot), "doc_id")
    for (i, text), mask in zip(corpus, gone, strict=True):
        data = (text or "").encode()
        left = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mask)))
        row = got[i]
        assert (bytes(row.kept_bytes), row.n_removed, len(row.removed)) == (left, sum(mask), spans), i
        assert row.shard == "kept"


def test_suffix_dedup_repeated_rows(spark):
    text = "".join(random.Random(2).choices("abcdef", k=500))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text[:450]), (None, None)], "doc_id long, text string")
    got = sorted((row.doc_id or -1, row.n_removed) for row in suffix_dedup.remove_repeats(frame, 400).collect())
    assert got == [(-1, 0), (-1, 450), (1, 500), (1, 500)]


def test_bpe(spark, docs, corpus):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = plain(bpe.decode(bpe.encode(docs, RANKS), RANKS), "doc_id")
    for i, text in corpus:
        ids = known.encode_ordinary(text or "")
        assert bytes(got[i].token_ids) == b"".join(x.to_bytes(4, "little") for x in ids)
        assert bytes(got[i].decoded) == (text or "").encode()
    r = random.Random(5)
    alphabet = " \n\t'stremvld0a1!?éß日½　\x1c_Zq²\U0001f600<|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)] + ["a" * 5000, "<|endoftext|>"]
    assert bpe.encode_texts(texts, bpe.read_ranks(RANKS)) == [known.encode_ordinary(t) for t in texts]


def test_merge_replay_takes_lower_ranks_first():
    """A rank file in which a merge makes a pair of a lower rank."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cab", b"aa", b"aaa"]
    content = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    ranks = {t: i for i, t in enumerate(tokens)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(500)]
    assert bpe.encode_texts(texts, content) == [known.encode_ordinary(t) for t in texts]


def test_quality_counts(docs, corpus):
    got = plain(quality_rules.judge(docs, keys=("source",)), "doc_id")
    for i, text in corpus:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[j : j + 8]) for j in range(len(words) - 7)]
        often = Counter(windows)
        repeat = {j + d for j, w in enumerate(windows) if often[w] > 1 for d in range(8)}
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat))
        row = got[i]
        assert tuple(row[c] for c in quality_rules.COUNTS) == want, i
        assert row.base_failed == (len(words) < 20 or 100 * len(repeat) > 30 * len(words))
        assert not (row.kept and row.base_failed)


def test_quality_sketch(spark):
    """Sketches add up, and their quantiles are within a bucket of the exact ones."""
    r = random.Random(4)
    values = [int(r.lognormvariate(4, 2)) for _ in range(5000)]
    frame = spark.createDataFrame([(v % 2, v) for v in values], "g int, x long")
    merged = quality_rules.sketches(frame, ["g"], ["x"]).groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    row = quality_rules.quantiles(merged, [], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    values.sort()
    for name, q in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
        exact = values[int(len(values) * q) - 1]
        assert row[name] <= exact <= row[name] * (1 + 1 / 64) + 1


def test_sharding(spark, docs, corpus):
    got = sharding.cut(sharding.weighed(docs), 24, partitions=5).collect()
    assert len(got) == len(corpus)
    sizes, slots = Counter(), defaultdict(list)
    for row in got:
        data = (corpus[row.doc_id][1] or "").encode()
        assert (row.size, row.text_crc32) == (len(data) + 8, zlib.crc32(data))
        sizes[row.shard] += row.size
        slots[row.shard].append(row.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    r = random.Random(6)
    frame = spark.createDataFrame([(i, prose(r, r.randint(20, 60)) if i % 3 else "same text") for i in range(3000)], "doc_id long, text string")
    rows = sharding.cut(sharding.weighed(frame), 24).collect()
    sizes = Counter()
    for row in rows:
        sizes[row.shard] += row.size
    mean = sum(sizes.values()) / 24
    assert set(sizes) == set(range(24))
    assert max(sizes.values()) < 1.06 * mean
    assert min(sizes.values()) > 0.9 * mean
    empty = frame.where("doc_id < 0")
    assert sharding.cut(sharding.weighed(empty), 24).count() == 0


def test_language_id(spark):
    r = random.Random(8)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["strz", "och", "eg", "ung"], "cc": ["ção", "inha", "ó", "qu"]}
    word = lambda lang: "".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(r.randint(15, 200))), lang) for i, lang in enumerate(r.choices(list(sounds), k=400))]
    rows += [(1000, None, "aa"), (1001, "12 !? \n", "aa"), (1002, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language_id.dictionaries(frame.where(~language_id.held_out(F.col("doc_id"))))
    got = plain(language_id.identify(frame.withColumn("score", F.lit("x")), known), "doc_id")
    tested = [(i, lang) for i, _, lang in rows if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(tested) > 50
    assert sum(got[i].lang_pred == lang for i, lang in tested) >= 0.95 * len(tested)
    assert all(0 <= row.score <= 1 for row in got.values())
    assert all(got[i].lang_pred == "und" for i in (1000, 1001, 1002))
    assert language_id.identify(frame, {}).where("lang_pred <> 'und'").count() == 0


def test_quality_model(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = prose(r, r.randint(30, 120)).split()
        grade = r.choices([0, 1, 2], [1, 2, 4])[0]
        for _ in range(3):
            words.insert(r.randrange(len(words)), {0: "fool", 1: "BUY!!", 2: "hence"}[grade])
        rows.append((i, " ".join(words), "x"))
        if i < 600:
            labels.append((i, int(grade == 2), int(grade == 0)))
        else:
            labels.append((i, None, None))
        rows[-1] = (*rows[-1], grade)
    frame = spark.createDataFrame([*rows, (5000, None, "x", 2), (5001, "", "x", 2)], "doc_id long, text string, tail string, truth int")
    model = quality_model.fit(quality_model.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), frame)
    assert all(a < b for a, b in zip(model.thresholds, model.thresholds[1:], strict=False))
    got = [row for row in quality_model.classify(frame, model).collect() if 600 <= row.doc_id < 5000]
    assert sum(row.keep == (row.truth == 2) for row in got) >= 0.97 * len(got)
    mean = lambda g: sum(row.expected_grade for row in got if row.truth == g) / sum(row.truth == g for row in got)
    assert mean(0) < mean(1) < mean(2)
    none = quality_model.fit(spark.createDataFrame([], "doc_id long, grade int"), frame)
    assert none is None
    assert quality_model.classify(frame, none).where("keep").count() == frame.count()


def test_decontamination(spark):
    r = random.Random(10)
    items = [prose(r, r.randint(12, 50)) for _ in range(30)] + ["short item", None, ""]
    rows, truth = [], {}
    for i in range(200):
        words = prose(r, r.randint(5, 150)).split()
        if i % 4 == 0:
            j = r.randrange(30)
            leak = items[j].split()
            if i % 8 == 0 and len(leak) > 35:
                leak[r.randrange(len(leak))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() if i % 3 else w for w in leak]
        if i % 50 == 1:
            words += ["Short,", "item"]
        rows.append((i, " ".join(words)))
    for i, text in rows:
        words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
        for j, item in enumerate(items):
            wanted = re.findall("[a-z0-9]+", (item or "").lower())
            k, n = min(5, len(wanted)), len(wanted)
            if not n:
                continue
            sh = lambda w, k=k: Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
            goal, best = sh(wanted), 0
            for a in range(len(words) - n + 1):
                mine = sh(words[a : a + n])
                best = max(best, Fraction(sum((mine & goal).values()), sum((mine | goal).values())))
            if best >= Fraction(4, 5):
                truth[i, j] = float(best)
    frame = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(row.doc_id, row.item_id): row.similarity for row in decontaminate.leak_pairs(frame, bench).collect()}
    assert len(truth) > 40
    assert got.keys() == truth.keys()
    assert all(abs(got[x] - truth[x]) < 1e-9 for x in truth)
    assert decontaminate.find_leaks(frame, bench.where("item_id < 0")).where(F.size("leaks") > 0).count() == 0


def test_feistel_is_a_bijection():
    import numpy as np

    for total in (1, 2, 3, 17, 1000, 4097):
        slots = token_shards.permute(np.arange(total), total, 11)
        assert sorted(slots.tolist()) == list(range(total))
        assert token_shards.permute(slots, total, 11, back=True).tolist() == list(range(total))
    assert token_shards.permute(np.arange(1000), 1000, 1).tolist() != token_shards.permute(np.arange(1000), 1000, 2).tolist()


def test_token_shards(spark, docs, corpus):
    known = bpe.encode_texts([t or "" for _, t in corpus], bpe.read_ranks(RANKS))
    options = {"length": 32, "shard_bytes": 66 * 40, "key": 5}
    index, read = token_shards.materialise(docs, RANKS, **options)
    index, read = index.collect(), {row.slot: row for row in read.collect()}
    total = len(index)
    assert sorted(read) == sorted(row.slot for row in index) == list(range(total))
    assert sorted(row.sequence for row in index) == list(range(total))
    stream, where = [], {}
    import numpy as np

    for row in sorted(index, key=lambda row: row.sequence):
        got = read[row.slot]
        assert (got.shard, got.row) == (row.shard, row.row) == divmod(row.slot, 40)
        stream += np.frombuffer(bytes(got.tokens), "<u2").tolist()[: row.n_tokens]
        for i in row.doc_ids:
            where.setdefault(i, row.sequence)
    texts, at = [], 0
    for i, x in enumerate(stream):
        if x == 50256:
            texts.append(tuple(stream[at:i]))
            at = i + 1
    assert at == len(stream)
    assert Counter(texts) == Counter(tuple(x) for x in known if x)
    assert set(where) == {i for (i, _), x in zip(corpus, known, strict=True) if x}
    path = spark.conf.get("spark.checkpoint.dir") + "/resume"
    token_shards.write_shards(docs, path, RANKS, **options)
    part = token_shards.read_shards(spark, path, 32, shard_bytes=66 * 40, first_slot=100).collect()
    assert sorted(row.slot for row in part) == list(range(100, total))
    assert token_shards.materialise(docs.where("doc_id < 0"), RANKS, **options)[0].count() == 0


def test_loser_tree():
    r = random.Random(12)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(r.choices(range(50), k=r.randint(0, 40))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


def test_warc(spark):
    r = random.Random(13)
    long_body = prose(r, 40)
    bodies = [long_body, "tiny", None, "", long_body, "tiny", prose(r, 300), "é" * 60, "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 4, long_body, "é" * 60]
    rows = [(i * 3 % 11, f"https://www.site{i % 3}.example.com:80/a/{i}?q={i}#top" if i != 4 else None, b, i) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset int").repartition(3)
    index = warc.capture_index(pages)
    got = index.collect()
    order = [(row.url_key, row.captured, row.page_id) for row in got]
    assert order == sorted(order)
    first = {}
    for i, _, b, _ in rows:
        first[b or ""] = min(i, first.get(b or "", i))
    by = {row.page_id: row for row in got}
    assert len(got) == len(rows)
    for i, _, b, _ in rows:
        data, row = (b or "").encode(), by[i]
        repeat = len(data) >= 100 and first[b or ""] < i
        assert (row.payload_bytes, row.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (row.record_type, row.refers_to) == (("revisit", first[b]) if repeat else ("response", None))
    assert by[1 * 3 % 11].url_key == "com,example,site1)/a/1?q=1"
    assert warc.capture_index(pages.where("page_id < 0")).count() == 0
