"""Grouped prefix join: documents whose sets of k-word shingles are similar, and their components.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set is its distinct k-word shingles (fewer
words: the whole sequence as one; none: empty, linked with nothing).

1. A fixed-size sketch counts all shingles of all texts. Sets are ordered by (sketched count, hash), rare
   shingles first; similar sets must then share a shingle in their prefixes. Any order gives the same links: the
   sketch only keeps passages that many documents share out of the prefixes.
2. Equal sets collapse into a class, and classes with identical prefixes and size into a group.
3. Groups that share a prefix shingle are paired and filtered by size, by the number of prefix shingles they
   share and by how many bits of their parity bitmaps differ. The survivors are expanded to classes and verified on
   whole texts.
4. Since components are asked for, a large family is not paired with itself: first every group is verified against one
   representative of each prefix shingle (and every class against its group's): the one whose prefix is most common,
   from which a family's copies come, then another drawn at random; then all pairs that still lie in different
   components are verified, none left out.

Null and empty texts get size 0 and stand alone. Documents with a null id are components of their own text class.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, append_columns, forget, row_keys, slices, stored
from .components import components
from .textarrays import LOWER, mix, shingles, span_hashes, texts, words

#: Counters of the sketch: four bytes each, whatever the input's size.
SKETCH_BITS = 21
CHUNKS = 64
ROUNDS = 2
#: 64-bit words of a set's parity bitmap: two sets differ in at least as many shingles as their bitmaps differ in bits.
BITMAP_WORDS = 8
SET = ["set_hash", "set_check"]
BITMAP = [f"bits{i}" for i in range(BITMAP_WORDS)]


def shingle_sets(piece: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, bounds = texts(piece.column(column))
    data = LOWER[data]
    starts, ends, first = words(data, bounds)
    hashes = span_hashes(data, starts, ends)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingles(hashes[a:b], k))


def sketch_counts(docs: DataFrame, k: int, text: str = "text") -> np.ndarray:
    """How many texts have a shingle in each counter's share of the hash space; 4 * 2**21 bytes in all.

    Tasks count whole partitions; their counters are added up chunk by chunk on the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for piece in slices(batch, text):
                for s in shingle_sets(piece, text, k):
                    held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                    size += len(s)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint32)
        parts = total.reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, v in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(v, dtype=np.uint32)
                sums[c] = sums[c] + part if c in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])

    rows = docs.select(text).mapInArrow(count, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros((CHUNKS, (1 << SKETCH_BITS) // CHUNKS), dtype=np.uint32)
    for row in rows.collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return out.ravel()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def profiles(docs: DataFrame, k: int, num: int, den: int, text: str = "text") -> DataFrame:
    """Add n_shingles, set_hash and set_check (128 bits that name a set), group_hash, weight and prefix (shingles of the set's prefix, in order) to each row; drops the text.

    ``weight`` is the mean of the logarithms of the prefix's sketched counts: of a family, the text that the others
    are copies of has the largest, as every change puts rare shingles into the prefix.
    """
    counts = docs.sparkSession.sparkContext.broadcast(sketch_counts(docs, k, text))

    def make() -> Callable[[pa.RecordBatch], list]:
        frequency = counts.value

        def step(piece: pa.RecordBatch) -> list:
            sizes, sets, checks, groups, weights, prefixes = [], [], [], [], [], []
            bits = BITMAP_WORDS * 64
            bitmaps = np.zeros((piece.num_rows, bits), dtype=np.uint8)
            for s in shingle_sets(piece, text, k):
                n = len(s)
                sizes.append(n)
                if not n:
                    sets.append(0)
                    checks.append(0)
                    groups.append(0)
                    weights.append(0.0)
                    prefixes.append(s.view(np.int64))
                    continue
                # powers of two of the count: finer steps would let noise decide
                scale = np.log2(frequency[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] + 1.0)
                p = prefix_length(n, num, den)
                order = np.lexsort((s, scale.astype(np.int64)))[:p]
                weights.append(float(scale[order].mean()))
                prefix = s[order].view(np.int64)
                bitmaps[len(sizes) - 1] = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                # sums of mixed hashes name a set, whatever its order
                for out, salt in ((sets, 1), (checks, 3)):
                    out.append(int(mix(mix(s ^ np.uint64(salt)).sum(keepdims=True)).view(np.int64)[0]))
                groups.append(int(mix(mix(prefix.view(np.uint64) ^ np.uint64(2)).sum(keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                prefixes.append(prefix)
            offsets = pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])], pa.int32())
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            packed = np.packbits(bitmaps, axis=1, bitorder="little").view("<i8")
            return [*[pa.array(x, pa.int64()) for x in (sizes, sets, checks, groups)], pa.array(weights, pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())), *[pa.array(packed[:, i].copy()) for i in range(BITMAP_WORDS)]]

        return step

    fields = [T.StructField(c, T.LongType()) for c in ("n_shingles", "set_hash", "set_check", "group_hash")] + [T.StructField("weight", T.DoubleType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    fields += [T.StructField(c, T.LongType()) for c in BITMAP]
    return append_columns(docs, make, fields, text).drop(text)


def least_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """The smallest intersection of sets of sizes a and b at the threshold."""
    return F.ceil(F.lit(num) * (a + b) / F.lit(num + den))


def may_link(n_a: Column, n_b: Column, shared: Column, num: int, den: int) -> Column:
    """What sizes and the number of shared prefix shingles allow.

    Beyond the end of the shorter-reaching prefix, at most that set's other shingles can be common.
    """
    rest = lambda n: F.ceil(n * num / den) - 1  # noqa: E731  what is behind the prefix
    return (F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num) & (shared + F.greatest(rest(n_a), rest(n_b)) >= least_overlap(n_a, n_b, num, den))


def may_be_equal_enough(a: str, b: str, n_a: Column, n_b: Column, num: int, den: int) -> Column:
    """What the parity bitmaps allow: a shingle of one set alone flips one bit, so differing bits are at most the differing shingles."""
    differ = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))).cast("long") for c in BITMAP), F.lit(0))
    return differ <= n_a + n_b - least_overlap(n_a, n_b, num, den) * 2


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes whose whole texts link, and the table of texts that they are found in; ``docs`` has the keys and text."""
    needed = pairs.select("a").union(pairs.select(F.col("b"))).distinct()
    bodies = classes.select("class", *KEY).join(needed.withColumnRenamed("a", "class"), "class", "left_semi").join(docs, KEY).select("class", "text").dropDuplicates(["class"])
    bodies = stored(bodies, "bodies")
    both = pairs.join(bodies.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(bodies.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in slices(batch, "text_a"):
                for piece in slices(half, "text_b"):
                    known: dict[int, np.ndarray] = {}
                    for side in "ab":
                        ids = piece.column(side).to_pylist()
                        fresh = [i for i, c in enumerate(ids) if c not in known]
                        fresh = list({ids[i]: i for i in fresh}.values())
                        known.update(zip([ids[i] for i in fresh], shingle_sets(piece.take(pa.array(fresh, pa.int64())), f"text_{side}", k), strict=True))
                    keep = []
                    for a, b in zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True):
                        x, y = known[a], known[b]
                        merged = np.concatenate([x, y])
                        merged.sort()
                        both_have = int((merged[1:] == merged[:-1]).sum())
                        keep.append(den * both_have >= num * (len(merged) - both_have))
                    yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), bodies


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, row_check, doc_id, n_shingles, class, root, component_id) of every document.

    ``class`` numbers equal sets and ``root`` components, both null without words; ``component_id`` is the smallest id reachable over links of at least num/den.
    ``row_key`` and ``row_check`` are hashes of id and text, equal for rows that repeat both.
    """
    keyed = docs.select(*row_keys(id, text), F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(profiles(keyed, k, num, den), "profiles")
    some = rows.where("n_shingles > 0")
    classes = some.groupBy(*SET).agg(F.min(F.struct(*KEY)).alias("r"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("group_hash").alias("group"), F.first("weight").alias("weight"), F.first("prefix").alias("prefix"), *[F.first(c).alias(c) for c in BITMAP])
    # written, so a class keeps its number
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "*", "r.*").drop("r"), "classes")
    members = classes.select("class", "group", "n")
    # by the prefix itself: should two have one hash, they stay two groups with that name, and only more is verified
    groups = stored(classes.groupBy("group", "n", "prefix").agg(F.min("class").alias("lead"), F.first("weight").alias("weight"), F.count("*").alias("size")), "groups")
    tokens = groups.select("group", "lead", "n", "weight", F.posexplode("prefix").alias("pos", "token"))
    # only shingles in two or more prefixes can pair groups
    shared = tokens.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1")
    tokens = stored(tokens.join(shared, "token").drop("uses"), "tokens")
    label = stored(classes.select(F.col("class").alias("node"), F.col("class").alias("root")), "labels")
    prefixes = classes.select("class", "n", "prefix", *BITMAP)

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs of classes that sizes and shared prefix shingles allow."""
        side = lambda x: prefixes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"), *[F.col(c).alias(f"{x}_{c}") for c in BITMAP])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        alike = may_be_equal_enough("a_", "b_", F.col("n_a"), F.col("n_b"), num, den)
        return both.where(alike & may_link(F.col("n_a"), F.col("n_b"), F.size(F.array_intersect("p_a", "p_b")), num, den)).select("a", "b")

    def look_at(pairs: DataFrame, tag: str) -> None:
        """Verify pairs and merge the components that they link; the new links join roots, so their graph shrinks from round to round."""
        nonlocal label
        pairs = stored(filtered(pairs), f"{tag}-pairs")
        if pairs.isEmpty():
            return
        links, bodies = verified(pairs, classes, keyed.select(*KEY, "text"), k, num, den)
        side = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        between = stored(links.join(side("a"), "a").join(side("b"), "b").select("root_a", "root_b").where("root_a <> root_b").distinct(), f"{tag}-links")
        forget(pairs, bodies)
        if between.isEmpty():
            return
        roots = components(between, "root_a", "root_b", "links").select(F.col("node").alias("old"), F.col("root").alias("new"))
        before = label
        label = stored(label.join(roots, label["root"] == roots["old"], "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
        forget(before, between)

    # rounds with representatives, the first with central ones: stars instead of all pairs of a family
    for i in range(ROUNDS):
        salt = F.lit(i)
        here = tokens.join(label.select(F.col("node").alias("lead"), "root"), "lead") if i else tokens.withColumn("root", F.col("lead"))
        drawn = F.xxhash64(salt, "root", "lead")
        star = here.groupBy("token").agg(F.min_by(F.struct("lead", "root", "n"), drawn if i else F.struct(-F.col("weight"), drawn)).alias("r"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        near = here.join(star, "token").where((F.col("lead") != F.col("r.lead")) & (F.col("root") != F.col("r.root")) & (F.least("n", F.col("r.n")) * den >= F.greatest("n", F.col("r.n")) * num))
        pairs = near.select(F.least("lead", F.col("r.lead")).alias("a"), F.greatest("lead", F.col("r.lead")).alias("b"))
        inner = members.join(label.select(F.col("node").alias("class"), "root"), "class")
        chosen = inner.groupBy("group").agg(F.min_by(F.struct("class", "root"), F.xxhash64(salt, "root", "class")).alias("r"), F.count("*").alias("size")).where("size > 1")
        own = inner.join(chosen, "group").where((F.col("class") != F.col("r.class")) & (F.col("root") != F.col("r.root"))).select(F.least("class", F.col("r.class")).alias("a"), F.greatest("class", F.col("r.class")).alias("b"))
        look_at(pairs.union(own).distinct(), f"star{i}")

    # all other pairs: of groups with a common prefix shingle, and within groups, in different components
    by_class = members.join(label.select(F.col("node").alias("class"), "root"), "class")
    keys = tokens.select("token", "pos", "group").join(by_class, "group").select("token", "pos", "n", "class", "root")
    within = by_class.join(groups.where("size > 1").select("group").distinct(), "group").select(F.col("group").alias("token"), F.lit(0).alias("pos"), "n", "class", "root")
    all_keys = keys = stored(keys.union(within), "keys")
    here = keys.groupBy("token", "root").agg(F.count("*").alias("c"), F.min("n").alias("least_n")).groupBy("token")
    main = here.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.min("least_n").alias("least_n")).where("roots > 1").drop("roots")
    # bitmaps join only what still meets another component, in front of what even the smallest set of that shingle needs
    near_front = F.col("pos") <= F.col("n") - least_overlap(F.col("n"), F.col("least_n"), num, den)
    keys = keys.join(main, "token").where(near_front).drop("least_n").join(classes.select("class", *BITMAP), "class")
    light = keys.where("root <> main").select("token", F.col("class").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), *[F.col(c).alias(f"x_{c}") for c in BITMAP])
    # the first common shingle of a pair that links stands so far in front in both sets that all it needs can follow
    needed = least_overlap(F.col("n"), F.col("n_x"), num, den)
    rest = light.join(keys, "token").where(
        (F.col("root") != F.col("root_x"))
        & (F.col("pos") <= F.col("n") - needed)
        & (F.col("pos_x") <= F.col("n_x") - needed)
        & (F.least("n", "n_x") * den >= F.greatest("n", "n_x") * num)
        & may_be_equal_enough("", "x_", F.col("n"), F.col("n_x"), num, den)
    )
    look_at(rest.select(F.least("class", "x").alias("a"), F.greatest("class", "x").alias("b")).distinct(), "rest")

    least = label.join(classes.select(F.col("class").alias("node"), "least_id", *SET), "node")
    roots = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = stored(least.join(roots, "root").select(*SET, F.col("node").alias("class"), "root", "component_id"), "named")
    forget(groups, tokens, all_keys)
    sized = rows.select(*KEY, "doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in SET])
    return sized.join(named, SET, "left").select(*KEY, "doc_id", "n_shingles", "class", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id; the columns are the input's.

    Null and empty texts stand alone and stay. Of rows that repeat id and text one stays; documents with a null
    id give way to any with one, and among equal or null ids the smallest hash of id and text stays.
    """
    found = near_duplicates(docs, k, num, den, id, text)
    alike = found.where("root is not null").select("root", "doc_id", *KEY)
    best = alike.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *KEY)).alias("best")).select("root", *[F.col(f"best.{c}").alias(f"stays_{c}") for c in KEY])
    drop = alike.join(best, "root").where(" or ".join(f"{c} <> stays_{c}" for c in KEY)).select(*KEY).distinct()
    twice = stored(found.groupBy(*KEY).count().where("count > 1").select(*KEY), "twice")
    same = lambda other: [k == other[c] for k, c in zip(row_keys(id, text), KEY, strict=True)]
    kept = docs.join(drop, same(drop), "left_anti")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, same(twice), "left_semi").dropDuplicates([id, text])
    return kept.join(twice, same(twice), "left_anti").unionByName(again)
