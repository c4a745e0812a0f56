"""Problem 5: near-duplicate records with small edits.

Method: an LSH forest.  Every class of equal shingle sets gets MinHash values;
each of ``TREES`` trees has a label for a class, some bits of each of its own
choice of values one after the other, and keeps the classes in the order of their
labels.  Classes whose labels have a prefix of ``DEPTH`` values in common stand in
one region, and the neighbours by longest common prefix in it are candidates: the
prefix grows, region by region, until at most ``REGION`` classes share it.

What such a growing prefix separates is not given up.  The classes of all regions
that were cut are searched exactly as well: two sets that are similar enough have
one of the rarest shingles of each in common (prefix filter), so classes meet at
rare shingles only, however many share a boilerplate.

Candidates pass a comparison of sketches and are then verified exactly on their
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrowmap import bounded, emit, sorted_groups
from tidemark.llm.lookalike import Alike, load
from tidemark.llm.textarrays import TextBatch, mix, successive
from tidemark.operators.components import connected
from tidemark.tables import materialize, small

#: MinHash values of a class; a tree's label is made of DEPTH values and DEEPER further ones, so many bits of each.
VALUES, TREES, DEPTH, DEEPER = 192, 64, 4, 2
BITS = (12,) * DEPTH + (8,) * DEEPER
LOW_BITS = sum(BITS[DEPTH:])
#: Classes a task remembers, so that copies send their keys once.
REMEMBERED = 250_000
#: A region of more classes is cut deeper.
REGION = 64
#: A region with so many classes in a 64th of all is not even brought together: its classes are searched exactly.
HOT = 2_000
#: Classes of a region that one task holds at a time.
HELD = 1_000_000
#: Counters of how frequent a shingle is; only the order of the shingles depends on them.
COUNTERS = 1 << 20
#: Classes that one task compares with all others at one shingle; shingles of more are split.
POSTING = 4096
#: Sketch: two bits of each of the first 64 values, in two words.
SKETCH_VALUES = 64

_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_CHOICE = np.stack([_RNG.permutation(VALUES)[: DEPTH + DEEPER] for _ in range(TREES)])
_SALT = _RNG.integers(0, 1 << 63, (TREES, DEPTH + DEEPER), dtype=np.uint64)
_OTHER = np.uint64(0x6A09E667F3BCC909)


def shingles(texts: list[str | None], words: int, alike: Alike) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word sequences of the folded texts: hash and owner, sorted and unique by (owner, hash); two digests of each text's words."""
    batch = TextBatch([alike.folded(t) for t in texts])
    start, end, owner = batch.words()
    word = batch.span_hash(start, end)
    # Digest of the word sequence, for texts too short for any shingle.
    whole = np.zeros((2, batch.n), np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
        placed = mix(word + mix(place.astype(np.uint64)))
        whole[0, owner[first]] = np.add.reduceat(placed, first)
        whole[1, owner[first]] = np.add.reduceat(mix(placed ^ _OTHER), first)
    gram, at = successive(word, owner, words)
    own = owner[at]
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    keep = np.ones(len(gram), bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])
    return gram[keep], own[keep], mix(whole)


def signatures(gram: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (owners with shingles x VALUES) and those owners."""
    if not len(gram):
        return np.zeros((0, VALUES), np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out = np.empty((VALUES, len(first)), np.uint64)
    # Blocks of whole owners keep the working arrays in cache.
    for a in range(0, len(first), 256):
        b = min(a + 256, len(first))
        lo, hi = first[a], first[b] if b < len(first) else len(gram)
        part, cuts = gram[lo:hi], first[a:b] - lo
        for v in range(VALUES):
            out[v, a:b] = np.minimum.reduceat(part * _MULTIPLY[v] + _ADD[v], cuts)
    return out.T, owner[first]


def set_keys(gram: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every text's set of shingles, of its words where it has none."""
    cls, check = whole.copy()
    if len(gram):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        count = np.diff(np.append(first, len(gram))).astype(np.uint64)
        cls[owner[first]] = mix(np.add.reduceat(mix(gram), first) + count)
        check[owner[first]] = mix(np.add.reduceat(mix(gram ^ _OTHER), first) + count)
    return cls, check


def _index(batch: pa.RecordBatch, words: int, alike: Alike) -> tuple:
    gram, owner, whole = shingles(batch.column(1).to_pylist(), words, alike)
    sig, have = signatures(gram, owner, batch.num_rows)
    n = batch.num_rows
    cls, check = set_keys(gram, owner, whole)
    sketch = np.zeros((2, n), np.uint64)
    bits = (mix(sig[:, :SKETCH_VALUES]) >> np.uint64(62)).astype(np.uint64)
    for v in range(SKETCH_VALUES):
        sketch[v // 32, have] |= bits[:, v] << np.uint64(2 * (v % 32))
    labels = np.zeros((n, TREES), np.uint64)
    for t in range(TREES):
        label = np.zeros(len(have), np.uint64)
        for v, salt, b in zip(_CHOICE[t], _SALT[t], BITS):
            label = (label << np.uint64(b)) | (mix(sig[:, v] ^ salt) >> np.uint64(64 - b))
        labels[have, t] = label
    has = np.zeros(n, bool)
    has[have] = True
    return cls, check, has, sketch, labels


def index(df: DataFrame, id_col: str, text_col: str, words: int, class_bits: int = 64) -> DataFrame:
    """``id, class, check, lo, hi, placed, keys`` of every row.

    ``class`` and ``check`` are keys of the set of shingles (of the word sequence where
    there is no shingle), 128 bits in all: rows that agree in both are copies of each
    other here.  ``keys`` are the labels in all trees; they come with the first row of a
    class in a task; the others, and rows without a shingle, have null.
    """
    mask, alike = np.uint64((1 << class_bits) - 1), load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in bounded(batches, "text", 2 << 20):
            cls, check, has, sketch, labels = _index(batch, words, alike)
            send = has.copy()
            for i in np.flatnonzero(has):
                c = int(check[i])
                send[i] = c not in seen
                seen.add(c)
            if len(seen) > REMEMBERED:
                seen.clear()
            cuts = np.concatenate([[0], np.cumsum(send)]).astype(np.int32) * TREES
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(labels[send].reshape(-1).view(np.int64)), mask=pa.array(~send))
            numbers = [pa.array(x.view(np.int64)) for x in (cls & mask, check, *sketch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(has), lists], ["id", "class", "check", "lo", "hi", "placed", "keys"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInArrow(run, f"id {kind}, class long, check long, lo long, hi long, placed boolean, keys array<long>")


def _pairs_in(order: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within groups; groups of one size are done together."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size):
        if s > 1:
            i, j = np.triu_indices(s, 1)
            base = start[size == s][:, None]
            a.append((base + i).ravel())
            b.append((base + j).ravel())
    return order[np.concatenate(a)], order[np.concatenate(b)]


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(new)))


def _walk(held: int):
    """Neighbours in the trees' orders: pairs ``a, b``, and with a null ``b`` the classes of regions that had to be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        going_on = None
        for group in sorted_groups(batches, "key", low_bits=LOW_BITS, most=held):
            key, cls = (group.column(c).to_numpy() for c in ("key", "class"))
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            # A class comes once from every task that has it.
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls = key[once], cls[once]
            order = np.arange(len(key))
            start, size = _runs(key >> LOW_BITS)
            large = size > REGION
            # A region that comes in parts is a large one to its end.
            large[0] |= going_on == key[0] >> LOW_BITS
            going_on = key[-1] >> LOW_BITS
            a, b = _pairs_in(order, start[~large], size[~large])
            out_a, out_b, cut = [cls[a]], [cls[b]], []
            for s, n in zip(start[large], size[large]):
                part = slice(s, s + n)
                # The common prefix grows value by value; what it leaves together and is small is paired and done.
                done = np.zeros(n, bool)
                for depth in range(DEPTH + 1, len(BITS) + 1):
                    first, count = _runs(key[part] >> sum(BITS[depth:]))
                    ok = (count <= REGION) & ~done[first]
                    i, j = _pairs_in(order[part], first[ok], count[ok])
                    out_a.append(cls[i])
                    out_b.append(cls[j])
                    done[np.repeat(first[ok], count[ok]) + np.arange(count[ok].sum()) - np.repeat(np.cumsum(count[ok]) - count[ok], count[ok])] = True
                cut.append(cls[part])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            yield from emit(schema, a=np.minimum(a, b), b=np.maximum(a, b))
            if cut:
                members = np.unique(np.concatenate(cut))
                yield from emit(schema, a=members, b=pa.nulls(len(members), pa.int64()))

    return run


def _agreeing(x: Column) -> Column:
    """Number of equal 2-bit fields, given the exclusive or of two sketch words."""
    either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
    return F.lit(32) - F.bit_count(either)


def min_agreement(similarity: float) -> int:
    """Equal fields that a pair at ``similarity`` has with all but a 2e-5 chance (4.1 standard deviations)."""
    p = similarity + (1 - similarity) / 4
    return max(0, int(SKETCH_VALUES * p - 4.1 * (SKETCH_VALUES * p * (1 - p)) ** 0.5))


def _agreement() -> Column:
    return _agreeing(F.col("alo").bitwiseXOR(F.col("blo"))) + _agreeing(F.col("ahi").bitwiseXOR(F.col("bhi")))


def _grams(df: DataFrame, id_col: str, text_col: str, words: int, classes: DataFrame) -> DataFrame:
    """``class, grams``: the shingles of ``classes`` (``class, id, own, check``), from the whole text of one member of each."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # An id that stands for several rows may stand for several texts; the keys pick the right one again.
    rows = texts.join(small(classes, 200_000), "id").select("class", "check", "text")
    alike = load()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            gram, owner, whole = shingles(batch.column("text").to_pylist(), words, alike)
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            same = set_keys(gram, owner, whole)[1].view(np.int64) == batch.column("check").to_numpy()
            out = pa.RecordBatch.from_arrays([batch.column("class"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(gram.view(np.int64)))], ["class", "grams"])
            yield out.filter(pa.array(same))

    return rows.mapInArrow(sets, "class long, grams array<long>").groupBy("class").agg(F.first("grams").alias("grams"))


def _rare(counts: np.ndarray, similarity: float):
    """The rarest shingles of every set, as many as two similar enough sets can't do without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            size = np.diff(lists.offsets.to_numpy())
            gram, owner = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), size)
            order = np.lexsort((gram, counts[gram & (COUNTERS - 1)], owner))
            gram, owner = gram[order], owner[order]
            place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
            kept = place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]
            row = pa.array(owner[kept])
            yield pa.RecordBatch.from_arrays([pa.array(gram[kept]), batch.column("class").take(row), pa.array(size[owner[kept]].astype(np.int32)), batch.column("lo").take(row), batch.column("hi").take(row)], ["gram", "class", "size", "lo", "hi"])

    return run


def _exact_candidates(grams: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of the given classes that can be similar enough, met at one of their rarest shingles.

    The order of the shingles is by a fixed number of counters; any order is right,
    this one makes the lists short.  A list of more than ``POSTING`` classes is split.
    """
    grams = materialize(grams, "grams")
    bucket = F.col("gram").bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    held = grams.select(F.explode("grams").alias("gram")).groupBy(bucket.alias("i")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[held.column("i").to_numpy()] = held.column("n").to_numpy()
    rare = grams.join(sketches, "class").mapInArrow(_rare(counts, similarity), "gram long, class long, size int, lo long, hi long")
    rare = materialize(rare, "rare")
    lists = rare.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram", F.ceil(F.col("n") / POSTING).cast("int").alias("parts"))
    met = rare.join(lists, "gram")
    a = met.select("gram", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"), *(F.col(c).alias("a" if c == "class" else "a" + c) for c in ("class", "size", "lo", "hi")))
    b = met.select("gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias("b" if c == "class" else "b" + c) for c in ("class", "size", "lo", "hi")))
    alike = (F.col("a") < F.col("b")) & (F.least("asize", "bsize") >= similarity * F.greatest("asize", "bsize") - 1e-9) & (_agreement() >= min_agreement(similarity))
    return a.join(b, ["gram", "part"]).filter(alike).select("a", "b").distinct()


def _neighbours(indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pairs, cut)``: candidates ``a, b`` of the forest, and the classes of regions that were cut deeper."""
    trees = indexed.select(F.explode("keys").alias("key"), "class").withColumn("region", F.shiftright("key", LOW_BITS))
    # Which regions are hot is estimated from a 64th of the classes; it decides where a class is worked on, not what is found.
    hot = trees.filter(F.xxhash64("class").bitwiseAND(F.lit(63)) == 0).groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT).select("region")
    hot = materialize(hot, "hot")
    some = not hot.isEmpty()
    cold = trees.join(small(hot, 100_000), "region", "left_anti") if some else trees
    walked = cold.select("key", "class").repartition(F.shiftright("key", LOW_BITS)).sortWithinPartitions("key").mapInArrow(_walk(HELD), "a long, b long")
    walked = materialize(walked, "neighbours")
    cut = walked.filter("b is null").select(F.col("a").alias("class"))
    if some:
        cut = cut.union(trees.join(small(hot, 100_000), "region", "left_semi").select("class"))
    return walked.filter("b is not null"), cut.distinct()


def similar_classes(df: DataFrame, id_col: str = "src_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, class_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(membership, links)``.

    ``membership`` has one row ``id, class`` per row with a text; ``links`` one row
    ``a, b, similarity`` (a < b) for every two classes whose sets of ``words``-word
    sequences have at least ``similarity`` of their union in common.  Null texts are
    in neither; texts without any such sequence are a class only with texts of the
    same words.  ``class_bits`` below 64 only serve tests of classes with equal keys.
    """
    indexed = materialize(index(df, id_col, text_col, words, class_bits), "forest").withColumn("own", F.col("class"))

    def settled(rows: DataFrame) -> DataFrame:
        # Copies: one partial row per class and task, so a class holding a third of all rows is no hot spot.
        held = [F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("check", "lo", "hi")), F.bool_or("placed").alias("placed")]
        return materialize(rows.groupBy("class").agg(*held, F.min("check").alias("x"), F.max("check").alias("y")), "classes")

    classes = settled(indexed)
    mistaken = classes.filter("x <> y").select("class", F.lit(True).alias("several"))
    if not mistaken.isEmpty():
        # A key that stands for several sets gives way to one made of all 128 bits.
        indexed = indexed.join(small(mistaken, 200_000), "class", "left").withColumn("class", F.when(F.col("several"), F.xxhash64("own", "check")).otherwise(F.col("own")))
        classes = settled(indexed)
    membership, classes = indexed.select("id", "class"), classes.filter("placed")
    sketches, members = classes.select("class", "lo", "hi"), classes.select("class", "id", "check")
    pairs, cut = _neighbours(indexed.filter("keys is not null").select("keys", "class"))
    x, y = sketches.toDF("a", "alo", "ahi"), sketches.toDF("b", "blo", "bhi")
    likely = pairs.distinct().join(x, "a").join(y, "b").filter(_agreement() >= min_agreement(similarity)).select("a", "b")
    if not cut.isEmpty():
        searched = members.join(small(cut, 200_000), "class", "left_semi")
        likely = likely.union(_exact_candidates(_grams(df, id_col, text_col, words, searched), sketches, similarity)).distinct()
    likely = materialize(likely, "likely")
    return membership, _verified(df, id_col, text_col, words, similarity, members, likely)


def _verified(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float, members: DataFrame, likely: DataFrame) -> DataFrame:
    """Exact similarity of the likely pairs, from the whole text of one member of each class."""
    involved = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct()
    grams = _grams(df, id_col, text_col, words, members.join(small(involved, 200_000), "class", "left_semi"))
    both = likely.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = batch.column("ga"), batch.column("gb")
            la, lb = (np.diff(g.offsets.to_numpy()) for g in (ga, gb))
            row = np.arange(batch.num_rows)
            value = np.concatenate([ga.flatten().to_numpy(), gb.flatten().to_numpy()])
            owner = np.concatenate([np.repeat(row, la), np.repeat(row, lb)])
            order = np.lexsort((value, owner))
            value, owner = value[order], owner[order]
            twice = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][twice], minlength=batch.num_rows)
            value = common / np.maximum(la + lb - common, 1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value)], ["a", "b", "similarity"]).filter(pa.array(value >= similarity))

    return both.mapInArrow(measure, "a long, b long, similarity double")


def similar_pairs(df: DataFrame, id_col: str = "src_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows that are similar enough, copies included."""
    membership, links = similar_classes(df, id_col, text_col, words, similarity)
    one, two = membership.toDF("id_a", "a"), membership.toDF("id_b", "b")
    across = links.join(one, "a").join(two, "b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    several = membership.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class")
    copies = membership.join(several, "class", "left_semi").select("id", "class")
    within = copies.toDF("id_a", "class").join(copies.toDF("id_b", "class"), "class").filter("id_a < id_b").select("id_a", "id_b")
    return across.union(within).filter("id_a <> id_b").distinct()


def groups(df: DataFrame, id_col: str = "src_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row ``id, class, group, n_copies, n_links`` per row with a text.

    ``class`` is its class of copies, ``n_links`` the classes that one is similar to, and
    ``group`` the smallest class of all that are reached from it by such links.
    """
    membership, links = similar_classes(df, id_col, text_col, words, similarity)
    both = links.select(F.col("a").alias("label"), F.col("b").alias("other"))
    both = materialize(both.union(both.select("other", "label")), "links")
    ends = both.groupBy("label").agg(F.count("*").alias("n_links"))
    linked = ends.join(connected(ends.select("label"), both), "label").select(F.col("label").alias("class"), "root", "n_links")
    copies = membership.groupBy("class").agg(F.count("*").alias("n_copies"))
    rows = membership.join(copies, "class").join(linked, "class", "left")
    return rows.select("id", "class", F.coalesce("root", "class").alias("group"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
