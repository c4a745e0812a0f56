"""Problem 6: long exact spans shared between records.

Method: prefix-partitioned suffix trees.  Only some suffixes are put into trees: of
the k-grams in every ``length`` successive characters the smallest (by hash) is an
*anchor*, and equal stretches of ``length`` characters have the same anchor at the
same place.  Suffixes that begin at anchors are partitioned by their first ``k``
characters; a partition with too many of them is split by longer prefixes, until it
fits.

* The successive windows of ``length`` characters with one anchor are a *run*, and
  runs are shipped as two fingerprints, of the anchor and of the run: a third of the
  text.  Runs alike in whole are one class, and a class that stands in several
  records is settled, as is a partition whose runs are all of one record.
* The remaining partitions get the text of one run of each class.  Each partition is
  made a tree: its suffixes in order, with the common prefixes of neighbours as the
  depths of internal nodes, and beside it the order of what stands before the
  anchors, read backwards.
* Below a node of depth ``d`` two suffixes whose texts also agree in the ``a``
  characters before the anchor have a repeat of ``a + d`` characters.  Nodes are
  visited from the deepest up; each passes on the order of what stands before its
  leaves, so a leaf meets those it agrees with farthest and nothing is compared twice.
  Nodes where ``a + d`` is at least ``length`` are deep enough and give the maximal
  repeats, each with another record that has it.

Trees are built from the characters themselves.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrowmap import bounded, emit, sorted_groups
from tidemark.llm.textarrays import TextBatch, common_prefixes, merged, window_argmin
from tidemark.tables import materialize

#: Runs of different classes that one partition may hold before it is split.
PARTITION_RUNS = 10_000


def _runs_of(texts: list[str | None], length: int, k: int):
    """Runs of successive windows with one anchor: text, first window, number, offset of the anchor, fingerprints of anchor and run."""
    batch = TextBatch(texts)
    grams = batch.gram_hash(k)
    anchor = window_argmin(grams, length - k + 1) if len(batch.cp) >= length else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(batch.n), batch.lengths)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + length <= batch.offsets[1:][owner]) if len(anchor) else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    low, own = anchor[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, len(at)))
    start = at[first]
    return own[first], start - batch.offsets[own[first]], number, low[first] - start, grams[low[first]], batch.span_hash(start, start + number - 1 + length)


def suffix_runs(df: DataFrame, id_col: str, text_col: str, length: int, k: int) -> DataFrame:
    """``id, at, n, gram, part, run``: runs of ``n`` successive windows from offset ``at`` (from 0), the anchor ``gram`` characters on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            row, at, n, gram, part, whole = _runs_of(batch.column("text").to_pylist(), length, k)
            small = [pa.array(x.astype(np.int32)) for x in (at, n, gram)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *small, pa.array(part.view(np.int64)), pa.array(whole.view(np.int64))], ["id", "at", "n", "gram", "part", "run"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.length("text") >= length)
    return rows.mapInArrow(run, "id long, at int, n int, gram int, part long, run long")


# A run in a partition: its class (origin, run), a record and the place of the anchor there, another record where there are
# several, its text from window ``shift`` on with the anchor at ``gram``, and which distances from the anchor (from <= a < to) are meant.
_ROW = "part long, origin long, run long, id long, place long, last_id long, last_place long, several boolean, text string, shift int, gram int, from int, to int"
_COLUMNS = [c.split(" ")[0] for c in _ROW.split(", ")]
#: Windows lo to hi (half-open) of a class, another record that has them, and where window 0 would be there.
_FOUND = "origin long, run long, lo int, hi int, p_id long, p_at long"


def _meant(rows):
    """The rows whose text is the one the run was made of: an id may stand for several texts, and the fingerprint tells."""
    batch = TextBatch(rows.column("text").to_pylist())
    right = batch.span_hash(batch.offsets[:-1], batch.offsets[1:]).view(np.int64) == rows.column("run").to_numpy()
    return rows if right.all() else rows.filter(pa.array(right))


def _only_meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _meant(batch)


class _Least:
    """Least of any stretch of a list of numbers."""

    def __init__(self, values: list[int]):
        self.levels = [values]
        if len(values) > 64:
            level, step = np.array(values), 1
            while 2 * step <= len(values):
                level = np.minimum(level[:-step], level[step:])
                self.levels.append(level.tolist())
                step *= 2

    def of(self, i: int, j: int) -> int:
        if len(self.levels) == 1:
            return min(self.levels[0][i:j])
        k = (j - i).bit_length() - 1
        level = self.levels[k]
        return min(level[i], level[j - (1 << k)])


def repeats(depth: list[int], rank: list[int], before: list[int], record: list[int], length: int, least: int) -> list[tuple[int, int, int, int]]:
    """Repeats of the leaves of one tree: ``(leaf, lowest, highest, other leaf)``.

    Leaves are in order of their suffixes; ``depth`` has the common prefix of every
    leaf and the next, ``rank`` the place of every leaf in the order of what stands
    before the anchors, ``before`` the common prefix of neighbours in that order.  A
    leaf's window that begins ``a`` characters before the anchor stands below another
    record's leaf too if ``a`` is in one of its ranges.  Depths below ``least`` are
    not looked at.
    """
    m, out = len(rank), []
    by_rank, low = [0] * m, _Least(before)
    for leaf, r in enumerate(rank):
        by_rank[r] = leaf
    held, root, best = [[r] for r in rank], list(range(m)), [-1] * m

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for b in sorted((b for b in range(m - 1) if depth[b] >= least), key=depth.__getitem__, reverse=True):
        need = length - depth[b]
        one, two = find(b), find(b + 1)
        if len(held[one]) > len(held[two]):
            one, two = two, one
        large = held[two]
        for r in held[one]:
            x = by_rank[r]
            mine = record[x]
            k = bisect_left(large, r)
            for way in (-1, 1):
                j, last, common, met = k - 1 if way < 0 else k, r, 1 << 60, None
                while 0 <= j < len(large):
                    q = large[j]
                    common = min(common, low.of(q, last) if way < 0 else low.of(last, q))
                    if common < need:
                        break
                    y = by_rank[q]
                    if record[y] != mine:
                        if met is None:
                            met = record[y]
                            if common > best[x]:
                                out.append((x, max(need, best[x] + 1), common, y))
                                best[x] = common
                        elif record[y] != met:
                            break
                        if common > best[y]:
                            out.append((y, max(need, best[y] + 1), common, x))
                            best[y] = common
                    last = q
                    j += way
            large.insert(k, r)
        root[one] = two
        held[one] = []
    return out


def _trees(length: int, checked: bool):
    """Repeats of every partition, for rows sorted by ``part``."""
    schema = pa.schema([("origin", pa.int64()), ("run", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("p_id", pa.int64()), ("p_at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "part", 4_000):
            if not checked:
                group = _meant(group)
            if group.num_rows < 2:
                continue
            texts = group.column("text").to_pylist()
            part, gram, ids, several = (group.column(c).to_numpy() for c in ("part", "gram", "id", "several"))
            record = np.where(several, -1 - np.arange(len(ids)), ids)
            after = pa.array([t[g:] for t, g in zip(texts, gram.tolist())])
            behind = pa.array([t[:g][::-1] for t, g in zip(texts, gram.tolist())])
            right = pc.sort_indices(pa.table([pa.array(part), after], ["p", "t"]), [("p", "ascending"), ("t", "ascending")]).to_numpy().astype(np.int64)
            left = pc.sort_indices(pa.table([pa.array(part), behind], ["p", "t"]), [("p", "ascending"), ("t", "ascending")]).to_numpy().astype(np.int64)
            depth = common_prefixes(after.take(pa.array(right)).to_pylist())
            before = common_prefixes(behind.take(pa.array(left)).to_pylist())
            rank = np.empty(len(ids), np.int64)
            rank[left] = np.arange(len(ids))
            order = part[right]
            first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
            size = np.diff(np.append(first, len(order)))
            # Trees of two leaves have one node: done at once.
            two = first[size == 2]
            need, common = length - depth[two], before[two]
            hit = (common >= need) & (record[right[two]] != record[right[two + 1]])
            x, y, need, common = right[two][hit], right[two + 1][hit], need[hit], common[hit]
            found = [np.stack([x, need, common, y]), np.stack([y, need, common, x])]
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                leaves = right[s : s + n]
                some = repeats(depth[s : s + n - 1].tolist(), (rank[leaves] - s).tolist(), before[s : s + n - 1].tolist(), record[leaves].tolist(), length, length - int(gram[leaves].max()))
                if some:
                    rows = np.array(some, np.int64).T
                    rows[0], rows[3] = leaves[rows[0]], leaves[rows[3]]
                    found.append(rows)
            x, low, high, y = np.concatenate(found, axis=1)
            # Classes of several records are settled already.
            x, low, high, y = (c[~several[x]] for c in (x, low, high, y))
            number = np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
            g, shift = gram[x].astype(np.int64), group.column("shift").to_numpy()[x]
            lo, hi = np.maximum(g - high, 0), np.minimum(g - np.maximum(low, 0), number[x] - 1) + 1
            # A settled class stands in two records at least; one of them is another.
            own = ids[y] == ids[x]
            other = np.where(own, group.column("last_id").to_numpy()[y], ids[y])
            place = np.where(own, group.column("last_place").to_numpy()[y], group.column("place").to_numpy()[y]) - g - shift
            ok = lo < hi
            origin, name = (group.column(c).to_numpy()[x] for c in ("origin", "run"))
            yield from emit(schema, origin=origin[ok], run=name[ok], lo=(lo + shift)[ok], hi=(hi + shift)[ok], p_id=other[ok], p_at=place[ok])

    return run


def _in_trees(rows: DataFrame, length: int, checked: bool) -> DataFrame:
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_trees(length, checked), _FOUND)


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Every run in its windows near the anchor and those farther off, in partitions of a longer prefix each.

    Windows that begin ``lo`` to ``hi - 1`` characters before the anchor have a stretch
    in common, from the nearest one's begin to the farthest one's end; it is the new prefix.
    """
    g, n = F.col("gram"), F.length("text") - length + 1
    middle = F.floor((F.col("from") + F.col("to")) / 2).cast("int")

    def half(lo: Column, hi: Column) -> Column:
        first, last = F.greatest(F.lit(0), g - hi + 1), F.least(n - 1, g - lo)
        stretch = F.substring(F.col("text"), g - lo + 1, lo - hi + 1 + length)
        row = F.struct(
            F.xxhash64("part", lo, hi, stretch).alias("part"), *(c for c in _COLUMNS[1:8]), F.substring(F.col("text"), first + 1, last - first + length).alias("text"),
            (F.col("shift") + first).alias("shift"), (g - first).alias("gram"), lo.alias("from"), hi.alias("to"),
        )
        return F.when((first <= last) & (lo < hi), row)

    both = F.array_compact(F.array(half(F.col("from"), middle), half(middle, F.col("to"))))
    return rows.select(F.explode(both).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in _COLUMNS))


def _in_large(rows: DataFrame, length: int, limit: int) -> DataFrame:
    """The same for partitions above ``limit`` runs: split until they are within it, or of one window each."""
    result, rows = None, rows.mapInArrow(_only_meant, _ROW)
    while True:
        rows = materialize(_halves(rows, length), "split")
        sizes = rows.groupBy("part").agg(F.count("*").alias("runs"), F.min(F.when(F.col("several"), -1).otherwise(F.col("id"))).alias("a"), F.max("id").alias("b"), F.bool_or("several").alias("s"), F.max(F.col("to") - F.col("from")).alias("range"))
        rows = rows.join(sizes.filter("runs > 1 and (a <> b or s)"), "part")
        done = _in_trees(rows.filter(f"range > 1 and runs <= {limit}").select(*_COLUMNS), length, True)
        # One window each: equal texts are the leaves below one node.
        single = rows.filter("range = 1")
        ends = [F.max(F.struct(F.col(i).alias("id"), F.col(p).alias("place"))) for i, p in (("id", "place"), ("last_id", "last_place"))]
        least = F.min(F.struct("id", "place"))
        nodes = single.groupBy("part", "text").agg(least.alias("p"), F.greatest(*ends).alias("q")).filter("p.id <> q.id")
        own = F.col("p.id") == F.col("id")
        other = single.filter(~F.col("several")).join(nodes, ["part", "text"]).select("origin", "run", F.col("shift").alias("lo"), (F.col("shift") + 1).alias("hi"), F.when(own, F.col("q.id")).otherwise(F.col("p.id")).alias("p_id"), (F.when(own, F.col("q.place")).otherwise(F.col("p.place")) - F.col("gram") - F.col("shift")).alias("p_at"))
        done = done.unionByName(other)
        result = done if result is None else result.unionByName(done)
        rows = rows.filter(f"range > 1 and runs > {limit}").select(*_COLUMNS)
        if rows.isEmpty():
            return result


def shared_pieces(df: DataFrame, id_col: str = "src_id", text_col: str = "text", length: int = 200, k: int = 80, partition_runs: int = PARTITION_RUNS) -> DataFrame:
    """``id, lo, hi, other_id, other_lo``: stretches [lo, hi) of at least ``length`` characters that another record has from ``other_lo`` on.

    Offsets count code points from 0.  Every shared character of a record is in one
    of its pieces; pieces overlap, and name one other record each.
    """
    runs = materialize(suffix_runs(df, id_col, text_col, length, k), "runs")
    classes = runs.groupBy("part", "run").agg(F.min(F.struct("id", "at", "n", "gram")).alias("first"), F.max(F.struct("id", "at")).alias("last"))
    classes = classes.select("part", "run", "first.*", F.col("last.id").alias("last_id"), F.col("last.at").alias("last_at"), (F.col("first.id") != F.col("last.id")).alias("several"))
    classes = materialize(classes, "classes")
    parts = classes.groupBy("part").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bool_or("several").alias("s"), F.bool_and("several").alias("settled"), F.count("*").alias("runs"))
    # Partitions whose runs are all settled, or all of one record, have no node left to find.
    open_parts = parts.filter("not settled and runs > 1 and (a <> b or s)").select("part", "runs")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = materialize(classes.join(open_parts, "part"), "wanted")
    cut = F.substring("text", F.col("at") + 1, F.col("n") + length - 1)
    rows = wanted.join(texts, "id").select(
        "part", F.col("part").alias("origin"), "run", "id", (F.col("at") + F.col("gram")).cast("long").alias("place"), "last_id", (F.col("last_at") + F.col("gram")).cast("long").alias("last_place"), "several",
        cut.alias("text"), F.lit(0).alias("shift"), "gram", F.lit(0).alias("from"), F.lit(length - k + 1).alias("to"), "runs",
    )
    found = _in_trees(rows.filter(F.col("runs") <= partition_runs).select(*_COLUMNS), length, False)
    if not wanted.filter(F.col("runs") > partition_runs).isEmpty():
        found = found.unionByName(_in_large(rows.filter(F.col("runs") > partition_runs).select(*_COLUMNS), length, partition_runs))
    found = found.select(F.col("origin").alias("part"), "run", "lo", "hi", "p_id", "p_at", F.lit(None).cast("long").alias("q_id"), F.lit(None).cast("long").alias("q_at"))
    settled = classes.filter("several").select("part", "run", F.lit(0).alias("lo"), F.col("n").alias("hi"), F.col("id").alias("p_id"), F.col("at").cast("long").alias("p_at"), F.col("last_id").alias("q_id"), F.col("last_at").cast("long").alias("q_at"))
    other = F.col("p_id") != F.col("id")
    pieces = runs.select("id", "at", "part", "run").join(settled.unionByName(found), ["part", "run"])
    return pieces.select(
        "id", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") - 1 + length).alias("hi"),
        F.when(other, F.col("p_id")).otherwise(F.col("q_id")).alias("other_id"), (F.when(other, F.col("p_at")).otherwise(F.col("q_at")) + F.col("lo")).alias("other_lo"),
    )


def shared_spans(df: DataFrame, id_col: str = "src_id", text_col: str = "text", length: int = 200, k: int = 80, partition_runs: int = PARTITION_RUNS) -> DataFrame:
    """``id, start_pos, n_chars``: each maximal run of shared characters of each record.

    Positions count code points from 1.  Null, empty and short texts have none.
    Rows with one id are one record, be they copies or different texts: a span that
    only they share is not shared with *another* record, and their spans are merged.
    """
    pieces = shared_pieces(df, id_col, text_col, length, k, partition_runs).select("id", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("start_pos", pa.int32()), ("n_chars", pa.int32())])
        for group in sorted_groups(batches, "id"):
            owner, lo, hi = merged(*(group.column(c).to_numpy() for c in ("id", "lo", "hi")))
            yield from emit(schema, id=owner, start_pos=lo + 1, n_chars=hi - lo)

    return pieces.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id long, start_pos int, n_chars int")


def passages(df: DataFrame, id_col: str = "src_id", text_col: str = "text", **options) -> DataFrame:
    """``id, start_pos, n_chars, other_id, other_pos``: passages of each record that stand verbatim in another one, and where.

    Together they cover the record's shared characters; successive pieces at the same
    distance in the same other record are one passage.  Positions count from 1.
    """
    pieces = shared_pieces(df, id_col, text_col, **options).withColumn("shift", F.col("other_lo") - F.col("lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("start_pos", pa.int32()), ("n_chars", pa.int32()), ("other_id", pa.int64()), ("other_pos", pa.int32())])
        for group in sorted_groups(batches, "id"):
            ids, other, shift, lo, hi = (group.column(c).to_numpy() for c in ("id", "other_id", "shift", "lo", "hi"))
            order = np.lexsort((lo, shift, other, ids))
            ids, other, shift, lo, hi = (c[order] for c in (ids, other, shift, lo, hi))
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])
            owner, lo, hi = merged(np.cumsum(new) - 1, lo, hi)
            at = np.flatnonzero(new)[owner]
            yield from emit(schema, id=ids[at], start_pos=lo + 1, n_chars=hi - lo, other_id=other[at], other_pos=lo + shift[at] + 1)

    return pieces.repartition("id").sortWithinPartitions("id").mapInArrow(run, "id long, start_pos int, n_chars int, other_id long, other_pos int")
