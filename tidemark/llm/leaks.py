"""Problem 9: evaluation texts leaking into training text.

Method: q-gram lemma filtering, for characters and for words.  A passage of ``n``
characters that a document has with at most ``e`` edits shares at least
``n + 1 - q - e * q`` character q-grams with the item, all within a band of ``e``
diagonals.  Shared q-grams are counted in overlapping diagonal bands, and pairs
with a region that meets the bound are kept.  An edit of a whole word can move what
follows by any number of characters; ``m`` equal words with at most ``e`` such edits
have ``ceil(m / (e + 1))`` successive words unchanged, and pairs that share so many
are kept too.  Every kept pair is verified by an alignment of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrowmap import bounded
from tidemark.llm.lookalike import WORD, Alike, load
from tidemark.llm.textarrays import TextBatch, mix, successive
from tidemark.tables import materialize

#: Bytes of items that every task holds in memory; larger sets are met by joins.
ITEM_BYTES = 4 << 20
#: Bits of the filter for larger sets, as a power of two (64 MB), and places of it for each entry.
FILTER_BITS, PROBES = 29, 3
_BITS = 22


def _spaced(texts: list[str | None], alike: Alike) -> list[str]:
    return [" ".join(WORD.findall(alike.folded(t))) if t else "" for t in texts]


def _grams(batch: TextBatch, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, text and offset of every q-gram inside a text."""
    h = batch.gram_hash(q)
    owner = np.repeat(np.arange(batch.n), batch.lengths)[: len(h)]
    at = np.flatnonzero(np.arange(len(h)) + q <= batch.offsets[1:][owner]) if len(h) else np.zeros(0, np.int64)
    return h[at], owner[at], at - batch.offsets[owner[at]]


def _word_grams(batch: TextBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and text of every k successive words of texts from ``_spaced``."""
    space, filled = batch.cp == 32, batch.lengths > 0
    first, last = np.zeros(len(space), bool), np.zeros(len(space), bool)
    first[1:], last[:-1] = space[:-1], space[1:]
    first[batch.offsets[:-1][filled]] = True
    last[batch.offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(batch.offsets, start, side="right") - 1
    gram, at = successive(batch.span_hash(start, end), owner, k)
    return gram, owner[at]


@dataclass
class Items:
    """Index of the items' q-grams and runs of words, and the shortest passage of ``words`` words of each."""

    ids: list
    texts: list[str]
    q: int
    edits: int
    words: int

    def __post_init__(self) -> None:
        batch = TextBatch(self.texts)
        gram, owner, at = _grams(batch, self.q)
        order = np.argsort(gram, kind="stable")
        gram, self.owner, self.at = gram[order], owner[order], at[order]
        self.gram, self.first, self.count = np.unique(gram, return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        shortest = [self._shortest(t.split(" ")) for t in self.texts]
        # Below one shared q-gram the lemma filters nothing; items without a passage can't be found.
        self.least = np.array([max(1, n + 1 - self.q * (1 + self.edits)) if n else np.iinfo(np.int64).max for n in shortest], np.int64)
        # Of edits + 1 unchanged pieces of so many words in all, the longest has this many.
        self.seed_words = -(-self.words // (self.edits + 1))
        seed, owner = _word_grams(batch, self.seed_words)
        long = np.array(shortest, np.int64)[owner] > 0
        seed, owner = seed[long], owner[long]
        order = np.argsort(seed, kind="stable")
        self.seed_owner = owner[order]
        self.seed, self.seed_first, self.seed_count = np.unique(seed[order], return_index=True, return_counts=True)

    def _shortest(self, words: list[str]) -> int:
        size = [len(w) for w in words]
        return min((sum(size[i : i + self.words]) + self.words - 1 for i in range(len(words) - self.words + 1)), default=0)

    def seeded(self, docs: TextBatch) -> np.ndarray:
        """Pairs, as document * items + item, that share a run of ``seed_words`` words."""
        if not len(self.seed):
            return np.zeros(0, np.int64)
        gram, doc = _word_grams(docs, self.seed_words)
        j = np.minimum(np.searchsorted(self.seed, gram), len(self.seed) - 1)
        hit = self.seed[j] == gram
        doc, j = doc[hit], j[hit]
        return np.unique(np.repeat(doc, self.seed_count[j]) * np.int64(len(self.texts)) + self.seed_owner[_ranges(self.seed_first[j], self.seed_count[j])])

    def regions(self, docs: TextBatch, seeded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, item and shared q-grams of every region that meets the bound or is of a seeded pair."""
        none = (np.zeros(0, np.int64),) * 3
        gram, doc, at = _grams(docs, self.q)
        if not len(gram) or not len(self.gram):
            return none
        maybe = np.flatnonzero(self.bitmap[(gram >> np.uint64(64 - _BITS)).astype(np.int64)])
        j = np.minimum(np.searchsorted(self.gram, gram[maybe]), len(self.gram) - 1)
        hit = self.gram[j] == gram[maybe]
        maybe, j = maybe[hit], j[hit]
        # A document with fewer hits in all than the lowest bound has no region.
        enough = np.bincount(doc[maybe], minlength=docs.n) >= self.least.min()
        enough[seeded // len(self.texts)] = True
        keep = enough[doc[maybe]]
        maybe, j = maybe[keep], j[keep]
        if not len(maybe):
            return none
        count = self.count[j]
        which = _ranges(self.first[j], count)
        d, item = np.repeat(doc[maybe], count), self.owner[which]
        shift = np.int64(1) << np.int64(31)
        diagonal = np.repeat(at[maybe], count) - self.at[which] + shift
        # Bands of 2 * step diagonals, a new one every step: any edits + 1 adjacent diagonals lie in one of them.
        step = self.edits + 1
        pair = d * np.int64(len(self.texts)) + item
        order = np.lexsort((diagonal, pair))
        pair, band = pair[order], diagonal[order] // step
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
        start = np.flatnonzero(new)
        cell, pair, band = np.diff(np.append(start, len(new))), pair[start], band[start]
        # A band holds the hits of its cell and of the next one, or of the cell before where that is richer.
        total = cell.copy()
        beside = (pair[1:] == pair[:-1]) & (band[1:] == band[:-1] + 1)
        up, down = np.zeros_like(cell), np.zeros_like(cell)
        up[:-1][beside] = cell[1:][beside]
        down[1:][beside] = cell[:-1][beside]
        total += np.maximum(up, down)
        ok = (total >= self.least[pair % len(self.texts)]) | np.isin(pair, seeded)
        return pair[ok] // len(self.texts), pair[ok] % len(self.texts), total[ok]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every entry, ``count`` numbers each."""
    return np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _places(words: list[str]) -> dict[str, list[int]]:
    place: dict[str, list[int]] = {}
    for j, w in enumerate(words):
        place.setdefault(w, []).append(j)
    return place


def longest_runs(a: list[str], place: dict[str, list[int]], edits: int) -> tuple[int, int]:
    """Longest exactly matching and longest aligned run of words of two texts; ``place`` has the positions of the second's words.

    The aligned run may hold up to ``edits`` words that differ, are missing or are extra; only equal words count.
    """
    exact = aligned = 0
    # For the last words of a: the most equal words in a run ending at each equal word of b, with at most 0, 1, ... edits.
    rows: list[dict[int, list[int]]] = [{} for _ in range(edits + 1)]
    for w in a:
        row = {}
        for j in place.get(w, ()):
            best = [1] * (edits + 1)
            for gi, before in enumerate(rows):
                for gj in range(edits + 1) if before else ():
                    if held := before.get(j - 1 - gj):
                        cost = max(gi, gj)
                        for e in range(cost, edits + 1):
                            best[e] = max(best[e], held[e - cost] + 1)
            row[j] = best
            exact, aligned = max(exact, best[0]), max(aligned, best[edits])
        rows = [row, *rows[:-1]]
    return exact, aligned


def _search(items: Items):
    alike = load()
    places: dict[int, dict[str, list[int]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 2 << 20):
            docs = _spaced(batch.column("text").to_pylist(), alike)
            flat = TextBatch(docs)
            seeded = items.seeded(flat)
            most = {divmod(p, len(items.texts)): 0 for p in seeded.tolist()}
            for d, i, n in zip(*(x.tolist() for x in items.regions(flat, seeded))):
                most[d, i] = max(most.get((d, i), 0), n)
            parts: dict[int, list[str]] = {}
            found: dict[tuple[int, int], tuple[int, int, int]] = {}
            for (d, i), n in most.items():
                if d not in parts:
                    parts[d] = docs[d].split(" ")
                if i not in places:
                    places[i] = _places(items.texts[i].split(" "))
                found[d, i] = *longest_runs(parts[d], places[i], items.edits), n
            rows = pa.array([d for d, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array([items.ids[i] for _, i in found], pa.int64()), *(pa.array([v[c] for v in found.values()], pa.int32()) for c in range(3))], ["doc_id", "item_id", "exact_words", "aligned_words", "shared_qgrams"])

    return run


_HITS = "doc_id {kind}, text string, hits array<struct<kind:int,gram:long,at:int>>, n_grams int"


def _item_grams(q: int, edits: int, words: int):
    """Spaced text, least shared q-grams, and q-grams (kind 0) and runs of words (kind 1) of every item that can be found."""
    alike = load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            texts = _spaced(batch.column("text").to_pylist(), alike)
            items = Items(list(range(len(texts))), texts, q, edits, words)
            flat = TextBatch(texts)
            gram, owner, at = _grams(flat, q)
            seed, of = _word_grams(flat, items.seed_words)
            long = items.least < np.iinfo(np.int64).max
            keep, keep_seed = long[owner], long[of]
            both = np.concatenate([owner[keep], of[keep_seed]])
            order = np.argsort(both, kind="stable")
            kind = np.concatenate([np.zeros(keep.sum(), np.int32), np.ones(keep_seed.sum(), np.int32)])[order]
            held = pa.StructArray.from_arrays([pa.array(kind), pa.array(np.concatenate([gram[keep], seed[keep_seed]])[order].view(np.int64)), pa.array(np.concatenate([at[keep], np.zeros(keep_seed.sum(), np.int64)])[order].astype(np.int32))], ["kind", "gram", "at"])
            cuts = np.searchsorted(both[order], np.arange(len(texts) + 1)).astype(np.int32)
            least = pa.array(np.where(long, items.least, 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts), least, pa.ListArray.from_arrays(pa.array(cuts), held)], ["id", "text", "least", "grams"])

    return run


def _probes(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(gram ^ np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64) for i in range(1, PROBES + 1)]


def _filter_bits(grams: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of all q-grams and runs of words of the items, of a size that their number asks for up to ``FILTER_BITS``."""
    n = grams.count()
    bits = min(FILTER_BITS, max(20, (32 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(batch.column("gram").to_numpy().view(np.uint64) ^ batch.column("kind").to_numpy().astype(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["at"])

    place = F.col("at") + 1
    chunks = grams.select("gram", "kind").mapInArrow(run, "at long").groupBy((F.bitmap_bucket_number(place) - 1).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")).toArrow()
    held = np.zeros((1 << bits) // 8, np.uint8)
    for chunk, bitmap in zip(chunks.column("chunk").to_pylist(), chunks.column("bitmap").to_pylist()):
        part = np.frombuffer(bitmap, np.uint8)
        held[chunk * 4096 : chunk * 4096 + len(part)] = part[: len(held) - chunk * 4096]
    return held, bits


def _doc_hits(broadcast, bits: int, q: int, seed_words: int, least: int):
    """Spaced text and hits of every document that may have a region or a run of words."""
    alike = load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = broadcast.value

        def known(gram: np.ndarray, kind: int) -> np.ndarray:
            ok = np.ones(len(gram), bool)
            for at in _probes(gram ^ np.uint64(kind), bits):
                ok &= (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            return np.flatnonzero(ok)

        for batch in bounded(batches, "text", 2 << 20):
            texts = _spaced(batch.column("text").to_pylist(), alike)
            flat = TextBatch(texts)
            gram, owner, at = _grams(flat, q)
            hit = known(gram, 0)
            seed, of = _word_grams(flat, seed_words)
            seen = known(seed, 1)
            count = np.bincount(owner[hit], minlength=flat.n)
            keep = count >= least
            keep[of[seen]] = True
            hit = hit[keep[owner[hit]]]
            both = np.concatenate([owner[hit], of[seen]])
            order = np.argsort(both, kind="stable")
            kind = np.concatenate([np.zeros(len(hit), np.int32), np.ones(len(seen), np.int32)])[order]
            hits = pa.StructArray.from_arrays([pa.array(kind), pa.array(np.concatenate([gram[hit], seed[seen]])[order].view(np.int64)), pa.array(np.concatenate([at[hit], np.zeros(len(seen), np.int64)])[order].astype(np.int32))], ["kind", "gram", "at"])
            cuts = np.searchsorted(both[order], np.arange(flat.n + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts), pa.ListArray.from_arrays(pa.array(cuts), hits), pa.array(count.astype(np.int32))], ["doc_id", "text", "hits", "n_grams"])
            yield out.filter(pa.array(keep))

    return run


def _compared(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [longest_runs(d.split(" "), _places(i.split(" ")), edits) for d, i in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), *(pa.array([r[c] for r in runs], pa.int32()) for c in (0, 1)), batch.column("shared_qgrams")], ["doc_id", "item_id", "exact_words", "aligned_words", "shared_qgrams"])

    return run


def _joined(rows: DataFrame, wanted: DataFrame, kind: str, words: int, q: int, edits: int) -> DataFrame:
    """The search by joins, for items of any number: nothing but a filter of bounded size is held as a whole.

    A document's q-grams and runs of words that pass the filter meet the items' in a
    join; hits are counted in overlapping diagonal bands by aggregation.  Documents
    that hit nothing are not moved.
    """
    items = wanted.mapInArrow(_item_grams(q, edits, words), "id long, text string, least int, grams array<struct<kind:int,gram:long,at:int>>")
    items = materialize(items.filter("least > 0").withColumn("item", F.monotonically_increasing_id()), "items")
    grams = items.select(F.explode("grams").alias("g"), "item").select("g.*", "item")
    held, bits = _filter_bits(grams)
    least = items.agg(F.coalesce(F.min("least"), F.lit(1))).first()[0]
    broadcast = rows.sparkSession.sparkContext.broadcast(held)
    hits = rows.mapInArrow(_doc_hits(broadcast, bits, q, -(-words // (edits + 1)), least), _HITS.format(kind=kind))
    hits = materialize(hits.withColumn("doc", F.monotonically_increasing_id()), "hits")
    met = hits.select("doc", F.explode("hits").alias("h")).select("doc", "h.kind", "h.gram", F.col("h.at").alias("there")).join(grams, ["kind", "gram"])
    cell = F.floor((F.col("there") - F.col("at")) / (edits + 1))
    bands = met.filter("kind = 0").select("doc", "item", F.explode(F.array(cell, cell - 1)).alias("band")).groupBy("doc", "item", "band").agg(F.count("*").cast("int").alias("n"))
    bands = bands.groupBy("doc", "item").agg(F.max("n").alias("n"), F.lit(False).alias("seeded"))
    seeded = met.filter("kind = 1").select("doc", "item").distinct().select("doc", "item", F.lit(0).alias("n"), F.lit(True).alias("seeded"))
    pairs = bands.unionByName(seeded).groupBy("doc", "item").agg(F.max("n").alias("shared_qgrams"), F.bool_or("seeded").alias("seeded"))
    found = pairs.join(items.select("item", F.col("id").alias("item_id"), F.col("text").alias("item_text"), "least"), "item").filter("seeded or shared_qgrams >= least")
    both = found.join(hits.select("doc", "doc_id", "text"), "doc").select("doc_id", "text", "item_id", "item_text", "shared_qgrams")
    return both.mapInArrow(_compared(edits), f"doc_id {kind}, item_id long, exact_words int, aligned_words int, shared_qgrams int")


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", words: int = 15, q: int = 20, edits: int = 1) -> DataFrame:
    """``doc_id, item_id, exact_words, aligned_words, shared_qgrams`` of each document and item that may be a leak.

    Every document that holds at least ``words`` successive words of an item with at
    most ``edits`` character edits is in it, and every one with ``aligned_words`` of at
    least ``words``.  ``exact_words`` is the longest run of words they have in common,
    ``aligned_words`` the most equal words in a run with up to ``edits`` words, of any
    length, that differ, are missing or are extra; ``shared_qgrams`` the most that a band
    of diagonals holds.  Texts are compared folded.  Null and empty texts leak
    nothing; items of fewer than ``words`` words can't be leaked.  Repeated ids
    give a row for each of them.

    Items of up to ``ITEM_BYTES`` in all are held by every task, and documents are only
    mapped over.  More of them are met by joins, see :func:`_joined`; the rows are the
    same.
    """
    kind = dict(docs.dtypes)[doc_col]
    rows = docs.select(F.col(doc_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    wanted = items.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > ITEM_BYTES:
        return _joined(rows, wanted, kind, words, q, edits)
    held = wanted.collect()
    index = Items([r["id"] for r in held], _spaced([r["text"] for r in held], load()), q, edits, words)
    return rows.mapInArrow(_search(index), f"doc_id {kind}, item_id long, exact_words int, aligned_words int, shared_qgrams int")
