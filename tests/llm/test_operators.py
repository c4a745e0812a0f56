"""The text operators against plain Python over small tables with the awkward cases."""

import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrowmap
from tidemark.llm import bpe, leaks, neardup, quality, sourcelines, spans, unify
from tidemark.llm.textarrays import common_prefixes
from tidemark.tables import spread

WORDS = "сеть связь город оператор канал проверка сбой жители ответ адрес сутки район посёлок письмо закон отчёт узел датчик неделя час".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "а", "ы", str(rng.randrange(99))]) for _ in range(n)) + "."


def posts(seed=5, n=120):
    rng = random.Random(seed)
    base = [sentence(rng, 60) for _ in range(25)]
    service = ["Подпишись на канал", "Ещё новости: @x", "***"]
    rows = []
    for i in range(n):
        text = rng.choice(base) if i % 3 else sentence(rng, 50)
        kind = rng.randrange(6)
        if kind == 0:
            w = text.split()
            w[rng.randrange(len(w))] = "правка"
            text = " ".join(w)
        elif kind == 1:
            text = sentence(rng, 8) + "\n" + text
        elif kind == 2:
            text = text.replace("о", "o").replace("й", "й")
        elif kind == 3:
            text = text[40:420]
        if i % 2:
            text += "\n" + (service[0] if i % 4 == 1 else service[0].upper()) + "\n\n" + rng.choice(service)
        rows.append((i, rng.choice(["a", "@A", "a", "b", None]), text))
    rows += [(n, "a", None), (n + 1, "a", ""), (n + 2, "b", " \n  \n"), (n + 3, "b", "два слова"), (n + 4, None, "два слова"), (n + 5, "b", "Два  слова"), (n + 6, "b", "слово " * 4000), (n + 7, "a", "слово " * 4000)]
    rows.append((n + 6, "b", "слово " * 4000))
    return rows


SCHEMA = "src_id long, channel_username string, text string"


@pytest.fixture(scope="module")
def rows():
    return posts()


@pytest.fixture(scope="module")
def df(spark, rows):
    # Columns with the names of internal and result columns must not matter.
    clash = {c: F.lit("x") for c in ("id", "class", "line_no", "part", "start_pos", "source", "key", "form")}
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(result):
    return sorted(tuple(r) for r in result.collect())


def test_lines_as_defined(df, rows):
    got = tuples(sourcelines.excess_occurrences(df, min_records=10, fdr=1.0))
    want = set(brute.repeated_lines(rows, 10))
    # With every hypothesis let through only lines that are rarer than outside are left out.
    assert set(got) <= want and got


def test_lines_statistics_and_removal(spark, df, rows):
    occurrences, excess = sourcelines.repeated_lines(df, min_records=3, fdr=0.05)
    by = {(r.source, r.line_key.hex()): r for r in excess.collect()}
    assert all(r.k_in >= 3 and r.g2 > 0 and r.significant for r in by.values())
    found = set(tuples(sourcelines.excess_occurrences(df, min_records=3, fdr=0.05)))
    texts = sourcelines.without_repeated_lines(df, min_records=3, fdr=0.05).collect()
    assert len(texts) == len(rows)
    given = {i: t for i, _, t in rows}
    for r in texts:
        t = given[r.id]
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (r.id, k) not in found)
        assert r.text == kept


def test_g2_and_tail(spark):
    import math

    df = spark.createDataFrame([tuple(map(float, x)) for x in [(30, 100, 10, 900), (1, 10, 100, 1000), (0, 0, 5, 10), (5, 10, 0, 0), (10, 10, 0, 10)]], "a double, n double, b double, m double")
    got = [r[0] for r in df.select(sourcelines.log_likelihood_ratio(F.col("a"), F.col("n"), F.col("b"), F.col("m"))).collect()]
    assert got[2] == got[3] == 0 and got[1] == 0 or abs(got[1]) < 1e-9
    p = 40 / 1000
    want = 2 * (30 * math.log(30 / (100 * p)) + 70 * math.log(70 / (100 * (1 - p))) + 10 * math.log(10 / (900 * p)) + 890 * math.log(890 / (900 * (1 - p))))
    assert got[0] == pytest.approx(want)
    tail = [r[0] for r in spark.createDataFrame([(x,) for x in (0.5, 3.84, 20.0, 400.0)], "g double").select(sourcelines.minus_log_p(F.col("g"))).collect()]
    for x, y in zip((0.5, 3.84, 20.0, 400.0), tail):
        assert y == pytest.approx(-math.log(math.erfc(math.sqrt(x / 2))), rel=1e-5)


def test_same_look_of_a_hot_form(spark):
    """A third of all rows are one text, and one more row looks like it."""
    text = F.when(F.col("src_id") == 7, "Пoст").when(F.col("src_id") % 3 == 0, "Пост").otherwise(F.concat(F.lit("другое "), F.col("src_id")))
    df = spark.range(30_000).select(F.col("id").alias("src_id"), text.alias("text"))
    got = tuples(unify.same_look_pairs(df))
    assert got == sorted((min(7, i), max(7, i)) for i in range(0, 30_000, 3))


def test_same_look_pairs(df, rows):
    assert set(tuples(unify.same_look_pairs(df))) == brute.same_look([(i, t) for i, _, t in rows])


def test_unify_keeps_every_row(df, rows):
    got = unify.unify(df).collect()
    assert len(got) == len(rows)
    assert all((r.form is None) == (dict((i, t) for i, _, t in rows)[r.id] is None) for r in got)


@pytest.mark.parametrize("size,least", [(3, 0.6), (5, 0.8), (1, 0.5)])
def test_similar_pairs(df, rows, size, least):
    got = tuples(neardup.similar_pairs(df, words=size, similarity=least))
    assert len(got) == len(set(got))
    assert set(got) == brute.similar([(i, t) for i, _, t in rows], size, least)


def test_similar_groups(df, rows):
    got = neardup.groups(df).collect()
    assert len(got) == sum(t is not None for _, _, t in rows)
    near = {}
    for a, b in brute.similar([(i, t) for i, _, t in rows], 5, 0.8):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    group = {r.id: r.group for r in got}
    for i, _, t in rows:
        if t is not None:
            reached, ahead = {i}, [i]
            while ahead:
                ahead = [x for y in ahead for x in near.get(y, ()) if x not in reached and not reached.add(x)]
            assert {k for k, g in group.items() if g == group[i]} == reached
    two = [r for r in got if r.id in (123, 124, 125)]
    assert len({r["class"] for r in two}) == 1 and all(r.n_copies == 3 for r in two)


def versions(n):
    """Versions of one text, every pair similar."""
    rng = random.Random(11)
    words = [f"слово{i}" for i in range(80)]
    rows = []
    for i in range(n):
        w = list(words)
        w[rng.randrange(80)] = f"правка{i}"
        rows.append((i, "a", " ".join(w)))
    return rows


@pytest.mark.parametrize("name,value", [("REGION", 64), ("HOT", 1), ("HELD", 20), ("POSTING", 30)])
def test_regions_that_must_be_cut(spark, monkeypatch, name, value):
    """Hundreds of versions: the exact search finds what the cuts separate, however the region is worked on."""
    monkeypatch.setattr(neardup, name, value)
    if name == "HELD":
        monkeypatch.setattr(arrowmap.sorted_groups, "__defaults__", (10, 0, None))
    rows = versions(150)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute.similar([(i, t) for i, _, t in rows], 3, 0.6)
    assert len(want) == 150 * 149 // 2
    assert set(tuples(neardup.similar_pairs(df, words=3, similarity=0.6))) == want


def test_parts_of_a_region_are_all_searched_exactly():
    """A region that is held in parts is a large one to its end, however small its last part."""
    keys = [5 << neardup.LOW_BITS | i for i in range(150)] + [6 << neardup.LOW_BITS, 6 << neardup.LOW_BITS]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 10]), pa.array(range(i, min(i + 10, 152)))], ["key", "class"]) for i in range(0, 152, 10)]
    defaults, arrowmap.sorted_groups.__defaults__ = arrowmap.sorted_groups.__defaults__, (10, 0, None)
    try:
        out = [r for b in neardup._walk(70)(iter(batches)) for r in b.to_pylist()]
    finally:
        arrowmap.sorted_groups.__defaults__ = defaults
    assert {r["a"] for r in out if r["b"] is None} == set(range(150))
    assert {(r["a"], r["b"]) for r in out if r["b"] is not None and r["b"] >= 150} == {(150, 151)}


def test_keys_that_stand_for_several_sets(spark, df, rows):
    got = tuples(neardup.similar_classes(df, words=3, similarity=0.6, class_bits=3)[0])
    want = neardup.similar_classes(df, words=3, similarity=0.6)[0].collect()
    for pairs in (got, want):
        assert len(pairs) == sum(t is not None for _, _, t in rows)
    assert len({c for _, c in got}) == len({c for _, c in want})
    assert set(tuples(neardup.similar_pairs(df, words=3, similarity=0.6))) == brute.similar([(i, t) for i, _, t in rows], 3, 0.6)


def test_a_boilerplate_of_many_is_not_squared(spark, monkeypatch):
    """20,000 texts with half of their wording in common stand in the same regions; of their 2 * 10^8 pairs a few for each text become candidates."""
    counted = []
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda *a: counted.append(a[-1].count()) or verified(*a))
    notice = " ".join(f"слово{i}" for i in range(40))
    text = F.concat_ws(" ", F.lit(notice), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64(F.col("src_id"), i), F.lit(1_000_000)).cast("string"))), " "))
    df = spark.range(20_000).select(F.col("id").alias("src_id"), text.alias("text"))
    df = df.union(df.filter("src_id < 3").select(F.col("src_id") + 20_000, F.concat("text", F.lit(" ещё")))).repartition(8)
    assert tuples(neardup.similar_pairs(df, words=3, similarity=0.6)) == [(0, 20_000), (1, 20_001), (2, 20_002)]
    assert counted[0] < 20 * 20_000


@pytest.mark.parametrize("length,k", [(200, 80), (60, 20)])
def test_shared_spans(df, rows, length, k):
    want = brute.shared_spans([(i, t) for i, _, t in dict((r[0], r) for r in rows).values()], length)
    assert tuples(spans.shared_spans(df, length=length, k=k)) == sorted(want)


def test_shared_spans_split_partitions(df, rows):
    want = brute.shared_spans([(i, t) for i, _, t in dict((r[0], r) for r in rows).values()], 60)
    assert tuples(spans.shared_spans(df, length=60, k=20, partition_runs=1)) == sorted(want)


@pytest.mark.parametrize("partition_runs", [10_000, 1])
def test_passages_name_a_record_that_has_them(df, rows, partition_runs):
    text = {i: t for i, _, t in rows}
    got = spans.passages(df, length=60, k=20, partition_runs=partition_runs).collect()
    covered = {}
    for r in got:
        assert r.id != r.other_id and r.n_chars >= 60
        assert text[r.id][r.start_pos - 1 : r.start_pos - 1 + r.n_chars] == text[r.other_id][r.other_pos - 1 : r.other_pos - 1 + r.n_chars]
        covered.setdefault(r.id, set()).update(range(r.start_pos, r.start_pos + r.n_chars))
    want = {}
    for i, start, n in brute.shared_spans([(i, t) for i, t in text.items()], 60):
        want.setdefault(i, set()).update(range(start, start + n))
    assert covered == want


def test_repeats_of_a_tree_against_all_pairs():
    rng = random.Random(21)
    for trial in range(400):
        length, m = 12, rng.randrange(2, 30)
        after = ["ab" + "".join(rng.choice("ab") for _ in range(rng.randrange(4, 20))) for _ in range(m)]
        behind = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 10))) for _ in range(m)]
        record = [rng.randrange(1, 6) for _ in range(m)]
        right, left = sorted(range(m), key=after.__getitem__), sorted(range(m), key=behind.__getitem__)
        place = {x: i for i, x in enumerate(left)}
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common_prefixes([after[x] for x in right]).tolist() == [common(after[x], after[y]) for x, y in zip(right, right[1:])]
        depth = [common(after[x], after[y]) for x, y in zip(right, right[1:])]
        before = [common(behind[x], behind[y]) for x, y in zip(left, left[1:])]
        got = {x: set() for x in range(m)}
        for x, lo, hi, y in spans.repeats(depth, [place[x] for x in right], before, [record[x] for x in right], length, 2):
            x, y = right[x], right[y]
            assert record[x] != record[y] and common(behind[x], behind[y]) >= hi and common(after[x], after[y]) >= length - lo
            got[x].update(range(lo, hi + 1))
        for x in range(m):
            want = set()
            for y in range(m):
                if record[x] != record[y]:
                    want.update(range(length - common(after[x], after[y]), common(behind[x], behind[y]) + 1))
            assert {a for a in got[x] if a >= 0} == {a for a in want if a >= 0}


def test_periodic_texts(spark):
    rows = [(1, "a", "аб" * 300), (2, "a", "х" * 10 + "аб" * 120 + "у" * 300), (3, "a", "ц" * 500), (4, "a", "ц" * 250 + "."), (5, "a", "ъ" * 199)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(brute.shared_spans([(i, t) for i, _, t in rows], 200))
    assert tuples(spans.shared_spans(df)) == want
    assert tuples(spans.shared_spans(df, partition_runs=1)) == want


def test_bpe_is_the_public_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    from pathlib import Path

    if not Path(bpe.VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    ranks = bpe.load_ranks(Path(bpe.VOCABULARY).read_bytes())
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "Привет, мир! 123 don't", "а" * 3000, "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000)), "👍🏽 ́é", "abc" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "Привет"])], "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.id: r.ids for r in bpe.encode(df).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in enumerate([*texts, "Привет"])}
    assert bpe.encode(df.limit(0)).count() == 0


def test_long_words_merge_alike():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 290, b"ab": 310, b"aab": 305}
    rng = random.Random(4)
    for _ in range(200):
        word = bytes(rng.choice(b"aaab") for _ in range(rng.randrange(2, 40)))
        if word not in ranks:
            assert bpe.merge(word, ranks) == bpe._merge_long(word, ranks)


def documents(rng):
    items = [(i, sentence(rng, rng.randrange(10, 60))) for i in range(12)] + [(50, None), (51, ""), (52, "коротко")]
    docs = []
    for d in range(80):
        text = sentence(rng, 40)
        if d % 2:
            w = items[rng.randrange(12)][1].split()
            at, n = rng.randrange(max(1, len(w) - 16)), rng.randrange(12, 30)
            part = w[at : at + n]
            if d % 8 == 1 and len(part) > 16:
                part[8] = "замена"
            text = sentence(rng, 5) + " " + ", ".join(part).upper() + "\n" + sentence(rng, 9)
        docs.append((d, text))
    return docs + [(100, None), (101, ""), (102, items[0][1] * 50), (0, docs[0][1])], items


def test_leaks(spark):
    docs, items = documents(random.Random(8))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string")
    got = tuples(leaks.leaks(d, i).filter("exact_words >= 15").select("doc_id", "item_id"))
    assert set(got) == brute.leaked(docs, [x for x in items if x[1]], 15)
    assert leaks.leaks(d, i.limit(0)).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def test_leaks_by_joins(spark, monkeypatch):
    """Items that are too many to be held give the same rows."""
    docs, items = documents(random.Random(9))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [items[3]], "item_id long, text string")
    want = tuples(leaks.leaks(d, i))
    monkeypatch.setattr(leaks, "ITEM_BYTES", 10)
    assert tuples(leaks.leaks(d, i)) == want and want
    got = tuples(leaks.leaks(d, i).filter("exact_words >= 15").select("doc_id", "item_id"))
    assert set(got) == brute.leaked(docs, [x for x in items if x[1]], 15)
    assert leaks.leaks(d, i.filter("text is not null and length(text) < 20")).count() == 0 and leaks.leaks(d.limit(0), i).count() == 0


def edited(rng):
    """Documents with passages of items, a word of which is replaced, missing or extra, of about the same or of quite another length."""
    items = [(i, " ".join("".join(rng.choice("абвгдежзик") for _ in range(rng.choice([2, 6, 6, 9]))) for _ in range(rng.randrange(14, 45)))) for i in range(10)]
    items += [(20, "сеть " * 20), (21, "да нет " * 9)]
    docs = []
    for d in range(240):
        w = rng.choice(items)[1].split()
        n = min(len(w), rng.choice([14, 15, 16, 17, 24, 30]))
        at = rng.randrange(len(w) - n + 1)
        part = w[at : at + n]
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
            k = rng.choice([len(part) // 2, rng.randrange(len(part))])
            new = rng.choice([["ы" * rng.choice([1, 6, 13, 40])], [], [part[k], "щ" * rng.choice([1, 7, 25])], [part[k], part[k]]])
            part[k : k + 1] = new
        docs.append((d, " ".join(["начало", *part, "и", "конец"])))
    return docs, items


@pytest.mark.parametrize("edits,item_bytes", [(0, 1 << 20), (1, 1 << 20), (2, 1 << 20), (1, 10)])
def test_leaks_with_words_edited(spark, monkeypatch, edits, item_bytes):
    monkeypatch.setattr(leaks, "ITEM_BYTES", item_bytes)
    docs, items = edited(random.Random(3))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.aligned_words for r in leaks.leaks(d, i, edits=edits).filter("aligned_words >= 15").collect()}
    best = {(a, b): brute.aligned(brute.words(t), brute.words(u), edits) for a, t in docs for b, u in items}
    want = {k: n for k, n in best.items() if n >= 15}
    assert len(want) > 50 and got == want


def test_leaks_past_a_longer_word(spark):
    words = [f"слово{chr(0x430 + k)}" for k in range(24)]
    docs = [(1, " ".join(words[:7] + ["в" * 13] + words[8:16])), (2, " ".join(words[:12] + ["ещёоднодлинное"] + words[12:])), (3, " ".join(words[:7] + words[8:16])), (4, " ".join(words[:7] + ["в" * 13] + words[8:15]))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {(r.doc_id, r.aligned_words) for r in leaks.leaks(d, i).filter("aligned_words >= 15").collect()}
    assert got == {(1, 15), (2, 24), (3, 15)}


STOPS = ["и", "в", "на", "Сеть", None, "и"]


def quality_docs(rng):
    odd = ["", " \n\t ", None, "и", "12 34 56 78 90 11 22 33.", "! " * 50, "a" * 5000, "Строка без конца\nи ещё одна\nи конец.", "в и на в и на в и.\r\n", "сеть и связь в городе на неделе и час в район!\n- пункт", "  x", "слово́ и в на и в на и в."]
    return [(i, t) for i, t in enumerate(odd + [" ".join(rng.choice(WORDS + ["и", "в", "на"]) for _ in range(rng.randrange(1, 40))) + rng.choice([".", "", "…", "\n"]) for _ in range(60)])] + [(3, "и")]


def test_quality(spark):
    docs = quality_docs(random.Random(6))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit("clash"))
    s = spark.createDataFrame([(w,) for w in STOPS], "word string")
    want = brute.not_prose(docs, {w.lower() for w in STOPS if w})
    assert {r.doc_id for r in quality.not_prose(d, s, rules=quality.RULES[:-1]).collect()} == want
    stats = quality.text_statistics(d, s).collect()
    assert len(stats) == len(docs)
    assert all((r.reasons is None) == (r.n_chars is None) for r in stats)


def test_quality_with_many_stop_words(spark, monkeypatch, tmp_path):
    """The joined path gives the same, also over input that is read in fewer partitions than there are cores and spread."""
    docs = quality_docs(random.Random(7)) * 3
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spread(spark.read.parquet(str(tmp_path / "d")))
    assert d.rdd.getNumPartitions() > 1
    s = spark.createDataFrame([(w,) for w in STOPS], "word string")
    few = sorted(map(str, quality.text_statistics(d, s).collect()))
    assert len(few) == len(docs)
    monkeypatch.setattr(quality, "MAX_LITERALS", 2)
    assert sorted(map(str, quality.text_statistics(d, s).collect())) == few
    assert {r.doc_id for r in quality.not_prose(d, s, rules=quality.RULES[:-1]).collect()} == brute.not_prose(docs, {w.lower() for w in STOPS if w})
    monkeypatch.undo()
    assert quality.not_prose(d, s.limit(0)).count() > 0


def test_bullets_are_a_reason(spark):
    text = "\n".join("- в районе сеть и в городе связь на неделе." for _ in range(20))
    d = spark.createDataFrame([(1, text), (2, text.replace("- ", ""))], "doc_id long, text string")
    s = spark.createDataFrame([(w,) for w in STOPS], "word string")
    assert {r.doc_id: r.reasons for r in quality.text_statistics(d, s).collect()} == {1: ["bullets"], 2: []}


def test_empty_tables(none):
    assert sourcelines.excess_occurrences(none).count() == 0
    assert sourcelines.without_repeated_lines(none).count() == 0
    assert unify.same_look_pairs(none).count() == 0 and unify.unify(none).count() == 0
    assert neardup.similar_pairs(none).count() == 0 and neardup.groups(none).count() == 0
    assert spans.shared_spans(none).count() == 0


@pytest.mark.parametrize("partition_runs", [10_000, 1])
def test_shared_spans_of_one_id_with_several_texts(spark, partition_runs):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, "a", a), (1, "a", b), (2, "a", "начало " + a), (3, "a", c + " конец"), (4, "a", c[:250])]
    got = tuples(spans.shared_spans(spark.createDataFrame(rows, SCHEMA), partition_runs=partition_runs))
    assert got == sorted([(1, 1, len(a)), (2, 8, len(a)), (3, 1, 250), (4, 1, 250)])
