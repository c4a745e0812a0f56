import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.operators import corpus, places, rules
from tidemark.operators.rules import Accept, Guard, LabelGuard, Near, Not, Part, PlaceGuard, Rule
from tidemark.plans import rulesql
from tidemark.tables import materialize


def one(spark, expression, **columns):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in columns.items()))
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ёлка и елка", ["елка", "и", "елка"]),
        ("Топ-100, 3.5%", ["топ", "100", "3", "5"]),
        ("👍🔥", []),
        ("", []),
        (None, None),
        ("а б", ["а", "б"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, X.tokens(F.col("t")), t=text) == want


def test_compounds(spark):
    assert one(spark, X.tokens(F.col("t"), compounds=True), t="кто-то 3.5 12:30.") == ["кто-то", "3.5", "12:30"]


def near_cel(spark, tokens, i, r):
    return one(spark, W.near_prefix(F.col("t"), F.lit(i), r, ["цель"]), t=tokens)


def test_window_edges(spark):
    t = ["x"] * 10
    for at in range(10):
        tokens = [*t[:at], "цельный", *t[at + 1 :]]
        for i in range(10):
            assert near_cel(spark, tokens, i, 3) == (abs(at - i) <= 3), (at, i)
    assert near_cel(spark, ["цель"], 0, 5) is True
    assert one(spark, W.prefix_places(F.col("t"), ["a"]), t=[]) == []
    assert one(spark, W.near_exact(F.col("t"), F.lit(0), 2, ["b"]), t=["a", "x", "b"]) is True


@pytest.mark.parametrize("tokens,want", [(["совет", "безопасности"], [0]), (["совет", "x", "безопасности"], [0]), (["совет", "x", "x", "безопасности"], []), (["безопасности", "совет"], [])])
def test_pairs(spark, tokens, want):
    assert one(spark, W.pair_places(F.col("t"), ["совет"], ["безопасност"], 2), t=tokens) == want


RULE = Rule("r", "G", prefixes=("цел",), words=("мм",), pairs=(("пер", "вто"),), guards=(Guard("bad", (Near(1, ("плох",)),)), Guard("both", (Near(4, ("бел",)), Near(4, ("дом",)))), LabelGuard("land", 2, {"фран": "F", "поль": "P"})))
NEEDS = Rule("n", "G", words=("ап",), requires=Near(2, ("власт",)))


@pytest.mark.parametrize(
    "rule,text,status,guard",
    [
        (RULE, "ничего такого", None, None),
        (RULE, "целое", "match", None),
        (RULE, "плохое целое", "excluded", "bad"),
        (RULE, "плохое целое и потом ещё раз целое", "match", None),
        (RULE, "целое белое здание", "match", None),
        (RULE, "целое белое у дома", "excluded", "both"),
        (RULE, "целое во франции", "excluded", "land:F"),
        (RULE, "целое из польши да франции", "excluded", "land:P"),
        (RULE, "плохое целое тут и там и здесь вот мм франция", "excluded", "land:F"),
        (RULE, "первый после второй", "match", None),
        (RULE, "плохое целое а б в г первый второй", "match", None),
        (NEEDS, "ап", "excluded", "n_no_context"),
        (NEEDS, "ап и власть", "match", None),
        (NEEDS, "ап и тут власть", "excluded", "n_no_context"),
    ],
)
def test_verdicts(spark, rule, text, status, guard):
    got = one(spark, rule.verdict(X.tokens(F.col("t"))), t=text)
    assert (got and got.status, got and got.guard) == (status, guard)


def footer(spark, text):
    return one(spark, X.footer_lines(F.col("t")), t=text)


def test_footer_lines(spark):
    assert footer(spark, "Это просто текст\nПодписаться на канал") == [1]
    assert footer(spark, "Имя канала\n\nПодписаться") == [0, 2]
    assert footer(spark, "Имя канала\n\nЕщё текст") == []
    assert footer(spark, "Вот три слова\nПодписаться") == [1]
    assert footer(spark, "x" * 60 + "\nПодписаться") == [0, 1]
    assert footer(spark, "x" * 61 + "\nПодписаться") == [1]
    assert footer(spark, "Подписаться " + "x" * 189) == []
    assert footer(spark, "Один\nДва\nПодписаться") == [1, 2]
    assert footer(spark, "") == [] and footer(spark, None) is None


@pytest.mark.parametrize("value,want", [("1 234", 1234), ("12.7", 12), ("-3.9", -3), ("abc", None), ("", None), (None, None), ("0", 0), ("1 000", 1000), ("1e30", None), ("nan", None)])
def test_counts_from_text(spark, value, want):
    assert one(spark, X.to_count(F.col("v")), v=value) == want


def test_rating_lists(spark):
    test = corpus.rating_list(X.norm_text(F.col("t")))
    assert one(spark, test, t="Топ-100 каналов") and one(spark, test, t="Подборка каналов " + "@a " * 8)
    assert not one(spark, test, t="Подборка каналов " + "@a " * 7) and not one(spark, test, t="Топ-100 песен")


PLATFORM, BLOCK = "телеграм", "замедляют"


@pytest.mark.parametrize(
    "text,match,guard",
    [
        (f"{PLATFORM} {BLOCK}", True, None),
        (BLOCK, False, None),
        (f"{PLATFORM} " + "слово " * 39 + BLOCK, True, None),
        (f"{PLATFORM} " + "слово " * 40 + BLOCK, False, "c_far_cooccurrence"),
        (f"{PLATFORM} " + "слово " * 11 + "отключили", True, None),
        (f"{PLATFORM} " + "слово " * 12 + "отключили", False, "c_off_far_from_platform"),
        (f"{PLATFORM} блокируют счета", False, "c_block_financial"),
        (f"{PLATFORM} блокируют войска", False, "c_block_military"),
        (f"{PLATFORM} {BLOCK} в польше", False, "c_foreign:Польша"),
    ],
)
def test_residual(spark, text, match, guard):
    rule = corpus.residual(places.countries(spark))
    got = rules.judge((rule,))(X_tokens(text))
    assert ((got[0]["status"] == "match", got[0]["guard"]) if got else (False, None)) == (match, guard)


def X_tokens(text):
    return re.findall(r"[^\W_]+", text.lower().replace("ё", "е"))


def verdict(rule, text, **more):
    got = rules.judge((rule,))(X_tokens(text), **more)
    return (got[0]["status"], got[0]["guard"]) if got else (None, None)


CHAIN = Rule(
    "person", "G",
    parts=(
        Part(words=("лебедь",)),
        Part(words=("лебедя", "лебедю"), otherwise="ambiguous", steps=(Guard("bird", (Near(2, ("птиц",)),)), Guard("lake", (Near(prefixes=("озер",), before=-1, after=1),)), Accept((Near(3, ("депутат",)),)), Guard("zoo", (Near(5, ("зоопарк",)), Not(Near(1, ("закон",))))), Accept((Near(5, ("закон",)),)))),
    ),
    sources=("lebed_news",),
)


@pytest.mark.parametrize(
    "text,want",
    [
        ("лебедь", ("match", None)),
        ("видели лебедя", ("excluded", "ambiguous")),
        ("птица лебедю депутат", ("excluded", "bird")),
        ("лебедю озеро депутат", ("excluded", "lake")),
        ("озеро лебедю депутат", ("match", None)),
        ("лебедю из зоопарка", ("excluded", "zoo")),
        ("закон лебедю из зоопарка", ("match", None)),
        ("лебедя в зоопарке ждёт закон", ("excluded", "zoo")),
        ("лебедю мешает новый закон", ("match", None)),
        ("птица лебедю и много слов дальше лебедя депутат", ("match", None)),
    ],
)
def test_steps_are_taken_in_order(text, want):
    assert verdict(CHAIN, text) == want


def test_own_source_and_hashtags(spark):
    assert verdict(CHAIN, "лебедь", source="lebed_news") == ("excluded", "self_channel") == verdict(CHAIN, "", source="lebed_news")
    assert verdict(CHAIN, "лебедь", source="other") == ("match", None)
    tagged = Rule("name", "P", prefixes=("имя",), hashtag="имя")
    df = spark.createDataFrame([(1, "#имя"), (2, "#имя имя"), (3, "имярек"), (4, "нет")], "id long, text string").withColumn("tokens", X.tokens(F.col("text")))
    got = {r.id: [(v.status, v.guard) for v in r.verdicts] for r in rules.apply_rules(df, (tagged,), norm=X.norm_text(F.col("text"))).collect()}
    assert got == {1: [("excluded", "hashtag_only")], 2: [("match", None)], 3: [("match", None)], 4: []}


def office(spark, text, **options):
    return {v["term"]: (v["status"], v["guard"], v["guarded"]) for v in rules.judge(corpus.office(places.countries(spark), **options))(X_tokens(text))}


def test_office_and_what_disqualifies_it(spark):
    assert office(spark, "Президент сказал") == {"prezident": ("match", None, False)}
    assert office(spark, "Офис президента") == {"prezident": ("excluded", "office_of_president", True)}
    assert office(spark, "президентский дворец") == {"prezident": ("excluded", "presidential_object", True)}
    assert office(spark, "президент УЕФА") == {"prezident": ("excluded", "president_of_org", True)}
    assert office(spark, "президент Франции") == {"prezident": ("excluded", "country:Франция", True)}
    assert office(spark, "немецкий президент") == {"prezident": ("excluded", "foreign_adj", True)}
    assert office(spark, "президент Петров", leaders=("петров",)) == {"prezident": ("excluded", "foreign_leader", True)}
    # The office of the own country, or a name, lets guarded mentions count.
    assert office(spark, "Президент России и президент Франции")["prezident"] == ("match", None, True)
    assert office(spark, "Иванов и президент Франции", persons=("иванов",)) == {"prezident": ("match", None, True), "name": ("match", None, False)}
    assert office(spark, "Верховный суд") == {"verkhovn": ("excluded", "rada_lider_komissar_sud", True)}
    assert office(spark, "Верховный суд и верховный сказал")["verkhovn"] == ("match", None, True)
    assert office(spark, "рост ВВП") == {"vvp": ("excluded", "econ_context", True)} and office(spark, "ВВП прибыл") == {"vvp": ("match", None, False)}
    assert office(spark, "от первого лица")["pervoe_litso"][1] == "ot_pervogo_litsa"
    assert office(spark, "первое лицо государства")["pervoe_litso"][0] == "match" and office(spark, "первое лицо")["pervoe_litso"][1] == "no_power_context"
    assert office(spark, "национальный наш лидер")["natslider"][0] == "match"
    df = spark.createDataFrame([(1, "Президент сказал и президент Франции"), (2, "Президент сказал"), (3, "Президент сказал, что завтра прибудет немецкий гость"), (4, None)], "id long, text string")
    got = {r.id: r.mixed for r in corpus.carve_office(df, "id", "text", markers=places.ADJECTIVES).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert [r.id for r in rules.without_mixed(spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, mixed boolean")).collect()] == [2, 3]


def test_persons_from_what_the_caller_knows():
    simple = corpus.person("ivolgin", "A", stem="иволгин")
    assert verdict(simple, "иволгину") == ("match", None) and verdict(simple, "иволга") == (None, None)
    form = corpus.person("sokol", "A", forms=("сокол",), ambiguous=("сокола", "соколу"), context=("депутат", "закон"))
    assert verdict(form, "сокол") == ("match", None) and verdict(form, "видели сокола") == ("excluded", "sokol_ambiguous") and verdict(form, "депутату соколу") == ("match", None)
    other = corpus.person("gusev", "B", stem="гусев", relatives=("анн",), others={"gusev_tennis": (2, ("теннис",))}, followed_by=("улиц",), not_words=(6, ("мяч",)), own_sources=("gusev_note",))
    assert verdict(other, "анна гусева") == ("excluded", "gusev_other_person") and verdict(other, "теннисист гусев") == ("excluded", "gusev_tennis")
    assert verdict(other, "гусева улица") == ("excluded", "gusev_other_thing") and verdict(other, "гусев взял в руки мяч") == ("excluded", "gusev_other_words") and verdict(other, "гусев взял мячи") == ("match", None)
    assert verdict(other, "гусев", source="gusev_note") == ("excluded", "self_channel")
    needs = corpus.person("zimin", "B", stem="зимин", given_names=("олег",), context=("комитет",))
    assert verdict(needs, "зимин") == ("excluded", "zimin_no_context") and verdict(needs, "олег зимин") == ("match", None) and verdict(needs, "зимин пришёл в комитет") == ("match", None)


def test_anchor_of_a_pair(spark):
    rule = next(r for r in corpus.registry(places.countries(spark)) if r.name == "adm_prezidenta")
    assert verdict(rule, "администрация нового президента сша") == ("excluded", "ap_foreign:США")
    assert verdict(rule, "в сша наша администрация нового президента") == ("match", None)


def test_places():
    names = ["Конго - Браззавиль", "Республика Корея", "Конго", "Того", "Франция", "Польша", "Чили", "Ирак", "Соединенные Штаты", "Остров Мэн"]
    found = places.gazetteer([*names, "Южная Корея"], {"сша": "США"}, lemmas={"галлию": "франция"})
    assert found["францией"] == found["галлию"] == "Франция" and found["польше"] == "Польша" and found["чили"] == "Чили" and found["ираком"] == "Ирак" and found["сша"] == "США"
    assert "корея" not in found and "того" not in found and "мэн" not in found and found["браззавиль"] == "Конго - Браззавиль"
    guard = Rule("r", "G", prefixes=("цел",), guards=(PlaceGuard("near", 2, {"рим": "Италия"}, ("немецк",), ("петров",)),))
    assert verdict(guard, "петров цель рим") == ("excluded", "near:Италия")
    assert verdict(guard, "петров цель немецкий") == ("excluded", "near:leader:петров") and verdict(guard, "немецкий петров цель") == ("excluded", "near:adj:немецк")


def test_lemmas_from_a_table(spark):
    lemmas = spark.createDataFrame([("городу", "город"), ("людей", "человек"), ("людей", "люди")], "token string, lemma string")
    df = spark.createDataFrame([(1, ["городу", "и", "людей", "городу"]), (2, []), (3, None), (1, ["городу"])], "_token long, words array<string>")
    got = sorted(((r[0], r.words) for r in places.lemmatized(df, "words", lemmas).collect()), key=str)
    assert got == sorted([(1, ["город", "и", "люди", "город"]), (2, []), (3, None), (1, ["город"])], key=str)


def test_countries_beside_an_office(spark):
    df = spark.createDataFrame([(["президент", "франции", "и", "президент", "польши"],), (["президент", "сша", "чили"],), (["франции"],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(corpus.countries_near(F.col("t"), places.countries(spark))).collect()]
    assert got == [["Польша", "Франция"], ["США"], [], []]


def test_rules_agree_with_their_sql(spark):
    """All rule sets, with leaders and names, over texts of the rules' own words in any order."""
    duckdb = pytest.importorskip("duckdb")
    names, rng = places.countries(spark), random.Random(17)
    sets = [corpus.registry(names, ("петров",)), (corpus.residual(names, ("петров",)),), corpus.office(names, ("петров",), full_names=(("иван", "ильич"),)), corpus.office_query(), corpus.triggers(("петров",)), corpus.aliases(), (CHAIN,)]
    for wanted in sets:
        words = set()
        classes = rules.TokenClasses()
        for r in wanted:
            r.compiled(classes)
        for prefixes, exact in classes.classes:
            words |= {p + rng.choice(["", "а", "ому"]) for p in prefixes} | set(list(exact)[:20])
        words = sorted(words) + ["слово", "ещё", "и"] * 4
        heads = [p for r in wanted for part in r.all_parts() for p in (*part.prefixes, *part.words, *(x.lstrip("=") for pair in part.pairs for x in pair))]
        docs = [[rng.choice(heads if rng.random() < 0.35 else words) for _ in range(rng.randrange(0, 60))] for _ in range(250)]
        run = rules.judge(wanted)
        got = sorted((i, v["term"], v["grp"], v["status"], v["guard"] or "", v["guarded"]) for i, d in enumerate(docs) for v in run(d))
        c = duckdb.connect()
        c.execute("create table t (id bigint, w varchar[])")
        c.executemany("insert into t values (?, ?)", list(enumerate(docs)))
        q = f"with docs as (select * from t, {rulesql.gazetteer(names)}) select id, term, grp, status, coalesce(guard, ''), guarded from {rulesql.verdicts(wanted, 'docs', 'id')}"
        assert sorted(c.execute(q).fetchall()) == got and got


def test_unseen_posts_are_dropped_last(spark):
    rows = [(1, "Роскомнадзор", "1 200"), (2, "Роскомнадзор", "0"), (3, "Роскомнадзор", None), (4, "Роскомнадзор", "x"), (5, "кремль Казани", None)]
    df = spark.createDataFrame(rows, "id long, text string, views string")
    got = {r.id: r.dropped for r in corpus.carve(df, "id", "text", views_col="views").collect()}
    assert got == {1: None, 2: "views", 3: "views", 4: "views", 5: None}


def test_rules_of_the_caller_pass_the_prescreen(spark):
    df = spark.createDataFrame([(1, "Иволгин выступил"), (2, "Погода"), (3, "#сокол"), (4, "Сокол и президент Франции")], "id long, text string")
    names = places.countries(spark)
    own = (*corpus.registry(names), corpus.person("ivolgin", "A", stem="иволгин"))
    assert {r.id: r.terms for r in corpus.carve(df, "id", "text", rules=own).collect()} == {1: "ivolgin"}
    got = {r.id: (r.terms, r.mixed) for r in corpus.carve_office(df, "id", "text", rules=corpus.office(names, persons=("сокол",))).collect()}
    assert got == {3: ("", False), 4: ("name,prezident", True)}


def test_another_corpus_leaves_nothing_over(spark):
    df = spark.createDataFrame([(1, "Замедляют телеграм"), (2, "Президент знает, что замедляют телеграм"), (3, "Верховный суд: замедляют телеграм")], "id long, text string")
    assert {r.id: r.residual for r in corpus.carve(df, "id", "text").collect()} == {1: True, 2: False, 3: True}


def test_carving(spark):
    rows = [(1, "Роскомнадзор сообщил о сбое"), (2, "Погода\nНаш канал: телеграм ограничен"), (3, "Топ-100 каналов про кремль"), (4, "Замедляют телеграм и всё"), (5, "ФАС"), (6, None), (7, "пусто"), (8, "Кремль в Казани и Роскомнадзор")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in corpus.carve(df, "id", "text").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8}
    assert got[1].terms == "roskomnadzor" and got[1].grps == "A" and not got[1].residual
    assert got[2].dropped == "footer_only" and got[2].footer_lines == 2 or got[2].footer_lines == 1
    assert got[3].dropped == "rating_list" and got[3].terms == ""
    assert got[4].residual and got[4].terms == ""
    assert got[5].terms == "" and [v.guard for v in got[5].verdicts] == ["fas_no_context"]
    assert got[8].terms == "roskomnadzor" and {v.guard for v in got[8].verdicts} == {None, "kreml_city"}
    report = rules.exclusion_report(materialize(corpus.carve(df, "id", "text").select("id", "verdicts"), "carved"), "id").collect()
    assert {(r.term, r.guard, r.n, r.first_ids) for r in report} == {("fas", "fas_no_context", 1, "5"), ("kreml", "kreml_city", 1, "8")}


def test_labels_and_names(spark):
    assert one(spark, X.sentiment_label(F.col("v")), v="Позитивный") == "positive"
    assert one(spark, X.sentiment_label(F.col("v")), v="NEGATIVE") == "negative"
    assert one(spark, X.topic_label(F.col("v")), v="-1_outliers") == "outliers"
    assert one(spark, X.author_name(F.col("a"), F.col("b"), F.col("c")), a="x", b="t", c="7") == "@x"
    assert one(spark, X.author_name(F.col("a"), F.col("b"), F.col("c")), a=" ", b=" t ", c="7") == "t"
    assert one(spark, X.author_name(F.col("a"), F.col("b"), F.col("c")), a=None, b=None, c="7") == "id_7"
    assert one(spark, X.separated(F.col("v")), v="") == [] and one(spark, X.separated(F.col("v")), v="a,b") == ["a", "b"]
    assert str(one(spark, X.local_day(F.col("v")), v="2025-01-01T23:30:00-05:00")) == "2025-01-01"
    assert str(one(spark, X.utc_day(F.col("v")), v="2025-01-01T23:30:00-05:00")) == "2025-01-02"
    assert one(spark, X.utc_day(F.col("v")), v="nonsense") is None
    assert one(spark, X.snippet(F.col("v")), v="a " * 200) == ("a " * 200).strip()[:177] + "..."
