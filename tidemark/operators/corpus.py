"""Carving a corpus out of posts: prescreen, footers, rating lists, rules, and what no rule names.

The cheap substring tests come first, so that tokens and windows are only made
for posts that can match; nothing here moves a row.

Rules are about institutions and offices.  Terms that are persons, and leaders whose
names mark a mention as foreign, are given by the caller (``names``, ``leaders``).
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import windows as W
from tidemark.operators import places
from tidemark.operators.rules import Accept, Guard, Near, Not, Part, PlaceGuard, Rule, apply_rules, groups, terms

# What disqualifies a mention of an institution, and what confirms one.
SPACE = ("ракет", "космодром", "носител")
REGIONS = ("област", "республик", "округ", "регион")
REGION_FORMS = ("край", "края", "краю", "краем", "крае")
KREMLIN_CITIES = (
    "казан", "нижегород", "новгород", "тульск", "псковск", "астрахан", "ростовск", "коломен", "измайлов", "рязан", "смолен", "тоболь",
    "зарайск", "углич", "вологод", "суздал", "волоколам", "александровск",
)
AP_CONTEXT = ("кремл", "администрац", "кириенко", "внутрипол", "куратор", "президент")
FAS_CONTEXT = ("антимонопольн", "служб", "штраф", "возбуд", "тариф", "реклам", "оператор", "монопол", "картел", "сговор")

# Cheap tests that every post with a term or a platform and a restriction passes.
PRESCREEN = ("роскомнадзор", "роскомпозор", "грчц", "тспу", "ссоп", "радиочастотн", "минцифр", "минсвяз", "кабмин", "кремл", "администрац", "совбез", "генпрокуратур")
SHORT_WORDS = ("ркн", "ап", "фас", "vpn", "впн", "тг")
PRESCREEN_WORD = rf"(?U)\b(?:{'|'.join(SHORT_WORDS)})\b"
RESTRICT = ("блокир", "замедл", "ограничен", "ограничив", "отключ", "цензур", "шатдаун")
PLATFORM = ("телеграм", "telegram", "мессенджер", "ютуб", "youtube", "whatsapp", "вотсап", "ватсап", "рунет", "vpn", "впн")
PLATFORM_PREFIXES = PLATFORM[:9]
PLATFORM_WORDS = ("vpn", "впн", "тг")

# What a blocking must not be near to be about networks, and how near the platform must be.
FINANCE = ("счет", "актив", "карт", "транзакц", "санкци")
MILITARY = ("позиц", "войск", "групп", "окружен", "гарнизон", "плацдарм", "котл")
FAR, NEAR = 40, 12

# Words about the office of a president, and what disqualifies them.
OFFICE_PRESCREEN = r"(?U)президент|верховн|владимирович|\bввп\b|перво[ег]\w*\s+лиц|нацлидер|национальн\w*\s+лидер|главковерх"
PRESIDENT_OBJECTS = ("дворец", "дворц", "бригад", "резиденц", "комплекс")
PRESIDENT_ORGANISATIONS = ("уефа", "фифа", "клуба", "компании", "федерации", "ассоциации", "академии")
SUPREME_OTHERS = ("суд", "рад", "лидер", "комиссар", "представит")
GDP_CONTEXT = ("рост", "росл", "процент", "трлн", "млрд", "доллар", "юан", "эконом", "инфляц", "дефицит", "номинал", "паритет", "душ")
FIRST_PERSON = ("=первое", "=первого", "=первому")
FIRST_PERSON_OTHERS = ("fpv", "фпв", "дрон")
FIRST_PERSON_CONTEXT = ("власт", "государств", "стран", "кремл", "решени", "доклад", "верховн", "главнокоманд")
NATIONAL_LEADER_OTHERS = ("кадыров", "зеленск", "чечн", "украин")
# Stems of adjectives of countries beside an office, and those an audit looks for.
OFFICE_ADJECTIVES = (
    "украинск", "киевск", "американск", "французск", "немецк", "британск", "польск", "болгарск", "израильск", "иранск", "турецк", "казахстанск",
    "белорусск", "армянск", "азербайджанск", "молдавск", "грузинск", "эстонск", "латвийск", "литовск", "сирийск", "венесуэльск", "финск",
    "чешск", "словацк", "румынск", "венгерск", "сербск", "южнокорейск", "севернокорейск", "китайск", "индийск", "бразильск", "аргентинск",
)
AUDIT_ADJECTIVES = (
    "украинск", "киевск", "американск", "французск", "немецк", "британск", "польск", "болгарск", "израильск", "иранск", "турецк", "казахстанск",
    "белорусск", "армянск", "азербайджанск", "молдавск", "грузинск", "эстонск", "латвийск", "литовск", "сирийск", "венесуэльск", "финск",
    "чешск", "словацк", "румынск", "венгерск", "сербск", "бывш",
)


def registry(names: dict[str, str], leaders: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """The terms of the corpus: institutions and what disqualifies a mention of them."""

    def foreign(term: str, radius: int) -> PlaceGuard:
        return PlaceGuard(f"{term}_foreign", radius, names, places.ADJECTIVES, leaders)

    return (
        Rule("roskomnadzor", "A", prefixes=("роскомнадзор", "роскомпозор")),
        Rule("rkn_abbr", "A", words=("ркн",), guards=(Guard("rkn_space_homonym", (Near(12, SPACE),)),)),
        Rule("rkn_infra", "A", words=("грчц", "тспу", "ссоп"), pairs=(("радиочастотн", "центр"),)),
        Rule("mincifry", "A", prefixes=("минцифр", "минсвяз"), pairs=(("министерств", "цифров"),), guards=(foreign("mincifry", 3), Guard("mincifry_regional", (Near(3, REGIONS, REGION_FORMS),)))),
        Rule("kreml", "B", prefixes=("кремл",), guards=(Guard("kreml_city", (Near(4, KREMLIN_CITIES),)), Guard("kreml_channel_name", (Near(1, ("прачк",)),)))),
        Rule("adm_prezidenta", "B", pairs=(("администрац", "президент"),), at_second=True, guards=(foreign("ap", 2),)),
        Rule("ap_abbr", "B", words=("ап",), requires=Near(10, AP_CONTEXT)),
        Rule("sovbez", "B", prefixes=("совбез",), pairs=(("совет", "безопасност"),), guards=(foreign("sovbez", 4), Guard("sovbez_white_house", (Near(4, ("белог",)), Near(4, ("дом",)))))),
        Rule("kabmin", "GOV", prefixes=("кабмин",), guards=(foreign("kabmin", 3),)),
        Rule("fas", "AGENCIES", words=("фас",), requires=Near(10, FAS_CONTEXT)),
        Rule("genprok", "AGENCIES", prefixes=("генпрокуратур",), pairs=(("генеральн", "прокуратур"),), guards=(foreign("genprok", 3),)),
    )


def residual(names: dict[str, str], leaders: tuple[str, ...] = ()) -> Rule:
    """Talk of restricted platforms without any actor.

    A restriction counts if no guard fires at it; it and a platform must be within
    40 tokens.  The last guard in the text is reported if none is left.
    """
    foreign = PlaceGuard("c_foreign", 4, names, places.ADJECTIVES, leaders)

    def far(kind: str) -> Guard:
        return Guard(f"c_{kind}_far_from_platform", (Not(Near(NEAR, PLATFORM_PREFIXES, PLATFORM_WORDS)),))

    return Rule(
        "residual",
        "C",
        parts=(
            Part(("блокир", "заблокир", "разблокир"), steps=(Guard("c_block_financial", (Near(3, FINANCE),)), Guard("c_block_military", (Near(4, MILITARY),)), foreign)),
            Part(("замедл", "цензур"), ("шатдаун",), steps=(foreign,)),
            Part(("ограничен", "ограничив"), steps=(far("restrict"), foreign)),
            Part(("отключ",), steps=(far("off"), foreign)),
        ),
        in_order=True,
        partner=Near(FAR, PLATFORM_PREFIXES, PLATFORM_WORDS),
        partner_guard="c_far_cooccurrence",
    )


def office(names: dict[str, str], leaders: tuple[str, ...] = (), persons: tuple[str, ...] = (), full_names: tuple[tuple[str, str], ...] = ()) -> tuple[Rule, ...]:
    """Mentions of the head of state by office.

    ``persons`` are stems of names: they match unless they only stand in hashtags, and
    with one of them, or the office of the own country, guarded mentions of the office
    count too.  ``full_names`` are pairs of stems.
    """
    guards = [
        Guard("office_of_president", (Near(prefixes=("офис",), before=1, after=-1),)),
        Guard("presidential_object", (Near(0, ("президентск",)), Near(prefixes=PRESIDENT_OBJECTS, before=-1, after=1))),
        Guard("president_of_org", (Near(words=PRESIDENT_ORGANISATIONS, before=-1, after=1),)),
        PlaceGuard("country", 2, names),
        Guard("foreign_adj", (Near(3, OFFICE_ADJECTIVES),)),
        *([Guard("foreign_leader", (Near(3, leaders),))] if leaders else []),
    ]
    own = Part(pairs=(("президент", "росси"), ("президент", "рф")))
    said = (Part(prefixes=persons),) if persons else ()
    rules = [
        Rule("prezident", "P", prefixes=("президент",), guards=tuple(guards), clean_if=(own, *said)),
        Rule("verkhovn", "P", prefixes=("верховн",), guards=(Guard("rada_lider_komissar_sud", (Near(1, SUPREME_OTHERS),)), Guard("nato", (Near(2, ("нато",)),)))),
        Rule("vvp", "P", words=("ввп",), guards=(Guard("econ_context", (Near(6, GDP_CONTEXT),)),)),
        Rule(
            "pervoe_litso", "P",
            parts=(Part(pairs=tuple((w, "лиц") for w in FIRST_PERSON), gap=1, otherwise="no_power_context", steps=(
                Guard("ot_pervogo_litsa", (Near(words=("от",), before=1, after=-1),)), Guard("fpv_context", (Near(5, FIRST_PERSON_OTHERS),)), Accept((Near(10, FIRST_PERSON_CONTEXT),)))),),
        ),
        Rule("natslider", "P", prefixes=("нацлидер",), pairs=(("национальн", "лидер"),), guards=(Guard("other_person", (Near(5, NATIONAL_LEADER_OTHERS),)),)),
        Rule("glavkoverh", "P", prefixes=("главковерх",)),
    ]
    rules += [Rule("name", "P", prefixes=(p,), hashtag=p) for p in persons]
    rules += [Rule("full_name", "P", pairs=full_names)] if full_names else []
    return tuple(rules)


def office_query(persons: tuple[str, ...] = (), full_names: tuple[tuple[str, str], ...] = ()) -> tuple[Rule, ...]:
    """The plain query for the office, without guards but one: whatever it matches is another corpus."""
    rules = [Rule("prezident", "P", prefixes=("президент", *persons)), Rule("verkhovn", "P", prefixes=("верховн",), guards=(Guard("court", (Near(1, ("суд",)),)),))]
    return tuple(rules + ([Rule("full_name", "P", pairs=full_names)] if full_names else []))


def triggers(leaders: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """What an audit of the office query looks for, each on its own."""
    foreign = (*AUDIT_ADJECTIVES, *leaders)
    return (
        Rule("prezident", "T", prefixes=("президент",)),
        Rule("prezident_foreign", "T", prefixes=("президент",), requires=Near(3, foreign)),
        Rule("verkhovn", "T", prefixes=("верховн",), guards=(Guard("court", (Near(1, ("суд",)),)),)),
        Rule("verkhovn_rada", "T", prefixes=("верховн",), requires=Near(1, ("рад",))),
    )


def person(
    name: str, group: str, stem: str | None = None, forms: tuple[str, ...] = (), ambiguous: tuple[str, ...] = (), context: tuple[str, ...] = (), relatives: tuple[str, ...] = (), others: dict[str, tuple[int, tuple[str, ...]]] | None = None,
    followed_by: tuple[str, ...] = (), given_names: tuple[str, ...] = (), not_words: tuple[int, tuple[str, ...]] | None = None, own_sources: tuple[str, ...] = (),
) -> Rule:
    """The rule for a person, from what the caller knows of the surname.

    The name is a ``stem``, or its ``forms`` where the stem is too common.  ``ambiguous``
    forms, which are words of their own, need ``context`` within ten tokens; with a stem
    or forms alone, ``context`` is needed if it is given, unless one of ``given_names`` is
    within three.  A mention is of somebody else with one of ``relatives`` within two
    tokens, with what ``others`` lists under a guard's name, with a next token that begins
    with one of ``followed_by``, or with whole ``not_words`` in their radius.  The term is
    not looked for in ``own_sources``.
    """
    steps: list = []
    if relatives:
        steps.append(Guard(f"{name}_other_person", (Near(2, relatives),)))
    if followed_by:
        steps.append(Guard(f"{name}_other_thing", (Near(prefixes=followed_by, before=-1, after=1),)))
    steps += [Guard(guard, (Near(radius, stems),)) for guard, (radius, stems) in (others or {}).items()]
    if not_words:
        steps.append(Guard(f"{name}_other_words", (Near(not_words[0], (), not_words[1]),)))
    if given_names:
        steps.append(Accept((Near(3, given_names),)))
    near = (Accept((Near(10, context),)),) if context else ()
    own = (*steps, *near) if context and not ambiguous else tuple(steps)
    parts = [Part((stem,) if stem else (), forms, steps=own, otherwise=f"{name}_no_context" if context and not ambiguous else None)] if stem or forms else []
    if ambiguous:
        parts.append(Part((), ambiguous, steps=(*steps, *near), otherwise=f"{name}_ambiguous"))
    return Rule(name, group, parts=tuple(parts), sources=own_sources)


# Cheap test and checks of other words for the office.
ALIAS_PRESCREEN = r"(?U)ввп|цар[ьяюее]|главковерх|нацлидер|национальн\w*\s+лидер|перво[ег]\w*\s+лиц|хозяин\w*\s+кремл"
TSAR = ("царь", "царя", "царю", "царем", "царе")


def aliases() -> tuple[Rule, ...]:
    return (
        Rule("vvp", "X", words=("ввп",)),
        Rule("tsar", "X", words=TSAR),
        Rule("glavkoverh", "X", prefixes=("главковерх",)),
        Rule("natslider", "X", prefixes=("нацлидер",), parts=(Part(prefixes=("национальн",), otherwise="no_leader", steps=(Accept((Near(prefixes=("лидер",), before=1, after=2),)),)),)),
        Rule("pervoe_litso", "X", pairs=tuple((w, "лиц") for w in FIRST_PERSON), gap=1),
        Rule("hozyain_kremlya", "X", pairs=(("хозяин", "кремл"),), gap=3),
    )


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    """Whether one of the parts is in it; plain searches, the first that hits ends them."""
    out = c.contains(parts[0])
    for p in parts[1:]:
        out = out | c.contains(p)
    return out


def prescreen(norm: Column) -> Column:
    """Whether a normalised text can hold a term at all.

    The text is normalised once for all tests, which stop at the first that holds.
    """
    return W.let(
        norm,
        lambda t: _any(t, PRESCREEN)
        | (_any(t, SHORT_WORDS) & t.rlike(PRESCREEN_WORD))
        | (t.contains("совет") & t.contains("безопасност"))
        | (t.contains("министерств") & t.contains("цифров"))
        | (t.contains("генеральн") & t.contains("прокуратур"))
        | (_any(t, RESTRICT) & _any(t, PLATFORM)),
    )


def rating_list(norm: Column) -> Column:
    """Whether the text is a list of channels: a top-N of channels, or eight handles under such a heading."""

    def test(t: Column) -> Column:
        handles = F.length(t) - F.length(F.replace(t, F.lit("@"), F.lit("")))
        return t.contains("канал") & (t.rlike(r"(?U)топ\s*[-–—]?\s*\d{2,3}") | ((handles >= 8) & t.rlike("подборк|топ|рейтинг")))

    return W.let(norm, test)


def _screen_for(screen, rules: Iterable[Rule], known: Iterable[str]):
    """``screen``, and beside it a search for the words of the rules that it doesn't know of."""
    known = set(known)
    parts = [p for r in rules if r.name not in known for p in r.all_parts()]
    words = tuple(sorted({w for p in parts for w in (*p.prefixes, *p.words, *(a.lstrip("=") for a, _ in p.pairs))}))
    return (lambda norm: W.let(norm, lambda t: screen(t) | _any(t, words))) if words else screen


def _screened(df: DataFrame, id_col: str, text_col: str, keep: list[str], screen) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep).filter(screen(X.norm_text(F.col("text"))))
    rows = rows.withColumn("lines", X.footer_lines(F.col("text"))).withColumn("clean", X.without_lines(F.col("text"), F.col("lines")))
    norm = X.norm_text(F.col("clean"))
    # Most texts have no footer, and what passed once needn't be tested again.
    dropped = F.when((F.size("lines") > 0) & ~screen(norm), "footer_only").when(rating_list(norm), "rating_list")
    rows = rows.withColumn("dropped", dropped)
    return rows.withColumn("tokens", F.when(F.col("dropped").isNull(), X.tokens(F.col("clean"))).otherwise(F.array().cast("array<string>")))


def carve(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] | None = None, left: Rule | None = None, other: tuple[Rule, ...] | None = None, source_col: str | None = None, views_col: str | None = None) -> DataFrame:
    """``id, dropped, footer_lines, clean, tokens, verdicts, terms, grps, residual, residual_guard`` of every post that passes the prescreen.

    ``dropped`` is ``footer_only`` where only footer lines pass it, ``rating_list``
    for lists of channels, else null; dropped posts have no terms.  Null texts pass
    nothing.  Guards are kept in ``verdicts`` also for posts that match other terms.
    Posts without a term that ``other`` (another corpus) doesn't match either are left
    for the rule ``left``.  With ``source_col`` rules are silent in their own sources.
    With ``views_col`` posts of less than one view, or of none that can be read, that
    would be in the corpus are dropped as ``views``, after all tests.
    """
    names = places.countries(df.sparkSession)
    rules = registry(names) if rules is None else rules
    left = residual(names) if left is None else left
    other = office_query() if other is None else other
    keep = [F.lower(F.ltrim(F.lit("@"), F.col(source_col))).alias("source")] if source_col else []
    keep += [X.to_count(F.col(views_col).cast("string")).alias("views")] if views_col else []
    rows = _screened(df, id_col, text_col, keep, _screen_for(prescreen, rules, (r.name for r in registry(names))))
    rows = apply_rules(rows, (*rules, left, *(o for o in other)), norm=X.norm_text(F.col("clean")) if any(r.hashtag for r in rules) else None, source=F.col("source") if source_col else None)
    own = F.filter("verdicts", lambda v: ~v["grp"].isin(left.group, *{o.group for o in other}))
    elsewhere = F.exists("verdicts", lambda v: v["grp"].isin(*{o.group for o in other}) & (v["status"] == "match")) if other else F.lit(False)
    rows = rows.withColumn("own", own).withColumn("rest", F.get(F.filter("verdicts", lambda v: v["grp"] == left.group), F.lit(0))).withColumn("elsewhere", elsewhere)
    rows = rows.withColumn("terms", terms(F.col("own"))).withColumn("grps", groups(F.col("own")))
    looked = (F.col("terms") == "") & F.col("dropped").isNull() & ~F.col("elsewhere")
    rows = rows.withColumn("residual", F.coalesce(looked & (F.col("rest.status") == "match"), F.lit(False))).withColumn("residual_guard", F.when(looked, F.col("rest.guard")))
    if views_col:
        unseen = ((F.col("terms") != "") | F.col("residual")) & ~F.coalesce(F.col("views") >= 1, F.lit(False))
        rows = rows.withColumn("dropped", F.coalesce("dropped", F.when(unseen, "views")))
    return rows.select("id", "dropped", F.size("lines").alias("footer_lines"), "clean", "tokens", F.col("own").alias("verdicts"), "terms", "grps", "residual", "residual_guard")


def carve_office(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] | None = None, markers: Iterable[str] = ()) -> DataFrame:
    """``id, dropped, tokens, verdicts, terms, mixed`` of every post that can mention the head of state.

    ``mixed`` marks posts that match and also have a guarded mention or a token that
    begins with one of ``markers`` (names of foreign leaders).
    """
    from tidemark.operators.rules import mixed

    names = places.countries(df.sparkSession)
    rules = office(names) if rules is None else rules
    rows = _screened(df, id_col, text_col, [], _screen_for(lambda norm: norm.rlike(OFFICE_PRESCREEN), rules, (r.name for r in office(names))))
    rows = apply_rules(rows, rules, norm=X.norm_text(F.col("clean")) if any(r.hashtag for r in rules) else None)
    return rows.select("id", "dropped", "tokens", "verdicts", terms(F.col("verdicts")).alias("terms"), mixed(F.col("verdicts"), F.col("tokens"), markers).alias("mixed"))


def countries_near(tokens: Column, names: dict[str, str], stem: str = "президент", radius: int = 1) -> Column:
    """Sorted distinct countries within ``radius`` tokens of any token that begins with ``stem``; such tokens themselves stand for none."""

    @F.arrow_udf("array<string>")
    def near(batch: pa.Array) -> pa.Array:
        out = []
        for words in batch.to_pylist():
            at = [i for i, w in enumerate(words or ()) if w.startswith(stem)]
            found = {names[w] for i in at for w in words[max(0, i - radius) : i + radius + 1] if w in names and not w.startswith(stem)}
            out.append(sorted(found))
        return pa.array(out, pa.list_(pa.string()))

    return near.asNondeterministic()(tokens)
