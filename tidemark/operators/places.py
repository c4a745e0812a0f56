"""Countries in Russian text: a gazetteer by rule, with the case forms of the names and none that are ambiguous.

The names are the public CLDR ones, asked of the ICU library that comes with Spark.
Of a name the last word of at least four letters counts, its case forms by the
paradigm of its ending.  A form of several countries stands for none.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of country names that name no country, tokens that are another word, forms of the own country.
GENERIC = ("и", "республика", "федерация", "королевство", "штаты", "острова", "остров", "демократическая", "народная", "соединенные", "центральноафриканская")
OTHER_WORDS = ("того",)
OWN = ("россия", "российская", "российской", "рф", "русский", "русская")
# Further names.
ALIASES = {"сша": "США", "америка": "США", "британия": "Великобритания", "фрг": "Германия", "оон": "ООН", "снбо": "Украина", "ес": "Евросоюз", "евросоюз": "Евросоюз"}
# Stems of adjectives of countries.
ADJECTIVES = (
    "украинск", "киевск", "американск", "французск", "немецк", "британск", "польск", "болгарск", "израильск", "иранск", "турецк", "казахстанск",
    "белорусск", "армянск", "азербайджанск", "молдавск", "грузинск", "эстонск", "латвийск", "литовск", "сирийск", "венесуэльск", "тайваньск",
)
# Case endings by the ending of the nominative, longest first; the last row is for consonants.
PARADIGMS = {"ия": "ия ии ию ией", "ья": "ья ьи ье ью ьей", "ша": "ша ши ше шу шей", "ка": "ка ки ке ку кой", "га": "га ги ге гу гой", "а": "а ы е у ой", "я": "я и е ю ей", "ай": "ай ая аю аем ае", "ь": "ь и ю ью", "": " а у ом е"}


def case_forms(word: str) -> list[str]:
    """The word and its singular cases, by the paradigm of its ending; words in other vowels have one form."""
    if len(word) < 4 or word[-1] in "оеиуыэю":
        return [word]
    for ending, forms in PARADIGMS.items():
        if ending and word.endswith(ending):
            return [word[: -len(ending)] + f for f in forms.split()]
    return [word + f for f in PARADIGMS[""].split(" ")] if word[-1].isalpha() and word[-1] not in "йъ" else [word]


@lru_cache(maxsize=1)
def _cldr(spark: SparkSession) -> tuple[str, ...]:
    icu = spark._jvm.com.ibm.icu
    names = icu.text.LocaleDisplayNames.getInstance(icu.util.ULocale("ru"))
    return tuple(names.regionDisplayName(code) for code in icu.util.ULocale.getISOCountries() if code != "RU")


def gazetteer(names: Iterable[str], aliases: Mapping[str, str] = ALIASES, lemmas: Mapping[str, str] | None = None) -> dict[str, str]:
    """Token -> country, for the tokens that stand for exactly one.

    ``lemmas`` maps tokens to their lemma, where there is a dictionary of them: tokens
    whose lemma is a name stand for it too.
    """
    found: dict[str, set[str]] = {}
    for name in names:
        words = [w for w in name.lower().replace("ё", "е").replace("-", " ").replace("(", " ").replace(")", " ").replace(",", " ").split() if len(w) >= 4 and w not in GENERIC]
        if words and words[-1] not in OTHER_WORDS and "неизвестн" not in name.lower():
            for form in case_forms(words[-1]):
                found.setdefault(form, set()).add(name)
    for word in OWN:
        for form in case_forms(word):
            found.pop(form, None)
    for alias, name in aliases.items():
        for form in case_forms(alias) if alias in ("америка", "британия", "евросоюз") else [alias]:
            found.setdefault(form, set()).add(name)
    for token, lemma in (lemmas or {}).items():
        if token not in found and lemma in found:
            found[token] = found[lemma]
    return {token: next(iter(names)) for token, names in found.items() if len(names) == 1 and token not in OTHER_WORDS}


@lru_cache(maxsize=1)
def countries(spark: SparkSession) -> dict[str, str]:
    """The gazetteer of all countries but the own one."""
    return gazetteer(_cldr(spark))


def lemmatized(df: DataFrame, tokens_col: str, lemmas: DataFrame, token: str = "token", lemma: str = "lemma") -> DataFrame:
    """``df`` with its token arrays replaced by lemmas from a table; a token that isn't in it stays.

    Tokens are met with the table by a join, and each array is put together again by
    position.  Null and empty arrays stay as they are; of several lemmas of a token the
    first in order counts.
    """
    table = lemmas.groupBy(F.col(token).alias("_token")).agg(F.min(lemma).alias("_lemma"))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    held = F.struct(*(F.col(c) for c in df.columns))
    words = rows.select("_row", held.alias("_held"), F.posexplode_outer(tokens_col).alias("_at", "_token")).join(table, "_token", "left")
    word: Column = F.coalesce("_lemma", "_token")
    whole = words.groupBy("_row").agg(F.first("_held").alias("_held"), F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", word.alias("_word"))))).alias("_words"))
    lemmas_of = F.when(F.size(F.col("_held").getField(tokens_col)) > 0, F.col("_words._word")).otherwise(F.col("_held").getField(tokens_col))
    return whole.select(*(lemmas_of.alias(c) if c == tokens_col else F.col("_held").getField(c).alias(c) for c in df.columns))
