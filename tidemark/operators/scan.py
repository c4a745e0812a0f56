"""Pattern flags over every text, and their totals and months."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import month, norm_text
from tidemark.functions.windows import let

# Patterns over the normalised text, by flag.
ACTORS = {
    "roskomnadzor": r"роскомнадзор",
    "rkn_abbr": r"\bркн\b",
    "grchc": r"\bгрчц\b",
    "radiochastotny_centr": r"радиочастотн\w*\s+центр",
    "cmu_ssop": r"\bссоп\b",
    "tspu": r"\bтспу\b",
    "mincifry": r"минцифр",
    "minsvyaz": r"\bминсвяз",
    "ministerstvo_cifrovogo": r"министерств\w*\s+цифров",
    "kabmin": r"\bкабмин",
    "fas_svyaz": r"\bфас\b",
    "prokuratura_gen": r"генпрокуратур",
}
LEADERS = {
    "kreml": r"кремл",
    "adm_prezidenta": r"администраци\w*\s+президента",
    "ap_abbr": r"\bап\b",
    "sovbez": r"совбез",
    "sovet_bezopasnosti": r"совет\w*\s+безопасности",
    "garant": r"\bгарант(?:а|у|ом|е)?\b",
}
CONTEXT = {
    "telegram_lat": r"telegram",
    "telegram_cyr": r"телеграм",
    "messenger": r"мессенджер",
    "whatsapp": r"whatsapp|вотсап|ватсап",
    "youtube": r"youtube|ютуб|ютьюб",
    "max_messenger": r"мессенджер\w*\s+max|\bmax\b",
    "block": r"блокир|заблокир",
    "slowdown": r"замедл",
    "restrict": r"ограничен",
    "vpn": r"\bvpn\b|\bвпн\b",
    "runet": r"рунет",
    "white_list": r"бел\w+\s+спис",
    "shutdown": r"шатдаун|отключени\w*\s+(?:мобильного\s+)?интернет",
    "cenzura": r"цензур",
}
PLATFORMS = ["telegram_lat", "telegram_cyr", "messenger", "whatsapp", "youtube", "vpn", "runet"]
RESTRICTIONS = ["block", "slowdown", "restrict", "shutdown", "cenzura", "white_list"]
CROSS = "ctx_platform_x_restrict"
FLAGS = [*ACTORS, *LEADERS, *CONTEXT, CROSS]


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the ``|`` that stand in no group."""
    out, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _needed(part: str) -> str:
    """The longest run of plain letters that every match of ``part`` holds."""
    plain = re.sub(r"\\.", " ", part)
    while (bare := re.sub(r"\([^()]*\)\??", " ", plain)) != plain:
        plain = bare
    return max(re.findall(r"[^\W\d_]+(?![?*])", plain), key=len, default="")


def has_pattern(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` matches somewhere.

    Every alternative is tested for a piece of plain text it can't do without
    before any regular expression runs; most texts have none.
    """
    out = None
    for part in _alternatives(pattern):
        need = _needed(part)
        test = text.contains(need) if need else F.lit(True)
        if part != need:
            test = test & text.rlike("(?U)" + part)
        out = test if out is None else out | test
    return out


def _either(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.col(n) == 1)
    return out.cast("int")


def _names(names: dict[str, str]) -> Column:
    return F.concat_ws(",", *(F.when(F.col(n) == 1, n) for n in names))


def flag_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the 0/1 flags, ``matched_actors`` and ``matched_leaders``.

    A null text has all flags 0.  Columns of these names in ``df`` are replaced.
    """
    drop = [c for c in df.columns if c in {*FLAGS, "matched_actors", "matched_leaders", "_norm"}]
    rows = df.drop(*drop).withColumn("_norm", F.coalesce(norm_text(F.col(text_col)), F.lit("")))
    flags = {n: has_pattern(F.col("_norm"), p).cast("int") for n, p in {**ACTORS, **LEADERS, **CONTEXT}.items()}
    rows = rows.withColumns(flags).drop("_norm")
    rows = rows.withColumn(CROSS, _either(PLATFORMS) * _either(RESTRICTIONS))
    return rows.withColumns({"matched_actors": _names(ACTORS), "matched_leaders": _names(LEADERS)})


def relevant_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with an actor, a leader, or a platform together with a restriction.

    Tested on the text before any flag is made: it is normalised once, and the
    tests stop at the first that holds.
    """

    def some(t: Column, names) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | has_pattern(t, {**ACTORS, **LEADERS, **CONTEXT}[n])
        return out

    return df.filter(let(norm_text(F.col(text_col)), lambda t: some(t, ACTORS) | some(t, LEADERS) | (some(t, PLATFORMS) & some(t, RESTRICTIONS))))


def term_months(flagged: DataFrame, date_col: str = "post_date") -> DataFrame:
    """``term, month, posts_n`` of every flag; rows without a date are in the null month."""
    pairs = F.explode(F.array_compact(F.array(*(F.when(F.col(n) == 1, n) for n in FLAGS))))
    return flagged.select(month(F.col(date_col)).alias("month"), pairs.alias("term")).groupBy("term", "month").agg(F.count("*").alias("posts_n"))


def term_totals(flagged: DataFrame) -> DataFrame:
    """``term, posts_n`` of every flag that occurs."""
    return term_months(flagged.withColumn("_none", F.lit(None).cast("string")), "_none").groupBy("term").agg(F.sum("posts_n").alias("posts_n"))
