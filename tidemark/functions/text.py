"""Text preparation as Column functions: everything stays in the JVM.

All regular expressions are written for Java with ``(?U)`` where ``\\w``, ``\\s`` or
``\\b`` occur, so they see Cyrillic letters and Unicode spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.windows import let

WORDS = r"[\p{L}\p{N}]+"
#: Hyphenated words, decimals and times as one token.
COMPOUNDS = r"[\p{L}\p{N}]+(?:[-.:][\p{L}\p{N}]+)*"

# Fixed value: what marks a line as an invitation to subscribe or to other channels.
FOOTER = (
    r"(?U)подпис(?:аться|ывайся|ывайтесь|ка|чик)|t\.me/|max\.ru|кана[лм]\w*\s+в\s+max|мы\s+в\s+max"
    r"|\bбуст\w*|\bboost|вступай\w*|наш\s+канал|прислать\s+новост|обратная\s+связь"
    r"|поддержать\s+(?:нас|канал)|резервн\w+\s+канал"
)
FOOTER_LINE_CHARS, TITLE_CHARS, TITLE_WORDS = 200, 60, 2


def norm_text(c: Column) -> Column:
    """Lower case with ``ё`` as ``е``."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def tokens(c: Column, compounds: bool = False) -> Column:
    """The normalised text's runs of letters and digits; null for null, an empty array for none."""
    return F.regexp_extract_all(norm_text(c), F.lit(COMPOUNDS if compounds else WORDS), F.lit(0))


def ngrams(words: Column, n: int = 2) -> Column:
    """The words, and after them every ``n`` successive ones joined by a space."""
    def pairs(w: Column) -> Column:
        last = F.size(w) - n
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.concat(w, F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n)))))

    return let(words, pairs)


def hashtag_only(norm: Column, stem: str) -> Column:
    """Whether the stem occurs, and every time as a hashtag."""
    count = F.length(norm) - F.length(F.replace(norm, F.lit(stem), F.lit("")))
    tagged = F.length(norm) - F.length(F.replace(norm, F.lit("#" + stem), F.lit("")))
    return (count > 0) & (count * (len(stem) + 1) == tagged * len(stem))


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def snippet(c: Column, limit: int = 180) -> Column:
    """The collapsed text, cut to ``limit`` characters with dots at the end."""
    flat = collapse(c)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def footer_lines(c: Column) -> Column:
    """Indexes (from 0) of the footer lines of a text.

    A line of up to 200 characters that matches the footer pattern is one; so is a
    line of one or two words (up to 60 characters) if the next line that isn't
    blank matches: it is the title of what is being advertised.
    """
    raw = F.transform(
        F.split(c, "\n"),
        lambda line, i: F.struct(
            i.alias("i"),
            F.length(line).alias("n"),
            F.size(F.regexp_extract_all(line, F.lit(r"(?U)\S+"), F.lit(0))).alias("words"),
            ((F.length(line) <= FOOTER_LINE_CHARS) & norm_text(line).rlike(FOOTER)).alias("footer"),
        ),
    )

    def titled(full: Column) -> Column:
        return F.transform(
            full,
            lambda x, k: F.struct(
                x["i"].alias("i"),
                (x["footer"] | ((x["n"] <= TITLE_CHARS) & (x["words"] <= TITLE_WORDS) & F.coalesce(F.get(full, k + 1)["footer"], F.lit(False)))).alias("footer"),
            ),
        )

    found = let(F.filter(raw, lambda x: x["words"] > 0), titled)
    return F.transform(F.filter(found, lambda x: x["footer"]), lambda x: x["i"])


def without_lines(c: Column, indexes: Column) -> Column:
    """The text without the lines of the given indexes."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda _, i: ~F.array_contains(indexes, i)), "\n")


def to_count(c: Column) -> Column:
    """A number given as text, spaces in it ignored, cut to a whole number; null for what is none."""
    number = F.regexp_replace(c, r"(?U)\s+", "").try_cast("double")
    return F.when(F.abs(number) < 9.2e18, number.try_cast("bigint"))


def topic_label(c: Column) -> Column:
    """A topic's name without its leading number."""
    return F.regexp_replace(c, r"^-*\d+_", "")


def author_name(username: Column, title: Column, channel_id: Column) -> Column:
    """``@username``, else the title, else ``id_`` and the channel's number."""
    user, name = F.trim(F.coalesce(username, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    handle = F.when(user.startswith("@"), user).otherwise(F.concat(F.lit("@"), user))
    return F.when(user != "", handle).when(name != "", name).otherwise(F.concat(F.lit("id_"), F.coalesce(channel_id.cast("string"), F.lit(""))))


def sentiment_label(c: Column) -> Column:
    """``positive``, ``negative`` or ``neutral`` by what the label contains, in that order; others as they are."""
    low = F.lower(F.trim(c))
    return (
        F.when(low.contains("pos") | low.contains("позит"), "positive")
        .when(low.contains("neg") | low.contains("негат"), "negative")
        .when(low.contains("neu") | low.contains("нейтр"), "neutral")
        .otherwise(low)
    )


def month(c: Column) -> Column:
    return F.substring(c, 1, 7)


def local_day(c: Column) -> Column:
    """The date a time stamp names in its own offset; null if unreadable."""
    return F.substring(c, 1, 10).try_cast("date")


def utc_day(c: Column) -> Column:
    """The UTC date of a time stamp with or without an offset; null if unreadable.  Needs the session time zone UTC."""
    return F.to_date(F.try_to_timestamp(c))


def joined(c: Column) -> Column:
    """Sorted distinct terms, separated by commas."""
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def separated(c: Column) -> Column:
    """The terms of a comma-separated list; an empty array for null or empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))
