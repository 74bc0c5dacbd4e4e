"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no topic words, of speech and of visible text.
SPEECH_STOPWORDS = (
    "a about after again all also am an and any are as at be because been before being but by can could did do does "
    "doing for from get go going got had has have he here how i if in into is it its just let like may me more most "
    "my no not now of on one or our out over right say see so some such than that the their them then there these they "
    "this those to too up us use very was we well were what when where which while who why will with would you your okay "
    "basically actually simply thing things example suppose"
).split()
VISIBLE_STOPWORDS = "a an and are as at be by for from has have in is it of on or that the this to was we will with you your can now let use using then than if else when where which".split()
# Token and cue patterns.
SPEECH_TOKEN = "[a-zA-Z][a-zA-Z0-9+#.-]{2,}"
VISIBLE_TOKEN = "[a-zA-Z][a-zA-Z0-9_+#.-]{2,}"
CUE = (
    r"(?i)^(?:okay[, ]+)?(?:now|next|finally|first|second|third|then|moving on|let(?:'s| us)|we will now|"
    r"coming to|the next|another important|now we|now let|so now|after this)\b"
)


def tokens(text: Column, pattern: str, stopwords: list[str]) -> Column:
    """Lower-case tokens in order, duplicates kept, stop words dropped."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(stopwords))


def speech_tokens(text: Column) -> Column:
    return tokens(text, SPEECH_TOKEN, SPEECH_STOPWORDS)


def visible_tokens(text: Column) -> Column:
    return tokens(text, VISIBLE_TOKEN, VISIBLE_STOPWORDS)


def is_cue(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(CUE)


def strip_cue(text: Column) -> Column:
    """Without one leading cue, edges trimmed, white space collapsed."""
    return F.regexp_replace(F.btrim(F.regexp_replace(text, CUE, ""), F.lit(" ,.-:")), r"\s+", " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def duration_text(seconds: Column) -> Column:
    """H:MM:SS or M:SS, half-even; nothing and negatives are 0:00."""
    s = F.greatest(F.lit(0).cast("long"), F.coalesce(F.bround(seconds).cast("long"), F.lit(0).cast("long")))
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def title_words(token: Column) -> Column:
    """Every run of letters capitalised: tokens are lower case already."""
    marked = F.regexp_replace(token, "([A-Za-z]+)", "\u0001$1\u0001")
    return F.array_join(F.transform(F.split(marked, "\u0001"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, ",")
