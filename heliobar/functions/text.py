"""Text and classification expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rolling import div

# fixed values
BULLISH = ["growth", "profit", "surge", "record", "expansion", "beat", "positive", "dividend"]
BEARISH = ["loss", "decline", "investigation", "subpoena", "default", "lawsuit", "cut", "risk"]
STRIPPED = ".,!?\"'()"


def _hits(low: Column, words: list[str]) -> Column:
    """How many blank-separated words of a lower-case text are one of ``words`` once marks around them are stripped."""
    some = [w for w in words if w and w == w.lower().strip(STRIPPED) and not re.search(r"\s", w)]  # no other can match
    if not some:
        return F.lit(0)
    marks = "[" + re.escape(STRIPPED) + "]*"
    return F.regexp_count(low, F.lit(rf"(?<!\S){marks}(?:{'|'.join(map(re.escape, some))}){marks}(?!\S)"))


def polarity(text: Column, positive: list[str] = BULLISH, negative: list[str] = BEARISH) -> Column:
    """(positive - negative) / (positive + negative) over stripped lower-case words; 0 with none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    both = F.struct(_hits(low, positive).cast("double").alias("up"), _hits(low, negative).cast("double").alias("down"))
    # a list of one value: the counts are taken once, however often they are read
    value = F.transform(F.array(both), lambda c: F.coalesce(div(c["up"] - c["down"], F.nullif(c["up"] + c["down"], F.lit(0.0))), F.lit(0.0)))
    return F.get(value, F.lit(0))


def volatility_flag(vix: Column) -> Column:
    return F.when(vix > 30, "HIGH_VOL_SPIKE").when(vix > 22, "ELEVATED_RISK").otherwise("LOW_VOL")


def news_surge(count: Column, average: Column) -> Column:
    return count / F.greatest(F.lit(1.0), average)


def feed_verdict(articles: Column, newest: Column) -> Column:
    """By the age of the newest article in seconds, an upper bound of the feed's delay."""
    return F.when(articles == 0, "none").when(articles < 20, "inconclusive").when(newest <= 120, "real-time").when(newest <= 1200, "upper bound").otherwise("delayed")


def error_status(code: Column, exception: Column) -> Column:
    """The kind of a provider's error: by its HTTP status, or, without one, by the class of the exception."""
    name = F.lower(F.coalesce(exception, F.lit("")))
    by_code = F.when(code.between(200, 299), "ok").when(code.isin(401, 403), "auth_failed").when(code == 429, "rate_limited")
    by_code = by_code.when(code.isin(408, 502, 503, 504), "unreachable").otherwise("error")
    by_class = F.when(name == "", "ok").when(name.rlike("(timeout|connect|socket|gaierror|ssl)[a-z]*$"), "unreachable").when(name.rlike("(auth|permission|credential)[a-z]*$"), "auth_failed").otherwise("error")
    return F.when(code.isNotNull(), by_code).otherwise(by_class)


def redacted(message: Column, secrets: list[str]) -> Column:
    """The message with each known credential, and the value of any query parameter, blotted out."""
    out = F.regexp_replace(message, r"([?&][^=&\s]+=)[^&\s]+", "$1***")
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("***"))
    return out


def fear_greed(value: Column) -> Column:
    return F.when(value <= 25, "extreme fear").when(value >= 75, "extreme greed").otherwise("neutral")
