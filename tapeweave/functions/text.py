"""News text and JSON field helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeweave.schemas import utc_ntz


def tagging_text() -> Column:
    """Lower-cased headline and body for keyword search."""
    return F.lower(F.concat_ws(" ", "headline", "body"))


def model_text() -> Column:
    """``headline. body`` for a text model, or the headline alone if the body is blank."""
    body = F.trim(F.coalesce("body", F.lit("")))
    return F.when(body != "", F.concat(F.col("headline"), F.lit(". "), body)).otherwise(F.col("headline"))


def json_text(payload: Column, *paths: str) -> Column:
    """First non-empty text among the JSON paths."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths])


def json_time(epoch: Column, iso: Column) -> Column:
    """Epoch seconds if there are any, else ISO text; unreadable text is NULL."""
    # Digits are read before the cast: ANSI casts raise on other text.
    seconds = F.regexp_extract(epoch, r"^(-?\d+)", 1)
    at = F.timestamp_seconds(F.nullif(seconds, F.lit("")).cast("long"))
    from_epoch = F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")
    return F.when(epoch.isNotNull(), from_epoch).otherwise(utc_ntz(iso))
