"""Platform, handle and display name from a creator link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from modlytics.functions import dictionary as fixed

# The parts of a link that name its owner, per platform.
POST_ID = r"/comments/([^/]+)"
USER_NAME = r"/user/([^/]+)"
BOARD_NAME = r"/r/([^/]+)"
VIDEO_QUERY = r"/watch/?\?(?:[^#]*&)?v=([^#&?]*)"
VIDEO_ID = r"(?:v=|/shorts/|/embed/|/v/|youtu\.be/)([^#&?]*)"
INSTAGRAM_NAME = r"instagram\.com/([^/]+)"
TWITTER_NAME = r"(?:twitter|x)\.com/([^/]+)"
TIKTOK_NAME = r"tiktok\.com/(@[^/]+)"
# What does not belong to the path: fragment, scheme with host, parameters of the last segment.
FRAGMENT = r"#.*$"
SCHEME_AND_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*"
LAST_PARAMETERS = r";[^/]*$"
NO_NAME = "creator"


def platform_of(url: Column) -> Column:
    """First platform with a substring in the lower-cased link, hosts or not."""
    lowered = F.lower(url)
    tests = [
        (reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(part)) for part in parts]), name)
        for name, parts in fixed.PLATFORMS
    ]
    first, *rest = tests
    chain = F.when(first[0], first[1])
    for test, name in rest:
        chain = chain.when(test, name)
    return chain.otherwise(fixed.OTHER_PLATFORM)


def without_query(url: Column) -> Column:
    return F.btrim(F.substring_index(url, "?", 1), F.lit(fixed.BLANKS))


def _found(url: Column, pattern: str, prefix: str = "") -> Column:
    part = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.concat(F.lit(prefix), part) if prefix else part


def last_path_part(url: Column) -> Column:
    """Last segment of the path; a link without a scheme is all path."""
    path = F.regexp_replace(url, FRAGMENT, "")
    path = F.regexp_replace(path, SCHEME_AND_HOST, "")
    path = F.regexp_replace(path, LAST_PARAMETERS, "")
    last = F.substring_index(F.btrim(path, F.lit("/")), "/", -1)
    return F.when(last == "", NO_NAME).otherwise(last)


def handle_of(url: Column, platform: Column) -> Column:
    """User, board, post or video that a link points to, else the last part of its path."""
    clean = without_query(url)
    fallback = last_path_part(clean)
    # An empty video id is an answer of its own, as in a bare short link.
    video = F.coalesce(
        _found(url, VIDEO_QUERY),
        F.when(F.regexp_like(clean, F.lit(VIDEO_ID)), F.regexp_extract(clean, VIDEO_ID, 1)),
    )
    named = (
        F.when(
            platform == "Reddit",
            F.coalesce(
                _found(clean, POST_ID, "Reddit Post: "), _found(clean, USER_NAME, "u/"), _found(clean, BOARD_NAME, "r/")
            ),
        )
        .when(platform == "YouTube", video)
        .when(platform == "Instagram", _found(clean, INSTAGRAM_NAME, "@"))
        .when(platform == "Twitter/X", _found(clean, TWITTER_NAME, "@"))
        .when(platform == "TikTok", _found(clean, TIKTOK_NAME))
    )
    return F.coalesce(named, fallback)


def display_name(platform: Column, handle: Column, title: Column) -> Column:
    """Title of the thread or video if one was landed, else the handle; videos say so."""
    video = F.concat(F.lit("YouTube Video: "), F.coalesce(F.nullif(handle, F.lit("")), F.lit("Demo")))
    return F.coalesce(title, F.when(platform == "YouTube", video).otherwise(handle))


def creator_label(name: Column, platform: Column, score: Column | None = None) -> Column:
    """Name and platform for a list of creators, with the score where one is given."""
    if score is None:
        return F.concat(name, F.lit(" ("), platform, F.lit(")"))
    return F.concat(name, F.lit(" ("), platform, F.lit(" - Safety: "), score.cast("string"), F.lit("%)"))
