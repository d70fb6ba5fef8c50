"""Schemas of the tables that jobs exchange."""

CREATOR = "profile_url STRING, platform STRING, creator_name STRING, safety_score DOUBLE, last_scanned TIMESTAMP"

RAW_COMMENT = "profile_url STRING, comment_id BIGINT, pos BIGINT, author STRING, text STRING, timestamp STRING"

MODERATED_COMMENT = (
    RAW_COMMENT + ", classification STRING, severity_score DOUBLE, triggers ARRAY<STRING>, flagged_words STRING"
)

EXTERNAL_LABEL = (
    "profile_url STRING, batch_id BIGINT, id BIGINT, item BIGINT,"
    " classification STRING, severity_score DOUBLE, flagged_words STRING"
)

LANDED_PAYLOAD = "profile_url STRING, payload STRING"

LANDED_PAGE = "profile_url STRING, landed_at TIMESTAMP, page BIGINT, payload STRING"

EXPORT = (
    "author STRING, text STRING, timestamp STRING, classification STRING,"
    " severity_score DOUBLE, flagged_words STRING"
)
EXPORT_COLUMNS = ["author", "text", "timestamp", "classification", "severity_score", "flagged_words"]

VIDEO_PAGE = (
    "STRUCT<items: ARRAY<STRUCT<snippet: STRUCT<topLevelComment: STRUCT<snippet: STRUCT<"
    "authorDisplayName: STRING, textDisplay: STRING, publishedAt: STRING>>>>>>"
)

VIDEO_INFO = "STRUCT<items: ARRAY<STRUCT<snippet: STRUCT<title: STRING>>>>"
