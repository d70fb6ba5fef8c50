"""The same queries in SQL for another engine, written flat: all hits of all tiers first, then one CASE."""

from __future__ import annotations

from modlytics.functions import automaton
from modlytics.functions import dictionary as fixed
from modlytics.functions import links
from modlytics.plans import catalog, fixtures


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _hits(terms: list[str], lowered: str = "low") -> str:
    return f"list_filter({_list(terms)}, lambda term: contains({lowered}, term))"


def _matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_text(pattern)})"


def _severity(hits: str, base: int, step: int, cap: int, yelling_cap: int | None = None) -> str:
    quiet = f"least({base} + {step} * len({hits}), {cap})"
    if yelling_cap is None:
        return quiet
    return f"CASE WHEN loud THEN least({quiet} + {fixed.YELLING_STEP}, {yelling_cap}) ELSE {quiet} END"


def moderated(source: str, name: str = "moderated") -> str:
    """CTEs that add class, severity and trigger string to ``source``, which has a text column."""
    shouted = f"CASE WHEN loud THEN [{_text(fixed.YELLING_TAG)}] ELSE [] END"
    emoji = f"[{_text(fixed.EMOJI_TAG)}]"
    return f"""
    {name}_hits AS (
        SELECT *, {_hits(fixed.HARMFUL_TERMS)} AS harmful, {_hits(fixed.ABUSIVE_TERMS)} AS abusive,
            {_hits(fixed.TOXIC_TERMS)} AS toxic,
            list_concat({_hits(fixed.SPAM_TERMS)},
                CASE WHEN {_matches("low", fixed.LINK_PATTERN)} THEN [{_text(fixed.URL_TAG)}] ELSE [] END) AS spam,
            {_matches("text", fixed.YELLING_PATTERN)} AS loud,
            len(regexp_extract_all(text, {_text(fixed.EMOJI_PATTERN)})) > {fixed.EMOJI_LIMIT} AS flood
        FROM (SELECT *, lower(text) AS low FROM {source})
    ),
    {name} AS (
        SELECT * EXCLUDE (low, harmful, abusive, toxic, spam, loud, flood),
            CASE WHEN len(harmful) > 0 THEN 'Harmful' WHEN len(abusive) > 0 THEN 'Abusive' WHEN len(toxic) > 0 THEN 'Toxic'
                WHEN len(spam) > 0 OR flood THEN 'Spam' ELSE 'Proper' END AS classification,
            CASE WHEN len(harmful) > 0 THEN {_severity("harmful", **fixed.HARMFUL_SEVERITY)}
                WHEN len(abusive) > 0 THEN {_severity("abusive", **fixed.ABUSIVE_SEVERITY)}
                WHEN len(toxic) > 0 THEN {_severity("toxic", **fixed.TOXIC_SEVERITY)}
                WHEN len(spam) > 0 THEN {_severity("spam", **fixed.SPAM_SEVERITY)}
                WHEN flood THEN {fixed.EMOJI_SEVERITY} ELSE 0 END / 100::DOUBLE AS severity_score,
            array_to_string(CASE WHEN len(harmful) > 0 THEN harmful
                WHEN len(abusive) > 0 THEN list_concat(abusive, {shouted})
                WHEN len(toxic) > 0 THEN list_concat(toxic, {shouted})
                WHEN len(spam) > 0 THEN spam WHEN flood THEN {emoji} ELSE [] END, ', ') AS flagged_words
        FROM {name}_hits
    )"""


def scored(source: str, name: str = "scored") -> str:
    """CTEs with one row per creator of ``source``: proper and total comments and the score."""
    return f"""
    {name}_parts AS (
        SELECT *, x16 + x4 AS x20, x4 - ((x16 + x4) - x16) AS rest FROM (
            SELECT profile_url, proper_comments, total_comments,
                proper_comments::DOUBLE / total_comments * 100::DOUBLE * 16 AS x16,
                proper_comments::DOUBLE / total_comments * 100::DOUBLE * 4 AS x4
            FROM (SELECT profile_url, count(*) FILTER (classification = 'Proper') AS proper_comments,
                count(*) AS total_comments FROM {source} GROUP BY profile_url))
    ),
    {name} AS (
        SELECT profile_url, proper_comments, total_comments, (half + CASE
            WHEN x20 - 2 * half > 1 OR (x20 - 2 * half = 1 AND (rest > 0 OR (rest = 0 AND half % 2 = 1))) THEN 1 ELSE 0
            END) / 10::DOUBLE AS safety_score
        FROM (SELECT *, floor(x20 / 2) AS half FROM {name}_parts)
    )"""


def platform_case(url: str) -> str:
    tests = [
        f"WHEN {' OR '.join(f'contains(lower({url}), {_text(p)})' for p in parts)} THEN {_text(name)}"
        for name, parts in fixed.PLATFORMS
    ]
    return f"CASE {' '.join(tests)} ELSE {_text(fixed.OTHER_PLATFORM)} END"


def named(source: str, name: str = "named") -> str:
    """CTEs that add platform and handle to ``source``, which has a profile_url."""

    def part(column: str, pattern: str) -> str:
        return f"nullif(regexp_extract({column}, {_text(pattern)}, 1), '')"

    def drop(column: str, pattern: str) -> str:
        return f"regexp_replace({column}, {_text(pattern)}, '')"

    path = drop(drop(drop("clean", links.FRAGMENT), links.SCHEME_AND_HOST), links.LAST_PARAMETERS)
    return f"""
    {name}_clean AS (
        SELECT *, {platform_case("profile_url")} AS platform, trim(split_part(profile_url, '?', 1)) AS clean FROM {source}
    ),
    {name} AS (
        SELECT * EXCLUDE (clean), coalesce(
            CASE platform
                WHEN 'Reddit' THEN coalesce('Reddit Post: ' || {part("clean", links.POST_ID)},
                    'u/' || {part("clean", links.USER_NAME)}, 'r/' || {part("clean", links.BOARD_NAME)})
                WHEN 'YouTube' THEN coalesce({part("profile_url", links.VIDEO_QUERY)},
                    CASE WHEN {_matches("clean", links.VIDEO_ID)} THEN regexp_extract(clean, {_text(links.VIDEO_ID)}, 1) END)
                WHEN 'Instagram' THEN '@' || {part("clean", links.INSTAGRAM_NAME)}
                WHEN 'Twitter/X' THEN '@' || {part("clean", links.TWITTER_NAME)}
                WHEN 'TikTok' THEN {part("clean", links.TIKTOK_NAME)}
            END,
            nullif(list_extract(string_split(trim({path}, '/'), '/'), -1), ''), {_text(links.NO_NAME)}) AS handle
        FROM {name}_clean
    )"""


def display_name(title: str) -> str:
    return (
        f"coalesce({title}, CASE WHEN platform = 'YouTube' THEN 'YouTube Video: ' || coalesce(nullif(handle, ''), 'Demo')"
        " ELSE handle END)"
    )


def bands(score: str) -> str:
    def chain(rows: list[tuple]) -> str:
        *bounded, last = rows
        return f"CASE {' '.join(f'WHEN {score} >= {low} THEN {_text(v)}' for low, v in bounded)} ELSE {_text(last[1])} END"

    return (
        f"{chain(fixed.SCAN_BANDS)} AS scan_band, {chain([(a, b) for a, b, _ in fixed.SAFETY_BANDS])} AS safety_band,"
        f" {chain([(a, c) for a, _, c in fixed.SAFETY_BANDS])} AS safety_text"
    )


LABELS = "classification, severity_score, flagged_words"
VIEW = f'profile_url, comment_id, author, text, "timestamp", {LABELS}'
WHEN_SCANNED = "strftime(last_scanned, '%Y-%m-%d %H:%M:%S') AS last_scanned"
ISSUES = "classification IN ('Toxic', 'Abusive', 'Harmful', 'Spam')"

FX_RAW = f"""
    fx_raw AS (
        SELECT *, row_number() OVER (PARTITION BY profile_url ORDER BY comment_id) - 1 AS pos FROM (
            SELECT {fixtures.PROFILE_URL} AS profile_url, doc_id AS comment_id, {fixtures.AUTHOR} AS author, text,
                {fixtures.TIMESTAMP} AS "timestamp" FROM documents)
    )"""
FX_COMMENTS = f"{FX_RAW}, {moderated('fx_raw', 'fx_comments')}"
FX_LINKS = f"""
    fx_links AS (
        SELECT DISTINCT {fixtures.PROFILE_URL} AS profile_url,
            timestamp '{fixtures.INGEST_TIME}' + {fixtures.SOURCE_NUMBER} * interval '1' hour AS last_scanned FROM documents
        UNION ALL SELECT 'https://example.org/c/quiet', timestamp '{fixtures.INGEST_TIME}'
    )"""
FX_CREATORS = f"""{FX_LINKS}, {named("fx_links", "fx_named")},
    fx_creators AS (
        SELECT profile_url, platform, {display_name("NULL")} AS creator_name, 100::DOUBLE AS safety_score, last_scanned
        FROM fx_named
    )"""
FX_STORED = f"""{FX_COMMENTS}, {scored("fx_comments", "fx_scores")}, {FX_CREATORS},
    fx_stored AS (
        SELECT profile_url, platform, creator_name, coalesce(s.safety_score, c.safety_score) AS safety_score, last_scanned
        FROM fx_creators c LEFT JOIN fx_scores s USING (profile_url)
    )"""
FX_BATCHED = f"""
    fx_batched AS (
        SELECT comment_id, profile_url, author, text, "timestamp",
            pos // {fixtures.BATCH_ROWS} AS batch_id, pos % {fixtures.BATCH_ROWS} AS id
        FROM fx_raw
    )"""
FX_ITEMS = """
    fx_items AS (
        SELECT b.comment_id, b.profile_url, b.batch_id, b.id,
            CASE WHEN toxic = 1 THEN 'Toxic' WHEN quality = 0 THEN 'LowQuality' ELSE 'Proper' END AS classification,
            CASE WHEN toxic = 1 THEN 0.9 WHEN quality = 0 THEN 0.3 ELSE 0 END::DOUBLE AS severity_score,
            '' AS flagged_words
        FROM fx_batched b JOIN labels ON doc_id = b.comment_id
    )"""
FX_MERGED = f"""{FX_RAW}, {FX_BATCHED}, {FX_ITEMS},
    fx_merged AS (
        SELECT b.*, coalesce(i.classification, 'Proper') AS classification, coalesce(i.severity_score, 0) AS severity_score,
            coalesce(i.flagged_words, '') AS flagged_words
        FROM fx_batched b LEFT JOIN fx_items i USING (comment_id)
    )"""
FX_THREADS = f"""
    fx_threads AS (
        SELECT 'https://www.reddit.com/r/talk/comments/c' || conv_id || 'p' || (turn // {fixtures.TURNS_PER_THREAD}) || '/t/'
                AS profile_url,
            row_number() OVER (PARTITION BY conv_id, turn // {fixtures.TURNS_PER_THREAD} ORDER BY turn) - 1 AS pos,
            'u/' || CASE WHEN (conv_id + turn) % 13 <> 0 THEN role ELSE 'Anonymous' END AS author, text,
            CASE WHEN (conv_id + turn) % 7 <> 0
                THEN strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%d %H:%M:%S')
                ELSE '{fixtures.INGEST_TIME}' END AS "timestamp"
        FROM conversations
        WHERE (conv_id + turn) % 11 <> 0 AND (conv_id + turn) % 17 <> 0 AND (conv_id + turn) % 19 <> 0
            AND text NOT IN ('', '[deleted]', '[removed]')
    )"""
FX_SCANS = f"""
    fx_scans AS (
        SELECT 'https://youtu.be/' || source AS profile_url, doc_id // {fixtures.COMMENTS_PER_PAGE} AS page, doc_id,
            CASE WHEN doc_id % 7 <> 3 THEN {fixtures.AUTHOR} ELSE 'Anonymous' END AS author, text,
            CASE WHEN doc_id % 9 <> 0 THEN {fixtures.TIMESTAMP} ELSE '{fixtures.INGEST_TIME}' END AS "timestamp",
            CASE WHEN {fixtures.SOURCE_NUMBER} % 7 = 5 AND page % 2 = 0 THEN 'broken'
                WHEN {fixtures.SOURCE_NUMBER} % 7 = 6 AND page % 2 = 1 THEN 'empty' ELSE 'ok' END AS status
        FROM documents
    )"""
FX_PAGES = f"""
    fx_pages AS (
        SELECT 'https://youtu.be/' || source || '_' || (doc_id // {fixtures.COMMENTS_PER_PAGE}) AS profile_url,
            row_number() OVER (PARTITION BY source, doc_id // {fixtures.COMMENTS_PER_PAGE} ORDER BY doc_id) - 1 AS pos,
            CASE WHEN doc_id % 7 <> 3 THEN {fixtures.AUTHOR} ELSE 'Anonymous' END AS author,
            regexp_replace('<b class=''t''>' || text || '</b><br>', '{fixed.TAG_PATTERN}', '', 'g') AS text,
            CASE WHEN doc_id % 9 <> 0 THEN {fixtures.TIMESTAMP} ELSE '{fixtures.INGEST_TIME}' END AS "timestamp"
        FROM documents
    )"""
CLASS_COUNTS = f"""
    counted AS (SELECT profile_url, classification, count(*) AS n FROM {{comments}} GROUP BY ALL),
    class_counts AS (
        SELECT profile_url, classification, coalesce(n, 0) AS comments
        FROM (SELECT profile_url, unnest({_list(fixed.CLASSES)}) AS classification FROM fx_creators)
        FULL JOIN counted USING (profile_url, classification)
    )"""
CHART_ORDER = (
    f"coalesce(list_position({_list(fixed.CHART_ORDER)}, classification) - 1, {fixed.CHART_ORDER_UNKNOWN})::BIGINT AS chart_order"
)
ROLLUP = f"""
    rolled AS (
        SELECT profile_url, platform, creator_name, safety_score, {WHEN_SCANNED},
            coalesce(total, 0) AS total_comments, coalesce(flagged, 0) AS flagged_comments,
            creator_name || ' (' || platform || ' - Safety: ' || safety_score || '%)' AS dashboard_label,
            creator_name || ' (' || platform || ')' AS manager_label
        FROM fx_stored LEFT JOIN (
            SELECT profile_url, count(*) AS total, count(*) FILTER (classification <> 'Proper') AS flagged
            FROM {{comments}} GROUP BY profile_url) USING (profile_url)
    )"""
OFFENDERS = f"""
    offenders AS (
        SELECT profile_url, author, count(*) AS violations_count,
            row_number() OVER (PARTITION BY profile_url ORDER BY count(*) DESC, author)::INT AS place
        FROM fx_comments WHERE classification <> 'Proper' GROUP BY profile_url, author
        QUALIFY place <= {fixed.TOP_OFFENDERS}
    )"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _term_query(terms: list[str]) -> str:
    return f"SELECT doc_id, array_to_string({_hits(terms, 'lower(text)')}, ', ') AS hits FROM documents"


def _search(term: str) -> str:
    return f"regexp_matches(text, {_text(term)}, 'i')"


_URLS = f"""{FX_LINKS}, urls AS (
        SELECT DISTINCT profile_url FROM (SELECT url AS profile_url FROM pages UNION ALL SELECT profile_url FROM fx_links))"""

# Platforms whose first batch comes back broken.
_FAILED = "(contains(profile_url, 'youtu.be') OR contains(profile_url, 'instagram') OR contains(profile_url, 'tiktok'))"

FX_AFTER = f"""{FX_MERGED}, {moderated('fx_raw', 'by_rules')}, {FX_CREATORS},
    again AS (SELECT * FROM fx_merged WHERE {platform_case('profile_url')} IN {tuple(catalog.RESCANNED)}),
    fx_after AS (
        SELECT {VIEW} FROM by_rules WHERE profile_url NOT IN (SELECT profile_url FROM again)
            AND {platform_case('profile_url')} <> '{catalog.DELETED_PLATFORM}'
        UNION ALL SELECT {VIEW} FROM again
    ),
    fx_known AS (SELECT * FROM fx_creators WHERE platform <> '{catalog.DELETED_PLATFORM}'),
    {scored("fx_after", "after_scores")},
    fx_kept AS (
        SELECT profile_url, platform, creator_name, coalesce(s.safety_score, c.safety_score) AS safety_score, last_scanned
        FROM fx_known c LEFT JOIN after_scores s USING (profile_url)
    )"""
_TOKENS = """list_transform(list_sort(list_transform(
        list_filter(list_transform(string_split(flagged_words, ','), lambda w: trim(w)),
            lambda w: w <> '' AND w NOT IN ('URL_LINK', 'YELLING', 'Excessive Emojis')),
        lambda w, i: {'size': -len(w), 'place': i, 'word': w})), lambda s: s.word)"""

_MARKED = f"""SELECT comment_id, list_reduce({_TOKENS}, lambda marked, word:
        regexp_replace(marked, '(' || regexp_escape(word) || ')', '<mark>\\1</mark>', 'gi'), text) AS marked_text
    FROM fx_comments"""

ORACLE: dict[str, str] = {
    "hits_harmful": _term_query(fixed.HARMFUL_TERMS),
    "hits_abusive": _term_query(fixed.ABUSIVE_TERMS),
    "hits_toxic": _term_query(fixed.TOXIC_TERMS),
    "hits_spam": _term_query(fixed.SPAM_TERMS),
    "detect_url": f"SELECT doc_id, {_matches('lower(text)', fixed.LINK_PATTERN)} AS has_link FROM documents",
    "detect_yelling": f"SELECT doc_id, {_matches('text', fixed.YELLING_PATTERN)} AS is_yelling FROM documents",
    "detect_emoji": f"""
        SELECT doc_id, emojis, emojis > {fixed.EMOJI_LIMIT} AS emoji_flood FROM (
            SELECT doc_id, len(regexp_extract_all(text || repeat('\U0001F600✈', (doc_id % 7)::INT) || '☺',
                {_text(fixed.EMOJI_PATTERN)}))::INT AS emojis FROM documents)""",
    "classify_emoji": _with(
        f"""padded AS (SELECT doc_id, text || repeat('\U0001F600✈', (doc_id % 7)::INT) AS text FROM documents), {moderated('padded')}""",
        f"SELECT doc_id, {LABELS} FROM moderated",
    ),
    "classify_comments": _with(moderated("documents"), f"SELECT doc_id, {LABELS} FROM moderated"),
    "classify_by_version": _with(moderated("documents"), f"SELECT doc_id, {LABELS} FROM moderated"),
    "term_places": f"""
        SELECT doc_id, tier, place, term, (strpos(low, term) - 1)::INT AS first
        FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN (VALUES {
            ", ".join(f"({tier}, {place}, {_text(term)})" for tier, (_, terms) in enumerate(automaton.TIERS) for place, term in enumerate(terms))
        }) AS t(tier, place, term) ON contains(low, term)""",
    "classify_turns": _with(moderated("conversations"), f"SELECT conv_id, turn, {LABELS} FROM moderated"),
    "moderate_comments": _with(
        f"{FX_COMMENTS}, {scored('fx_comments')}", f"SELECT *, {bands('safety_score')} FROM scored"
    ),
    "stream_moderation": _with(moderated("documents"), f"SELECT doc_id, 'Anonymous' AS author, {LABELS} FROM moderated"),
    "reddit_flatten": _with(FX_THREADS, 'SELECT profile_url, pos, author, text, "timestamp" FROM fx_threads'),
    "reddit_flatten_deep": f"""
        SELECT 'https://www.reddit.com/r/talk/comments/chain' || (conv_id // {fixtures.CONVERSATIONS_PER_CHAIN}) || '/t/' AS profile_url,
            row_number() OVER (PARTITION BY conv_id // {fixtures.CONVERSATIONS_PER_CHAIN} ORDER BY conv_id, turn) - 1 AS pos,
            'u/' || CASE WHEN (conv_id + turn) % 13 <> 0 THEN role ELSE 'Anonymous' END AS author, text,
            CASE WHEN (conv_id + turn) % 7 <> 0
                THEN strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y-%m-%d %H:%M:%S')
                ELSE '{fixtures.INGEST_TIME}' END AS "timestamp"
        FROM conversations
        WHERE (conv_id + turn) % 11 <> 0 AND (conv_id + turn) % 17 <> 0 AND (conv_id + turn) % 19 <> 0
            AND text NOT IN ('', '[deleted]', '[removed]')""",
    "reddit_flatten_limited": _with(
        FX_THREADS, 'SELECT profile_url, pos, author, text, "timestamp" FROM fx_threads WHERE pos < 3'
    ),
    "landed_status": _with(
        f"{FX_THREADS}, {FX_SCANS}",
        f"""SELECT DISTINCT 'https://www.reddit.com/r/talk/comments/c' || conv_id || 'p' || (turn // {fixtures.TURNS_PER_THREAD})
                || '/t/' AS profile_url, NULL AS landed_at, 0 AS page,
                CASE WHEN profile_url IN (SELECT profile_url FROM fx_threads) THEN 'ok' ELSE 'empty' END AS status
            FROM conversations
            UNION ALL SELECT DISTINCT profile_url, '{fixtures.LATER_SCAN}', page, status FROM fx_scans
            UNION ALL SELECT DISTINCT profile_url, '{fixtures.EARLIER_SCAN}', page, 'empty' FROM fx_scans WHERE page % 2 = 0""",
    ),
    "youtube_pages": _with(
        FX_SCANS,
        f"""SELECT profile_url, page * {2**32} + row_number() OVER (PARTITION BY profile_url, page ORDER BY doc_id) - 1 AS pos, author,
                regexp_replace('<b class=''t''>' || text || '</b><br>', '{fixed.TAG_PATTERN}', '', 'g') AS text, "timestamp"
            FROM fx_scans WHERE status = 'ok'""",
    ),
    "youtube_flatten": _with(FX_PAGES, 'SELECT profile_url, pos, author, text, "timestamp" FROM fx_pages'),
    "scan_links": _with(
        f"""{FX_THREADS}, {FX_PAGES}, landed AS (SELECT * FROM fx_threads UNION ALL BY NAME SELECT * FROM fx_pages),
        {moderated('landed')}, {scored('moderated')}, {named('scored')}""",
        f"""SELECT profile_url, platform, {display_name("'Talk ' || nullif(regexp_extract(profile_url, '/c([0-9]+)p', 1), '')")}
            AS creator_name, safety_score, '{fixtures.INGEST_TIME}' AS last_scanned FROM named""",
    ),
    "detect_platform": _with(_URLS, f"SELECT profile_url, {platform_case('profile_url')} AS platform FROM urls"),
    "extract_handle": _with(f"{_URLS}, {named('urls')}", "SELECT profile_url, platform, handle FROM named"),
    "creator_names": _with(
        f"{FX_LINKS}, {named('fx_links')}",
        f"""SELECT profile_url, platform, handle, {display_name(
            "CASE WHEN contains(profile_url, '/r/gaming/') THEN 'Thread ' || split_part(profile_url, '/', 7) END")}
            AS creator_name FROM named""",
    ),
    "strip_html": f"SELECT page_id, regexp_replace(html, '{fixed.TAG_PATTERN}', '', 'g') AS text FROM pages",
    "normalise_comments": """
        SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'Anonymous' ELSE coalesce(role, 'Anonymous') END AS author,
            coalesce(text, '') AS text, '' AS "timestamp" FROM conversations""",
    "label_batches": _with(f"{FX_RAW}, {FX_BATCHED}", "SELECT comment_id, profile_url, batch_id, id FROM fx_batched"),
    "label_payloads": _with(
        f"{FX_RAW}, {FX_BATCHED}",
        """SELECT profile_url, batch_id, to_json(list({'id': id, 'text': text} ORDER BY id))::VARCHAR AS payload,
            count(*) AS items FROM fx_batched GROUP BY profile_url, batch_id""",
    ),
    "label_payload_items": _with(f"{FX_RAW}, {FX_BATCHED}", "SELECT profile_url, batch_id, id, text FROM fx_batched"),
    "parse_external_labels": _with(
        f"{FX_RAW}, {FX_BATCHED}, {FX_ITEMS}",
        f"""SELECT profile_url, batch_id,
            (row_number() OVER (PARTITION BY profile_url, batch_id ORDER BY id) - 1)::INT AS item, id, {LABELS}
            FROM fx_items WHERE NOT (batch_id = 0 AND {_FAILED})""",
    ),
    "external_batch_status": _with(
        f"{FX_RAW}, {FX_BATCHED}",
        f"SELECT DISTINCT profile_url, batch_id, NOT (batch_id = 0 AND {_FAILED}) AS ok FROM fx_batched",
    ),
    "merge_external_labels": _with(FX_MERGED, f"SELECT comment_id, profile_url, batch_id, id, {LABELS} FROM fx_merged"),
    "hybrid_labels": _with(
        f"{FX_MERGED}, {moderated('fx_raw', 'by_rules')}",
        f"""SELECT m.comment_id, m.profile_url, NOT {_FAILED.replace('profile_url', 'm.profile_url')} AS scan_ok,
            {', '.join(f"CASE WHEN scan_ok THEN m.{c} ELSE r.{c} END AS {c}" for c in LABELS.split(', '))}
            FROM fx_merged m JOIN by_rules r USING (comment_id)""",
    ),
    "stream_labels": _with(
        f"""{FX_MERGED}, {moderated('fx_raw', 'by_rules')},
        decided AS (SELECT DISTINCT profile_url, CASE WHEN {_FAILED} THEN 'broken'
            WHEN contains(profile_url, 'x.com') THEN 'late' ELSE 'complete' END AS reason FROM fx_raw)""",
        f"""SELECT m.comment_id, m.profile_url, reason = 'complete' AS scan_ok, reason,
            {', '.join(f"CASE WHEN reason = 'complete' THEN m.{c} ELSE r.{c} END AS {c}" for c in LABELS.split(', '))}
            FROM fx_merged m JOIN by_rules r USING (comment_id) JOIN decided d ON d.profile_url = m.profile_url""",
    ),
    "stream_tables": _with(
        f"""{FX_SCANS}, fx_landed AS (
            SELECT profile_url, page * {2**32} + row_number() OVER (PARTITION BY profile_url, page ORDER BY doc_id) - 1 AS pos, author,
                regexp_replace('<b class=''t''>' || text || '</b><br>', '{fixed.TAG_PATTERN}', '', 'g') AS text, "timestamp"
            FROM fx_scans WHERE status = 'ok'), {moderated('fx_landed', 'labelled')}""",
        f'SELECT profile_url, pos, author, text, "timestamp", {LABELS} FROM labelled',
    ),
    "scan_comments": _with(FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments"),
    "list_creators": _with(FX_STORED, f"SELECT * REPLACE ({WHEN_SCANNED}) FROM fx_stored"),
    "replace_comments": _with(
        f"""{FX_MERGED}, {moderated('fx_raw', 'by_rules')},
        again AS (SELECT * FROM fx_merged WHERE {platform_case('profile_url')} IN {tuple(catalog.RESCANNED)})""",
        f"""SELECT {VIEW} FROM by_rules WHERE profile_url NOT IN (SELECT profile_url FROM again)
            UNION ALL SELECT {VIEW} FROM again""",
    ),
    "upsert_creators": _with(
        FX_STORED,
        f"""SELECT profile_url, platform, CASE WHEN platform IN {tuple(catalog.RESCANNED)} THEN 'New ' ELSE '' END || creator_name
                AS creator_name, safety_score, strftime(last_scanned + CASE WHEN platform IN {tuple(catalog.RESCANNED)}
                THEN interval '30' day ELSE interval '0' day END, '%Y-%m-%d %H:%M:%S') AS last_scanned FROM fx_stored
            UNION ALL
            SELECT 'https://example.org/conv/' || conv_id, 'Other', 'Turn ' || max(turn), 100::DOUBLE,
                strftime(timestamp '{fixtures.INGEST_TIME}' + max(turn) * interval '1' hour, '%Y-%m-%d %H:%M:%S')
            FROM conversations GROUP BY conv_id""",
    ),
    "delete_creators": _with(
        FX_STORED, f"SELECT * REPLACE ({WHEN_SCANNED}) FROM fx_stored WHERE platform <> '{catalog.DELETED_PLATFORM}'"
    ),
    "delete_creator_comments": _with(
        FX_COMMENTS,
        f"""SELECT profile_url, comment_id, author, "timestamp", {LABELS} FROM fx_comments
            WHERE {platform_case('profile_url')} <> '{catalog.DELETED_PLATFORM}'""",
    ),
    "kept_class_counts": _with(
        f"{FX_AFTER}, {CLASS_COUNTS.format(comments='fx_after').replace('fx_creators', 'fx_known')}", "SELECT * FROM class_counts"
    ),
    "kept_rollup": _with(
        f"{FX_AFTER}, {ROLLUP.format(comments='fx_after').replace('fx_stored', 'fx_kept')}", "SELECT * FROM rolled"
    ),
    "kept_top_offenders": _with(f"{FX_AFTER}, {OFFENDERS.replace('fx_comments', 'fx_after')}", "SELECT * FROM offenders"),
    "export_comments_csv": _with(
        FX_COMMENTS, f'SELECT profile_url AS creator, author, text, "timestamp", {LABELS} FROM fx_comments WHERE {ISSUES}'
    ),
    "export_blocklist_csv": _with(
        FX_COMMENTS,
        "SELECT DISTINCT profile_url AS creator, author AS \"Username\" FROM fx_comments WHERE classification IN ('Abusive', 'Harmful', 'Spam')",
    ),
    "safety_scores": _with(f"{FX_COMMENTS}, {scored('fx_comments')}", "SELECT * FROM scored"),
    "thread_safety_scores": _with(
        f"""talks AS (SELECT 'https://example.org/conv/' || conv_id AS profile_url, text FROM conversations),
        {moderated('talks')}, {scored('moderated')}""",
        "SELECT * FROM scored",
    ),
    "safety_bands": _with(
        f"{FX_COMMENTS}, {scored('fx_comments')}", f"SELECT profile_url, safety_score, {bands('safety_score')} FROM scored"
    ),
    "class_counts": _with(
        f"{FX_COMMENTS}, {FX_CREATORS}, {CLASS_COUNTS.format(comments='fx_comments')}", "SELECT * FROM class_counts"
    ),
    "external_class_counts": _with(
        f"{FX_MERGED}, {FX_CREATORS}, {CLASS_COUNTS.format(comments='fx_merged')}", f"SELECT *, {CHART_ORDER} FROM class_counts"
    ),
    "class_distribution": _with(
        f"{FX_COMMENTS}, {FX_CREATORS}, {CLASS_COUNTS.format(comments='fx_comments')}",
        f"SELECT *, {CHART_ORDER} FROM class_counts",
    ),
    "creator_rollup": _with(f"{FX_STORED}, {ROLLUP.format(comments='fx_comments')}", "SELECT * FROM rolled"),
    "external_creator_rollup": _with(
        f"{FX_STORED}, {FX_MERGED.replace(FX_RAW + ',', '', 1)}, {ROLLUP.format(comments='fx_merged')}", "SELECT * FROM rolled"
    ),
    "top_offenders": _with(f"{FX_COMMENTS}, {OFFENDERS}", "SELECT * FROM offenders"),
    "creator_analytics": _with(
        f"{FX_STORED}, {OFFENDERS}",
        f"""SELECT profile_url, creator_name, platform, safety_score,
                strftime(last_scanned, '%Y-%m-%d %H:%M') AS last_scanned_text,
                coalesce(total, 0) AS total_comments,
                {', '.join(f"coalesce({c.lower()}, 0) AS {c.lower()}_comments" for c in fixed.CLASSES)},
                coalesce(issues, 0) AS flagged_issues, coalesce(worst, '') AS top_offenders, {bands('safety_score')}
            FROM fx_stored
            LEFT JOIN (SELECT profile_url, count(*) AS total, count(*) FILTER ({ISSUES}) AS issues,
                {', '.join(f"count(*) FILTER (classification = '{c}') AS {c.lower()}" for c in fixed.CLASSES)}
                FROM fx_comments GROUP BY profile_url) USING (profile_url)
            LEFT JOIN (SELECT profile_url, string_agg(author || ':' || violations_count, ',' ORDER BY place) AS worst
                FROM offenders GROUP BY profile_url) USING (profile_url)""",
    ),
    "external_creator_analytics": _with(
        f"{FX_STORED}, {FX_MERGED.replace(FX_RAW + ',', '', 1)}",
        f"""SELECT profile_url, coalesce(total, 0) AS total_comments, coalesce(listed, '') AS class_counts,
                coalesce(issues, 0) AS flagged_issues
            FROM fx_stored LEFT JOIN (
                SELECT profile_url, sum(n) AS total, string_agg(classification || ':' || n, ',' ORDER BY classification) AS listed,
                    coalesce(sum(n) FILTER ({ISSUES}), 0) AS issues
                FROM (SELECT profile_url, classification, count(*) AS n FROM fx_merged GROUP BY ALL) GROUP BY profile_url
            ) USING (profile_url)""",
    ),
    "blocklist": _with(
        FX_COMMENTS,
        "SELECT DISTINCT profile_url, author FROM fx_comments WHERE classification IN ('Abusive', 'Harmful', 'Spam')",
    ),
    "comments_of_creator": _with(
        FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE profile_url = 'https://instagram.com/src2'"
    ),
    "comments_of_creators": _with(
        FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE {platform_case('profile_url')} = 'Instagram'"
    ),
    "comments_by_class": _with(FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE classification IN ('Harmful', 'Spam')"),
    "flagged_view": _with(FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE {ISSUES}"),
    "search_comments": _with(FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE {_search(catalog.SEARCH_TERM)}"),
    "search_by_index": _with(FX_COMMENTS, f"SELECT {VIEW} FROM fx_comments WHERE {_search(catalog.SEARCH_TERM)}"),
    "comment_pages": _with(
        FX_COMMENTS,
        " UNION ALL ".join(
            f"""SELECT profile_url, comment_id, '{name}' AS sorted_by, position, position // {catalog.PAGE_ROWS} AS page FROM (
                SELECT profile_url, comment_id, row_number() OVER (PARTITION BY profile_url ORDER BY {by} DESC, comment_id) - 1 AS position
                FROM fx_comments)"""
            for name, by in (("newest", '"timestamp"'), ("gravest", "severity_score"))
        ),
    ),
    "second_page": _with(
        FX_COMMENTS,
        f"""SELECT {VIEW} FROM fx_comments WHERE profile_url = 'https://instagram.com/src2'
            ORDER BY "timestamp" DESC, comment_id LIMIT {catalog.PAGE_ROWS} OFFSET {catalog.PAGE_ROWS}""",
    ),
    "filtered_counts": _with(
        f"{FX_COMMENTS}, {FX_CREATORS}",
        f"""SELECT profile_url, count(shown) AS shown_comments FROM fx_creators LEFT JOIN (
                SELECT profile_url, 1 AS shown FROM fx_comments WHERE {ISSUES} AND {_search(catalog.SEARCH_TERM)}
            ) USING (profile_url) GROUP BY profile_url""",
    ),
    "severity_percent": _with(
        FX_COMMENTS,
        """SELECT comment_id, severity_score, nullif(trunc(severity_score * 100)::INT, 0) AS severity_percent
            FROM fx_comments""",
    ),
    "highlight_triggers": _with(FX_COMMENTS, _MARKED),
    "highlight_by_places": _with(FX_COMMENTS, _MARKED),
}
