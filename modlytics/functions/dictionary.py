"""Fixed values of the moderation rules."""

# ---------------------------------------------------------------------------
# Fixed values. Results depend on them term by term: the order is the order in
# which triggers are printed, and a term listed twice counts and prints twice.
# The lists come from a public source under the MIT licence.
# ---------------------------------------------------------------------------

HARMFUL_TERMS = [
    "kill you", "kill yourself", "kill u", "kys", "die", "murder", "stab", "dox",
    "find your address", "bomb", "shoot", "attack", "punch you", "beat you", "destroy you",
    "slit", "suicide", "hang yourself", "terrorist", "nigger", "chink", "kike", "spic",
    "rape", "assassinate", "run over", "burn you", "throat slit",
]

ABUSIVE_TERMS = [
    "stupid", "idiot", "dumb", "ugly", "fat", "loser", "trash", "garbage", "suck",
    "sucks", "hate you", "clown", "retard", "faggot", "moron", "imbecile", "pathetic",
    "useless", "noob", "disgusting", "freak", "shut up", "get lost", "worthless",
    "brainless", "coward", "failure", "joke", "fraud", "scum", "bitchy",
]

TOXIC_TERMS = [
    "fuck", "shit", "bitch", "asshole", "bastard", "crap", "dick", "pussy", "cunt",
    "motherfucker", "fucker", "whore", "slut", "crap", "piss", "damn", "screw you",
    "wanker", "bollocks", "arsehole", "prick", "cock", "dipshit",
]

SPAM_TERMS = [
    "subscribe", "sub to", "my channel", "check out my", "follow me", "follow back",
    "free crypto", "giveaway", "whatsapp me", "telegram me", "earn money", "make money",
    "passive income", "promocode", "click here", "link in bio", "dm me", "check my profile",
    "free skin", "easy cash", "invest", "profits", "unlimited cash", "discord.gg",
]

# Labels of the five classes; any other label may only come from outside.
PROPER, TOXIC, ABUSIVE, HARMFUL, SPAM = "Proper", "Toxic", "Abusive", "Harmful", "Spam"
CLASSES = [PROPER, TOXIC, ABUSIVE, HARMFUL, SPAM]
CHART_ORDER = [PROPER, SPAM, TOXIC, ABUSIVE, HARMFUL]
CHART_ORDER_UNKNOWN = 9
ISSUE_CLASSES = [TOXIC, ABUSIVE, HARMFUL, SPAM]
BLOCKED_CLASSES = [ABUSIVE, HARMFUL, SPAM]

# Triggers that name a rule instead of a term.
YELLING_TAG, URL_TAG, EMOJI_TAG = "YELLING", "URL_LINK", "Excessive Emojis"
SYSTEM_TAGS = [URL_TAG, YELLING_TAG, EMOJI_TAG]

# Severity in hundredths: base + step per trigger, up to a cap. Where yelling
# counts, it adds YELLING_STEP up to a cap of its own.
HARMFUL_SEVERITY = {"base": 70, "step": 10, "cap": 100}
ABUSIVE_SEVERITY = {"base": 50, "step": 8, "cap": 95, "yelling_cap": 98}
TOXIC_SEVERITY = {"base": 35, "step": 8, "cap": 85, "yelling_cap": 90}
SPAM_SEVERITY = {"base": 40, "step": 10, "cap": 90}
YELLING_STEP = 10
EMOJI_SEVERITY = 45
EMOJI_LIMIT = 8

# Top-level domains that make a bare host a link.
LINK_DOMAINS = [
    "com", "net", "org", "info", "co", "xyz", "biz", "tv", "io", "me", "us", "click", "site",
    "download",
]

# Emoji ranges that count.
EMOJI_RANGES = [(0x263A, 0x263F), (0x2700, 0x27BF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF)]

# Safety score bands: (lowest score, band, text), first match wins.
SCAN_BANDS = [(80, "green"), (50, "amber"), (None, "red")]
SAFETY_BANDS = [
    (90, "green", "Extremely clean and friendly community environment. Very low risk."),
    (70, "amber", "Generally healthy discussion with occasional toxicity or spam. Moderate safety."),
    (50, "orange", "High toxicity/abuse detected. Community guidelines are frequently violated."),
    (None, "red", "Severely hostile community environment. Immediate moderation action required."),
]

# Platforms in the order they are tried: (name, substrings of the lower-cased URL).
PLATFORMS = [
    ("Reddit", ["reddit.com"]),
    ("YouTube", ["youtube.com", "youtu.be"]),
    ("Instagram", ["instagram.com"]),
    ("Twitter/X", ["twitter.com", "x.com"]),
    ("TikTok", ["tiktok.com"]),
]
OTHER_PLATFORM = "Other"

# Defaults and limits.
ANONYMOUS = "Anonymous"
REMOVED_BODIES = ["[deleted]", "[removed]"]
THREAD_TITLE = "Reddit Thread"
LABEL_BATCH_ROWS = 50
TOP_OFFENDERS = 5
EMPTY_SCORE = 100.0
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
DISPLAY_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm"
BLANKS = " \t\n\r\x0b\x0c"

# ---------------------------------------------------------------------------
# Patterns, written so that Java and RE2 read them alike: explicit classes in
# place of \b, \w and \S, whose reach differs between engines. A word character
# is a letter, a number or "_"; a blank is any Unicode blank.
# The second spelling of i and s is what case-insensitive matching adds to them.
# ---------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
NOT_BLANK = r"[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]"
I, S = r"[i\x{131}]", r"[s\x{17f}]"

YELLING_PATTERN = rf"(?:^|{NOT_WORD})[A-Z]{{4,}}(?:$|{NOT_WORD})"
_ANY_DOMAIN = "|".join(d.replace("i", I).replace("s", S) for d in LINK_DOMAINS)
LINK_PATTERN = (
    rf"http{S}?://{NOT_BLANK}|www\.{NOT_BLANK}|{WORD}\.(?:{_ANY_DOMAIN})(?:$|{NOT_WORD})"
)
# Found wherever the pattern above it is, and quicker to rule out.
LINK_HINT = rf"[:.w](?://|ww\.|{_ANY_DOMAIN})"
YELLING_HINT = "[A-Z]{4}"
EMOJI_PATTERN = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in EMOJI_RANGES) + "]"
# More emoji than the limit, whatever stands between them.
EMOJI_FLOOD_PATTERN = f"(?:{EMOJI_PATTERN}{EMOJI_PATTERN.replace('[', '[^')}*){{{EMOJI_LIMIT + 1}}}"
TAG_PATTERN = r"<[^<]+?>"
