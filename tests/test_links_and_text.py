from urllib.parse import urlparse

from pyspark.sql import functions as F

from modlytics.functions.links import creator_label, display_name, handle_of, last_path_part, platform_of, without_query
from modlytics.functions.text import epoch_text, highlight, iso_text, strip_tags

LINKS = [
    ("https://www.reddit.com/r/gaming/comments/abc1/t/", "Reddit", "Reddit Post: abc1"),
    ("reddit.com/user/bob", "Reddit", "u/bob"),
    ("https://reddit.com/r/gaming", "Reddit", "r/gaming"),
    ("https://reddit.com/u/bob", "Reddit", "bob"),
    ("https://youtu.be/XYZ?t=3", "YouTube", "XYZ"),
    ("https://www.youtube.com/@chan", "YouTube", "@chan"),
    ("https://youtu.be/", "YouTube", ""),
    ("https://www.youtube.com/watch?v=XYZ", "YouTube", "XYZ"),
    ("https://www.youtube.com/watch?list=1&v=XYZ&t=4", "YouTube", "XYZ"),
    ("https://www.youtube.com/watch?list=1", "YouTube", "watch"),
    ("https://www.youtube.com/shorts/S1", "YouTube", "S1"),
    ("https://www.youtube.com/embed/E1#x", "YouTube", "E1"),
    ("https://instagram.com/foo", "Instagram", "@foo"),
    ("HTTPS://WWW.INSTAGRAM.COM/Foo", "Instagram", "Foo"),
    ("https://netflix.com/title/9", "Twitter/X", "@title"),
    ("https://twitter.com/jane/status/1", "Twitter/X", "@jane"),
    ("https://www.tiktok.com/@me/video/1", "TikTok", "@me"),
    ("https://www.tiktok.com/discover", "TikTok", "discover"),
    ("https://example.org", "Other", "creator"),
    ("https://example.org/a/b;p=1#f", "Other", "b"),
    (" https://example.org/a/ ?x=1", "Other", "a"),
    ("foo.com/bar", "Other", "bar"),
    ("foo.com", "Other", "foo.com"),
]


def test_platform_and_handle(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in LINKS], "url STRING")
    platform = platform_of(F.col("url"))
    got = {r[0]: (r[1], r[2]) for r in df.select("url", platform, handle_of(F.col("url"), platform)).collect()}
    for url, platform, handle in LINKS:
        assert got[url] == (platform, handle), url


def test_last_path_part_of_page_links(spark, small):
    urls = spark.read.parquet(f"{small}/pages.parquet").select("url")
    clean = without_query(F.col("url"))
    for url, got in urls.select(clean, last_path_part(clean)).collect():
        path = urlparse(url).path.strip("/")
        assert got == (path.split("/")[-1] if path else "creator"), url


def test_names_and_labels(spark):
    df = spark.createDataFrame(
        [("Reddit", "r/a", "A thread"), ("Reddit", "r/a", None), ("YouTube", "XYZ", None), ("YouTube", "", None)],
        "platform STRING, handle STRING, title STRING",
    )
    name = display_name(F.col("platform"), F.col("handle"), F.col("title"))
    assert [r[0] for r in df.select(name).collect()] == ["A thread", "r/a", "YouTube Video: XYZ", "YouTube Video: Demo"]
    one = spark.createDataFrame([("Bob", "TikTok", 66.7)], "n STRING, p STRING, s DOUBLE")
    got = one.select(creator_label(F.col("n"), F.col("p"), F.col("s")), creator_label(F.col("n"), F.col("p"))).first()
    assert tuple(got) == ("Bob (TikTok - Safety: 66.7%)", "Bob (TikTok)")


def test_strip_tags(spark):
    df = spark.createDataFrame([("a<br>b <a href=x>c</a> <>d",), ("1 < 2 > 0",), ("<a\nb>c",)], "t STRING")
    assert [r[0] for r in df.select(strip_tags(F.col("t"))).collect()] == ["ab c <>d", "1  0", "c"]


def test_times(spark):
    df = spark.createDataFrame(
        [(1704067200.9, "2026-06-21T12:00:00Z"), (0.0, ""), (None, None)], "e DOUBLE, p STRING"
    )
    got = df.select(epoch_text(F.col("e"), F.lit("now")), iso_text(F.col("p"), F.lit("now"))).collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00", "2026-06-21 12:00:00"), ("now", "now"), ("now", "now")]


def test_highlight(spark):
    cases = [
        ("go Kill Yourself now", "kill you, kill yourself", "go <mark><mark>Kill You</mark>rself</mark> now"),
        ("What CRAP", "crap, crap, YELLING", "What <mark><mark>CRAP</mark></mark>"),
        ("join discord.gg or discordXgg", "discord.gg, URL_LINK", "join <mark>discord.gg</mark> or discordXgg"),
        ("a+b (c) $1", "a+b, (c), $1", "<mark>a+b</mark> <mark>(c)</mark> <mark>$1</mark>"),
        ("fine", "", "fine"),
        ("fine", None, "fine"),
        ("x <b> die", "die", "x <b> <mark>die</mark>"),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i INT, t STRING, f STRING")
    got = {r[0]: r[1] for r in df.select("i", highlight(F.col("t"), F.col("f"))).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}
    escaped = df.filter("i = 6").select(highlight(F.col("t"), F.col("f"), "<em>", "</em>", escape=True)).first()[0]
    assert escaped == "x &lt;b&gt; <em>die</em>"
