import json
import os
import random
import sys
from urllib.parse import quote_plus

import pytest
from pyspark.sql import functions as F

from modlytics.plans.scan import landed_status, raw_comments, scan
from modlytics.sources.landed import latest_scans, read_landed
from modlytics.sources.threads import read_threads, thread_comments, thread_titles
from modlytics.sources.videos import video_comments, video_titles

NOW = "2024-02-01 00:00:00"


def node(body, replies="", kind="t1", **data):
    if isinstance(replies, list):
        replies = {"data": {"children": replies}}
    return {"kind": kind, "data": {"author": "ann", "body": body, "created_utc": 1704067200, "replies": replies, **data}}


def thread(*nodes, title="T"):
    return json.dumps([{"data": {"children": [{"data": {"title": title}}]}}, {"data": {"children": list(nodes)}}])


def landed(spark, payloads):
    return spark.createDataFrame(list(payloads.items()), "profile_url STRING, payload STRING")


def texts(df):
    out = {}
    for r in df.orderBy("profile_url", "pos").collect():
        out.setdefault(r.profile_url, []).append(r.text)
    return out


def test_thread_order_and_drops(spark):
    tree = thread(
        node("1", [node("[deleted]", [node("1.0.0")]), node("", [node("1.1.0")], kind="more")]),
        node("2", "", author=None, created_utc=0),
        node("", [node("[removed]")]),
    )
    rows = thread_comments(landed(spark, {"u": tree}), NOW).orderBy("pos").collect()
    assert [(r.pos, r.text, r.author, r.timestamp) for r in rows] == [
        (0, "1", "u/ann", "2024-01-01 00:00:00"),
        (1, "1.0.0", "u/ann", "2024-01-01 00:00:00"),
        (2, "2", "u/Anonymous", NOW),
    ]


def test_thread_payloads_that_give_nothing(spark):
    bad = {
        "one element": json.dumps([{"data": {}}]),
        "object": json.dumps({"data": {"children": [node("x")]}}),
        "broken": thread(node("x"))[:-2],
        "trailing": thread(node("x")) + " [",
        "empty": thread(),
    }
    assert thread_comments(landed(spark, bad), NOW).count() == 0
    titles = dict(thread_titles(landed(spark, {**bad, "good": thread(node("x"), title="Hello")})).collect())
    assert titles["good"] == "Hello" and titles["object"] == "Reddit Thread" and titles["broken"] == "Reddit Thread"


def chain(depth):
    last = node(str(depth - 1))
    for i in reversed(range(depth - 1)):
        last = node(str(i), [last])
    return last


def test_deep_threads_come_whole_or_with_a_status(spark):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        payloads = {f"{n}": thread(chain(n)) for n in (1, 40, 199, 200, 300)}
    finally:
        sys.setrecursionlimit(limit)
    read = {r.profile_url: (r.status, [c.body for c in r.comments or []]) for r in read_threads(landed(spark, payloads)).collect()}
    assert read == {
        **{f"{n}": ("ok", [str(i) for i in range(n)]) for n in (1, 40, 199)},
        **{f"{n}": ("too deep", []) for n in (200, 300)},
    }


def test_statuses(spark):
    threads = {"ok": thread(node("x")), "empty": thread(), "broken": thread(node("x"))[:-2], "gone": thread(node("[deleted]")), "null": None}
    pages = {"page": json.dumps({"items": [item()]}), "none": json.dumps({}), "cut": json.dumps({"items": [item()]})[:-1], "odd": json.dumps({"items": [{}]})}
    found = landed_status(landed(spark, threads), landed(spark, pages)).collect()
    assert {r.profile_url: r.status for r in found} == {
        "ok": "ok", "empty": "empty", "broken": "broken", "gone": "empty", "null": "broken", "page": "ok", "none": "empty", "cut": "broken", "odd": "broken",
    }


def test_pages_and_rescans_of_a_link(spark):
    def scan(day, page, *bodies):
        return ("v", f"2024-01-0{day} 00:00:00", page, json.dumps({"items": [item(b) for b in bodies]}))

    rows = [scan(1, 0, "old"), scan(2, 1, "c"), scan(2, 0, "a", "b"), scan(1, 2, "gone"), scan(2, 0, "a", "b")]
    df = spark.createDataFrame(rows, "profile_url STRING, landed_at STRING, page BIGINT, payload STRING")
    df = df.withColumn("landed_at", F.to_timestamp("landed_at"))
    got = raw_comments(df.limit(0), df, NOW).orderBy("pos").collect()
    assert [r.text for r in got] == ["a", "b", "c"]
    assert len({r.pos for r in got}) == len({r.comment_id for r in got}) == 3


def test_folder_of_landed_files(spark, tmp_path):
    link = "https://youtu.be/a b?x=1"
    for page in (0, 1):
        folder = tmp_path / f"link={quote_plus(link)}"
        folder.mkdir(exist_ok=True)
        (folder / f"{page}.json").write_text(json.dumps({"items": [item(f"page\n{page}")]}))
    found = read_landed(spark, str(tmp_path))
    assert [(r.profile_url, r.page) for r in found.orderBy("page").collect()] == [(link, 0), (link, 1)]
    assert [r.text for r in video_comments(latest_scans(found.withColumn("landed_at", F.lit(0).cast("timestamp"))), NOW).orderBy("pos").collect()] == ["page\n0", "page\n1"]


def land(folder, link, page, written, *bodies):
    place = folder / f"link={quote_plus(link)}"
    place.mkdir(parents=True, exist_ok=True)
    (place / f"{page}.json").write_text(json.dumps({"items": [item(b) for b in bodies]}))
    os.utime(place / f"{page}.json", (written, written))


def scanned_texts(spark, folder, path):
    found = read_landed(spark, str(folder))
    comments = scan(found.limit(0), found, NOW, str(path))[1]
    return [r.text for r in comments.orderBy("profile_url", "pos").collect()]


def test_all_pages_of_a_scan_whenever_written(spark, tmp_path):
    first, second = (tmp_path / "landed" / f"scan={quote_plus(day)}" for day in ("2024-01-01 00:00:00", "2024-01-02T00:00:00+00:00"))
    for page in range(4):
        land(first, "https://youtu.be/v", page, 9_000 + page, f"old {page}")
    for page in range(3):
        land(second, "https://youtu.be/v", page, 1_000 + 60 * page, f"new {page}")
    land(first, "https://youtu.be/w", 0, 500, "only once")
    assert scanned_texts(spark, tmp_path / "landed", tmp_path / "comments") == ["new 0", "new 1", "new 2", "only once"]


def test_all_pages_without_a_scan_folder(spark, tmp_path):
    for page in range(3):
        land(tmp_path / "landed", "https://youtu.be/v", page, 1_000 + 60 * page, f"text {page}")
    assert scanned_texts(spark, tmp_path / "landed", tmp_path / "comments") == ["text 0", "text 1", "text 2"]


def test_scan_folder_without_a_time(spark, tmp_path):
    land(tmp_path / "scan=third", "https://youtu.be/v", 0, 1_000, "a")
    with pytest.raises(Exception, match="no time in the scan folder"):
        read_landed(spark, str(tmp_path)).collect()


def test_payloads_of_unknown_time(spark):
    rows = [("u", None, 0, "a"), ("u", None, 1, "b"), ("v", None, 0, "old"), ("v", "2024-01-01 00:00:00", 0, "c")]
    df = spark.createDataFrame(rows, "profile_url STRING, landed_at STRING, page BIGINT, payload STRING")
    kept = latest_scans(df.withColumn("landed_at", F.to_timestamp("landed_at"))).collect()
    assert sorted(r.payload for r in kept) == ["a", "b", "c"]


def test_all_rows_of_a_long_thread_unless_limited(spark):
    tree = thread(node("[deleted]"), *[node(str(i), [node(f"{i}.0")]) for i in range(200)])
    payloads = landed(spark, {"long": tree, "short": thread(node("a"))})
    got = texts(thread_comments(payloads, NOW))
    assert len(got["long"]) == 400 and got["long"][:4] == ["0", "0.0", "1", "1.0"] and got["short"] == ["a"]
    assert texts(thread_comments(payloads, NOW, rows_per_thread=3))["long"] == ["0", "0.0", "1"]


@pytest.mark.parametrize("seed", [1, 3])
def test_random_threads(spark, seed):
    rng = random.Random(seed)
    expected = {}

    def grow(name, depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            body = rng.choice(["[deleted]", "[removed]", "", f"t{rng.random()}", f"t{rng.random()}"])
            kind = rng.choice(["t1", "t1", "t1", "more"])
            if kind == "t1" and body.startswith("t"):
                expected[name].append(body)
            hidden, before = kind != "t1", len(expected[name])
            replies = grow(name, depth - 1) if depth else ""
            if hidden:
                del expected[name][before:]
            out.append(node(body, replies, kind=kind))
        return out

    payloads = {}
    for i in range(30):
        name = f"n{i}"
        expected[name] = []
        payloads[name] = thread(*grow(name, 5))
    got = texts(thread_comments(landed(spark, payloads), NOW))
    assert got == {k: v for k, v in expected.items() if v}


def item(text="hi", **fields):
    return {"snippet": {"topLevelComment": {"snippet": {"textDisplay": text, **fields}}, "totalReplyCount": 3}}


def test_video_pages(spark):
    pages = {
        "good": json.dumps(
            {
                "items": [
                    item("a<br>b", authorDisplayName="Ann", publishedAt="2026-06-21T12:00:00Z"),
                    item(""),
                    {"snippet": {"topLevelComment": {"snippet": {}}}},
                ],
                "nextPageToken": "x",
            }
        ),
        "one bad item": json.dumps({"items": [item("x"), {"snippet": {}}]}),
        "broken": json.dumps({"items": [item("x")]})[:-1],
        "trailing": json.dumps({"items": [item("x")]}) + "{}",
        "no items": json.dumps({}),
    }
    got = [tuple(r) for r in video_comments(landed(spark, pages), NOW).orderBy("profile_url", "pos").collect()]
    assert got == [
        ("good", 0, "Ann", "ab", "2026-06-21 12:00:00"),
        ("good", 1, "Anonymous", "", NOW),
        ("good", 2, "Anonymous", "", NOW),
    ]


def test_video_titles(spark):
    infos = {"a": json.dumps({"items": [{"snippet": {"title": "Film"}}]}), "b": json.dumps({"items": []}), "c": "{"}
    assert dict(video_titles(landed(spark, infos)).collect()) == {"a": "Film", "b": None, "c": None}


def test_one_evaluation_of_each_payload(spark):
    """Nothing moves the parsing into a filter as well."""
    payloads = landed(spark, {"a": "{}"}).filter(F.col("profile_url") != "b")
    plan = video_comments(payloads, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
