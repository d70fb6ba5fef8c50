import json
import random
import sys

import pytest

from modlytics import schemas
from modlytics.functions.payloads import DEEPEST
from modlytics.plans.scan import landed_status, scan
from modlytics.session import scratch_path
from modlytics.sources.deep_threads import parse, read_deep
from modlytics.sources.threads import comments_of_threads, read_all_threads, read_threads

LINK = "https://www.reddit.com/r/x/comments/1/t/"


def node(body, replies="", author="ann", kind="t1", **more):
    return {"kind": kind, "data": {"author": author, "body": body, "created_utc": 1704067200.0, "replies": replies, **more}}


def listing(nodes):
    return {"data": {"children": nodes}}


def thread(nodes, title="Deep"):
    return [listing([{"data": {"title": title}}]), listing(nodes)]


def chain(n, bottom=""):
    """A thread in which every comment answers the one before, as text: too deep for a recursive writer."""
    first = json.dumps(thread([]))
    head = "".join(f'{{"kind":"t1","data":{{"author":"a{i % 3}","body":"reply {i}","created_utc":{1704067200 + i},"replies":{{"data":{{"children":[' for i in range(n))
    return first.replace('"children": []', f'"children": [{head}{bottom}{"]}}}}" * n}]')


def test_a_chain_of_replies_gives_all_rows(spark):
    payloads = [(LINK + str(n), chain(n, json.dumps(node("last"))), None) for n in (3, 150, 250, 5000)]
    payloads += [(LINK + "broken", chain(3000)[:-1], None), (LINK + "more", chain(3000) + "x", None), (LINK + "none", "[]", None), (LINK + "null", None, None)]
    landed = spark.createDataFrame([p[:2] for p in payloads], schemas.LANDED_PAYLOAD)
    read = read_all_threads(landed)
    statuses = {r.profile_url.removeprefix(LINK): r.status for r in read.collect()}
    plain = {r.profile_url.removeprefix(LINK): r.status for r in read_threads(landed).collect()}
    assert statuses == plain | {"250": "ok", "5000": "ok", "broken": "broken", "more": "broken"}
    assert {k for k in plain if plain[k] == "too deep"} == {"250", "5000", "broken", "more"}
    rows = comments_of_threads(read, "now").collect()
    for n in (3, 150, 250, 5000):
        own = sorted((r for r in rows if r.profile_url == f"{LINK}{n}"), key=lambda r: r.pos)
        assert [r.text for r in own] == [f"reply {i}" for i in range(n)] + ["last"]
        assert [r.pos for r in own] == list(range(n + 1)) and own[2].author == "u/a2" and own[1].timestamp == "2024-01-01 00:00:01"
    status = landed_status(landed, landed.limit(0)).collect()
    assert {r.profile_url.removeprefix(LINK): r.status for r in status} == statuses
    creators, comments = scan(landed, landed.limit(0), "2024-02-01 00:00:00", scratch_path(spark, "scan"))
    assert comments.count() == len(rows) and {r.creator_name for r in creators.collect()} == {"Deep"}


def random_thread(chance, depth=0):
    nodes = []
    for _ in range(chance.randrange(4)):
        body = chance.choice(["text", "", "[deleted]", "[removed]", 'q"uo\\te\n', "é😀", None, 12, True])
        replies = chance.choice(["", None, listing(random_thread(chance, depth + 1)) if depth < 4 else "", "x", []])
        made = node(body, replies, chance.choice(["ann", None, "b"]), chance.choice(["t1", "t1", "t1", "more", 1]))
        if chance.random() < 0.2:
            made["data"]["created_utc"] = chance.choice([None, 0, "5", True, "x", 1.5e9])
        if chance.random() < 0.05:
            made = chance.choice([{}, [], None, "t1", {"kind": "t1"}])
        nodes.append(made)
    return nodes


def test_other_threads_are_read_as_by_the_json_reader(spark):
    """Both readers on the same shallow payloads."""
    chance = random.Random(2)
    texts = [json.dumps(thread(random_thread(chance), chance.choice(["T", "", None, 5])), ensure_ascii=chance.random() < 0.5) for _ in range(150)]
    texts += ["", "{}", "[1]", "[1, 2]", '[{}, {"data": {"children": []}}]', '[{}, {"data": {"children": [{"kind": "t1", "kind": "t1"}]}}]', "[1, 2", "nul", "[1,]", '{"a": 1,}', '["\\x"]', "[01]", "[1] 2"]
    landed = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], schemas.LANDED_PAYLOAD)
    for r in read_threads(landed).collect():
        status, title, found = read_deep(texts[int(r.profile_url)])
        assert status == r.status, texts[int(r.profile_url)]
        if status != "broken":
            assert found == [(c.author, c.body, c.created_utc) for c in r.comments] and title == r.title, texts[int(r.profile_url)]


def test_parse_as_the_standard_library():
    chance = random.Random(3)
    for _ in range(300):
        text = json.dumps(thread(random_thread(chance)), indent=chance.choice([None, 1]))
        assert json.dumps(_plain(parse(text))) == json.dumps(_plain(json.loads(text)))
        cut = text[: chance.randrange(len(text))]
        with pytest.raises(ValueError):
            parse(cut)
    deep = "[" * 200_000 + "]" * 200_000
    assert isinstance(parse(deep), list) and 200_000 > max(DEEPEST, sys.getrecursionlimit())


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, bool) or type(value) is str else float(value)
