"""Captures: store, lookups against brute force, listings, blocks, statistics."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import adblock, blocks, collections, fuzzy, integrity, listing, lookup, stats, store

MS = 1_583_209_506_000  # a time in March 2020


@pytest.fixture(scope="module")
def five(spark):
    """Two sites, one URL captured twice, one body stored under two URLs."""
    body = lambda x: x if isinstance(x, bytes) else x.encode()
    rows = [
        (0, "https://one.test/", MS, "p1", b"\1\2\3"), (1, "https://one.test/app.js", MS + 1000, "p1", b"text"), (2, "https://two.one.test/page", MS - 10**9, "p2", b"\0\1\0\1"),
        (3, "https://one.test/", MS + 31_536_000_000, "p3", b"\4\5\6"), (4, "https://one.test/copy", MS + 7_948_800_000, "p2", b"\1\2\3"),
    ]
    data = [(i, u, t, p, bytearray(body(b)), "sha-256:" + hashlib.sha256(b).hexdigest(), 200, "text/html", None) for i, u, t, p, b in rows]
    return spark.createDataFrame(data, "seq long, url string, ts_ms long, page_id string, payload binary, digest string, status int, mime string, location string")


def test_new_digests_and_reference_counts(five):
    assert [x.is_new for x in store.first_of_digest(five, "seq").orderBy("seq").collect()] == [True, True, True, True, False]
    refs = store.digest_refs(five, F.length("payload"))
    by = {x.digest: x.refs for x in refs.collect()}
    rows = five.orderBy("seq").collect()
    assert [by[x.digest] for x in rows] == [2, 1, 1, 1, 2]
    spark = five.sparkSession
    left, now, freed = store.delete_pages(five, refs, spark.createDataFrame([("p1",)], "page_id string"))
    by = {x.digest: x.refs for x in now.collect()}
    assert [by.get(x.digest) for x in rows] == [1, None, 1, 1, 1]
    assert freed.first().freed == 4 and left.count() == 3
    left, now, _ = store.delete_pages(left, now, spark.createDataFrame([("p2",), ("p3",)], "page_id string"))
    assert left.count() == now.count() == 0


def test_lookup_prefers_forward_and_falls_back(five):
    ask = five.sparkSession.createDataFrame(
        [(0, "https://one.test/", 1_400_000_000_000), (1, "https://one.test/", MS + 1000), (2, "https://one.test/", 1_900_000_000_000), (3, "https://one.test/", None), (4, "https://none.test/", MS), (5, "https://one.test/", 0)],
        "req_id int, url string, ts_ms long",
    )
    got = {x.req_id: x.hit and x.hit.seq for x in lookup.lookup(ask, five, ["seq", "digest"]).collect()}
    assert got == {0: 0, 1: 3, 2: 3, 3: 3, 4: None, 5: 3}


def _skipped(c, skip5xx=False):
    to = c["location"] or c["url"]
    return (skip5xx and c["status"] >= 500) or (300 <= c["status"] < 400 and to == c["url"])


def _brute(caps, req, o):
    mine = sorted((c for c in caps if c["url"] == req["url"]), key=lambda c: c["ts_ms"])
    drop = lambda c: _skipped(c, o.skip5xx) or (o.no_revisits and c["mime"] == "warc/revisit") or (o.page_id is not None and c["page_id"] not in (None, o.page_id))
    t = req["ts_ms"]
    bound = float("inf")
    if t:
        ahead = [c for c in mine if c["ts_ms"] >= t]
        bound = t
        if o.filtered:
            for c in ahead[:16]:
                if not drop(c):
                    return c["seq"]
        elif ahead:
            if not _skipped(ahead[0], o.skip5xx):
                return ahead[0]["seq"]
            bound = t + 10_000
    for c in reversed([c for c in mine if c["ts_ms"] <= bound]):
        if not drop(c):
            return c["seq"]
    return None


@pytest.mark.parametrize("options", [lookup.Options(), lookup.Options(skip5xx=True), lookup.Options(no_revisits=True), lookup.Options(page_id="p1", bucket_ms=500), lookup.Options(no_revisits=True, skip5xx=True, bucket_ms=3000)])
def test_lookup_against_brute_force(spark, options):
    r = random.Random(5)
    caps, seen = [], set()
    for i in range(500):
        u = f"https://s.test/{r.choice(['hot', 'hot', 'b', 'c'])}"
        t = r.randrange(1, 60_000)
        if (u, t) in seen:
            continue
        seen.add((u, t))
        status = r.choice([200, 200, 302, 304, 404, 503])
        to = r.choice([None, u, u + "/x", "/" + u.split("/")[-1]]) if status == 302 else None
        caps.append({"seq": i, "url": u, "ts_ms": t, "status": status, "mime": r.choice(["text/html", "warc/revisit", None]), "page_id": r.choice(["p1", "p2", None]), "location": to})
    full = [{**c, "location": c["url"] if c["location"] and c["location"].startswith("/") else c["location"]} for c in caps]
    reqs = [{"req_id": i, "url": f"https://s.test/{r.choice(['hot', 'b', 'c', 'd'])}", "ts_ms": r.choice([None, 0, r.randrange(1, 70_000)])} for i in range(200)]
    cdf = spark.createDataFrame([tuple(c.values()) for c in caps], "seq long, url string, ts_ms long, status int, mime string, page_id string, location string")
    rdf = spark.createDataFrame([tuple(q.values()) for q in reqs], "req_id long, url string, ts_ms long")
    got = {x.req_id: x.hit and x.hit.seq for x in lookup.lookup(rdf, cdf, ["seq"], options).collect()}
    assert got == {q["req_id"]: _brute(full, q, options) for q in reqs}


def test_lookup_plan_has_no_nested_loop(five):
    ask = five.select(F.col("seq").alias("req_id"), "url", "ts_ms")
    plan = lookup.lookup(ask, five, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("options", [lookup.Options(), lookup.Options(no_revisits=True)])
def test_lookup_shuffles_rows_once(five, options):
    ask = five.select(F.col("seq").alias("req_id"), "url", "ts_ms")
    plan = lookup.lookup(ask, five, ["seq"], options)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("options", [lookup.Options(bucket_ms=900), lookup.Options(no_revisits=True, skip5xx=True, bucket_ms=3000)])
def test_hot_urls_are_cut_into_buckets(spark, monkeypatch, options):
    monkeypatch.setattr(lookup, "HOT_ROWS", 150)  # some URLs are hot
    test_lookup_against_brute_force(spark, options)
    r = random.Random(8)
    caps = spark.createDataFrame([(i, r.choice(["a", "a", "a", "b", None]), r.randrange(900)) for i in range(400)], "event_id long, url string, ts_ms long").dropDuplicates(["url", "ts_ms"]).localCheckpoint()
    ask = spark.createDataFrame([(i, r.choice(["a", "a", "b", "c", None]), r.randrange(900)) for i in range(300)], "req_id long, url string, ts_ms long")
    found = lambda: sorted((x.req_id, x.hit and x.hit.event_id) for x in lookup.nearest(ask, caps, ["event_id"], bucket_ms=70).collect())
    hot = found()
    assert all(e is None for i, e in hot if ask.collect()[i].url is None) and len(hot) == 300
    monkeypatch.setattr(lookup, "HOT_ROWS", 10**9)
    assert found() == hot


def test_priority_dedup_and_upsert(spark):
    kind = "url string, ts_ms long, seq long, mime string, status int"
    a = spark.createDataFrame([("u", 1, 1, "warc/revisit", 200), ("u", 1, 2, "text/html", 404), ("u", 2, 3, "text/html", None), ("v", None, 9, "text/html", 200)], kind)
    b = spark.createDataFrame([("u", 1, 1, "text/html", 200), ("u", 2, 1, "warc/revisit", None), ("u", 2, 0, "text/html", 200)], kind)
    once = store.upsert(a.where("ts_ms is not null"), b)
    assert {(x.url, x.ts_ms, x.mime, x.status) for x in once.collect()} == {("u", 1, "text/html", 200), ("u", 2, "text/html", 200)}
    assert store.priority_dedup(once).count() == store.priority_dedup(store.priority_dedup(once)).count() == 2
    assert store.without_seen_revisits(b, a).where("mime = 'warc/revisit'").count() == 0


def test_pages_lists_and_twins(spark):
    pages = spark.createDataFrame([(None, "https://s.test/", None, None, "2020-01-02T00:00:00Z", 0), ("x", "https://s.test/b", "B", 5, None, 16)], "id string, url string, title string, ts_ms long, date string, state int")
    got = {x.url: x for x in store.normalize_pages(pages).collect()}
    assert got["https://s.test/"].title == "https://s.test/" and got["https://s.test/"].ts_ms == 1577923200000 and got["https://s.test/"].state == 0x11
    assert got["https://s.test/b"].state == 16 and len(got["https://s.test/"].id) == 24
    lists = spark.createDataFrame([(1, "L", True, ["c", "a"]), (2, "M", False, ["z"])], "id long, title string, show boolean, pages array<string>")
    rows = store.curated_rows(lists)
    assert [(x.list, x.pos, x.page) for x in rows.orderBy("pos").collect()] == [(1, 0, "c"), (1, 1, "a")]
    out = {x.id: x.pages and [p.page for p in x.pages] for x in store.assemble_lists(lists.drop("pages"), rows, ["page"]).collect()}
    assert out == {1: ["c", "a"], 2: None}


def test_pairing_is_greedy(spark):
    kinds = ["req", "resp", "resp", "req", "req", "resp", "req", None, "resp"]
    df = spark.createDataFrame([("f", i, k) for i, k in enumerate(kinds)], "f string, i int, k string")
    out = store.pair_adjacent(df, "f", "i", F.col("k") == "req", F.col("k") == "resp")
    groups: dict = {}
    for x in out.orderBy("i").collect():
        groups.setdefault((x._run, x.pair), []).append(x.i)
    assert sorted(groups.values()) == [[0, 1], [2, 3], [4, 5], [6], [7], [8]]


def test_schemes_origins_payloads(spark, five):
    ask = spark.createDataFrame([(0, "//one.test/"), (1, "http://one.test/app.js"), (2, "http://none.test/")], "req_id long, url string").withColumn("ts_ms", F.lit(MS))
    got = {x.req_id: (x.url, x.hit and x.hit.seq) for x in lookup.with_scheme_fallback(ask, five, ["seq"], "req_id").collect()}
    assert got == {0: ("https://one.test/", 0), 1: ("https://one.test/app.js", 1), 2: (None, None)}
    moved = five.withColumns({"orig_url": F.when(F.col("seq") == 4, "https://one.test/"), "orig_ts_ms": F.lit(None).cast("long")})
    ask = spark.createDataFrame([(0, "https://one.test/copy", MS)], "req_id long, url string, ts_ms long")
    cols = ["seq", "orig_url", "orig_ts_ms"]
    found = lookup.follow_origin(lookup.lookup(ask, moved, cols), moved, cols, "req_id").first()
    assert found.hit.seq == 0
    bodies = five.select("digest", "payload").dropDuplicates(["digest"])
    asked = spark.createDataFrame([("a", lookup.EMPTY_DIGESTS[0], 200), ("b", "none", 200), ("c", None, 304), ("d", five.first().digest, 200)], "k string, digest string, status int")
    got = {x.k: x.payload for x in lookup.with_payload(asked, bodies).collect()}
    assert set(got) == {"a", "c", "d"} and bytes(got["a"]) == b"" and bytes(got["d"]) == b"\1\2\3"


def test_nearest_and_revisits(spark):
    caps = spark.createDataFrame([(1, "u", 10, 200, "text/html", None), (2, "u", 20, 200, "warc/revisit", None), (3, "u", 30, 200, "text/html", None)], "event_id long, url string, ts_ms long, status int, mime string, location string")
    ask = spark.createDataFrame([(0, "u", 15), (1, "u", 16), (2, "u", 99), (3, "v", 1)], "req_id long, url string, ts_ms long")
    assert {x.req_id: x.hit and x.hit.event_id for x in lookup.nearest(ask, caps, ["event_id"]).collect()} == {0: 1, 1: 2, 2: 3, 3: None}
    c = caps.withColumns({"orig_url": F.lit(None).cast("string"), "orig_ts_ms": F.lit(None).cast("long"), "page_id": F.lit(None).cast("string")})
    assert [(x.event_id, x.hit.event_id) for x in lookup.resolve_revisits(c, ["event_id"]).collect()] == [(2, 3)]


def test_listing(spark, five):
    assert listing.host(five, "https://one.test").count() == 4
    first = [x.seq for x in listing.url_page(five, five, "", 2).collect()]
    last = listing.url_page(five, five, "", 2).collect()[-1]
    then = [x.seq for x in listing.url_page(five, five, "", 10, last.url, last.ts_ms).collect()]
    assert sorted(first + then) == [0, 1, 2, 3, 4]
    keys = spark.createDataFrame([("https://one.test/a",), ("https://two",)], "k string")
    assert sorted(x.seq for x in listing.match_any(five, "url", keys, as_prefix=True).collect()) == [1, 2]
    assert listing.match_any(five, "url", keys.limit(0), as_prefix=True).count() == 0
    pages = spark.createDataFrame([(str(i), f"https://s.test/{i}", "Even" if i % 2 == 0 else "odd", i) for i in range(9)], "id string, url string, title string, ts_ms long")
    assert [x.id for x in listing.pages_matching(pages, "EVEN", 2, 2).collect()] == ["4", "6"]


def test_blocks_hold_every_match(spark):
    keys = sorted(f"test,s{i:03d})/" for i in range(60))
    heads = keys[::7]
    idx = spark.createDataFrame([("w", k) for k in heads], "archive string, prefix string")
    ask = spark.createDataFrame([(i, "w", k) for i, k in enumerate(keys)], "req_id long, archive string, key string")
    got = {(x.req_id, x.prefix) for x in blocks.candidate_blocks(idx, ask, F.col("key")).collect()}
    for i, k in enumerate(keys):
        own = [h for h in heads if h <= k][-1]
        assert (i, own) in got
        assert len([g for g in got if g[0] == i]) <= 2


def test_statistics(spark):
    hits = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "client string, ts_ms long")
    clients = spark.createDataFrame([("a", "pa", None), ("b", "pb", "pa")], "client string, page_url string, referrer string")
    out = stats.roll_up(stats.with_parents(stats.client_stats(hits), clients)).collect()
    assert [(x.root, x.n, x.first_ms, x.last_ms, x.children) for x in out] == [("a", 3, 1, 9, 1)]
    v = stats.verify(spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "id string, expected string"), spark.createDataFrame([("x", "1"), ("y", "9")], "id string, actual string"))
    assert stats.verification_summary(v).first().asDict() == {"n_valid": 1, "n_invalid": 1, "n_unchecked": 1}
    chain = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "url string, referrer string")
    assert {x.url: x.top for x in stats.referrer_top(chain).collect()} == {"c": "a", "b": "a", "a": "a"}


def test_nearest_blocks_without_their_pairs(spark):
    r = random.Random(5)
    idx = spark.createDataFrame([(r.choice("vw"), f"test,s{i:03d})/", r.choice([None, r.randrange(40)])) for i in range(150)], "archive string, prefix string, at long")
    ask = [(i, r.choice("vw"), r.choice(["test,s0", "test,s1", "test,s02", "no"]), r.choice([None, *range(-5, 50)])) for i in range(200)]
    ask += [(900, "v", "test,s0", 3), (900, "w", "test,s", 3)]  # a request of several archives
    ask = spark.createDataFrame(ask, "req_id long, archive string, key string, ts_ms long")
    for limit in (1, 3, 7):
        want = blocks.nearest_blocks(blocks.candidate_blocks(idx, ask, F.col("key"), as_prefix=True), F.col("at"), limit)
        got = blocks.nearest_candidates(idx, ask, F.col("at"), F.col("key"), True, limit)
        plain = lambda rows: sorted(map(repr, rows.select("req_id", "archive", "key", "ts_ms", "prefix", "at", "rank").collect()))
        assert plain(got) == plain(want)
    # 20,000 requests of one range of 20,000 blocks: no 400 million pairs
    many = spark.range(20_000).selectExpr("'w' as archive", "concat('test,s', lpad(id, 5, '0')) as prefix", "id * 10 as at")
    hot = spark.range(20_000).selectExpr("id as req_id", "'w' as archive", "'test' as key", "id * 10 as ts_ms")
    got = blocks.nearest_candidates(many, hot, F.col("at"), F.col("key"), True)
    assert got.count() == 140_000
    assert got.where("ts_ms between 30 and 199960").agg(F.max(F.expr("abs(at - ts_ms)"))).first()[0] == 30


def test_adblock(spark):
    texts = spark.createDataFrame([("! c\ns.test,t.test##.ad\r\n##.all x.s.test#@#.ad\nplain",)], "text string")
    rules = adblock.parse_rules(adblock.lines_of(texts))
    hosts = spark.createDataFrame([("s.test",), ("x.s.test",), ("o.test",)], "host string")
    css = {x.host: x.css for x in adblock.css_for(hosts, rules).collect()}
    assert css["s.test"].startswith(".ad {") and css["x.s.test"].startswith(".all {") and css["o.test"].startswith(".all {")


def test_collections(spark):
    c = spark.createDataFrame([("a", "archive", 1, 2, {"k": "v"}), ("l", "live", 0, 0, None)], "name string, type string, size long, total_size long, metadata map<string,string>").withColumn("headers", F.lit(None).cast("map<string,string>"))
    assert [x.name for x in collections.listed(c).collect()] == ["a"]
    assert collections.create(c, c).count() == 2 and collections.delete(c, ["a"]).count() == 1
    assert collections.merge_metadata(c, "a", {"k": "w", "n": "1"}).where("name = 'a'").first().metadata == {"k": "w", "n": "1"}
    grown = collections.add_sizes(c, spark.createDataFrame([("a", 10, 3)], "name string, full long, dedup long")).where("name = 'a'").first()
    assert (grown["size"], grown.total_size) == (4, 12)
    assert collections.update_auth(c, "a", {"h": "1"}).where("name = 'a'").first().headers == {"h": "1"}


def test_fuzzy_lookup(spark):
    caps = spark.createDataFrame([("https://s.test/q?a=1&b=2", 200, 1), ("https://s.test/q?a=1&b=9", 200, 2), ("https://s.test/lib.js", 200, 3), ("https://s.test/lib.js", 200, 4)], "url string, status int, ts_ms long")
    ask = spark.createDataFrame([(0, "https://s.test/q?a=1&b=2&c=3"), (1, "https://s.test/other"), (2, "https://s.test/lib.js?v=5")], "req_id long, url string")
    got = {x.req_id: x.hit_url for x in fuzzy.best_matches(ask, caps).collect()}
    assert got[0] == "https://s.test/q?a=1&b=2" and 1 not in got and got[2] == "https://s.test/lib.js"


def test_fuzzy_lookup_by_each_rule(spark):
    from palimpsest.functions.fuzzy_match import RULES, rule_for

    pairs = [
        ("https://r1.googlevideo.com/videoplayback?id=1&itag=2&x=%s", "3", "4"),
        ("https://www.youtube.com/get_video_info?video_id=a&t=%s", "1", "2"),
        ("https://www.washingtonpost.com/wp-apps/imrs.php?src=u&w=%s", "1", "2"),
        ("https://static.news.test/resizer/%s/img/a.jpg", "AA/100x200", "BB/300x400"),
        ("https://lh3.googleusercontent.com/p/pic%s", "=s64-c", "=s128"),
        ("https://www.youtube.com/embed/x?a=%s", "1", "2"),
        ("https://www.youtube.com/channel/c?view=%s", "1", "2"),
        ("https://www.youtube.com/@name?view=%s", "1", "2"),
        ("https://a-vod.akamaized.net/exp=%s/12/34.mp4", "1~x", "2~y"),
        ("https://player.vimeo.com/video/77?h=%s", "1", "2"),
        ("https://static.wixstatic.com/media/p.png/v1/fill/w_%s/p.png", "10,h_10", "20,h_20"),
        ("https://pbs.twimg.com/profile_images/1/face_%s.jpg", "normal", "400x400"),
        ("https://www.youtube.com/youtubei/v1/player?videoId=v&k=%s", "1", "2"),
        ("https://cdn.test/videoplayback?id=1&itag=2&x=%s", "1", "2"),
        ("https://www.facebook.com/ajax/pagelet/generic.php/photoviewerinitpagelet?data=1&_x=%s", "1", "2"),
        ("https://twitter.com/u/status/1?s=%s", "20", "21"),
        ("https://api.test/graphql?q=2&cursor=%s", "1", "2"),
        ("https://www.facebook.com/ajax/bulk-route-definitions?route_urls[0]=/a&_n=%s", "1", "2"),
        ("https://s.test/q?a=1&_=%s", "123", "456"),
        ("https://s.test/lib.js?v=%s", "1", "2"),
    ]
    assert {rule_for(u.replace("%s", a))[0] for u, a, _ in pairs} == set(RULES)
    ask = spark.createDataFrame([(i, u.replace("%s", a)) for i, (u, a, _) in enumerate(pairs)], "req_id long, url string")
    caps = spark.createDataFrame([(u.replace("%s", b), 200, i) for i, (u, _, b) in enumerate(pairs)], "url string, status int, ts_ms long")
    got = {x.req_id: x.hit_url for x in fuzzy.best_matches(ask, caps).collect()}
    assert got == {i: u.replace("%s", b) for i, (u, _, b) in enumerate(pairs)}


def test_integrity(spark):
    import json

    text = b"manifest"
    good = "sha256:" + hashlib.sha256(text).hexdigest()
    assert integrity.digest_record(json.dumps({"hash": good, "signedData": {"hash": "no", "signature": "s"}}), text) == [("datapackageHash", good, True), ("signature", "s", None), ("signedHash", "no", False)]
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, payload binary")
    res = spark.createDataFrame([("a", "sha256:" + hashlib.sha256(b"x").hexdigest()), ("b", "sha256:0"), ("c", "sha256:1")], "path string, hash string")
    assert {x.id: x.matched for x in integrity.check_manifest(res, files).collect()} == {"a": True, "b": False, "c": None}
