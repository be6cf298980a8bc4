"""Scalar functions: times, URLs, fuzzy rules, rewriting, text."""

from __future__ import annotations

import gzip
import json
import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import fuzzy_match as Z
from palimpsest.functions import predicates as P
from palimpsest.functions import text as X
from palimpsest.functions import timestamps as D
from palimpsest.functions import urls as U
from palimpsest.functions.rewrite import headers as H
from palimpsest.functions.rewrite import text as R
from palimpsest.functions.rewrite import video as V
from palimpsest.functions.rewrite.html import rewrite_html, rewrite_srcset
from palimpsest.functions.rewrite.js import declared, rewrite_js

PRE = "https://arc.test/c/2021mp_/"
BASE = "https://site.test/dir/page.html"


def _one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_times(spark):
    r = _one(
        spark, a=D.ts_to_ms(F.lit("2020")), b=D.ts_to_ms(F.lit("20200315")), c=D.ts_to_ms(F.lit("20200315123456789")), d=D.ts_to_ms(F.lit("")), e=D.ts_to_ms(F.lit("20x0")),
        f=D.iso_to_ts14(F.lit("2020-03-15T12:34:56.789Z")), g=D.iso_to_ts17(F.lit("2020-03-15T12:34:56.789Z")), h=D.ms_to_ts14(F.lit(1584275696789)),
        i=D.page_ts(F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit("2020-03-15T00:00:00Z")), j=D.ms_to_seconds(F.lit(-1)),
    )
    assert (r.a, r.b, r.c, r.d, r.e) == (1577836800000, 1584230400000, 1584275696789, None, None)
    assert (r.f, r.g, r.h, r.i, r.j) == ("20200315123456", "20200315123456789", "20200315123456", 1584230400000, -1)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("next.html", "next.html"), ("/a/b.css", "/c/2021mp_/https://site.test/a/b.css"), ("../up.png", PRE + "https://site.test/up.png"),
        ("http://else.test/x", PRE + "http://else.test/x"), ("//cdn.test/y", "//arc.test/c/2021mp_///cdn.test/y"), ("#frag", "#frag"),
        ("mailto:me@site.test", "mailto:me@site.test"), (PRE + "http://done.test/", PRE + "http://done.test/"), ("/c/2021mp_/http://done.test/", "/c/2021mp_/http://done.test/"),
        ("", ""), ("data:text/plain,hi", "data:text/plain,hi"), ("http:\\/\\/esc.test", PRE + "http:\\/\\/esc.test"), ("\\path\\q.gif", "/c/2021mp_/https://site.test/path/q.gif"),
    ],
)
def test_rewrite_url(url, want):
    assert U.rewrite_url(url, PRE, BASE) == want
    if not want.startswith("//"):
        assert U.rewrite_url(want, PRE, BASE) == want


def test_url_columns(spark):
    r = _one(
        spark, surt=U.surt(F.lit("https://www.Sub.Site.test/Path?Q=1#x")), root=U.surt(F.lit("http://site.test")), yes=U.is_surt(F.lit("test,site)/p")), no=U.is_surt(F.lit("http://site.test/")),
        lev=U.lev_score(F.lit("kitten"), F.lit("sitting")), dom=U.domain_suffixes(F.lit("www.a.b.site.test")), cookie=U.cookies(F.lit("a=b; Expires=Wed, 1 Jan; HttpOnly; Secure; Path=/"), F.lit(False)),
        name=U.attachment_name(F.lit("https://site.test/d/my file.txt?x=1")), swap=U.tld_swap(F.lit("https://my.site.test/x"), "test", "example"), up=U.upgrade_scheme(F.lit("http://a/")), text=U.status_text(F.lit(404)),
        conv=U.rewrite_links(F.lit("/k"), PRE, F.lit("https://site.test")),
    )
    assert (r.surt, r.root, r.yes, r.no, r.lev) == ("test,site,sub)/path?q=1", "test,site)/", True, False, 3)
    assert r.dom == ["a.b.site.test", "b.site.test", "site.test"]
    assert r.cookie == "a=b; Path=/"
    assert r.name.endswith("''my%20file.txt")
    assert (r.swap, r.up, r.text) == ("https://my.site.example/x", "https://a/", "Not Found")
    assert r.conv == U.rewrite_url("/k", PRE, BASE)
    assert U.canonical_redirect("https://Site.test:443/a") == "https://site.test/a"
    assert U.canonical_redirect("https://site.test/a") is None
    assert U.prefix_upper_bound("abc") == "abd"
    p = _one(spark, **U.parse_replay(F.lit(":pg/20200101mp_/https://site.test/a#b")))
    assert (p.page_id, p.ts, p.modifier, p.url, p.fragment) == ("pg", "20200101", "mp_", "https://site.test/a", "#b")


def test_post_bodies_as_queries():
    assert U.post_query("https://s.test/a", "x=1&y=2").endswith("&x=1&y=2")
    assert U.post_query("https://s.test/a?z=0", '{"k": {"m": [1, "two"]}}', "application/json").endswith("&m=1&m.2_=two")
    assert len(U.truncate_query("https://s.test/?" + "k" * 900 + "=" + "v" * 5000)) == len("https://s.test/?") + 512 + 1 + 1024


def test_predicates(spark):
    page = lambda u, s=200, m="text/html": P.is_page(F.lit(u), F.lit(s), F.lit(m))
    r = _one(
        spark, a=page("https://s.test/a"), b=page("https://s.test/robots.txt"), c=page("https://s.test/a", 404), d=page("https://s.test/a", 200, "image/png"), e=page("https://s.test/?" + "q" * 40), f=page("https://s.test/.env"),
        g=P.same_url(F.lit("https://s.test/a%20b+c"), F.lit("https://s.test/a b+c"), F.lit("GET")), h=P.time_agrees(F.lit(1999), F.lit(1000)), i=P.digest_agrees(F.lit("sha1:X"), F.lit("sha-1:X")),
        j=P.strip_range_query(F.lit("https://s.test/v?id=1&range=0-99&x=2")), k=P.has_range_query(F.lit("https://s.test/v?range=0-99")), m=P.full_range(F.lit("bytes 0-9/10"), F.lit("10")), n=P.mime_in(F.lit(None).cast("string"), ""),
        o=P.mime_in(F.lit("text/css"), "image/,text/"), p=P.starts_with_any(F.lit("abc"), ["x", "ab"]), q=P.contains_any(F.lit("abc"), ["z"]),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (True, False, False, False, False, False)
    assert (r.g, r.h, r.i, r.k, r.m, r.n, r.o, r.p, r.q) == (True, True, True, True, True, True, True, True, False)
    assert r.j == "https://s.test/v?id=1&x=2"


def test_similarity_by_hand():
    full = Z.similarity([("a", "b")], [("_", "123"), ("__foo", "789"), ("__bar", "abc"), ("a", "b")])
    assert full == pytest.approx(16 / 11)
    other = Z.similarity([("_", "1"), ("__x", "2"), ("a", "b")], [("a", "b")])
    assert other == pytest.approx(16 / 11.2)
    assert Z.similarity([("k", "1")], [("k", "2")], required=("k",)) == -1000
    assert Z.similarity([("n", "5")], [("n", "9")]) == pytest.approx((1 + 5 + 10 - math.log(5)) / 11)
    nested = Z.similarity([("j", '{"u": "v"}')], [("j", '{"u": "v" }')])
    assert nested == pytest.approx((1 + 5 + 20 * Z.similarity([("u", "v")], [("u", "v")])) / 11)


def test_best_match_and_rules():
    c = lambda *urls: [Z.Candidate(u) for u in urls]
    assert Z.best_match("https://s.test/?w=one,two", c("https://s.test/?w=xyz", "https://s.test/?w=one,twx"))[0].url == "https://s.test/?w=one,twx"
    assert Z.best_match("https://s.test/?w=1", [Z.Candidate("https://s.test/?w=1", 304), Z.Candidate("https://s.test/?w=2", 404)])[0].status == 404
    assert Z.best_match("https://s.test/?w=1", []) is None
    rule, prefix, canon = Z.rule_for("https://s.test/lib.js?v=77")
    assert (prefix, canon, rule.max_results) == ("https://s.test/lib.js?", "https://s.test/lib.js", 2)
    assert Z.rule_for("https://s.test/q?_=99")[2] == "https://s.test/q?"
    assert Z.rule_for("https://s.test/" + "x" * 5000 + "?_=99")[0] is None
    assert Z.canons_with_args("https://r9.googlevideo.com/videoplayback?z=1&itag=7&id=abc") == [f"https://{Z.CANONICAL_HOST}/videoplayback?id=abc&itag=7", f"https://{Z.CANONICAL_HOST}/videoplayback?id=abc"]


def test_styles_json_and_maps():
    assert R.rewrite_css("a{background:url('/i.png')} @import \"http://o.test/s.css\";", PRE, BASE) == "a{background:url('/c/2021mp_/https://site.test/i.png')} @import \"" + PRE + 'http://o.test/s.css";'
    assert R.rewrite_css("b{src:url(data:font/woff;base64,AA)}", PRE, BASE) == "b{src:url(data:font/woff;base64,AA)}"
    assert R.rewrite_jsonp_text('old({"a": 1});', "https://s.test/x?callback=fresh") == 'fresh({"a": 1});'
    assert R.rewrite_jsonp_text('old({"a": 1});', "https://s.test/x?callback=?") == 'old({"a": 1});'
    assert R.rewrite_jsonp_text('{"a": 1}', "https://s.test/x?callback=fresh") == '{"a": 1}'
    assert json.loads(R.rewrite_importmap('{"imports": {"m": "https://o.test/m.js"}}', PRE, BASE))["imports"]["m"] == PRE + "https://o.test/m.js"
    rows = [{"bitrate": b, "content_type": t, "url": u} for b, t, u in ((900, "video/mp4", "low"), (4000, "video/mp4", "best"), (9000, "video/mp4", "big"), (1, "application/x", "no"))]
    assert json.loads("{" + R.best_variant_json('"variants":' + json.dumps(rows), 5000) + "}")["variants"] == [rows[1]]


def test_jsonp_column(spark):
    r = _one(spark, a=R.rewrite_jsonp(F.lit('/* c */ old({"a": 1});'), F.lit("https://s.test/x?jsonp=n.w")), b=R.rewrite_jsonp(F.lit("no json"), F.lit("https://s.test/x?jsonp=n")))
    assert (r.a, r.b) == ('n.w({"a": 1});', "no json")


def test_headers():
    got = H.rewrite_headers({"ETag": "1", "Location": "/go", "Content-Type": "text/html", "Access-Control-Allow-Origin": "*", "Link": "</s.js>; rel=preload, </t>; rel=next"}, PRE, BASE)
    assert got["x-archive-orig-etag"] == "1" and got["x-archive-orig-access-control-allow-origin"] == "*" and got["content-type"] == "text/html"
    assert got["location"] == "/c/2021mp_/https://site.test/go"
    assert got["link"] == "</c/2021mp_/https://site.test/s.js>; rel=preload, </c/2021mp_/https://site.test/t>; rel=next"
    assert H.rewrite_link("</s.js>; rel=preload, </t>; rel=next", PRE, BASE, preload_only=True).endswith("</t>; rel=next")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<P><A Href="to.html">T</a></P>', '<P><A Href="to.html">T</a></P>'),
        ('<a href="https://o.test/">x</a>', f'<a href="{PRE}https://o.test/">x</a>'),
        ('<IMG Src="../i.gif"/>', '<img src="https://arc.test/c/2021im_/https://site.test/i.gif"/>'),
        ('<table background="/bg.png">', '<table background="/c/2021mp_/https://site.test/bg.png">'),
        ("<meta content='5; url=/n' http-equiv=refresh>", '<meta content="5; url=/c/2021mp_/https://site.test/n" http-equiv="refresh">'),
        ("<meta content=origin name=referrer>", '<meta content="no-referrer-when-downgrade" name="referrer">'),
        ("<meta content=x http-equiv=content-security-policy>", '<meta _content="x" http-equiv="content-security-policy">'),
        ('<base href="http://o.test">', f'<base href="{PRE}http://o.test/">'),
        ('<a href="#top">t</a>&amp; &nbsp;', '<a href="#top">t</a>&amp; &nbsp;'),
        ('<a href="http&#x3a;//o.test/p">', f'<a href="{PRE}http://o.test/p">'),
        ('<style>i{background:url(/b.gif)}</style>', '<style>i{background:url(/c/2021mp_/https://site.test/b.gif)}</style>'),
        ("<script type=lua>print(top)</script>", "<script type=lua>print(top)</script>"),
        ('<script>var q = "</p>";</script><p>', '<script>var q = "</p>";</script><p>'),
        ("<!-- <a href='http://o.test/'> -->", "<!-- <a href='http://o.test/'> -->"),
        ('<link rel="stylesheet" href="http://o.test/s.css">', '<link rel="stylesheet" href="https://arc.test/c/2021cs_/http://o.test/s.css">'),
        ('<script src="lib.js"></script>', f'<script src="{PRE}https://site.test/dir/lib.js" data-orig-src="lib.js"></script>'),
    ],
)
def test_html(html, want):
    assert rewrite_html(html, PRE, BASE) == want


def test_srcset():
    fix = lambda u: f"<{u}>"
    assert rewrite_srcset("/a,b 2x, http://o.test/c,d", fix) == "</a,b> 2x, <http://o.test/c,d>"
    assert rewrite_srcset("http://o.test/1 2w,http://o.test/2 4w", fix) == "<http://o.test/1> 2w, <http://o.test/2> 4w"
    assert rewrite_srcset("", fix) == ""


def test_scripts():
    assert rewrite_js("var x = 1 + y;") == "var x = 1 + y;"
    out = rewrite_js("window.location = '/a'")
    assert out.startswith("var __replay_get") and 'let window = __replay_get("window");' in out
    assert declared("let top = 1; function f() { let self = 2; }") == {"top"}
    assert 'let top = __replay_get("top");' not in rewrite_js("let top = window;")
    assert rewrite_js('import a from "./m.js";\nwindow.x = a;', PRE, BASE).endswith('import a from "https://arc.test/c/2021esm_/https://site.test/dir/m.js";\nwindow.x = a;')
    assert "__replay_eval" in rewrite_js("eval('1')")
    assert rewrite_js("'use strict'; window.a = 1").startswith("'use strict';")


def test_hls():
    text = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=500,RESOLUTION=320x200\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=640x480\nmid.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=9000,RESOLUTION=1920x1080\nbig.m3u8\n"
    assert [v["uri"] for v in V.hls_variants(text)] == ["low.m3u8", "mid.m3u8", "big.m3u8"]
    assert V.rewrite_hls(text).split("\n")[1:] == ["#EXT-X-STREAM-INF:BANDWIDTH=900,RESOLUTION=640x480", "mid.m3u8"]
    assert "low.m3u8" in V.rewrite_hls(text, {"max_pixels": 10})
    assert "big.m3u8" in V.rewrite_hls(text, {"max_bandwidth": 10_000}, by_bandwidth=True)


def test_dash():
    text = '<MPD><Period><AdaptationSet mimeType="video/mp4"><Representation id="a" bandwidth="100" width="100" height="100"/><Representation id="b" bandwidth="200" width="600" height="400"/><Representation id="c" bandwidth="9000000" width="4000" height="3000"/></AdaptationSet></Period></MPD>'
    assert [r["rep_id"] for r in V.dash_representations(text)] == ["a", "b", "c"]
    ids: list[str] = []
    out = V.rewrite_dash(text, best_ids=ids)
    assert ids == ["b"] and 'id="b"' in out and 'id="c"' not in out
    assert V.rewrite_dash("not xml") == "not xml"


def test_text_and_encodings(spark):
    assert X.extract_text("<title>T</title><script>no</script><p> one <b>two</b></p><footer>x</footer>&amp;") == "T one two &amp;"
    assert X.extract_text("<header><style>x</style>seen</header>") == "seen"
    assert X.extract_text(None) is None
    # references without an end, or of nothing, stay as written
    assert X.extract_text("<p>a&am; b&am c&#65 d&#; e</p><i>f</i> g&am") == "a&am; b&am c&#65 d&#; e f g&am"
    assert X.decode_body(gzip.compress(b"abc"), "gzip", None) == b"abc"
    assert X.decode_body(b"abc", "gzip", None) == b"abc"
    assert X.decode_body(b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", None, "chunked") == b"abcde"
    r = _one(spark, **{k: c for k, c in X.byte_range(F.lit(b"0123456789"), F.lit("bytes=2-4")).items()})
    assert (r.status, r.content_range, bytes(r.body)) == (206, "bytes 2-4/10", b"234")
    r = _one(spark, **X.byte_range(F.lit(b"0123456789"), F.lit("bytes=50-")))
    assert (r.status, r.content_range, r.body) == (416, "bytes */10", None)
    r = _one(spark, a=X.charset(F.lit('<meta charset="ISO-8859-1">')), b=X.decode_text(F.lit("é".encode("latin-1")), F.lit("latin1")), c=X.decode_text(F.lit(b"\xff\xfea\x00"), F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == ("iso-8859-1", "é", "a")


def test_top_level_names_outlive_the_wrapper():
    from palimpsest.functions.rewrite.js import top_names

    script = "let a = 1, b = {c: 2};\nconst d = () => { let inner = 3; }\nconst {e} = d; let top = 4; window.x = `${a}`"
    assert [(k, n) for k, n, _ in top_names(script)] == [("let", "a"), ("let", "b"), ("const", "d"), ("let", "top")]
    out = rewrite_js(script)
    assert out.startswith("let a;\nlet b;\n") and "\n a = 1, b = {c: 2};" in out and "let top = 4" in out
    assert out.endswith("const d = self.__replay_const_d; delete self.__replay_const_d;\n") and "self.__replay_const_d = d;" in out


def test_failing_reads_are_repeated():
    from palimpsest.sources import files

    calls = []

    def read():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return b"x"

    assert files.retried(read, wait=0, first=0) == b"x" and len(calls) == 3
    with pytest.raises(OSError, match="busy"):
        files.retried(lambda: (_ for _ in ()).throw(OSError("busy")), tries=2, wait=0, first=0)


def test_players_become_frames():
    from palimpsest.functions.rewrite.html import rewrite_html

    flash = '<object type="application/x-shockwave-flash" data="//www.youtube.com/v/abc?x=1"></object>'
    assert rewrite_html(flash, PRE, BASE) == f'<iframe type="application/x-shockwave-flash" src="{PRE.replace("mp_", "if_")}https://www.youtube.com/embed/abc"></iframe>'


def test_links_of_a_page_parse_its_address_once(monkeypatch):
    from palimpsest.functions import urls
    from palimpsest.functions.rewrite import html

    parsed = []
    split = urls.urlsplit
    monkeypatch.setattr(urls, "urlsplit", lambda *a: (parsed.append(a), split(*a))[1])
    page = "".join(f'<a href="/p{i}/x.html"></a>' for i in range(100))
    prefix = "https://replay.example/once/20200101000000mp_/"
    assert html.rewrite_html(page, prefix, "HTTP://Once.Example:80/d/p") == "".join(f'<a href="/once/20200101000000mp_/http://once.example/p{i}/x.html"></a>' for i in range(100))
    assert len(parsed) <= 3
    # paths that something is resolved or encoded in go the whole way, with the same result
    for base in ("https://u:p@h.test:8/a/b", "http://H.test", "data:x", "", "ftp://f/x"):
        for path in ("/a", "/a/b.c", "/a/", "/", "//h/x", "/.a", "/a/../b", "/a/./b", "/a//b", "/a;b", "/a;", "/a b", "/a?b", "/a#b", "/a\n", "/é", "/a..b", "/a:b@c", "/%41"):
            assert urls.whatwg_join(base, path) == urls._join(base, path)


def test_pages_are_dealt_to_the_tasks_of_a_shuffle(spark):
    from palimpsest.plans import inventory

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet("/root/testdata/sf0.001/events.parquet").rdd.getNumPartitions() < n
    for name in ("object_conversion", "page_attributes", "text_node_rule", "proxied_pages"):
        assert inventory.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == n
