"""Main text of pages, and transport streams."""

import hashlib
import html
import html.parser
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from larder.llm import html_template as ht
from larder.llm import queries
from larder.llm import transport_stream as ts


def expected(page):
    """The article of the test data's pages, by their known layout."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", article)
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_pages_of_the_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: re.sub(r"\s+", " ", expected(r.html)) for r in pages.collect()}
    got = ht.extract_main_text(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert re.sub(r"\s+", " ", r.text) == want[r.page_id] and r.n_chars == len(r.text)


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!doctype html><html><head>{head}</head><body>{body}</body></html>"


def test_what_stays_and_what_goes():
    cases = {
        "<p>a &amp; b&nbsp;c &frac12; &#233; &amp;lt;</p>": "a & b c ½ é &lt;",
        "<h1>T</h1><p>one<br>two<p>three <b>bo</b>ld</div>": "T\none two\nthree bold",
        "<nav>n</nav><header>h</header><main><h2>x</h2>y<aside>s</aside></main><footer>f</footer>": "x\ny",
        "<article><header><h1>H</h1></header><p>b</p><section id='comments'><p>c</p></section></article>": "H\nb",
        "<div class='cookie-notice'>n</div><p>text</p><form><p>f</p></form><div class='ad'>x</div>": "text",
        "<div class='adapted'>stays</div><div id=leftSidebar>no</div>": "stays",
        "<script>if (a < b) '</p>'</script><p>ok</p><!-- <p>no</p> --><textarea><p>no</textarea>": "ok",
        "<ul><li>a<li>b <p>c</p></ul><table><tr><td>d<td>e</table><pre> f\n g </pre>": "a\nb\nc\nd\ne\nf g",
        "a < b and <unknown>c</unknown>": "a < b and c",
        "<div role='navigation'>x</div><blockquote>q</blockquote>": "q",
        "": "",
    }
    for body, text in cases.items():
        assert ht.main_text(page(body)) == text, body
    assert ht.main_text(None) == "" and ht.main_text("<p") == ""


def test_names_and_articles_only_break_ties():
    cases = {
        "<div id='menu-recipes'><p>The recipe</p></div>": "The recipe",
        "<p>See the <span class='notice'>notice</span> word</p>": "See the notice word",
        "<p class='share-of-voice'>share</p><p>of voice</p>": "share\nof voice",
        "<main><h1>T</h1><p>x</p></main><article class='comment'>reader</article>": "T\nx",
        "<main><p>lead and more</p></main><article>teaser</article>": "lead and more\nteaser",
        "<main><p>lead</p><article>teaser</article></main>": "lead\nteaser",
        '<p class="x>text</p>': "text",
        "<p>all of the text</p><article>a teaser</article>": "all of the text\na teaser",
        "<article class='ad'><p>bought words</p></article><p>the text that is more</p>": "the text that is more",
    }
    for body, text in cases.items():
        assert ht.main_text(page(body)) == text, body


def test_most_texts_of_the_data_come_from_the_counts(spark):
    """Without the hashes found by counting, pages of counted hosts keep their menus."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hosts = Counter(r.url.split("/")[2] for r in pages)
    counted = [r for r in pages if hosts[r.url.split("/")[2]] >= ht.MIN_PAGES]
    assert len(counted) > 40
    for r in counted:
        text, want = (" ".join(x.split()) for x in (ht.main_text(r.html, frozenset()), expected(r.html)))
        assert text != want and want in text


def test_layouts_without_names_or_articles(spark):
    """Words of menus and notes differ on every page; only where they stand recurs."""
    rows, want = [], {}
    for i in range(40):
        menu = "<div><ul>" + "".join(f"<li><a href='/{i}-{k}'>part {i} {k}</a></li>" for k in range(3)) + "</ul></div>"
        story = f"<h1>title {i}</h1>" + f"<p>story {i} goes on with more words</p>" * 3
        note = f"<section><p>note {i}</p></section>"
        if i % 4 == 3:  # a second layout of the host
            source = page(f"{menu}<table><tr><td>{story}<ul><li>item {i}</li></ul></td></tr></table>{note}")
            want[i] = "\n".join([f"title {i}", *[f"story {i} goes on with more words"] * 3, f"item {i}"])
        else:
            source = page(f"{menu}<section class='text'>{story}</section>{note}")
            want[i] = "\n".join([f"title {i}", *[f"story {i} goes on with more words"] * 3])
        rows.append((i, "https://plain.example/", source))
    # A page of hardly any text has its words in the menu; the counts of the others still tell.
    rows.append((40, "https://plain.example/", page("<div><ul><li>part 40 0</li></ul></div><section class='text'><p>hm</p></section>")))
    want[40] = "hm"
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in ht.extract_main_text(df).collect()} == want
    for i, _, source in rows:
        assert ht.main_text(source, frozenset()) != want[i]


class Outline(html.parser.HTMLParser):
    """Containers of well-formed pages by another parser: (tag, class, text, children) trees."""

    def __init__(self, source):
        super().__init__()
        self.open, self.found = [("#", "", [])], []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, dict(attrs).get("class", ""), []))

    def handle_data(self, data):
        self.open[-1][2].append(" ".join(data.split()))

    def handle_endtag(self, tag):
        done = self.open.pop()
        tree = (done[0], done[1], tuple(done[2]))
        self.found.append(tree)
        self.open[-1][2].append(tree)


def test_counts_equal_those_of_another_parser(spark):
    draw, rows = random.Random(8), []
    parts = ["<div><b>menu one</b> <i>of it</i></div>", "<ul><li>a b c</li><li>d</li></ul>", "<section><p>p q r</p></section>"]
    for i in range(60):
        body = "".join(draw.sample(parts, draw.randrange(4))) + f"<div><p>own words {i} and {i * i} so on</p></div>"
        rows.append((i, f"https://h{i % 2}.example/", f"<html><body>{body}</body></html>"))
    rows.append((60, *rows[0][1:]))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    keyed = df.select(F.xxhash64(ht.host_of(F.col("url"))).alias("site"), F.xxhash64("html").alias("page"), "html")
    got = ht.subtree_hashes(keyed).where(F.col("kind").isin(ht.CONTENT, ht.CONTAINER)).groupBy("site", "hash").count()
    want = Counter()
    for url, source in {(u, s) for _, u, s in rows}:
        want.update((url, tree) for tree in set(Outline(source).found) if tree[0] in ht.BLOCKS - {"html", "body"})
    assert sorted(r["count"] for r in got.collect()) == sorted(want.values())


def test_templates_are_counted_by_host(spark):
    shared = "<div><a href='/x'>Home</a> <a href='/y'>All posts</a></div>"
    rows = []
    for i in range(12):
        passage = "<p>A passage that all articles share.</p>"
        rows.append((i, f"https://one.example/p{i}", page(f"{shared}<article><h1>n{i}</h1>{passage}<p>own {i}</p></article>")))
        rows.append((100 + i, f"https://two.example/{i}", page(f"{shared}<div><p>story {i}</p></div><div>Credits line</div>")))
    rows.append((200, "https://three.example/", page(f"{shared}<p>alone</p>")))
    rows += [(300, None, None), (None, "no url", ""), (301, "https://two.example/", None), rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "'a' as text", "2 as template")
    got = Counter(tuple(r) for r in ht.extract_main_text(df).collect())
    want = Counter()
    for i, url, source in rows:
        text = ""
        if source and "one.example" in url:
            text = f"n{i}\nA passage that all articles share.\nown {i}"
        elif source and "two.example" in url:
            text = f"story {i - 100}"
        elif source:
            text = "Home All posts\nalone"
        want[(i, url, text, len(text))] += 1
    assert got == want
    assert ht.extract_main_text(df.limit(0)).count() == 0


def test_rare_menus_of_a_large_host(spark):
    rows, want = [], {}
    for i in range(200):
        # Each menu is on 3 % of the pages; so is a passage, which is no container.
        menu = f"<div><a href='/{i % 33}'>Part {i % 33}</a> <a href='/more'>More of it</a></div>"
        story = f"<p>A passage cited {i % 33} times.</p><p>story {i} " + "of several words of its own " * 3 + f"</p><div>yes {i % 33}</div>"
        rows.append((i, "https://large.example/", page(menu + story)))
        own = " ".join(f"story {i} {'of several words of its own ' * 3}".split())
        want[i] = f"A passage cited {i % 33} times.\n{own}\nyes {i % 33}"
    # Copies of one page are no reason to drop what it holds.
    for i in range(200, 210):
        rows.append((i, "https://large.example/copy", page("<div><p>one story told</p></div><div><p>another one told</p></div>")))
        want[i] = "one story told\nanother one told"
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in ht.extract_main_text(df).collect()} == want


def test_streams_round_trip():
    draw = random.Random(2)
    sizes = [0, 1, 64, 150, 151, 156, 157, 158, 159, 160, 161, 162, 163, 164, 165, 170, 171, 4096, 4097, 40000, 70001]
    for n in sizes + list(range(300, 560)):
        data = draw.randbytes(n)
        media = ts.mux(ts.padded(data))
        assert len(media) % 188 == 0
        found = ts.demux(media)
        payload = found.payload()
        assert payload[:n] == data and not payload[n:].strip(b"\0") and len(payload) % 64 == 0 and len(payload) > 0
        assert found.programs == {1: ts.PMT_PID} and found.streams == {ts.DATA_PID: 6}
        assert (found.continuity_errors, found.repeated, found.bad_sections, found.lost_sync) == (0, 0, 0, 0)
        assert [u.ticks for u in found.units] == [k * 3600 for k in range(len(found.units))]
        assert [u.random_access for u in found.units] == [k % 8 == 0 for k in range(len(found.units))]


def test_faults_are_counted():
    media = ts.mux(bytes(range(256)) * 100)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert ts.demux(b"".join(packets[:5] + packets[6:])).continuity_errors == 1
    twice = ts.demux(b"".join(packets[:5] + packets[4:]))
    assert twice.repeated == 1 and twice.payload() == bytes(range(256)) * 100
    noise = ts.demux(b"".join(packets[:5]) + b"\0\1\2" + b"".join(packets[5:]))
    assert noise.lost_sync == 1 and noise.payload() == bytes(range(256)) * 100
    broken = bytearray(media)
    broken[10] ^= 1
    assert ts.demux(bytes(broken)).bad_sections == 1 and not ts.demux(bytes(broken)).streams
    assert ts.demux(b"").packets == 0 and ts.demux(b"\x47" * 187).packets == 0
    # A map longer than a packet, as other writers make it.
    body = b"".join(bytes([6, 0xE2, k, 0xF0, 0]) for k in range(60))
    section = ts._section(2, 1, b"\xe1\x01\xf0\x00" + body)
    head = packets[0] + bytes([0x47, 0x41, 0, 0x10, 0]) + section[:183]
    more = bytes([0x47, 0x01, 0, 0x11]) + section[183:]
    assert len(ts.demux(head + more + b"\xff" * (188 - len(more))).streams) == 60


def test_media_query_values(spark, tmp_path, docs, rows):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r)[:6] + (r.media_sha256,) for r in queries.op9_transport_stream(spark, str(tmp_path)).collect())
    want = Counter()
    for d, t, _ in rows:
        raw = (t or "").encode()
        payload, media = ts.padded(raw), ts.mux(ts.padded(raw))
        want[
            (d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        ] += 1
    assert got == want
    empty = ts.read_streams(spark.createDataFrame([(1, None)], "doc_id bigint, media binary")).first()
    assert empty.stream is None
