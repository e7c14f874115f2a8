import random
import time

import duckdb
import pytest

from tellurion.llm import pages, queries, urls

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><ul><li><a href=x>Home</a><li><a>About</a></ul></header>
<div class="cookie-notice">We use cookies</div><div id=wrap class="layout has-sidebar content"><main><article class="post post-{n}"><header><h1>My &amp; title</h1></header>
<p>First para, with <b>bold</b>
text and <a href="#">a link</a>.<p>Second &lt;para&gt; x<br>y<ul><li>one<li>two</ul><div class="ad">Buy now</div><form><input><label>Name</label></form>
<blockquote>Quote&nbsp;&eacute;</blockquote><script>if (a<b) "</article>"</script><style>p{{}}</style><section class="comments"><p>I agree, says a reader, at very great length indeed.</p></section></article>
<aside><p>Side text</p></aside></main></div><footer>foot</footer></body></html>"""
TEXT = "My & title\nFirst para, with bold text and a link.\nSecond <para> x y\none\ntwo\nQuote é"

PLAIN = """<body><div class="top"><a href=1>one</a> <a href=2>two</a></div><div class="c{n}"><h2>Head {n}</h2><p>{body}</p></div><div class="x-share">share</div></body>"""


def test_article_without_the_rest():
    assert pages.Page(PAGE.format(n=7)).extract(None) == TEXT


ARTICLE = "<body><{tag}><h1>Title</h1><p>First of the article.</p>{part}<p>Last of the article.</p></{tag}></body>"


def test_names_alone_take_no_text_from_an_article():
    kept = [
        ('<section id="discussion"><h2>Discussion</h2><p>We discuss.</p></section>', "Discussion\nWe discuss."), ('<h2 id="feedback">Feedback</h2>', "Feedback"),
        ('<h2 id="reviews"><a href="#reviews">Reviews</a></h2>', "Reviews"), ('<h3 class="header">Header files</h3>', "Header files"), ('<div class="reviews"><p>All reviews.</p></div>', "All reviews."),
        ('<p class="popular">Well liked.</p>', "Well liked."), ('<pre>x = 1 <span class="hljs-comment"># one</span></pre>', "x = 1 # one"), ('<p>See <a class="notice" href="x">the notice</a>.</p>', "See the notice."),
        ('<div id="comments"><p>On comments in code.</p></div>', "On comments in code."), ('<p class="market-share">Half the market.</p>', "Half the market."),
        ('<div id="cookies"><p>Bake them.</p><form><input></form></div>', "Bake them."), ('<ul id="related"><li>Prose with <a href="x">a link</a></ul>', "Prose with a link"),
        ('<div class="overflow-hidden"><p>In a frame.</p></div>', "In a frame."), ('<div class="hidden md:block">On wide screens.</div>', "On wide screens."),
    ]
    for part, text in kept:
        for tag in ("article", "main", 'div class="x entry-content"'):
            assert pages.Page(ARTICLE.format(tag=tag, part=part)).extract(None) == f"Title\nFirst of the article.\n{text}\nLast of the article.", part


def test_clear_cases_go_from_an_article():
    gone = [
        '<div class="inline-ad">Buy now</div>', '<ins class="adsbygoogle">Buy now</ins>', '<div class="sponsored">Buy now</div>', '<div class="share">Tell others</div>', '<div class="x social-share">Tell others</div>',
        '<ol class="comment-list"><li>I agree</ol>', '<div class="comments-area">I agree</div>', '<div class="related-posts"><a href="x">More on it</a> <a href="y">And more</a></div>',
        '<div class="newsletter"><p>Our news by mail</p><form><input></form></div>', '<span class="visually-hidden">unseen</span>', '<nav class="pager">1 2</nav>',
    ]
    for part in gone:
        assert pages.Page(ARTICLE.format(tag="article", part=part)).extract(None) == "Title\nFirst of the article.\nLast of the article.", part


def test_names_of_topics_outside_an_article():
    body = "<p>" + "word " * 40 + "</p>"
    for part in ('<div id="discussion"><p>We discuss.</p></div>', '<div class="reviews"><p>We discuss.</p></div>', '<h2 class="popular">We discuss.</h2>'):
        assert pages.Page(f'<div class="c1">{body}{part}</div>').extract(None) == ("word " * 40).strip() + "\nWe discuss.", part
    for part in ('<div class="cookie-notice">We use cookies</div>', '<div id="related"><a href="x">More</a></div>', '<div class="sidebar"><p>Side</p></div>'):
        assert pages.Page(f'<div class="c1">{body}{part}</div>').extract(None) == ("word " * 40).strip(), part


NAMES = ["page-footer", "sidebar-content", "comment-body", "cookie-text", "ad-content", "main-menu", "footer-text", "nav-main", "content-sidebar", "login-body", "post-comments", "story-share-buttons share"]


@pytest.mark.parametrize("name", NAMES)
def test_a_word_for_content_saves_no_boilerplate(name):
    """Beside a headed text, more or less of it."""
    for n in (3, 60):
        part = f'<div class="{name}"><p>{"other " * n}</p></div>'
        for source in (f'<div class="c1"><h1>Head</h1><p>{"word " * 40}</p></div>{part}', f'{part}<div class="c1"><h2>Head</h2><p>{"word " * 40}</p></div>'):
            assert pages.Page(source).extract(None) == "Head\n" + ("word " * 40).strip(), (name, n)


def test_layout_names_condemn_nothing():
    for name in ("layout-has-sidebar content", "no-sidebar", "content-with-sidebar", "sidebar-right-layout"):
        assert pages.Page(f'<div class="{name}"><h1>Head</h1><p>Text of it.</p></div><div class="sidebar">Side</div>').extract(None) == "Head\nText of it.", name
    assert pages.Page('<div class="sidebar"><p>All that there is.</p></div>').extract(None) == "All that there is."
    assert pages.Page('<form id="aspnet"><div><h1>Head</h1><p>Text in a form around the page.</p><input><select><option>x</select></div></form>').extract(None) == "Head\nText in a form around the page."
    assert pages.Page('<p>Text</p><div data-class="ad" title="class=ad"><p>more</p></div>').extract(None) == "Text\nmore"


HOSTILE = ["<div>", "<b>", "<p>x", "<ul><li>", "<table><tr><td>z", '<a "', "<!-", "</i>", '<div class="sidebar">x', "<h1>", '<div class="']


@pytest.mark.parametrize("part", HOSTILE)
def test_time_is_linear_in_a_page(part):
    def seconds(n):
        began = time.process_time()
        pages.Page("<b>" * n + part * n + "y").extract(None)
        return time.process_time() - began

    seconds(100)
    assert seconds(40_000) < 3 * min(seconds(20_000), seconds(20_000)) + 0.3
    began = time.process_time()
    pages.Page(part * 100_000)
    assert time.process_time() - began < 5


def test_broken_and_bare_pages():
    for source, text in ((None, ""), ("", ""), ("plain", "plain"), ("<p>a", "a"), ('<a title="x>y">z</a>', "z"), ("a<b c", "a<b c"), ("<!-- c", ""), ("<script>x", ""), ("<p>" + "w " * 50_000, ("w " * 50_000).strip())):
        assert pages.Page(source).extract(None) == text
    for source, text in (("<p>a</p><3 all", "a\n<3 all"), ("<p>a</p>b <", "a\nb <"), ("<p>a</p>b <div class=x", "a\nb"), ("<p>a</p>b <!-- c", "a\nb"), ("<p>a</p></p", "a"), ("<p>a</p><script>x", "a"), ("<p>a</p><!--> b", "a\nb"), ("<p>a</p><!--->b<!--!> c", "a\nb"), ("<p>a<!-- > b -->c", "ac"), ("<script>a > b", "")):
        assert pages.Page(source).extract(None) == text, source


def test_pages_of_a_host_agree(spark):
    rows = [(k, f"http://a.example/{k}", PLAIN.format(n=k, body="word " * 40)) for k in range(6)]
    # here something longer stands beside the article; the host's other pages tell which is which
    rows.append((6, "http://a.example/6", PLAIN.format(n=6, body="word " * 40).replace("<div class=\"x-share\">share</div>", "<div class=\"z\"><p>" + "other " * 60 + "</p></div>")))
    rows += [(7, None, PAGE.format(n=1)), (8, "http://b.example/", None), (None, "http://b.example/", PAGE.format(n=2)), (7, None, PAGE.format(n=1))]
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, votes int")
    got = pages.extract(frame).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for k in range(7):
        assert by_id[k].text == f"Head {k}\n" + ("word " * 40).strip()
    assert by_id[7].text == by_id[None].text == TEXT and by_id[7].n_chars == len(TEXT)
    assert by_id[8].text == ""
    assert pages.extract(frame.limit(0)).collect() == []


def site(rng, host, n):
    """[(url, html, text)] of pages without an article element, of one template of neutral names: what repeats is boilerplate, what varies is text."""

    def say(k):
        return " ".join(rng.choice(["river", "stone", "market", "window", "letter", "winter"]) + str(rng.randrange(1000)) for _ in range(k))

    name = [f"k{rng.randrange(10**6)}x" for _ in range(6)]
    top, side, note, bottom = (say(rng.randrange(4, 30)) for _ in range(4))
    out = []
    for k in range(n):
        blocks = [say(6), *(say(rng.randrange(8, 40)) for _ in range(rng.randrange(3, 8)))]
        body = "".join(f"<p>{b}</p>" for b in blocks[1:])
        html = f"""<html><body><div class="{name[0]}">{top}</div><div class="{name[1]}"><div class="{name[2]} n{k}"><h2>{blocks[0]}</h2>{body}<div class="{name[3]}"><p>{note}</p></div></div>
        <div class="{name[4]}"><p>{side}</p></div></div><div class="{name[5]}"><p>{bottom} <a href="/{k}">{k}</a></p></div></body></html>"""
        out.append((f"http://{host}/{k}", html, "\n".join(blocks)))
    return out


def test_the_pages_of_a_host_tell_text_from_boilerplate(spark):
    """Pages of neutral names, without an article: the text is found whole and alone, on hosts of few and of many pages, copies or not."""
    rng = random.Random(4)
    made = [p for k, n in enumerate((5, 8, 30)) for p in site(rng, f"h{k}.example", n)]
    made += [made[0]] * 40  # copies of a page prove nothing
    got = pages.extract(spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(made)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: text for k, (_, _, text) in enumerate(made)}


def test_near_copies_of_a_page_keep_their_text(spark):
    paragraphs = [f"Paragraph {k} of a text that stands on many pages." for k in range(6)]
    rows = [(k, f"http://copies.example/{k}", f"<article><h1>Title</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}<p>Only here: {k}</p></article>") for k in range(12)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: "\n".join(["Title", *paragraphs, f"Only here: {k}"]) for k in range(12)}


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def brute(url, rules=RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if c.isascii() else c for c in host), slash + path
    fits = [(-len(r), v != "block", r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(min(fits)[2:] if fits else (None, None)))


def levels(host):
    """(domain, suffix) of a host."""
    bare = host.rpartition("@")[2]
    bare = bare.rpartition(":")[0] if ":" in bare and bare.rpartition(":")[2].strip("0123456789") == "" else bare
    labels = bare.split(".")
    if bare.startswith("[") or (len(labels) == 4 and all(x.isdigit() for x in labels)):
        return bare, bare
    k = 2 if len(labels) >= 3 and len(labels[-1]) == 2 and labels[-2] in urls.SECOND else 1
    return ".".join(labels[-k - 1 :]), ".".join(labels[-k:])


def slow_bounds(counts):
    """{host: bound} of {host: (labelled, bad)}, level by level."""

    def strength(children, mean):
        off = sum((k - n * mean[c]) ** 2 - n * mean[c] * (1 - mean[c]) for c, (n, k) in children.items())
        den = sum(n * (n - 1) * mean[c] * (1 - mean[c]) for c, (n, _) in children.items())
        return 1 / min(urls.MOST, max(urls.LEAST, off / den if den else 0.0)) - 1

    def total(by):
        out = {}
        for h, (n, k) in counts.items():
            was = out.get(by(h), (0, 0))
            out[by(h)] = (was[0] + n, was[1] + k)
        return out

    base = (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)
    suffixes, domains = total(lambda h: levels(h)[1]), total(levels)
    w = strength(suffixes, dict.fromkeys(suffixes, base))
    suffix = {s: (w * base + k) / (w + n) for s, (n, k) in suffixes.items()}
    above = {d: suffix[d[1]] for d in domains}
    w = strength(domains, above)
    domain = {d: (w * above[d] + k) / (w + n) for d, (n, k) in domains.items()}
    above = {h: domain[levels(h)] for h in counts}
    w = strength(counts, above)
    out = {}
    for h, (n, k) in counts.items():
        a, b = w * above[h] + k, w * (1 - above[h]) + n - k
        out[h] = a / (a + b) - urls.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


def slow_judgement(asked, rules, outcomes=None):
    """[(host, path, rule, verdict)] of urls."""
    counts, judged = {}, [brute(u, rules) for u in asked]
    for host, _, _, says in judged:
        reviewed = outcomes is None and any(host == h or host.endswith("." + h) for h in (r.split("/", 1)[0] for _, r in rules))
        n, k = counts.get(host, (0, 0))
        counts[host] = (n + reviewed, k + (reviewed and says == "block"))
    for u, bad in outcomes or []:
        host = brute(u, [])[0]
        n, k = counts.get(host, (0, 0))
        counts[host] = (n + (bad is not None), k + (bad or 0))
    bounds = slow_bounds(counts)
    return [(h, p, r, v or ("block" if bounds[h] > urls.LIMIT else "allow")) for h, p, r, v in judged]


def told(rows):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str)


def judged(spark, asked, rules, outcomes=None):
    frame = spark.createDataFrame([(k, u, "h", "p", 1) for k, u in enumerate(asked)], "page_id long, url string, host string, rule string, n int")
    return told(urls.judge(frame, rules, outcomes and spark.createDataFrame(outcomes, "url string, bad int")).collect())


def expected(asked, rules, outcomes=None):
    return sorted(((k, *x) for k, x in enumerate(slow_judgement(asked, rules, outcomes))), key=str)


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "https://example.net/EN/x", "x://net", "x://net/", "http://b.example.com/de/1", "http://b.example.com/deep", "http://notexample.com/de/1",
    "http://f.org/fr/1#a", "http://f.org?fr/", "http://f.org/", "ftp://ÄB.org/fr/://x", "http://a.co.uk:8080/x", "http://c.example.com/en/\n/2", "http://10.1.2.3/x", "http://10.1.2.4:80/x", "http://u:p@[::1]:8080/", "http://u@x.example.com/de/",
    "http://f.org/fr/1#a",
]


@pytest.mark.parametrize("inline", [64, 0])
def test_urls_are_judged_by_the_longest_rule(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE", inline)
    assert judged(spark, URLS, RULES) == expected(URLS, RULES)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).collect() == []


@pytest.mark.parametrize("more", [0, 60, 61, 200])
def test_equally_long_rules_are_settled_alike_by_any_number_of_rules(spark, more):
    """Below and above INLINE rules."""
    rules = [("block", "a.net/"), ("allow", "net/x/"), ("allow", "b.com/y/"), ("block", "b.com/y/"), *(("allow", f"other{k}.org/") for k in range(more))]
    asked = ["http://a.net/x/1", "http://a.net/y", "http://b.net/x/", "http://b.com/y/z", "http://other1.org/"]
    got = judged(spark, asked, rules)
    assert got == expected(asked, rules)
    assert [r[3:] for r in got[:4]] == [("a.net/", "block"), ("a.net/", "block"), ("net/x/", "allow"), ("b.com/y/", "block")]


@pytest.mark.parametrize("asked", [["http://a.example/1", "http://b.example/"], ["http://a.net/"], ["http://a.net/1", "http://a.net/2", "http://b.net/"], ["http://a.example.com/x"], [None], [None, None, ""]])
def test_few_or_no_reviewed_pages(spark, asked):
    """No rule fits, a single page, all pages blocked: nothing scatters."""
    assert judged(spark, asked, RULES) == expected(asked, RULES)
    assert judged(spark, asked, RULES, [(None, None)]) == expected(asked, RULES, [(None, None)])


PLANTED = [*(f"http://bad.example.com/de/{k}" for k in range(60)), "http://bad.example.com/fr/1", "http://bad.example.com/", *(f"http://good.example.com/en/{k}" for k in range(40)), "http://good.example.com/de/1", "http://new.bad.example.com/x", "http://else.info/", None]


def test_the_registered_query_and_its_sql_block_a_host_by_reputation(spark, tmp_path):
    """Rules block most of one host's pages; its other pages go with them, and those of its neighbours stay."""
    spark.createDataFrame(list(enumerate(PLANTED)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = told(queries.op10_url_reputation(spark, str(tmp_path)).collect())
    assert got == expected(PLANTED, queries.URL_RULES)
    by_reputation = {PLANTED[k]: verdict for k, _, _, rule, verdict in got if rule is None}
    assert by_reputation["http://bad.example.com/fr/1"] == by_reputation["http://bad.example.com/"] == "block"
    assert by_reputation["http://good.example.com/en/1"] == by_reputation["http://else.info/"] == by_reputation[None] == "allow"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op10_url_reputation']})").fetchall(), key=str) == got


def test_reputation_shrinks_little_evidence(spark):
    outcomes = [(f"http://bad.shop.com/{k}", 1) for k in range(40)] + [(f"http://good.site.org/{k}", 0) for k in range(40)]
    outcomes += [(f"http://mixed.site.org/{k}", k % 2) for k in range(20)] + [("http://other.site.org/", 1), (None, None)]
    asked = ["http://bad.shop.com/new", "http://good.site.org/new", "http://other.site.org/new", "http://never.seen/", "http://new.shop.com/"]
    got = judged(spark, asked, [], outcomes)
    assert got == expected(asked, [], outcomes)
    verdict = {host: v for _, host, _, _, v in got}
    assert verdict["bad.shop.com"] == "block"
    assert verdict["good.site.org"] == verdict["other.site.org"] == verdict["never.seen"] == "allow"  # one bad page of a good domain proves little


def test_addresses_are_their_own_domain(spark):
    names = ["10.1.2.3", "10.1.2.3:80", "u:p@[::1]:8080", "a.b.co.uk", "a.b.c.com:1", "com", "", "x.y.z."]
    frame = spark.createDataFrame([(h,) for h in names], "h string")
    domain, suffix = urls.domain_levels(frame["h"])
    assert [tuple(r) for r in frame.select("h", domain, suffix).collect()] == [(h, *levels(h)) for h in names]
