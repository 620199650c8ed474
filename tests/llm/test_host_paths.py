"""Page extraction: planted layouts, the host's vote, and odd pages."""

import html as H
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF  # noqa: F401
from lakeops.llm import host_paths as P

LAYOUT = """<!DOCTYPE html><html><head><title>T</title><script>var t="<p>no</p>";</script></head><body>
<header class="top"><nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav></header>
<div id="cookie-banner">We use cookies.</div><div class="layout">
<div class="entry post-{n}"><h2>Head {n}</h2><p>First &amp; second&nbsp;text &#233;.<br>Line two<p>Another <i>para</i>
here<ul><li>one<li>two</ul><form><p>Your name</p></form></div>
<div class="comments"><p>{comment}</p></div><aside><p>Side</p></aside></div><footer>Foot</footer></body></html>"""
MAIN = "Head {n}\n\nFirst & second text é. Line two\n\nAnother para here\n\none\n\ntwo"


def test_articles_of_the_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in P.extract(pages).collect()}
    for r in pages.collect():
        inside = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        blocks = (re.sub(r"\s+", " ", H.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " ", b))).strip()
                  for b in re.split(r"</?(?:p|h1)>", inside))
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_host_votes_over_pages_that_mislead(spark):
    long_ = "A reader writes a great deal more than the article itself has. " * 20
    data = [(n, f"https://blog.example.org/{n}", LAYOUT.format(n=n, comment=long_)) for n in range(20)]
    # one page whose list of links has become longer than the article
    odd = '<body><div class="layout"><div class="entry post-9"><p>Short.</p></div><div class="box"><p>' + "Loud text. " * 30 + "</p></div></div></body>"
    data.append((99, "https://BLOG.example.org/99", f"<html>{odd}</html>"))
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["path"]) for r in P.extract(df).collect()}
    assert all(got[n][0] == MAIN.format(n=n) for n in range(20))
    assert got[0][1] == "/html/div.layout/div.entry.post-"
    assert got[99] == ("Short.", "/html/div.layout/div.entry.post-")   # the host's path, not the page's best
    alone = P.extract(df.filter("page_id = 99").withColumn("url", F.lit("https://other.example.org/"))).first()
    assert alone["text"].startswith("Loud")


def brute_choice(pages):
    """Each page's path by the definition, from all pages' votes: {row number: path}."""
    weight, own, of = defaultdict(float), {}, {}
    for i, (url, html) in enumerate(pages):
        nodes, blocks = P.parse(html)
        found = P.scores(nodes, blocks)
        own[i] = P.best_path(nodes, blocks, found)
        of[i] = (P.host_of(url), found)
        if own[i] is not None:
            total = sum(len(t) for n, t in blocks if not n.skip)
            weight[P.host_of(url), own[i]] += len(P.text_under(own[i], nodes, blocks).replace("\n\n", "")) / total
    return {i: max((p for p in [*found, *([own[i]] if own[i] is not None else [])] if (host, p) in weight),
                   key=lambda p: weight[host, p], default=None) for i, (host, found) in of.items()}


def test_votes_equal_a_count_over_all_pages(spark):
    """Hosts with two layouts each and pages that carry boxes of both: the heavier vote decides, page by page."""
    rng = random.Random(5)
    pages = []
    for n in range(300):
        host = f"h{rng.randrange(6)}.org"
        boxes = [f'<div class="{c}"><p>{" ".join(rng.choices(["lorem", "ipsum", "dolor"], k=rng.randint(3, 60)))}</p></div>'
                 for c in rng.sample(["text", "entry", "story", "column"], rng.randint(1, 3))]
        pages.append((f"http://{host}/{n}", f"<html><body><div class=all>{''.join(boxes)}</div></body></html>"))
    pages += pages[:40]   # copies vote too
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in P.extract(df).collect()}
    want = brute_choice(pages)
    changed = 0
    for i, (url, html) in enumerate(pages):
        nodes, blocks = P.parse(html)
        assert got[i] == P.text_under(want[i], nodes, blocks)
        changed += want[i] != P.best_path(nodes, blocks, P.scores(nodes, blocks))
    assert changed > 20   # the vote matters


def one(spark, html):
    return P.extract(spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")).first()["text"]


def test_headline_and_lead_stay(spark):
    body = "Text of the article. " * 50
    post = f'<body><div class="post"><h1>Headline</h1><p>A lead.</p><div class="text"><p>{body}</p></div></div><div class=box><p>Else.</p></div></body>'
    assert one(spark, post) == f"Headline\n\nA lead.\n\n{body.strip()}"
    main = f"<body><main><h1>Headline</h1><article><p>{body}</p></article></main></body>"
    assert one(spark, main) == f"Headline\n\n{body.strip()}"
    plain = f"<body><h1>Headline</h1><div class=text><p>{body}</p></div><p>Stray.</p></body>"
    assert one(spark, plain) == f"Headline\n\n{body.strip()}\n\nStray."
    own = f"<body><h1>Site</h1><article><h2>Headline</h2><p>{body}</p></article></body>"
    assert one(spark, own) == f"Headline\n\n{body.strip()}"


@pytest.mark.parametrize("name", ["content with-sidebar", "no-comments", "social-studies", "has-tags", "entry-header", "adhesive"])
def test_names_that_only_mention_a_mark_keep_their_text(spark, name):
    assert one(spark, f'<body><div class="{name}"><h1>Head</h1><p>Some text.</p></div></body>') == "Head\n\nSome text."


@pytest.mark.parametrize("name", ["ad", "ads box", "cookie-banner", "post-comments", "comments-area", "site-footer", "main-nav", "sidebar",
                                  "page-header", "newsletter-signup", "top-bar share"])
def test_marked_parts_go(spark, name):
    assert one(spark, f'<body><div class="text"><p>Some text.</p><div class="{name}"><p>Else.</p></div></div></body>') == "Some text."


def test_other_attributes_mark_nothing(spark):
    html = '<body><div class=t><p data-id="share" data-class="comments">One.</p><p x-role=menu title="id=ad">Two.</p><p id=share>No.</p></div></body>'
    assert one(spark, html) == "One.\n\nTwo."


@pytest.mark.parametrize("html", ['<a x ' * 200_000, "<div>" * 60_000 + "text" + "</section>" * 60_000, "<!x " * 300_000, '<p a="' * 200_000,
                                  "<div class=a><p>t</p>" * 30_000, "<ul><li>x" * 40_000, "<header>" * 50_000, "<a>" * 50_000 + "</a>" * 50_000, "&" * 500_000])
def test_long_pages_take_linear_time(html):
    t = time.process_time()
    nodes, blocks = P.parse(html)
    found = P.scores(nodes, blocks)
    best = P.best_path(nodes, blocks, found)
    if best is not None:
        P.text_under(best, nodes, blocks)
    assert time.process_time() - t < 10


def test_odd_pages(spark):
    data = [(1, None, None), (1, "x", ""), (None, "http://", "plain text &lt; more"), (2, "//h/p", "<p>a<p>b"),
            (3, "u", "<div class='ad'>only adverts</div>"), (4, "u", "<p>open <b>bold <p>next"),
            (5, "u", "<script>var x = '<p>no</p>'"), (6, "u", "a < b and c > d"), (7, "u", "<p>" + "word " * 50000)]
    df = spark.createDataFrame([(*d, 0, "z") for d in data], "page_id long, url string, html string, path int, host string")
    rows = sorted((r["page_id"] or 0, r["text"]) for r in P.extract(df).collect())
    assert [t for _, t in rows] == ["plain text < more", "", "", "a\n\nb", "", "open bold\n\nnext", "", "a < b and c > d",
                                    ("word " * 50000).strip()]
    assert P.extract(df.limit(0)).count() == 0


def test_paths_lose_digits_and_hidden_parts_go():
    nodes, blocks = P.parse("<body><div class='post-17 b'><p>x</p></div><div hidden><p>y</p></div><div style='display: none'>z</div>")
    assert P.name_of(nodes[1].path, nodes) == "/div.b.post-"
    assert nodes[1].path == P.parse("<body><div class='b post-93'>x</div>")[0][1].path
    assert [t for n, t in blocks if not n.skip] == ["x"]
