import html
import random
import re
import time
from math import e, log

import pytest
from pyspark.sql import functions as F

from meridia.llm import html_text as H
from meridia.llm.html_text import extract_text, main_text

PARA = ["The first paragraph of the story is long enough to be told from what stands around it, and says so.", "A second one goes on at some length about the matter at hand & what came of it in the end.", "Short one."]
ART = "<h1>Head line</h1>" + "".join(f"<p>{html.escape(p)}</p>" for p in PARA)
WANT = "Head line " + " ".join(PARA)


def test_article_among_boilerplate():
    noise = [
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News and a long label for a link</a></ul></nav>", "<div class='sidebar'><p>Read this too, it is quite a long text in the side bar of the page indeed.</p></div>",
        "<form><label>Name</label><input name=q><button>Send it</button></form>", "<div id=comments><p>I think that this is a very long comment by a reader, longer than the paragraphs of the article.</p></div>",
        "<footer>&copy; all rights</footer>", "<div class=\"cookie-notice\">We use cookies for this and that.</div>", "<aside>Aside</aside>", "<script>if (a < b) document.write('<p>x</p>')</script>", "<style>p{}</style>", "<!-- <p>no</p> -->",
    ]
    for wrap in ("<article>%s</article>", "<main>%s</main>", "<div class=content>%s</div>", "<div><div>%s</div></div>"):
        for n in noise:
            assert main_text(f"<html><head><title>T</title></head><body>{n}{wrap % ART}</body></html>") == WANT, (wrap, n)
            assert main_text(f"<body>{wrap % ART}{n}") == WANT, (wrap, n)
        assert main_text(f"<body>{''.join(noise)}{wrap % ART}{''.join(noise)}</body>") == WANT


def test_layouts_without_semantic_elements():
    menu = "<ul class='menu'>" + "".join(f"<li><a href=/{i}>Section number {i}</a></li>" for i in range(12)) + "</ul>"
    links = "<div>" + "".join(f"<a href=/{i}>A story of some length that is told elsewhere {i}</a> " for i in range(8)) + "</div>"
    side = "<td class=left>" + links + "</td>"
    pages = [
        f"<body><div id=header><a href=/>Site</a></div>{menu}<div id=main>{ART}</div><div id=footer>Imprint, privacy and so on, as every site has it.</div></body>",
        f"<body><table><tr>{side}<td>{ART}</td></tr></table></body>",
        f"<body><form action=/x><div class='page has-sidebar'>{menu}<div>{ART}</div></div></form></body>",
        f"<body><div class=content>{ART}<div class=share-buttons>Share this on all of the networks</div><section id=comments><h3>Comments</h3><article class=comment><p>This is a comment which goes on for a while, longer than any paragraph of the text above it does.</p></article></section></div></body>",
        f"<body><header><div class=logo>The site</div></header><article><header>{ART[:ART.index('<p>')]}</header>{ART[ART.index('<p>'):]}<footer>Tags: a, b</footer></article><aside>More</aside></body>",
        f"<body>{links}<div>{ART}</div>{links}</body>",
        f"<body><div class='alert' role=alert>Down for maintenance tonight, all of you be warned.</div><div>{ART}<ins class=adsbygoogle>Buy now</ins></div></body>",
    ]
    for page in pages:
        assert main_text(page) == WANT, page[:80]


def test_density_decides_beside_articles():
    teaser = "<article class=teaser><h2><a href=/t>Another story of the day</a></h2><p><a href=/t>What it says in short, with a link to all of it.</a></p></article>"
    for tag in ("article", "main"):
        one = teaser.replace("article", tag)
        for page in (f"<div class=story>{ART}</div>{one}", f"{one}<div class=story>{ART}</div>", f"{one}<div><div class=story>{ART}</div></div>{one}{one}"):
            assert main_text(f"<body>{page}</body>") == WANT, page
    assert main_text(f"<body><article>{ART}</article>{teaser}</body>") == WANT  # widened to its headline, and no further


def test_only_whole_names_of_attributes_count():
    for a in ('href="/the-hidden-river"', 'title="Hidden valley"', 'href="/p?id=search"', "data-hidden=false", 'title="a class=comment"', "data-id=nav", "title='role=search' data-x", "aria-hidden=false", "href=/x?class=share"):
        assert main_text(f"<article>{ART}<p>See <a {a}>the river</a> there.</p><section {a}>More of it.</section></article>") == f"{WANT} See the river there. More of it.", a
    for a in ("hidden", "HIDDEN=''", 'title="x" hidden', "hidden=until-found", 'aria-hidden="true"', "style='display: none'", 'data-x=">" class="comment"', "role = search", "id=nav", 'class="box hidden"'):
        assert main_text(f"<article>{ART}<div {a}>Not this.</div></article>") == WANT, a


def test_parts_of_an_article_are_kept():
    for a in ("id=discussion", "class=warning", "class=related", "class=header", "class=social", "id=responses", "id=hidden-river"):
        assert main_text(f"<article>{ART}<section {a}><p>A part of the story.</p></section></article>") == f"{WANT} A part of the story.", a
        assert main_text(f"<body><div {a}><p>Around it.</p></div><article>{ART}</article>") == WANT, a
    for a in ("class=comments", "class=share-buttons", "class=advert", "id=nav"):
        assert main_text(f"<article>{ART}<section {a}><p>No part of it.</p></section></article>") == WANT, a


def test_text_rules():
    assert main_text("<article>a<b>b</b>c <i>d</i>\n\t e<br>f<p>g<p>h&eacute;&#33;&amp;lt;</article>") == "abc d e f g hé!&lt;"
    assert main_text("") == main_text(None) == main_text("<nav>x</nav>") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>1 < 2 and <p>3 > 2") == "1 < 2 and 3 > 2"
    assert main_text("<article><div class='comment'>no</div><ul><li>a<li>b</ul></article>") == "a b"
    big = "<article>" + "<p>word &amp; word</p>" * 20000 + "</article>"
    assert main_text(big) == " ".join(["word & word"] * 20000)
    assert len(main_text("<div>" * 3000 + "x" + "</div>" * 3000)) == 1


def test_whole_table(spark):
    def truth(h):
        a = re.sub(r"<(p|/p|h1|/h1|br)\b[^>]*>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", a)).split())

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: truth(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in extract_text(pages).collect()} == want
    renamed = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|main)\\b", "<$1div"))
    assert {r.page_id: r.text for r in extract_text(renamed).collect()} == want  # no element is taken by its name
    odd = spark.createDataFrame([(1, None), (1, ""), (None, ART)], "page_id long, html string")
    assert sorted(r.text for r in extract_text(odd).collect()) == ["", "", WANT] and extract_text(odd.limit(0)).count() == 0


def stripped(h):
    """The page without names that tell its parts: all layout elements are div, and classes, ids and roles are gone."""
    head, body = h.split("<body", 1)
    body = re.sub(r"<(/?)(nav|header|footer|aside|form|article|main|section)\b", r"<\1div", body)
    return head + "<body" + re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]*)", "", body)


def test_density_alone_on_the_whole_table(spark, monkeypatch):
    """Nothing but density and running text tells menu, advert and footer from the article here; what is missed are articles shorter than these."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [main_text(p) for p in pages]  # as test_whole_table holds
    bare = [stripped(p) for p in pages]
    kept = [main_text(b) == w for b, w in zip(bare, want, strict=True)]
    assert sum(kept) >= 0.95 * len(pages) and all(k for k, w in zip(kept, want, strict=True) if len(w) >= 200)
    with monkeypatch.context() as m:
        m.setattr(H.Page, "picked", lambda self, gone: {0})
        assert not any(main_text(b) == w for b, w in zip(bare, want, strict=True))
    monkeypatch.setattr(H, "density", lambda *a: 1.0)
    assert sum(main_text(b) == w for b, w in zip(bare, want, strict=True)) < sum(kept)


def test_no_article_text_is_lost_by_a_word():
    lead = "<div id=w><p>Short lead.</p><div class=sec><h2>One</h2>" + "".join(f"<p>{p}</p>" for p in PARA * 3) + "</div><div class=sec><h2>Two</h2><p>Brief.</p></div></div>"
    assert main_text(f"<body>{LINKS}{lead}<div>Imprint</div></body>") == "Short lead. One " + " ".join(PARA * 3) + " Two Brief."
    for part, text in (
        ("<pre><code><span class='hljs-comment'># start the server</span>\nrun</code></pre>", "# start the server run"), ("<p><code class=comment><span class='token comment'># none</span></code></p>", "# none"),
        ("<ul class='menu-items'><li>Soup of the day</ul>", "Soup of the day"), ("<p class='modal-verbs'>Can and could are modal verbs.</p>", "Can and could are modal verbs."), ("<p class=comment>A remark.</p>", "A remark."),
    ):
        assert main_text(f"<body><article>{ART}{part}</article></body>") == f"{WANT} {text}", part


LINKS = "<div>" + "".join(f"<div><a href=/{i}>Story {i}</a></div>" for i in range(9)) + "</div>"


def test_density_decides(monkeypatch):
    pages = [f"<body>{LINKS}<{t}>{ART}</{t}></body>" for t in ("article", "main", "div")]
    assert [main_text(p) for p in pages] == [WANT] * 3
    monkeypatch.setattr(H, "density", lambda *a: 1.0)
    assert [main_text(p) == WANT for p in pages] == [False] * 3


def naive(node, body, inside_link=False):
    """(characters, tags, linked characters, link tags) of a tree (tag, children) by the definition, and a list of (density, sum) of
    its blocks in page order."""
    tag, children = node
    link = inside_link or tag == "a"
    c = t = lc = lt = total = 0
    own, out, a = [0, 0], [], 0
    for x in children:
        if isinstance(x, str):
            k = len(x.replace(" ", ""))
            own = [own[0] + k, own[1] + k * link]
        elif x[0] in ("a", "b"):  # inline: text of this block
            for y in x[1]:
                k = len(y.replace(" ", ""))
                own = [own[0] + k, own[1] + k * (link or x[0] == "a")]
            a += x[0] == "a"
        else:
            (c2, t2, lc2, lt2), blocks = naive(x, body, link)
            c, t, lc, lt, total = c + c2, t + t2 + 1, lc + lc2, lt + lt2, total + blocks[0][0]
            out += blocks
    d = lambda c, t, lc, lt: c / (t or 1) * log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1)) / log(max(log(c / max(c - lc, 1) * lc + body * c + e), 1 + 1e-9)) if c else 0.0
    total += d(own[0], a, own[1], a)
    whole = (c + own[0], t + a, lc + own[1], lt + a)
    return whole, [(d(*whole), total), *out]


def test_densities_by_definition():
    rng = random.Random(5)

    def tree(depth):
        kinds = ["text", "a", "b", "div", "section"] if depth < 4 else ["text", "a", "b"]
        kids = []
        for _ in range(rng.randint(0, 4)):
            k, text = rng.choice(kinds), "x" * rng.randint(1, 40)
            kids.append(text if k == "text" else (k, [text]) if k in "ab" else (k, tree(depth + 1)))
        return kids

    show = lambda x: x if isinstance(x, str) else f"<{x[0]}>{''.join(map(show, x[1]))}</{x[0]}>"
    for _ in range(300):
        kids = tree(0)
        page = H.Page("".join(map(show, kids)))
        whole, _ = naive(("body", kids), 0.0)
        _, want = naive(("body", kids), whole[2] / max(whole[0], 1))
        dense, total, _, block = page.densities([False] * len(page.tag))
        got = [(dense[i], total[i]) for i in range(len(block)) if block[i] == i]
        assert len(got) == len(want) and all(x == pytest.approx(y) for x, y in zip(got, want, strict=True))
        blocks = [i for i in range(len(block)) if block[i] == i]
        assert not any(d for d, _ in want) or want[blocks.index(min(page.picked([False] * len(block)), key=lambda i: -total[i]))][1] == pytest.approx(max(t for _, t in want))


def test_words_that_may_name_a_part_of_the_story():
    mid = "<div class='pull-side quote'>A quote.</div><section class=discussion>A discussion.</section><p class=warning>A warning.</p>"
    cut = ART.rindex("<p>")
    for tag in ("article", "div"):
        text = main_text(f"<body>{LINKS}<{tag}>{ART[:cut]}{mid}{ART[cut:]}</{tag}><div class=related>Related stories without a link.</div></body>")
        assert text == WANT.replace(" Short one.", " A quote. A discussion. A warning. Short one."), tag


def test_sections_of_unequal_length():
    long, short = "".join(f"<p>{p}</p>" for p in PARA * 3), "<h2>Later</h2><p>A short section at the end.</p>"
    want = " ".join(PARA * 3) + " Later A short section at the end."
    for tag in ("article", "main", "div"):
        for form in ("<section>%s</section><section>%s</section>", "<div><div>%s</div></div><div class=row><div class=col>%s</div></div>"):
            assert main_text(f"<body>{LINKS}<{tag}><h1>Head line</h1>{form % (long, short)}</{tag}>{LINKS}</body>") == f"Head line {want}", (tag, form)


def test_linked_parts_and_single_letters():
    posts = "<div class=related-posts><h3>Related</h3><ul>" + "".join(f"<li><a href=/{i}>Another story {i}</a></li>" for i in range(4)) + "</ul></div>"
    cut = ART.rindex("<p>")
    for tag in ("article", "main", "div"):
        assert main_text(f"<body>{LINKS}<{tag}>{ART[:cut]}{posts}{ART[cut:]}</{tag}></body>") == WANT, tag
        assert main_text(f"<body>{LINKS}<{tag}><h1>A headline of some words</h1><p>|</p></{tag}></body>") == "A headline of some words |", tag


def test_long_hostile_pages_take_linear_time():
    for part in ("<div>", '<a href="', "<p><b><table>", "<!", "<title>", "</script ", "<a b='", "<li>", "</p>", "<b>", "<", "&", "<a ", "<td><p>", "<a =\"=\"="):
        page = part * (1_000_000 // len(part))
        began = time.process_time()
        main_text(page + "story")
        assert time.process_time() - began < 5, part
    assert main_text("<head><title>T</title><p>" + PARA[0]) == PARA[0]  # a head that is never closed
