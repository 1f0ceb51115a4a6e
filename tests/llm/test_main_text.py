"""Main text of pages by hand, and the host's repeats."""

import random

import pytest

from tidelog.llm import main_text as M

PAGES = "page_id long, url string, html string"


def text_of(page):
    found = M._read(page)
    return found[0] if found[0] is not None else "\n\n".join(found[1])


@pytest.mark.parametrize(("page", "expected"), [
    ("<p>One &amp; two&#33;<p>three\n\n four", "One & two!\n\nthree four"),
    ("<body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div><article><h1>T</h1><p><b>a<br>b</b></p></article><footer>&copy; x</footer>", "T\n\na b"),
    ("<article>Text<script>var a='</p>';</script><style>p{}</style><!-- c --> on</article>", "Text on"),
    ("<article><header><h1>Title</h1><p>By X</p></header><p>Body</p><section class='comments'><article class=comment>No</article></section></article>", "Title\n\nBody"),
    ("<main><p>Only main</p><aside>side</aside></main><p>outside</p>", "Only main"),
    ("<div class='page with-sidebar'><article><p>x</p></article><div id='sidebar-left'>y</div></div>", "x"),
    ("<article><p>a</p><form><label>Name</label><input></form><div role=alert>Cookies!</div><div hidden>h</div><p style='display: none'>n</p><p>b</p></article>", "a\n\nb"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p title='a > b'>x</p><td>cell<td>two", "x\n\ncell\n\ntwo"),
    ("<article><span class='ad-label'>Ad</span><p>kept <em class=note>em</em> too</p></article>", "kept em too"),
    ("<!DOCTYPE html><title>t</title>", ""), ("", ""), (None, ""), ("no tags at all", "no tags at all"), ("a < b and <3", "a < b and <3"),
    ("<article><p>nb&nbsp;sp</p><ul><li>one</li><li>two</li></ul><blockquote>q</blockquote></article>", "nb sp\n\none\n\ntwo\n\nq"),
])
def test_structure(page, expected):
    assert text_of(page) == expected


def page_set(rnd, n, host):
    words = [f"w{k}" for k in range(500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    head, tail, short = f"<div><p>{line(12)}</p></div>", f"<div><p>{line(6)}</p><p>{line(9)}</p></div>", "<p>Back to top</p>"
    bodies = [[line(rnd.randint(9, 40)) for _ in range(3)] for _ in range(n)]
    shared = line(30)
    bodies[0].append(shared)
    bodies[1].append(shared)  # two pages are not enough
    pages = [(k, f"http://{host}/{k}", head + "".join(f"<p>{b}</p>" for b in body) + short + tail) for k, body in enumerate(bodies)]
    return pages, {k: "\n\n".join(body) for k, body in enumerate(bodies)}


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_open_pages_lose_what_the_host_repeats(spark, broadcast):
    rnd = random.Random(2)
    pages, expected = page_set(rnd, 12, "a.org")
    other = [(k + 100, f"http://b{k}.org/", p[2]) for k, p in enumerate(pages)]  # each page on a host of its own
    copies = [(k + 200, "http://c.org/", pages[0][2]) for k in range(5)]  # exact copies count once
    rows = M.main_text(spark.createDataFrame(pages + other + copies, PAGES), broadcast).collect()
    got = {r.page_id: r.text for r in rows}
    assert {k: got[k] for k in expected} == expected
    whole = "\n\n".join(M._read(pages[0][2])[1])
    assert got[100] == whole and got[200] == whole and len(whole) > len(expected[0])
    assert all(r.n_chars == len(r.text) for r in rows) and all(r.n_repeated > 0 for r in rows if r.page_id < 100)


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_what_repeats_does_not_hang_on_the_size_of_the_host(spark, broadcast):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    section = "<p>This block stands below each page of one section alone</p><p>To the section</p>"
    bodies = [" ".join(rnd.choice(words) for _ in range(20)) for _ in range(90)]
    pages = [(k, f"http://a.org/{k}", f"<p>{b}</p>{section if k < 4 else ''}") for k, b in enumerate(bodies)]
    for n in (4, 90):
        got = {r.page_id: r.text for r in M.main_text(spark.createDataFrame(pages[:n], PAGES), broadcast).collect()}
        assert got == dict(enumerate(bodies[:n]))


def test_a_repeated_article_stays(spark):
    page = "<nav>menu of all pages of this host here</nav><article><p>A paragraph of more than eight words that repeats everywhere.</p><p>{}</p></article>"
    rows = M.main_text(spark.createDataFrame([(k, "http://a/", page.format(f"own {k}")) for k in range(9)], PAGES)).collect()
    assert all(r.text.startswith("A paragraph of more") and r.n_repeated > 0 for r in rows)
