"""Pages: boilerplate by name, and templates against plain counting."""

import random
from urllib.parse import urlsplit

import pytest

from concilia.llm import pages


@pytest.mark.parametrize(
    "html, text",
    [
        ('<div class="container has-sidebar"><article>body text</article></div>', "body text"),
        ('<div class="no-ad cookie-consent-off"><main>body text</main></div>', "body text"),
        ('<div class="page-with-footer"><p>body text</div>', "body text"),
        ('<div class="sidebar"><main>body text</main></div>', "body text"),
        ('<article><p>long body text<p class="market-share">market<div id="related-work">work</div></article>', "long body text\n\nmarket\n\nwork"),
        ('<article><p>long body text</p><div class="share-buttons">tweet</div><div class="relatedPosts">more</div></article>', "long body text"),
        ('<p>long body text of the page</p><div class="site-footer">imprint</div><div id="ad-1">buy</div>', "long body text of the page"),
        ('<article>body</article><section class="comments"><article class="x">me first</article></section>', "body"),
        ('<article><p>body</p><ul class="commentList"><li>me first, and much longer than the body</ul></article>', "body"),
        ('<div class="banner"><p>the only text</div>', "the only text"),
    ],
)
def test_names_nominate_and_articles_stay(html, text):
    assert pages.main_text(html) == text


def site(seed=4):
    """Pages without articles or tell-tale names: a host's frame, a folder's menu, own paragraphs."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for host in ("https://a.example", "http://b.example:80", ""):
        frame = [f"<div><p>{word()} {word()}</p></div>" for _ in range(2)]
        for folder in ("", "/news", "/news/old"):
            menu = f"<ul><li>{word()}<li>{word()}</ul>"
            for i in range(9):
                own = [f"{word()} {word()}" for _ in range(3)]
                body = f"{frame[0]}{menu}<div><p>{own[0]}<p>{own[1]}</div><p>{own[2]}</p>{frame[1]}"
                rows.append((len(rows), f"{host}{folder}/{i}.html" if host else None, f"<body>{body}</body>", "\n\n".join(own)))
    return rows


def brute_templates(rows, min_pages, min_share, article_share):
    """Distinct rests of pages by section and subtree, in dictionaries."""
    rests, sections = {}, {}
    for _, url, html, *_ in rows:
        parts = urlsplit((url or "").lower())
        folders = parts.path.rsplit("/", 1)[0].split("/")
        own = [(parts.hostname or "") + "/".join(folders[: k + 1]) for k in range(len(folders))] if url else [""]
        sections[own[-1]] = own
        for mark, rest, inside in pages.Page(html or "").rests():
            for section in own[:1] if inside else own:
                rests.setdefault((section, mark, inside), set()).add(rest)
    out = {}
    for folder, own in sections.items():
        for section in own:
            whole = len(rests[section, None, False])
            for (at, mark, inside), found in rests.items():
                share = article_share if inside else min_share
                if at == section and mark is not None and whole >= min_pages <= len(found) >= whole * share:
                    out.setdefault(folder, set()).add(mark)
    return out


def test_templates_are_those_of_plain_counting(spark):
    rows = site() + [(900, "https://a.example/news/9.html", None, ""), (901, "https://a.example/x", "<article><p>b</p><p>c</p></article>", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    for limits in ((5, 0.2, 0.8), (3, 0.5, 0.9), (20, 0.1, 0.5)):
        got = {r.folder: set(r.template) for r in pages.templates(table, *limits).collect()}
        assert got == brute_templates(rows, *limits)


def test_templates_alone_decide_pages_without_articles(spark):
    rows = site()
    table = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r.page_id: r for r in pages.extract(table).collect()}
    assert {i: r.text for i, r in got.items()} == {i: want for i, _, _, want in rows}
    assert all(pages.main_text(html) != want and got[i].n_template for i, _, html, want in rows)
