"""Main-text rules on pages without helpful elements, hostile pages, and both passes against plain restatements."""

import os
import random
import re
import time

import pytest

from lodestone.llm import html_text as H

PAGES = "/root/testdata/sf0.01/pages.parquet"
PROSE = ["The river was low and it had been so for most of the year, as all of them could see from the road.", "There is more to this than they would have us think, and it will be out in the next week or so."]


@pytest.fixture(scope="module")
def pages():
    if not os.path.exists(PAGES):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    return pq.read_table(PAGES, columns=["html"])["html"].to_pylist()


def without(page, *tags):
    return re.sub(rf"(</?)({'|'.join(tags)})\b", r"\1div", page)


def text_of(page, stop_words):
    cut = H.Page(page)
    return " ".join(b["text"] for b, good in zip(cut.blocks, H.decide(cut, stop_words), strict=True) if good)


def test_articles_need_no_article_element(pages):
    same = sum(H.main_text(p) == H.main_text(without(p, "article", "main")) for p in pages)
    assert same >= 0.98 * len(pages)


def test_density_decides_where_no_place_is_marked(pages):
    bare = [without(p, "article", "main", "nav").replace('<div class="ad">', "<div>") for p in pages]
    whole = [H.main_text(p) for p in pages]
    with_words = sum(H.main_text(b) == w for b, w in zip(bare, whole, strict=True))
    without_words = sum(text_of(b, frozenset()) == w for b, w in zip(bare, whole, strict=True))
    assert with_words >= 0.75 * len(pages) and without_words <= 0.25 * len(pages)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<div class='related-work'><p>{PROSE[0]}</p></div>", PROSE[0]),
        (f"<article><div class='search-results'><p>{PROSE[0]}</p></div><p>{PROSE[1]}</p></article>", " ".join(PROSE)),
        (f"<form><div><h2>One</h2><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div></form>", " ".join(["One", *PROSE])),
        (f"<div><p>{PROSE[0]}</p></div><form><label>Name</label><p>Give us your name and we will be in touch.</p><button>Go</button></form>", PROSE[0]),
        (f"<div><p>{PROSE[0]}</p></div><div id='comments'><p>{PROSE[1]}</p></div><div class='sidebar-left x'>{PROSE[1]}</div>", PROSE[0]),
        (f"<div><p>{PROSE[0]}</p><p>Short.</p><p>Shorter.</p></div><footer>x</footer>", f"{PROSE[0]} Short. Shorter."),
        (f"<div><h2>Head</h2><p>{PROSE[0]}</p></div><div><a href=a>One</a> <a href=b>Two</a></div><div>Buy now</div><div><a href=c>Three</a></div>", f"Head {PROSE[0]}"),
        ("<p>zork blarg</p>", "zork blarg"),
        (f"<p title=\"a > b\" class=it's>{PROSE[0]}</p><p>a < b &lt; c and so on, as it was</p>", f"{PROSE[0]} a < b < c and so on, as it was"),
        ("<p>x<script>if (a < b) { '</p>' }</SCRIPT >y<!-- <p>no</p> --></p><style>p{}", "xy"),
    ],
)
def test_golden(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a b", "<div>", '<a b="', "<div>x ", '<a b="x>" ', "<a \"'>", "<!--", "<script>", "</x ", "&amp", "<a b= ", "</p><div>", "word word "])
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    out = H.main_text(page)
    assert time.perf_counter() - began < 5
    if unit == "word word ":
        assert out == page.strip()
    if unit == "<div>x ":
        assert out == " ".join(["x"] * (len(page) // len(unit)))


def plain_second_pass(page, marks):
    """The same rules by looking at every block."""
    out = list(marks)
    boxes = {}
    for i, m in enumerate(marks):
        if m is not None:
            continue
        box = page.blocks[i]["box"]
        while True:
            inside = [j for j in range(page.start[box], page.end[box]) if marks[j] is not None]
            if inside:
                break
            box = page.parent[box]
        boxes[i] = box
        left, right = max((j for j in inside if j < i), default=None), min((j for j in inside if j > i), default=None)
        if left is None or right is not None and page.blocks[i]["heading"]:
            out[i] = marks[right]
        elif right is None:
            out[i] = marks[left]
        else:
            out[i] = marks[left] if marks[left] == marks[right] else True if i - left == right - i else marks[left if i - left < right - i else right]
    return out


def plain_first_pass(b, page, i):
    words = re.findall(r"[^\W\d_]+", b["text"].lower())
    density = len([w for w in words if w in H.STOP_WORDS]) / max(1, len(words))
    links = [x["links"] > 0.5 * len(x["text"]) for x in page.blocks]
    if b["strong"] or links[i]:
        return False
    if len(b["text"]) >= 70 and density >= 0.15:
        return True
    among = b["links"] or 0 < i < len(links) - 1 and links[i - 1] and links[i + 1]
    return False if len(b["text"]) >= 70 and density < 0.05 and among else None


def test_both_passes_equal_plain_ones():
    r = random.Random(3)
    pieces = [PROSE[0], PROSE[1], "Zork blarg frump " * 6, "Short.", "<a href=x>Link link</a>", "<a href=x>Link</a> " + "zork blarg frump " * 6]
    decided = 0
    for _ in range(300):
        page, depth = "", 0
        for _ in range(r.randrange(1, 14)):
            tag = r.choice(["p", "h2", "li", "div"])
            page += f"<{tag}>{r.choice(pieces)}</{tag}>"
            if r.random() < 0.3:
                page, depth = page + r.choice(["<div>", "<section>", "<ul>", "<nav>"]), depth + 1
            elif depth and r.random() < 0.3:
                page, depth = page + "</div></section></ul></nav>", 0
        cut = H.Page(page)
        first = [plain_first_pass(b, cut, i) for i, b in enumerate(cut.blocks)]
        assert H._first_pass(cut, H.STOP_WORDS) == first
        if True in first:
            decided += 1
            assert H.decide(cut) == plain_second_pass(cut, first)
    assert decided > 100
