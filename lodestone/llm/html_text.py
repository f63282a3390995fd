"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; scripts, styles, comments and
other raw elements vanish, character references are decoded, white space inside
a block becomes one space.

First pass, for each block on its own:

* link density over ``LINKS`` - bad;
* in a boilerplate place - bad. Places are marked by element (nav, footer, aside,
  button ...), by an ARIA role, by being hidden, or by a class or id that as a whole
  names one (``comments``, ``related-posts``, not ``related-work``). Forms, headers
  and the like are weak marks: they don't count where they hold most of the
  page's dense text;
* ``LONG`` characters and stop-word density ``DENSE`` - good;
* stop-word density under ``SPARSE`` in a block of ``LONG`` characters that has a link,
  or stands among links - bad;
* else undecided. An article or main element is one more feature: what stands
  outside it must be twice as long to be good, and is bad otherwise.

Second pass: an undecided block takes the label of its nearest decided neighbours
in the smallest container that has any; where the two sides differ the nearer
wins, and at equal distance good. An undecided heading goes with what follows it.
On a page without a good block, undecided blocks are good inside an article, or
else where they make up the longest run without bad ones between them.

Good blocks are joined in page order by one space. Defined results: null or
empty html, or a page without text, gives the empty text. Unclosed tags end with
their container; a tag that never ends is text. Pages of any length and nesting take
time in proportion to their length. Rows are handled one by one, repeated or not; an empty table
gives an empty result; other columns stay, and columns named text or n_chars are
replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, bounded_batches, fresh, plus, read

LINKS, LONG, DENSE, SPARSE = 0.5, 70, 0.15, 0.05

# Common function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could do for from had has have he her his if in into is it its
    more no not of on one or other our out she so some than that the their them then there they this to was we were what when
    which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei das dass dem den der die durch ein eine einem einen einer er es für hat ich im ist man mit
    nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur
    al como con del el ella entre era esta este fue ha hay las lo los más me mi muy nos para pero por porque ser si sin sobre
    su sus también y ya
    """.split()
)
# Element names by role.
RAW = "script|style|noscript|template|textarea|iframe|svg|math|object|title|select|canvas|audio|video"
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button label legend option".split())
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody thead tfoot figcaption summary hr button label legend option address".split())
STRONG = frozenset("nav footer aside menu dialog button label legend option".split())
WEAK = frozenset("form fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_ITSELF = frozenset("p li option dd dt td th tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:[a-z]+[-_])?(?:nav|navbar|navigation|menu|menubar|side-?bar|footer|masthead|banner|cookies?|consent|gdpr|notices?|alert|ads?|adv|advert|adverts|advertisement|advertising|adsense|promo|promotion|sponsor|sponsored"
    r"|comments?|commentlist|disqus|repl(?:y|ies)|respond|responses|share|sharing|social|breadcrumbs?|related|recommended|recommendations|subscribe|subscription|newsletter|widgets?|login|signup|sign-?in"
    r"|popup|modal|overlay|pagination|pager|toolbar|copyright|disclaimer|search)"
    r"(?:[-_]?(?:bar|box|list|wrapper|wrap|container|inner|area|section|links?|posts?|articles?|items?|stories|block|content|header|footer|body|form|text|top|bottom|left|right|main|menu|message|notice|banner|buttons?|thread|author|meta|\d+))*",
    re.I,
)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, ""), in one pass over the page."""
    at, n, last, tag_of = 0, len(page), page.rfind(">"), _TAG
    while at < n:
        i = page.find("<", at)
        if i < 0 or i > last:
            yield "text", page[at:], ""
            return
        if i > at:
            yield "text", page[at:i], ""
        m = _COMMENT.match(page, i) if page[i + 1 : i + 2] in ("!", "?") else None
        if m:
            at = m.end()
            continue
        m = tag_of.match(page, i) if page[i + 1 : i + 2].isalpha() or page[i + 1 : i + 2] == "/" else None
        if m is None and page[i + 1 : i + 2].isalpha() and tag_of is _TAG:
            tag_of = _PLAIN_TAG  # quotes run to the end of the page: from here on they don't count
            m = tag_of.match(page, i)
        if m is None:
            yield "text", "<", ""
            at = i + 1
            continue
        tag, at = m[2].lower(), m.end()
        if not m[1] and tag in _ENDS:
            end = _ENDS[tag].search(page, at)
            if not m[3].endswith("/"):
                at = end.end() if end else n
            continue
        yield ("close", tag, "") if m[1] else ("open", tag, m[3])


def _mark(tag: str, rest: str, in_article: bool) -> int:
    """2 for a strong mark of a boilerplate place, 1 for a weak one, 0 for none."""
    if tag in STRONG:
        return 2
    found = 1 if tag in WEAK and not (tag == "header" and in_article) else 0
    if not rest or tag in ("html", "body", "main", "article"):
        return found
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and any(NAMES.fullmatch(x) for x in value.split()):
            return 2
        if name == "role" and value.lower() in ROLES or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return 2
    return found


class Page:
    """Blocks in order, with what the rules look at, and the containers they stand in."""

    def __init__(self, page: str):
        self.blocks: list[dict] = []
        self.parent, self.start, self.end = [-1], [0], [0]  # by container; 0 is the page
        self.has_article = False
        self._cut(page)
        self.end = [len(self.blocks) if e < 0 else e for e in self.end]
        self.end[0] = len(self.blocks)

    def _cut(self, page: str) -> None:
        top = ("", 0, -1, False, 0)  # tag, mark, outermost weakly marked container, in article, container
        stack, open_tags, parts = [top], Counter(), []
        links, in_link = 0, False

        def flush():
            nonlocal links
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    tag, mark, weak, inside, box = stack[-1]
                    self.blocks.append({"text": text, "links": min(links, len(text)), "strong": mark == 2, "weak": weak, "inside": inside, "heading": tag in HEADINGS, "box": box})
            parts.clear()
            links = 0

        def pop():
            tag, _, _, _, box = stack.pop()
            open_tags[tag] -= 1
            if box != stack[-1][4]:
                self.end[box] = len(self.blocks)

        for kind, x, rest in tokens(page):
            if kind == "text":
                parts.append(x)
                if in_link:
                    links += len(" ".join(html.unescape(x).split()))
            elif x == "a":
                in_link = kind == "open"
            elif x in VOID:
                if x == "hr":
                    flush()
                parts.append(" ")
            elif kind == "close":
                if open_tags[x]:
                    flush()
                    in_link = False
                    while stack[-1][0] != x:
                        pop()
                    pop()
                elif x in BLOCKS:
                    flush()
            else:
                mark = _mark(x, rest, stack[-1][3])
                if x not in BLOCKS and not mark:
                    continue
                flush()
                in_link = False
                if x in BLOCKS and (stack[-1][0] == "p" or x in CLOSED_BY_ITSELF and stack[-1][0] == x):
                    pop()
                _, above, weak, inside, box = stack[-1]
                if x in ("article", "main") and above < 2:
                    inside = self.has_article = True
                if rest.endswith("/"):
                    continue
                if x in CONTAINERS:
                    self.parent.append(box)
                    self.start.append(len(self.blocks))
                    self.end.append(-1)
                    box = len(self.parent) - 1
                stack.append((x, max(mark, above), box if mark == 1 and weak < 0 else weak, inside, box))
                open_tags[x] += 1
        flush()


def _density(text: str, stop_words: frozenset[str]) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in stop_words for w in found) / max(1, len(found))


def _first_pass(page: Page, stop_words: frozenset[str]) -> list[bool | None]:
    density = [_density(b["text"], stop_words) for b in page.blocks]
    linked = [b["links"] > LINKS * len(b["text"]) for b in page.blocks]
    dense = [len(b["text"]) >= LONG and d >= DENSE and not l and not b["strong"] for b, d, l in zip(page.blocks, density, linked, strict=True)]
    in_weak: Counter = Counter()
    for b, good in zip(page.blocks, dense, strict=True):
        in_weak[b["weak"]] += len(b["text"]) if good else 0
    most = sum(in_weak.values()) / 2
    out: list[bool | None] = []
    for i, b in enumerate(page.blocks):
        n = len(b["text"])
        if b["strong"] or linked[i] or (b["weak"] >= 0 and in_weak[b["weak"]] <= most):
            out.append(False)
        elif page.has_article and not b["inside"]:
            out.append(dense[i] and n >= 2 * LONG)
        elif dense[i]:
            out.append(True)
        else:
            among = b["links"] > 0 or (0 < i < len(linked) - 1 and linked[i - 1] and linked[i + 1])
            out.append(False if n >= LONG and density[i] < SPARSE and among else None)
    return out


def _longest_run(page: Page, marks: list[bool | None]) -> list[bool]:
    """Where nothing is good: the undecided blocks of the article, or of the longest run of them."""
    free = [m is None for m in marks]
    if page.has_article:
        return free
    runs, size = [], []
    for i, f in enumerate(free):
        if f and (i == 0 or not free[i - 1]):
            runs.append([i, i])
            size.append(0)
        if f:
            runs[-1][1] = i
            size[-1] += len(page.blocks[i]["text"])
    best = runs[size.index(max(size))] if runs else [1, 0]
    return [best[0] <= i <= best[1] for i in range(len(marks))]


def decide(page: Page, stop_words: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Which blocks are main text."""
    marks = _first_pass(page, stop_words)
    if True not in marks:
        return _longest_run(page, marks)
    n = len(marks)
    before, after, count = [-1] * n, [n] * n, [0] * (n + 1)
    for i in range(n):
        before[i] = i if marks[i] is not None else before[i - 1] if i else -1
        count[i + 1] = count[i] + (marks[i] is not None)
    for i in range(n - 1, -1, -1):
        after[i] = i if marks[i] is not None else after[i + 1] if i + 1 < n else n
    near = [0] * len(page.parent)  # the smallest container around each that has a decided block
    for c in range(1, len(near)):
        near[c] = c if count[page.end[c]] > count[page.start[c]] else near[page.parent[c]]
    out = []
    for i, m in enumerate(marks):
        if m is not None:
            out.append(m)
            continue
        box = near[page.blocks[i]["box"]]
        left = before[i] if before[i] >= page.start[box] else None
        right = after[i] if after[i] < page.end[box] else None
        if right is not None and (page.blocks[i]["heading"] or left is None or marks[left] == marks[right]):
            out.append(marks[right])
        elif right is None:
            out.append(marks[left])
        else:
            out.append(i - left == right - i or marks[left if i - left < right - i else right])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    cut = Page(page)
    return " ".join(b["text"] for b, good in zip(cut.blocks, decide(cut), strict=True) if good)


def extracted(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""
    bounded_batches(pages.sparkSession)
    held, = fresh(pages, "held_html")
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    df = pages.select(*keep, F.col(html_col).cast("string").alias(held))

    def extract(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(held).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return df.transform(arrow, extract, plus(df, keep, "text string, n_chars bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
