"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. A word's score is a sum of log odds, counted over labelled pages, of what it
stands in: the kind of its block (text, heading, list, link), the landmark elements around it, and the words of class
and id names around it. Words that come out positive are candidates and score at most 1 each; the others (an advert
between two paragraphs) are left out, with the tags before them. Tags score negative, by how much rarer they are
inside main text than outside. One linear scan finds the contiguous region with the greatest sum, so words beside the
main text stay out unless they outweigh the tags on the way to them. No part of a page ends the region for good.

Labelled pages are fixed ones of this module, so a page's text depends on nothing else in the table.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import slices, tidy

#: Bounds of one log odds, and what is added to each count.
LEAST, MOST, SMOOTH = -3.0, 1.0, 0.2
#: Bounds of a tag's score, and that of tags which no labelled page has.
TAG_LEAST, TAG_MOST, TAG_OTHER = -1.0, -0.02, -0.2
#: A block of which so large a part stands in links is a link.
LINKED = 0.9

# Elements by what they do to text.
HIDDEN = frozenset("script style noscript template iframe object svg math head title select option textarea canvas audio video datalist".split())
RAW = frozenset("script style textarea title".split())
LANDMARKS = frozenset("nav header footer aside form menu dialog button fieldset article main".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCKS - frozenset("p li dt dd td th tr tbody thead tfoot hr caption h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Every part stops at the next "<" or takes all it can for good, so that no page takes more than linear time.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:"[^"<]*+"|'[^'<]*+'|[^>"'<])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN_ATTR = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class Block:
    """Text between two block boundaries, with the surroundings that its words share."""

    kind: str  # heading, list, text; link if nearly all of it is in links
    around: tuple[str, ...]  # landmark elements and names around it
    parts: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)  # tags before it
    linked: int = 0  # characters in links

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def named(attributes: str) -> tuple[str, ...]:
    """Class, id, role and label names of an element, lower-cased, each as ``.first-second``."""
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
    return tuple("." + "-".join(w) for w in (re.findall(r"[a-z]+", x) for x in found.split()) if w)


def parse(page: str) -> list[Block]:
    """Blocks of a page in order. Unclosed and stray tags are put up with."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open containers: element, what it adds to its surroundings
    hidden, anchor, tags = [], 0, []
    leaf, leaf_names = "", ()
    current: Block | None = None

    def add(piece: str) -> None:
        nonlocal current, tags
        if current is None:
            if not piece.strip():
                return
            kind = "heading" if leaf in HEADINGS else "list" if leaf == "li" else "text"
            current = Block(kind, tuple(dict.fromkeys([x for _, each in stack for x in each] + [*leaf_names])), tags=tags)
            tags = []
            blocks.append(current)
        current.parts.append(piece)
        if anchor:
            current.linked += len(piece.strip())

    at = 0
    end_of = {}
    page = page[: page.rfind(">") + 1] + re.sub(r"<[a-zA-Z/!?].*", "", page[page.rfind(">") + 1 :], flags=re.S)  # a tag that is cut off
    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece and not hidden:
            add(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in RAW:
            end = end_of.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I)).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in HIDDEN:
            if closing and name in hidden:
                while hidden.pop() != name:
                    pass
            elif not closing and not attributes.endswith("/"):
                hidden.append(name)
            continue
        if hidden and name in ("body", "article", "main"):
            hidden.clear()  # a head that was never closed
        if hidden:
            continue
        if name in BLOCKS:
            tags.append(name)
        if name == "a":
            anchor = 0 if closing else 1
        elif name == "br":
            if current is not None:
                add(" ")
        if name not in BLOCKS:
            continue
        current, anchor = None, 0
        leaf, leaf_names = ("", ()) if closing or name in CONTAINERS else (name, _around(name, attributes, stack))
        if name in CONTAINERS and name not in VOID:
            if not closing:
                stack.append((name, _around(name, attributes, stack)))
            elif any(x == name for x, _ in stack):
                while stack.pop()[0] != name:
                    pass
    for b in blocks:
        if b.linked >= LINKED * sum(len(p.strip()) for p in b.parts):
            b.kind = "link"
    return blocks


def _around(name: str, attributes: str, stack: list[tuple[str, tuple[str, ...]]]) -> tuple[str, ...]:
    """What an element says of the words in it. The header of an article is not that of a page."""
    own = (name,) if name in LANDMARKS and not (name == "header" and any(x in MAIN for x, _ in stack)) else ()
    if name not in ("html", "body"):
        own += named(attributes)
    return own + ((".hidden",) if attributes and _HIDDEN_ATTR.search(attributes) else ())


@dataclass
class Weights:
    """Log odds of kinds of blocks, of surroundings, and of tags, between main text and the rest."""

    words: dict[str, float]
    tags: dict[str, float]

    def name(self, x: str) -> float:
        """Log odds of a name: as a whole, or by its last word, or, for half, by its first."""
        if x in self.words or not x.startswith("."):
            return self.words.get(x, 0.0)
        first, *_, last = (x[1:].split("-") * 2)[: max(2, x.count("-") + 1)]
        return self.words["." + last] if "." + last in self.words else self.words.get("." + first, 0.0) / 2

    def word(self, b: Block) -> float:
        """Score of each word of a block; without a positive one its words are no main text."""
        return max(LEAST, min(1.0, self.words.get(b.kind, 0.0) + sum(map(self.name, b.around))))

    def tag(self, t: str) -> float:
        return self.tags.get(t, TAG_OTHER)


# Small labelled pages. {...} marks the main text.
LABELLED = [
    "<body><nav><a>Home</a><a>News</a></nav><div id=content><h1>{Rain in the hills}</h1><p>{It rained for three days and the river rose.}</p><p>{Nobody was hurt.}</p></div><footer>All rights reserved by the paper</footer></body>",
    "<body><header><div>Daily site name and its motto</div></header><div class=post><h2>{A short walk}</h2><p>{We went along the old road to the mill.}</p><ul><li>{bread}</li><li>{cheese and apples}</li></ul><p>{Then we came home.}</p></div><div class=comments><p>Nice story, thanks for that</p><div class=comment>I went there too last year</div></div></body>",
    "<body><div><a>One</a></div><div><a>Two</a></div><div class=cookie-notice>This site uses cookies to work</div><div class=cookie>We value your privacy</div><div id=notice>Please read our new terms</div><p>{The council met on Monday to talk about the bridge.}</p><p>{It will be closed in May.}</p><aside><p>Read our other pieces about bridges</p></aside><p>{The work takes a month.}</p></body>",
    "<body><ul><li><a>Shop</a></li><li><a>Cart</a></li></ul><main><h1>{On bees}</h1><p>{Bees live in hives and make honey from what flowers give.}</p><div class=ad><p>Buy honey now at our shop</p></div><p>{They sleep in winter.}</p></main><form><p>Your e-mail address here</p></form></body>",
    "<body><article><h1>{Notes}</h1><p>{First of all, the plan was never written down by anyone.}</p><p class=ads>A word from those who pay</p></article><section class=related><p>More to read from us here</p></section><footer><p>Contact and imprint</p></footer></body>",
    "<body><div class=banner>Sale until Sunday only</div><div class=menu><ul><li><a>Start</a></li><li><a>About us</a></li></ul></div><div class=text><h1>{How to bake}</h1><ol><li>{Mix the flour with water and salt.}</li><li>{Let it rest for an hour.}</li><li>{Bake it until it is brown.}</li></ol></div><div class=sidebar><h3>Popular</h3><p>What others read this week</p></div></body>",
    "<body><div class=breadcrumbs><a>Home</a> and <a>Science</a></div><div class=entry><h1>{The moon}</h1><p>{The moon goes round the earth in a month.}</p><blockquote>{It is a world of its own.}</blockquote><div class=share>Tell your friends about it</div><p>{It has no air.}</p></div><div class=newsletter>Get our letter each week</div><div class=promo>Three months for the price of one</div></body>",
    "<body><table><tr><td><a>Forum</a></td><td><a>Help</a></td></tr></table><div><h2>{Fixing a bike}</h2><p>{Turn the wheel and listen for a click.}</p><table><tr><td>{front wheel}</td><td>{rear wheel}</td></tr></table><p>{Oil the chain last.}</p></div><div class=footer>Made by a small team</div><div class=copyright>All rights reserved</div></body>",
    "<body><div class=popup><p>Sign up and save ten percent</p></div><dialog><p>Do you accept our terms</p></dialog><article><header><h1>{A day at sea}</h1></header><p>{We left before the sun was up, and the wind was cold.}</p><figure><figcaption>{The harbour at dawn}</figcaption></figure><p>{By noon we were far out.}</p><footer><p>Posted in travel by the editor</p></footer></article><div class=sponsored>Paid for by a bank</div><div class=advertisement>The best loans in town</div></body>",
    "<body><header><p>Welcome to the town's own page</p></header><menu><li>File</li><li>Edit</li></menu><main><article><h1>{Snow}</h1><p>{Snow fell on the town for the first time in ten years.}</p></article><article class=comment><p>We had none here at all</p></article><section class=replies><p>Same here, no snow yet</p></section></main><button>Load more of them</button><fieldset>Choose your town here</fieldset></body>",
    "<body><div class=widget>Weather for the week ahead</div><div class=nav><p>Up one level or down</p></div><div class=story><h1>{The old school}</h1><p>{The old school closed after a hundred years.}</p><div class=related>See also what we wrote then</div><div class=tags>schools and towns</div><p>{Its bell is kept in the church.}</p></div><div class=consent>Do you allow us to count visits</div><div class=subscribe>Pay and read on</div></body>",
    "<body><div class=login>Name and password please</div><div class=search>Find it on this site</div><div class=social>Follow us here and there</div><div id=main><h1>{Salt}</h1><p>{Salt was once worth as much as gold.}</p><p>{Roads were built for it.}</p></div><div class=pager>Next page or last page</div><div class=legal>No liability for what is said</div><div class=recommended>You may like these too</div><div hidden>Not to be seen by anyone</div></body>",
    "<body><div class=ad-slot>Cheap flights to the south</div><div class=ad-container>New shoes for half</div><div class=site-header>The Evening Post online</div><div class=body><h1>{A choir}</h1><section><p>{The choir sang in the square until it was dark.}</p><p>{People stayed to listen, though it was cold.}</p></section></div><div class=comment-list><p>I was there and it was fine</p></div><div class=discussion>Have your say below</div><div class=respond>Leave a reply with your name</div></body>",
    "<body><div class=overlay>Wait, do not go yet</div><div class=modal>One more thing for you</div><div class=toolbar>Print or save it</div><div class=content><h1>{Mills}</h1><p>{There were four mills on this river, and one still turns.}</p><ul><li>{the upper mill, built of stone}</li><li>{the lower mill}</li></ul></div><div class=pagination><a>1</a><a>2</a></div><div class=sharing>Send this to a friend</div><div class=topbar>Call us today or write</div><div class=masthead>The Morning Paper since long ago</div><div class=disqus>Join in and talk about it</div></body>",
]


def count(pages: list[list[tuple[Block, bool]]]) -> Weights:
    """Log odds of kinds, surroundings and tags, by words, between main text and the rest."""
    inside, outside, tin, tout = Counter(), Counter(), Counter(), Counter()
    for blocks in pages:
        for b, main in blocks:
            n = len(b.text.split())
            # What a block's name says counts for the name, not for the kind of block in it.
            for x in b.around or (b.kind,):
                (inside if main else outside)[x] += n
            if main:
                inside[b.kind] += n
            (tin if main else tout).update(b.tags)
    odds = lambda a, b: math.log((a + SMOOTH) / (b + SMOOTH))
    words = {k: max(LEAST, min(MOST, odds(inside[k], outside[k]))) for k in {*inside, *outside}}
    return Weights(words, {t: max(TAG_LEAST, min(TAG_MOST, odds(tin[t], tout[t]))) for t in {*tin, *tout}})


def fixed_pages() -> list[list[tuple[Block, bool]]]:
    found = []
    for page in LABELLED:
        blocks = parse(page)
        labelled = [(b, "{" in b.text) for b in blocks]
        for b in blocks:
            b.parts = [p.replace("{", "").replace("}", "") for p in b.parts]
        found.append(labelled)
    return found


def scores(blocks: list[Block], weights: Weights) -> list[tuple[float, float]]:
    """For each block the score of the tags before it and of all its words."""
    found = []
    for b in blocks:
        word = weights.word(b)
        found.append((sum(map(weights.tag, b.tags)), word * len(b.text.split())) if word > 0 else (0.0, 0.0))
    return found


def best_region(scored: list[tuple[float, float]]) -> tuple[int, int]:
    """First and last block (exclusive) of the region with the greatest sum; empty if no sum is positive.

    A region starts with a block's words, so the tags before its first block do not count.
    """
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, (tags, words) in enumerate(scored):
        total += tags
        if total <= 0:
            total, start = 0.0, i
        total += words
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """Blocks of the best region that score positive, one a line."""
    if not page:
        return ""
    blocks = [b for b in parse(page) if b.text]
    low, high = best_region(scores(blocks, weights))
    return "\n".join(b.text for b in blocks[low:high] if weights.word(b) > 0)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url and text of each row.

    Null or empty html, and pages without main text, give an empty text. Equal pages give equal texts; extra
    columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or count(fixed_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, shared.value) for p in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string")
