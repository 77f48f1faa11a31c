"""Main text of web pages from flat text blocks.

A page is cut into text blocks at block-level tags, in one pass. A block is described by its word
count and link density, those of the blocks before and after it, by marks of the elements it
stands in, and by how much plain text its container holds. A decision tree, trained on the
labelled pages that the rule below writes, keeps or drops it.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.shared import map_arrow

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea svg math iframe object head title select option button audio video canvas".split())
_RAW_END = {n: re.compile(rf"</{n}\s*[^>]*>", re.I) for n in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
#: Elements that are followed while open; others end a block and are forgotten.
FOLLOWED = frozenset("div section article main nav header footer aside form ul ol dl table td th figure dialog menu fieldset blockquote details".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements whose blocks belong to the container around them.
LOOSE = frozenset("ul ol dl figure blockquote details".split())
#: Words of class, id and role that mark a part of a page as something else than its text ...
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations "
    "teaser teasers comment comments commentlist reply replies discussion disqus responses".split()
)
#: ... or as a part of its frame, which may well stand around the text too.
FRAME = frozenset(
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header copyright legal widget widgets toolbar login search skip rating complementary contentinfo tags".split()
)
#: ... or as its text.
CONTENT = frozenset("content main article post entry story articlebody maincontent".split())
_STATES = frozenset("has no with without is show hide hidden open closed".split())

Block = tuple[str, list[float]]
#: Order of the features of a block. ``content``, ``boiler`` and ``hinted``: the nearest marked element
#: around it is one of text, a boilerplate element, or marked by its names; ``share`` and ``kin``: the part of the page's plain words
#: that its container holds, and the plain words of the container's other blocks.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "boiler", "hinted", "heading", "share", "kin")


def marks_of(names: str) -> tuple[bool, bool, bool]:
    """Whether the names of an element mark it as other, as frame, as content. Names that tell
    a state of the page (has-sidebar, page-with-menu, tags-open) mark nothing."""
    other = frame = content = False
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split():
        parts = re.split(r"[_-]+", name)
        if not _STATES.isdisjoint(parts):
            continue
        odd, edge = not OTHER.isdisjoint(parts), not FRAME.isdisjoint(parts)
        other, frame = other or odd, frame or edge
        content = content or not (odd or edge or CONTENT.isdisjoint(parts))
    return other, frame, content


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, content, boilerplate, hinted, heading, container) of each block.
    Each character is looked at a bounded number of times, however the markup is broken."""
    out: list[tuple] = []
    # name, content, boilerplate, hinted, other, container
    top = ("", False, False, False, False, 0)
    stack = [top]
    open_names: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link = heading = containers = 0
    endless: set[str] = set()
    last_end = page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                n = len(words)
                dense = min(1.0, len(html.unescape("".join(linked)).split()) / n) if linked else 0.0
                out.append((" ".join(words), float(n), dense, *map(float, stack[-1][1:4]), float(heading), stack[-1][5]))
            parts, linked = [], []

    def text(t: str) -> None:
        parts.append(t)
        if in_link:
            linked.append(t)

    def pop(name: str) -> None:
        if open_names.get(name):
            while True:
                gone = stack.pop()[0]
                open_names[gone] -= 1
                if gone == name:
                    return

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt != at:
            text(page[at : lt if lt >= 0 else size])
            at = lt if lt >= 0 else size
            continue
        m = _NAME.match(page, at + 1)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                parts.append(html.escape(page[at + 9 : end if end >= 0 else size], quote=False))
                at = end + 3 if end >= 0 else size
            elif page.startswith(("<!", "<?", "</"), at):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else size
            else:
                text("<")
                at += 1
            continue
        # the tag ends at the first > outside a quoted value
        here = m.end()
        if here > last_end:
            break
        end = here
        while True:
            stop = _STOP.search(page, end)
            if stop is None:
                end = size
                break
            end = stop.end()
            if stop[0] == ">":
                break
            if page[end - 2 : end - 1] == "=" and last_quote[stop[0]] >= end:
                end = page.find(stop[0], end) + 1
        attributes = page[here : end - 1] if end <= size and page[end - 1] == ">" else page[here:end]
        at = end
        name = m[0].lower()
        ends, empty = name[0] == "/", attributes.endswith("/")
        name = name.lstrip("/")
        if name in INLINE:
            if name == "a":
                in_link = 0 if ends else 1
            elif name in ("img", "input"):
                parts.append(" ")
            continue
        if name in RAW:
            if not ends and not empty:
                if name not in ("select", "option", "button", "title"):
                    close()
                found = None if name in endless else _RAW_END[name].search(page, at)
                if found is None:
                    # an element that is never closed ends with the page, but for a head without an end
                    endless.add(name)
                    at = at if name in ("head", "option") else size
                else:
                    at = found.end()
            continue
        close()
        in_link = 0
        if name[0] == "h" and name[1:].isdigit():
            heading = 0 if ends else 1
            continue
        if name in ("p", "br", "li", "tr"):
            heading = 0
        if name not in FOLLOWED:
            continue
        heading = 0
        if ends:
            pop(name)
            continue
        if empty:
            continue
        if name in ("td", "th") and stack[-1][0] in ("td", "th"):
            pop(stack[-1][0])
        _, content, boiler, hinted, strong, container = stack[-1]
        names = " ".join(next(filter(None, g), "") for g in _NAMES.findall(attributes)) if "=" in attributes else ""
        other, frame, texts = marks_of(names) if names else (False, False, False)
        own = name in ("article", "main")
        if other and not (own and not {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "teaser"} & set(re.split(r"[\s_-]+", names.lower()))):
            hinted, strong = True, True
        elif own or (texts and not frame and not other):
            # what stands around the text as a frame doesn't count in it; what is something else does
            content, boiler, hinted = True, False, strong
        elif frame and not own:
            hinted = True
        if name in BOILER or (name == "header" and not content):
            boiler = True
        if name not in LOOSE:
            containers += 1
            container = containers
        stack.append((name, content, boiler, hinted, strong, container))
        open_names[name] = open_names.get(name, 0) + 1
    close()
    return out


def features(found: list) -> np.ndarray:
    """A row of FEATURES for each block; a page's edge counts as an empty block."""
    own = np.array([b[1:7] for b in found], float).reshape(-1, 6)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])
    at = np.array([b[7] for b in found], np.int64)
    plain = own[:, 0] * (1 - own[:, 1]) * (own[:, 3] == 0) * (own[:, 4] == 0)
    held = np.bincount(at, plain, at.max() + 1)[at] if len(at) else plain
    return np.hstack([own[:, :2], before[: len(own)], after[: len(own)], own[:, 2:], (held / max(1.0, plain.sum()))[:, None], (held - plain)[:, None]])


#: The labelled table: pages whose blocks are main text where their element has the mark ``data-m``.
LABELLED_PAGES = (
    """<header><h1>Daily Paper</h1><p>News since 1901</p></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World news</a></li></ul></nav>
    <div class="ad">Buy one get one free today only.</div><article><h1 data-m>Storm reaches the coast</h1><p data-m>The storm reached the coast late on Sunday and left thousands of homes without light or water.</p>
    <p data-m>Short.</p><p data-m>Officials said that repairs would take several days and that more rain is due before the end of the week.</p>
    <div class="ad">Cheap flights to the sun.</div><p data-m>See also <a href=/x>the map</a> of all closed roads.</p><p data-m>Stay safe.</p>
    <div class="comments"><p>I saw it from my window and it was the worst storm I can remember in thirty years.</p><p>Me too.</p></div></article>
    <aside><h3>Most read</h3><p>A long teaser about another story that has nothing to do with this page.</p></aside><footer>&copy; Daily Paper. All rights reserved.</footer>""",
    """<div id="menu"><a href=/>Start</a> <a href=/k>Kontakt</a></div><div id="content"><h2 data-m>Ein Rezept</h2>
    <p data-m>Zuerst werden die Zwiebeln fein gehackt und in heißer Butter langsam goldbraun gebraten, dann kommt das Mehl dazu.</p><p data-m>Salzen.</p>
    <p data-m>Nach zwanzig Minuten wird alles durch ein Sieb gegeben und mit etwas Sahne verfeinert, bevor man es serviert.</p></div>
    <div class="cookie-notice">Wir verwenden Cookies, um diese Seite besser zu machen, und Sie stimmen dem zu.</div><div>Impressum</div>""",
    """<p><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sport</a></p><p data-m>The committee met for the third time this year and agreed on a plan that will change how the river is used by boats and swimmers.</p>
    <p data-m>Its members had argued about the plan for months, and two of them left the room before the final vote was taken.</p><p data-m>No one else did.</p>
    <p data-m>The plan will be published in the spring, after the council has read it and the public has had time to comment on it.</p><p><a href=/1>Next story about boats</a></p><p><a href=/2>Older stories from the archive</a></p><p>Copyright 2020</p>""",
    """<form><p>Enter your name and your address below to receive a letter from us every week.</p></form><main><p data-m>Todo empezó una mañana de abril cuando el viejo barco volvió al puerto sin nadie a bordo.</p>
    <ul><li data-m>Una vela rota</li><li data-m>Dos mapas</li></ul><ul class="related"><li><a href=/q>Otra historia del mar</a></li></ul><p data-m>Nadie supo por qué.</p></main>
    <nav>Usted está aquí: inicio, historias, mar y otros lugares que visitar</nav><div class="sidebar"><p>Suscríbase para leer cada semana una historia nueva en su correo.</p></div><footer><p>Todos los derechos reservados por los autores de esta página y sus amigos.</p></footer>""",
    """<article><h1 data-m>On walking</h1><p data-m>Walk.</p><p data-m>Then walk again, and do not count the steps, for counting is not walking and walking is not counting.</p><p data-m><a href=/w>Walking shoes</a> help a little.</p>
    <section id="share">Share this page with your friends and tell them what you think of it.</section><p data-m>The end.</p></article><div>Ten people like this</div><div class="notice">This site will be closed for repairs on Sunday from two until four.</div>""",
    """<div><a href=/>Home</a></div><div data-m>Kurz gesagt war die Reise lang, der Wagen alt und das Wetter schlecht, aber wir haben viel gelacht und gut gegessen.</div><div data-m>Am Abend kamen wir an, müde und froh, und niemand wollte mehr ein Wort über den Motor hören.</div><div><a href=/z>Zurück zur Liste aller Reisen</a></div><div>Seite 3</div>""",
    """<div class="ad">Achetez deux livres.</div><p data-m>Le matin, la ville dort encore et les rues sont vides, mais le boulanger travaille depuis longtemps déjà et son pain est chaud.</p>
    <div class="banner">Une offre pour vous, valable cette semaine seulement, dans tous nos magasins de la ville et sur notre site.</div><p data-m>À midi tout change, les marchands crient et les enfants courent entre les tables sous le grand soleil de la place.</p>
    <div class="widget">Il fait beau.</div><p data-m>Le soir, on ferme les volets, on parle un peu devant les portes, et la ville dort de nouveau jusqu'au matin suivant.</p><div class="comments"><p>Très beau texte, merci beaucoup, il me rappelle la ville de mon enfance et le pain de ma grand-mère.</p></div>
    <footer>Écrit pour le journal du village par ses lecteurs, imprimé une fois par mois sur du papier recyclé.</footer>""",
    """<nav>All pages of this handbook in order of their number, from the first to the last one, with notes.</nav><nav>Start.</nav><article><div class="promo">New: the second edition.</div><p data-m>Turn the wheel to the left until it stops and then wait for the light to go out before you open the door.</p>
    <div class="promo">Order the second edition now and get the first one for half of its price, while there are copies left.</div><p data-m>Do not force it.</p><aside>Tip of the day.</aside><p data-m>When the light stays on for more than a minute the wheel has to be cleaned with warm water and a soft cloth.</p><aside>Readers who liked this page also liked the page on wheels, the page on doors, and the page on lights.</aside>
    <form>Was this page helpful to you?</form><form>Please tell us in a few words what we could do better on this page, and leave your address if you like.</form></article><footer>Printed on paper.</footer><header>The handbook of wheels and doors for those who repair them at home with their own hands.</header>""",
)
#: Surroundings of the text in the pages that ``written_pages`` writes.
FRAMES = (
    "<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>", "<section class=post-content>{}</section>", "<div class='layout has-sidebar'><article>{}</article></div>",
    "<div class=page-with-menu><div id=main>{}</div></div>", "<article class='post tags-open related'>{}</article>", "<div>{}</div>", "<section>{}</section>", "{}",
    "<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{}</td></tr></table>", "<div class=wrapper><div>{}</div></div>", "<div class=sidebar-layout-with-menu>{}</div>",
)
#: Elements that hold something else, wherever they stand.
ASIDES = ("nav", "footer", "aside", "form", "div class=ad", "div class=cookie-notice", "div class=comments", "div id=sidebar", "div class='related-posts'", "section id=share", "div role=navigation", "div class=promo-box")


def written_pages(seed: int = 7, many: int = 156) -> list[str]:
    """Labelled pages by rule: text in each of FRAMES, of paragraphs of 1 to 400 words, with a
    few links, headings and lists, among ASIDES, lists of links and short lines."""
    rng = random.Random(seed)
    words = lambda n: " ".join(["word"] * n)
    out = []
    for k in range(many):
        frame = FRAMES[k % len(FRAMES)]
        bare = frame == "{}"
        wrapped = not bare and rng.random() < 0.3
        most = 60 if rng.random() < 0.2 else 14

        def aside() -> str:
            tag = rng.choice(ASIDES)
            n = rng.choice((1, 2, 4, 8, 15, 30, 60, 120, 250))
            inner = rng.choice((f"<p>{words(n)}</p>", words(n), f"<ul><li><a href=/x>{words(2)}</a><li><a href=/y>{words(3)}</a></ul>"))
            return f"<{tag}>{inner}</{tag.split()[0]}>"

        def links() -> str:
            return "<ul>" + "".join(f"<li><a href=/{i}>{words(rng.randint(1, 9))}</a></li>" for i in range(rng.randint(2, 8))) + "</ul>"

        def line() -> str:
            return f"<div>{words(rng.randint(1, 5))}</div>"

        def paragraph() -> str:
            n = round(10 ** rng.uniform(0, 2.6))
            tag = "div" if wrapped else "p"
            if n > 5 and rng.random() < 0.25:
                linked = rng.randint(1, max(1, n // 3))
                return f"<{tag} data-m>{words(n - linked)} <a href=/w>{words(linked)}</a></{tag}>"
            return f"<{tag} data-m>{words(n)}</{tag}>"

        body = [f"<h1 data-m>{words(rng.randint(2, 9))}</h1>" if rng.random() < 0.7 else f"<h2 data-m><a href=/t>{words(4)}</a></h2>"] if not bare and k % 3 else []
        body.append(f"<p data-m>{words(rng.randint(20, 200))}</p>")
        for _ in range(rng.randint(2, most)):
            body.append(paragraph())
            r = rng.random()
            if r < 0.12:
                body.append(aside())
            elif r < 0.2:
                body.append(links())
            elif r < 0.28 and not bare:
                body.append("<ul>" + "".join(f"<li data-m>{words(rng.randint(1, 12))}</li>" for _ in range(3)) + "</ul>")
        body.append(f"<p data-m>{words(rng.randint(15, 120))}</p>")
        head = "".join(rng.choice((aside, links, aside) if bare else (aside, links, line))() for _ in range(rng.randint(0, 4)))
        foot = "".join(rng.choice((aside, links, aside) if bare else (aside, links, line))() for _ in range(rng.randint(0, 4)))
        out.append(head + frame.format("".join(body)) + foot)
    return out


#: Blocks that a leaf of the tree stands for, at least.
LEAF = 4


class Tree:
    """A binary decision tree by Gini impurity, of bounded depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.leaf = float(y.mean()) if len(y) else 0.0
        self.feature = None
        if depth == 0 or len(y) < 2 * LEAF or self.leaf in (0.0, 1.0):
            return
        best = len(y) * self.leaf * (1 - self.leaf) - 1e-9
        # marks of elements come first: among equal splits the first one is taken
        for f in (8, 7, 6, 9, 1, 11, 10, 0, 3, 5, 2, 4):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            mean_a, mean_b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            cost = n * mean_a * (1 - mean_a) + (len(y) - n) * mean_b * (1 - mean_b)
            cost[(v[1:] == v[:-1]) | (n < LEAF) | (len(y) - n < LEAF)] = np.inf
            k = int(cost.argmin())
            if cost[k] < best:
                best, self.feature, self.cut = float(cost[k]), f, (v[k] + v[k + 1]) / 2
        if self.feature is not None:
            low = x[:, self.feature] <= self.cut
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.leaf)
        out = np.empty(len(x))
        low = x[:, self.feature] <= self.cut
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    xs, ys = [], []
    for page in (*LABELLED_PAGES, *written_pages()):
        marked = re.sub(r"(<[^<>]*\bdata-m\b[^<>]*>)", "\\1\u0001", page)
        found = blocks(marked)
        # the mark joins the first word of its block, so counts are as without it
        ys += [1.0 if "\u0001" in b[0] else 0.0 for b in found]
        xs.append(features(found))
    return np.vstack(xs), np.array(ys)


_tree: Tree | None = None


def tree() -> Tree:
    global _tree
    if _tree is None:
        _tree = Tree(*labelled_table())
    return _tree


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of a page, number of blocks kept, number of blocks."""
    found = blocks(page) if page else []
    if not found:
        return "", 0, 0
    keep = tree().predict(features(found)) > 0.5
    kept = [b[0] for b, k in zip(found, keep, strict=True) if k]
    return " ".join(kept), len(kept), len(found)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_kept, n_blocks for every row of ``pages(page_id, url, html, ...)``.

    A null or empty page, and one without main text, has an empty text. Broken markup is read
    as far as it goes. Repeated rows and null ids each give a row; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batch):
        got = [main_text(t) for t in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array([g[0] for g in got], pa.string()),
                pa.array([len(g[0]) for g in got], pa.int64()),
                pa.array([g[1] for g in got], pa.int64()),
                pa.array([g[2] for g in got], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"],
        )

    return map_arrow(
        pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")),
        run,
        "page_id bigint, url string, text string, n_chars bigint, n_kept bigint, n_blocks bigint",
    )
