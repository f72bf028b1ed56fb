"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags. Each block has features of
its ancestors (tags, class and id words, roles) and of its text (length, links, punctuation). A chain of two labels,
content and clutter, is trained on labelled pages by its exact likelihood (forward and backward sums over padded
batches), and a page is decoded by Viterbi. The labelled pages come from a rule: page templates whose blocks are marked.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, table

BLOCK_TAGS = set("address article aside audio blockquote body br button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre section summary svg table tbody td tfoot th thead tr ul video".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = set("head title script style template iframe textarea select noframes annotation annotation-xml desc metadata".split())
#: An opening tag closes an open one of these below the nearest boundary.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = set("article aside body div footer form header html main nav section table ul ol dl td th".split())

#: Words of classes, ids and roles by what they say of a block.
LEXICON = {
    "menu": "nav navbar navigation menu menubar topnav breadcrumb breadcrumbs crumbs tabs toc pager pagination links sitemap skip dropdown",
    "top": "header masthead banner topbar logo branding sitename tagline head",
    "foot": "footer foot colophon copyright contentinfo legal bottom credits imprint",
    "side": "sidebar aside side widget widgets rail complementary related recommended recommendations popular trending more recent tags archive",
    "notice": "cookie cookies consent gdpr notice alert alertdialog warning disclaimer popup modal overlay dialog privacy message toast paywall status",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense commercial teaser outbrain taboola",
    "form": "form search login signup subscribe subscription newsletter register contact input searchbox feedback survey poll",
    "share": "share sharing social follow facebook twitter toolbar tools print buttons",
    "comment": "comment comments commentlist discussion disqus reply replies respond responses reader reactions thread",
    "content": "content article main post entry story body text maincontent mainbody articlebody page blogpost prose richtext copy",
}
OF_WORD = {w: k for k, words in reversed(LEXICON.items()) for w in words.split()}
CLUTTER_TAGS = {"nav": "menu", "header": "top", "footer": "foot", "aside": "side", "form": "form", "menu": "menu", "dialog": "notice", "noscript": "notice", "fieldset": "form", "article": "content", "main": "content"}


class Node:
    """An open tag, and what its path says: the innermost kinds, and the features of all its tags. A node that says nothing new
    shares its parent's set, so that deep pages need no more memory than flat ones."""

    __slots__ = ("tag", "label", "kind", "clutter", "content", "said")

    def __init__(self, parent: Node | None, tag: str, words: list[str], label: str | None, known: dict | None):
        self.tag, self.label = tag, label or (parent.label if parent else None)
        self.kind, self.clutter, self.content, said = (parent.kind, parent.clutter, parent.content, parent.said) if parent else ("none", "none", False, frozenset())
        own = {CLUTTER_TAGS[tag]} if tag in CLUTTER_TAGS else set()
        names = {f"tag={tag}"}
        for w in words:
            kind = OF_WORD.get(w) or OF_WORD.get(w.rstrip("0123456789"))
            names.add(f"kind={kind}" if kind else f"word={w}")
            if kind:
                own.add(kind)
        kinds = sorted(own - {"content"}) or sorted(own)
        names |= {f"kind={k}" for k in kinds}
        if kinds:
            self.kind = kinds[-1]
            if kinds == ["content"]:
                self.content = True
            else:
                self.clutter = "inside content" if self.content else "outside content"
        if known is not None:
            names = {x for x in names if x in known}
        self.said = said if names <= said else said | names

    def features(self) -> list[str]:
        """What the ancestors say: tags, class words, the kinds of both, and the innermost kinds."""
        return [*self.said, f"parent={self.tag}", f"inner={self.kind}", f"clutter={self.clutter}", "content" if self.content else "no content"]


#: Elements whose content is text up to their end tag.
RAW_TAGS = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")


class RawEnd:
    """Finds the end tag of an element with raw text. In a script that holds `<!--`, `<script` up to `</script` nests, until `-->`."""

    def __init__(self, tag: str):
        self.mark = re.compile(rf"<!--|-->|<(/?){tag}(?=[\s/>])", re.IGNORECASE)
        self.script = tag == "script"

    def search(self, raw: str, at: int):
        escaped = nested = False
        for m in self.mark.finditer(raw, at):
            if m[0] == "<!--":
                escaped = True
            elif m[0] == "-->":
                escaped = nested = False
            elif not m[1]:
                nested = escaped and self.script
            elif nested:
                nested = False
            else:
                return m
        return None


class Blocks(HTMLParser):
    """Collects the leaf blocks of a page: (text, node, characters in links, label). known: the features that matter, or all. The page is fed
    whole, so that what is not closed is known to go on to the end."""

    CDATA_CONTENT_ELEMENTS = RAW_TAGS

    def __init__(self, known: dict | None = None):
        super().__init__(convert_charrefs=True)
        self.known = known
        self.outside = Node(None, "none", [], None, {})
        self.stack: list[Node] = []
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0
        self.node = self.outside
        self.found: list[tuple[str, Node, int, str | None]] = []

    def set_cdata_mode(self, elem):
        """Scripts and styles go on to the end where they are not closed; other raw text is then read as markup, as it hides a whole page."""
        end = RawEnd(elem)
        if elem in ("script", "style") or end.search(self.rawdata, self.rawdata.find(">", self.began)):
            self.cdata_elem, self.interesting = elem, end

    def parse_starttag(self, i):
        self.began = i
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        if self.cdata_elem is None:
            return super().parse_endtag(i)
        elem, end = self.cdata_elem, self.rawdata.find(">", i)
        self.clear_cdata_mode()
        self.handle_endtag(elem)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i, report=1):
        """Closed by `-->` or `--!>`; `<!-->` and `<!--->` are whole comments. Met between tags only: the parser knows where it stands."""
        end = re.compile(r"-?>").match(self.rawdata, i + 4) or re.compile(r"--!?>").search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i):
        """To the next `>`, CDATA too; within SVG and MathML CDATA is text."""
        if self.rawdata.startswith("<![CDATA[", i) and (self.open.get("svg") or self.open.get("math")):
            end = self.rawdata.find("]]>", i)
            self.handle_data(self.rawdata[i + 9 : end] if end >= 0 else self.rawdata[i + 9 :])
            return end + 3 if end >= 0 else len(self.rawdata)
        return self.parse_pi(i)

    def parse_pi(self, i):
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append((text, self.node, self.linked, self.node.label))
            self.parts, self.linked = [], 0

    def pop_to(self, depth: int):
        for node in self.stack[depth:]:
            self.silent -= node.tag in SILENT_TAGS
            self.links -= node.tag == "a"
            self.open[node.tag] -= 1
        del self.stack[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            closing = CLOSES.get(tag, set()) if tag in CLOSES else {"p"}
            for depth in range(len(self.stack) - 1, -1, -1):
                open_tag = self.stack[depth].tag
                if open_tag in closing or open_tag == "p":
                    if tag != "br":
                        self.pop_to(depth)
                    if open_tag in closing:
                        break
                elif open_tag in BOUNDARY:
                    break
        elif self.stack and self.stack[-1].tag == "head" and tag not in SILENT_TAGS | VOID_TAGS | {"noscript"}:
            self.pop_to(len(self.stack) - 1)
        if tag == "body" and self.open.get("head"):  # an unclosed head ends here
            self.pop_to(next(d for d, x in enumerate(self.stack) if x.tag == "head"))
        if tag in VOID_TAGS:
            return
        words, label = [], None
        for key, value in attrs:
            if value and key in ("class", "id", "role", "itemprop"):
                words += "".join(c if c.isalnum() else " " for c in value).lower().split()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and "display:none" in value.replace(" ", "").lower():
                words.append("hidden")
            elif key == "data-block-label":
                label = value
        self.stack.append(Node(self.stack[-1] if self.stack else self.outside, tag, words, label, self.known))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT_TAGS
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if not self.open.get(tag):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth].tag == tag:
                self.pop_to(depth)
                return
            if self.stack[depth].tag in BOUNDARY and tag not in BLOCK_TAGS:
                return

    def handle_data(self, data):
        if not self.silent:
            if not self.parts:
                self.node = self.stack[-1] if self.stack else self.outside
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


INTERNAL_SUBSET = re.compile(r"<!doctype[^>\[]*\[[^\]]*\]\s*>", re.IGNORECASE)


def blocks_of(html: str, known: dict | None = None) -> list[tuple[str, Node, int, str | None]]:
    """The leaf blocks of a page in order. Tags may be unclosed or unopened; a comment that is not closed goes on to the end."""
    html = INTERNAL_SUBSET.sub("", html, count=1)
    parser = Blocks(known)
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


#: Marks of clutter in a text.
PHRASES = ("©", "copyright", "all rights reserved", "cookie", "subscribe", "newsletter", "sign in", "log in", "sign up", "advert", "sponsored", "comments", "reply", "share", "read more", "privacy policy", "terms of")


def text_features(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    low = text.lower()
    out = ["words=" + ("1" if words == 1 else "2-4" if words < 5 else "5-12" if words < 13 else "13-40" if words < 41 else "41+")]
    share = linked / max(1, len(text))
    out.append("links=" + ("none" if share == 0 else "some" if share < 0.5 else "most"))
    out.append("ends=" + ("stop" if text[-1] in ".!?…\"'”»)" else "colon" if text[-1] == ":" else "letter"))
    out += [f"says={p}" if 400 * low.count(p) >= len(low) else f"mentions={p}" for p in PHRASES if p in low]
    return out


class ChainField:
    """A linear chain over labels 0 (clutter) and 1 (content): a weight for each feature and label, and for each step."""

    def __init__(self, names: list[str]):
        self.index = {name: i for i, name in enumerate(names)}
        self.weights, self.steps, self.begin = np.zeros((len(names) + 1, 2)), np.zeros((2, 2)), np.zeros(2)

    def active(self, page: list[tuple[str, Node, int, str | None]]) -> list[list[int]]:
        of = self.index.get
        none = len(self.index)
        out = []
        for i, (text, node, linked, _) in enumerate(page):
            names = [*node.features(), *text_features(text, linked), "bias", "first" if i == 0 else "last" if i == len(page) - 1 else "between"]
            out.append([k for k in (of(x, none) for x in names) if k != none])
        return out

    def train(self, pages: list[list[tuple]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> ChainField:
        """Adam on the regularised log-likelihood of all pages at once."""
        rows = [self.active(p) for p in pages]
        longest, n = max(map(len, pages)), len(pages)
        labels = np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        for i, p in enumerate(pages):
            labels[i, : len(p)] = [x[3] == "1" for x in p]
            mask[i, : len(p)] = True
        flat = [f for r in rows for f in r]
        feature = np.array([k for f in flat for k in f])
        heads = np.concatenate([[0], np.cumsum([len(f) for f in flat])[:-1]])
        owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        params = [self.weights, self.steps, self.begin]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        truth = np.eye(2)[labels]
        for t in range(1, rounds + 1):
            node = np.zeros((n, longest, 2))
            node[mask] = np.add.reduceat(self.weights[feature], heads, axis=0)
            forward, backward = np.zeros_like(node), np.zeros_like(node)
            forward[:, 0] = node[:, 0] + self.begin
            for j in range(1, longest):
                into = np.logaddexp.reduce(forward[:, j - 1, :, None] + self.steps, axis=1) + node[:, j]
                forward[:, j] = np.where(mask[:, j, None], into, forward[:, j - 1])
            for j in range(longest - 2, -1, -1):
                out = np.logaddexp.reduce(self.steps + (node[:, j + 1] + backward[:, j + 1])[:, None, :], axis=2)
                backward[:, j] = np.where(mask[:, j + 1, None], out, 0)
            total = np.logaddexp.reduce(forward[:, -1], axis=1)
            belief = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
            pair = np.exp(forward[:, :-1, :, None] + self.steps + (node + backward)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
            gap = (truth - belief)[mask]
            slope = np.stack([np.bincount(feature, weights=gap[owner, k], minlength=len(self.weights)) for k in (0, 1)], 1)
            seen = truth[:, :-1, :, None] * truth[:, 1:, None, :] * mask[:, 1:, None, None]
            slopes = [slope / n, (seen - pair).sum((0, 1)) / n, (truth[:, 0] - belief[:, 0]).sum(0) / n]
            for k, (p, g) in enumerate(zip(params, slopes, strict=True)):
                g = g - decay * p
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                p += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def decode(self, page: list[tuple]) -> list[bool]:
        """The likeliest labels of a page's blocks, by Viterbi."""
        if not page:
            return []
        node = [self.weights[f].sum(0).tolist() for f in self.active(page)]
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b = node[0][0] + self.begin[0], node[0][1] + self.begin[1]
        back = []
        for x, y in node[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((from_a, from_b))
            a, b = (a + s00 if from_a else b + s10) + x, (a + s01 if from_b else b + s11) + y
        label = b > a
        out = [label]
        for from_a, from_b in reversed(back):
            label = not (from_b if label else from_a)
            out.append(label)
        return out[::-1]


def labelled_page(rng: random.Random) -> str:
    """A page by a rule: templates for clutter around and inside an article, with every block's label marked."""
    syllables = "ba ce di fo gu la me ni po ru sa te vi xo zy an er in on un".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int = 1, hi: int = 16) -> str:
        return " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize() + rng.choice("....?!")

    def some(k: str) -> str:
        return rng.choice(LEXICON[k].split())

    def prose() -> str:
        return escape(" ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 9)))))

    def inline(text: str) -> str:
        return rng.choice((text, text, f"<b>{text}</b>", f'{text} <a href="/x">{word()}</a> {word()}.', f"{text}<br>{prose()}", f"{text} <math><mi>{word()}</mi><mo>=</mo><mn>{rng.randint(0, 99)}</mn></math> {word()}."))

    def named(k: str, tags: str = "div div section") -> tuple[str, str]:
        tag = rng.choice(tags.split())
        key = rng.choice(("class", "class", "id"))
        return f'<{tag} {key}="{rng.choice((some(k), f"{some(k)}-{word()}", f"{word()} {some(k)}", f"{word()}_{some(k)}"))}" data-block-label="0">', f"</{tag}>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n)) + "</ul>"

    def clutter(k: str) -> str:
        plain = {"menu": "nav", "top": "header", "foot": "footer", "side": "aside", "form": "form", "notice": "dialog"}
        a, b = (f'<{plain[k]} data-block-label="0">', f"</{plain[k]}>") if k in plain and rng.random() < 0.5 else named(k)
        inside = {
            "menu": lambda: links(rng.randint(2, 8)),
            "top": lambda: rng.choice((f"<h1>{word()}</h1><p>{prose()}</p>", f'<a href="/">{word()}</a>', f"<div>{prose()}</div>")),
            "foot": lambda: rng.choice((f"&copy; {word()}.example.com &middot; {prose()}", f"<p>{prose()}</p>{links(3)}", f"<p>Copyright {word()}. All rights reserved.</p>")),
            "side": lambda: f"<h3>{word()}</h3>" + rng.choice((links(4), f"<p>{prose()}</p>")),
            "notice": lambda: rng.choice((f"<p>{prose()}</p>", f"We use cookies. {prose()}", prose())),
            "advert": lambda: rng.choice((prose(), f"<p>{prose()}</p>", f'<a href="/buy">{prose()}</a>')),
            "form": lambda: f"<label>{word()}</label> <input><p>{prose()}</p>",
            "share": lambda: links(3),
            "comment": lambda: f"<h3>{rng.choice(('Comments', word()))}</h3>" + "".join(rng.choice((f"<p>{prose()}</p>", f"<div><b>{word()}</b><p>{prose()}</p></div>", f"<ul><li>{prose()}</li></ul>", f"<article><p>{prose()}</p></article>")) for _ in range(rng.randint(1, 4))),
        }
        return a + inside[k]() + b

    body = []
    for _ in range(rng.choice((1, 1, 2, 4, 8, 14))):
        body.append(rng.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}<p>{}", "<h2>{}</h2>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{}</li></ul>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>")).replace("{}", "\0"))
        if rng.random() < 0.08:
            body.append(rng.choice((f"<svg><text>{word()}</text></svg>", f"<figure><object>{prose()}</object><figcaption>{prose()}</figcaption></figure>")))
        if rng.random() < 0.08:
            body.append(rng.choice((f'<button data-block-label="0">{word()}</button>', f'<video data-block-label="0">{sentence(3, 9)}</video>', f'<audio data-block-label="0">{sentence(3, 9)}</audio>', f'<canvas data-block-label="0">{sentence(2, 6)}</canvas>')))
        if rng.random() < 0.12:
            body.append(clutter(rng.choice(("advert", "side", "share", "form", "notice"))))
    text = "".join(body)
    while "\0" in text:
        text = text.replace("\0", inline(prose()), 1)
    title = rng.choice((f"<h1>{prose()}</h1>", f"<h1>{word()}</h1>", f'<header data-block-label="1"><h1>{prose()}</h1></header>', ""))
    open_tag, close_tag = rng.choice((("<article", "article"), ("<article", "article"), ("<main", "main"), (f'<div class="{some("content")}"', "div"), (f'<div id="{some("content")}-{word()}"', "div"), (f'<section class="{some("content")}"', "section"), ('<main><div class="inner"', "div")))
    article = f'{open_tag} data-block-label="1">{title}{text}' + (clutter("comment") if rng.random() < 0.25 else "") + f"</{close_tag}>"
    before = [clutter(k) for k in ("top", "menu", "notice", "advert", "form") if rng.random() < 0.45]
    after = [clutter(k) for k in ("side", "comment", "share", "advert", "form", "foot") if rng.random() < 0.45]
    rng.shuffle(before)
    page = "".join(before) + article + "".join(after)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(("wrapper", "container", "page", "site", "main"))}">{page}</div>'
    return f'<html><head><title>{word()}</title><style>p{{}}</style></head><body data-block-label="0">{page}</body></html>'


def trained_field(pages: int = 400, seed: int = 5) -> ChainField:
    """A chain trained on labelled pages made by the rule; their number and seed are parameters."""
    rng = random.Random(seed)
    made = [p for p in (blocks_of(labelled_page(rng)) for _ in range(pages)) if p]
    often: dict[str, int] = {}
    for page in made:
        for text, node, linked, _ in page:
            for name in {*node.features(), *text_features(text, linked)}:
                often[name] = often.get(name, 0) + 1
    return ChainField(sorted({k for k, c in often.items() if c >= 5} | {"bias", "first", "last", "between"})).train(made)


def extract_main_text(df: DataFrame, field: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text of every page: its content blocks in order, joined by a space.

    Within a block character references are decoded and white space becomes one space. Defined cases: null and empty
    pages and pages without content give an empty text; broken markup is read as far as it goes; repeated rows and null
    ids each give a row; an empty table gives an empty result; other columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            texts = []
            for html in batch.column(2):
                page = blocks_of(html.as_py() or "", chain.index)
                texts.append(" ".join(block[0] for block, keep in zip(page, chain.decode(page), strict=True) if keep))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[*batch.schema.names[:2], "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, url_col, html_col).mapInArrow(lean(run), f"`{id_col}` {kind}, `{url_col}` string, text string")


def op6_html_extract(spark, sf_dir):
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
