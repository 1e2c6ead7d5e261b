"""Main text of web pages by template deduction over equivalence classes.

Pages of one host share a template. A page is a row of markup tokens (tags, told apart by the path of open elements above them) and
text. Over a group of pages of one host, each token has an occurrence vector: how often each page holds it (tokens that
all pages hold equally often are told apart by their number). Tokens with equal vectors form an equivalence class; a class is valid if its tokens come in the same order on every page and
another class fits between two of its tokens or not at all. The class that occurs once a page is the template's frame;
valid classes that stand in one of its gaps on every page nest in it. The gaps between frame tokens, and the nested classes in them, are slots.

The template decides what is extracted. Texts are tokens too: a block that most pages (three at least, exact copies
counted once) hold at the same path is the template's; near copies of one story count once too. Of the frame's elements, the article's container is the smallest one
that holds at least half of what remains over all pages of the group, outside links (`container`); it is widened by
headings beside it. On a page, the container's slots are the main text. Names are tests on slots: elements that are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments by their name, class or id are left out
of all sums and results (a class that puts most of the text or an <article> aside counts for nothing: it names a layout); an element that names the article weighs `NAMED` times its text when the container is
chosen, and where a container holds such elements, only their slots are kept. What the template repeats goes from them too, and so do slots of links. Names decide alone on pages without
a container: single pages of a host, and pages that lack it. README.md has the figures.

Groups: the pages of a host, cut by a hash of page_id into parts of about `GROUP_PAGES`, so that a host with a third
of all pages is many groups; a host's last part may be small, and one page is a template of its own. Pages travel once, to their group.

Null html is empty. Pages without an article, and empty ones, have an empty text. Null urls, and urls without a host, are one
host. Repeated rows are pages of their own. Very long pages are taken whole. An empty table gives no rows.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import in_slices
from .common import materialise

GROUP_PAGES = 64
#: Slots with a smaller share of their text outside links are menus.
LEAST_PLAIN = 0.5
#: Weight of the text of elements that name the article, where the container is chosen.
NAMED = 3
#: Longer paths are told apart by a hash of what is above, so that deep pages take memory in proportion to their size.
PATH_CHARS = 240
#: A text is the template's if at least so many pages hold it, and more than half of the group.
LEAST_PAGES = 3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# HTML element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover object q rp rt ruby s samp small span strike strong sub sup svg time tspan tt u var wbr".split()
)
#: Blocks of running text: never an article's container.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption blockquote pre address ul ol dl table tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OUTSIDE = frozenset("nav header footer aside form script style noscript template title head button select textarea input dialog menu iframe".split())
NAMES_ARTICLE = frozenset("article main".split())
# Words in class and id attributes, and roles. A class is cut at hyphens, underscores and capitals; its first or last word decides.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar aside "
    "rail widget widgets related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation topbar toolbar masthead header footer foot copyright legal pagination pager skip search tags tagcloud".split()
)
#: These decide as the last word only: a form's parts, not what is named after a form.
LAST_WORDS = frozenset({"form"})
#: Readers' words: out wherever they stand in a class.
COMMENT_WORDS = frozenset("comment comments commentlist replies reply disqus respond".split())
#: A class that begins with one of these says how something looks or is filed, not what it is.
MODIFIERS = frozenset("has with without no is not tag category cat type format status lang js page-template layout theme".split())
#: What these begin with belongs to the article, its header and title as well.
ARTICLE_STEMS = frozenset("article post entry story content main body page".split())
HEAD_WORDS = frozenset("header head title heading".split())
ARTICLE_CLASS = re.compile(r"(?:article|article-?body|article-?content|post|post-?body|post-?content|entry|entry-?content|main|main-?content|content|story|story-?body|body-?text|hentry|markdown-?body)\Z", re.I)
#: Words that begin like these are as well.
ASIDE_STEMS = re.compile(r"(?:advert|sponsor|promo|recommend)\w*\Z|nav(?!y\Z|al)\w*\Z")
_CLASS_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


@dataclass
class Page:
    """tokens: path of the element, with / before it where it closes; roles and parents (token of the element around it,
    or -1) by token; texts: (token of the innermost element, text in a link, block, text)."""

    tokens: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[tuple[int, bool, int, str]] = field(default_factory=list)

    def add(self, token: str, role: str, parent: int) -> int:
        self.tokens.append(token)
        self.roles.append(role)
        self.parents.append(parent)
        return len(self.tokens) - 1


def element(token: str) -> str:
    """The element's name of a token."""
    return token.rsplit("/", 1)[1].split("#")[0]


def class_says(name: str) -> str:
    """What one class or id says of its element: comments, out, in, or nothing."""
    words = [w.lower() for w in _CLASS_WORD.findall(name)]
    if not words:
        return ""
    if not COMMENT_WORDS.isdisjoint(words) and words[0] not in MODIFIERS:
        return "comments"
    if ARTICLE_CLASS.match(name):
        return "in"
    if words[0] in MODIFIERS or words[0] in ARTICLE_STEMS and words[-1] in HEAD_WORDS and len(words) > 1:
        return ""
    ends = (words[0], words[-1])
    return "out" if words[-1] in LAST_WORDS or any(w in ASIDE_WORDS or ASIDE_STEMS.match(w) for w in ends) else ""


def _role(name: str, attributes: str) -> str:
    """out: never article; aside: not article by its class or id, unless the template says otherwise; in: names the article; or nothing."""
    if name in OUTSIDE:
        return "out"
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ASIDE_ROLES or re.search(r"display\s*:\s*none", found.get("style", "")):
        return "out"
    if name in ("html", "body"):
        return ""
    says = {class_says(c) for c in (*found.get("class", "").split(), *found.get("id", "").split())}
    if name in NAMES_ARTICLE or found.get("role", "").lower() in ("main", "article"):
        return "out" if "comments" in says and name != "main" and "in" not in says else "in"
    if "comments" in says:
        return "out"
    if "out" in says:
        return "aside"
    return "in" if "in" in says or ARTICLE_CLASS.match(found.get("itemprop", "")) else ""


def read_page(source: str) -> Page:
    """Tokens, their elements' roles, and texts, with elements that the markup leaves open closed as browsers do."""
    page, at, block, end = Page(), 0, 0, len(source)
    stack: list[tuple[str, str, int, str]] = []  # name, path, token, path of the innermost block element
    links = 0

    def inner() -> int:
        return stack[-1][2] if stack else -1

    def text(a: int, b: int, raw: bool = False) -> None:
        if b > a:
            page.texts.append((inner(), links > 0, block, source[a:b] if raw else entities.unescape(source[a:b])))

    def close(n: int) -> None:
        nonlocal links
        while len(stack) > n:
            name, path, token, _ = stack.pop()
            links -= name == "a"
            page.add(f"/{path}", "", token)

    while at < end:
        m = _TOKEN.search(source, at)
        text(at, m.start() if m else end)
        if not m:
            break
        at = m.end()
        cdata, closing, name, attributes = m.groups()
        if cdata is not None:
            text(m.start(1), m.end(1), raw=True)
            continue
        if closing:
            closing = closing.lower()
            if closing not in INLINE:
                block += 1
            elif closing == "br":
                page.texts.append((inner(), False, block, " "))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == closing:
                    close(i)
                    break
                if closing in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end tag doesn't close the blocks that are open inside
            continue
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            block += 1
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            alike = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in alike:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tr", "tbody", "select"):
                    break
        # The path names block elements only: a paragraph is the same token inside or outside of <b>.
        upper = stack[-1][3] if stack else ""
        path = f"{upper}/{name}"
        if len(path) > PATH_CHARS:
            path = f"~{hashlib.blake2b(upper.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}/{name}"
        # An article's own header holds its title.
        inside = name == "header" and any(n == "article" for n, *_ in stack)
        token = page.add(path, _role("div" if inside else name, attributes or ""), inner())
        if name == "br":
            page.texts.append((inner(), links > 0, block, " "))
        if name in VOID or (attributes or "").endswith("/"):
            continue
        stack.append((name, path, token, upper if name in INLINE else path))
        links += name == "a"
        if name in RAW:
            until = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            close(len(stack) - 1)
            at = until.end() if until else end
            block += 1
    close(0)
    return page


def equivalence_classes(pages: list[Page]) -> list[list[str]]:
    """Valid classes of tokens with equal occurrence vectors, the most frequent on all pages first.

    A class is valid if its tokens, taken alone, stand in one repeated order on every page.
    """
    counts = [Counter(p.tokens) for p in pages]
    vectors: dict[str, list[int]] = defaultdict(lambda: [0] * len(pages))
    for i, c in enumerate(counts):
        for token, n in c.items():
            vectors[token][i] = n
    classes: dict[tuple[int, ...], set[str]] = defaultdict(set)
    for token, vector in vectors.items():
        classes[tuple(vector)].add(token)
    out = []
    for vector, tokens in sorted(classes.items(), key=lambda x: (-sum(n > 0 for n in x[0]), sum(x[0]), sorted(x[1]))):
        order: list[str] | None = None
        valid = True
        for page, n in zip(pages, vector, strict=True):
            if n:
                mine = [t for t in page.tokens if t in tokens]
                order = order or mine[: len(tokens)]
                if mine != order * n:
                    valid = False
                    break
        if valid and order:
            out.append(order)
    return out


def differentiate(pages: list[Page]) -> None:
    """Number the occurrences of tokens that every page holds equally often: the second <div> is another token than the
    first, where all pages have three."""
    counts = [Counter(p.tokens) for p in pages]
    even = {t for t, n in counts[0].items() if n > 1 and all(c[t] == n for c in counts)} if counts else set()
    for page in pages:
        seen: Counter[str] = Counter()
        for i, t in enumerate(page.tokens):
            if t in even:
                page.tokens[i] = f"{t}#{seen[t]}"
                seen[t] += 1


def template(pages: list[Page]) -> tuple[set[str], dict[str, int]]:
    """Tokens of the frame (valid classes that occur at most once on each page and on most pages), and the number of the
    class of each block element in a valid class that stands, on every page, in one and the same gap of the frame."""
    differentiate(pages)
    counts = [Counter(p.tokens) for p in pages]
    frame: set[str] = set()
    others: list[list[str]] = []
    for tokens in equivalence_classes(pages):
        n = [c[tokens[0]] for c in counts]
        if max(n) == 1 and 2 * sum(n) >= len(pages):
            frame.update(tokens)
        else:
            others.append(tokens)
    # The gap of a token: the frame token before it.
    gaps: dict[str, set[str]] = defaultdict(set)
    for page in pages:
        gap = ""
        for token in page.tokens:
            if token in frame:
                gap = token
            else:
                gaps[token].add(gap)
    nested = {}
    for i, tokens in enumerate(others):
        if len(set().union(*(gaps[t] for t in tokens))) == 1:
            nested.update((t, i) for t in tokens if element(t) not in INLINE)
    return frame, nested


def template_frame(pages: list[Page]) -> set[str]:
    return template(pages)[0]


def block_texts(page: Page) -> dict[int, tuple[str, str]]:
    """Path and text, white space made single, of each block that has text."""
    paths: dict[int, str] = {}
    blocks: dict[int, list[str]] = {}
    for token, _, block, part in page.texts:
        if block not in blocks:
            while token >= 0 and element(page.tokens[token]) in INLINE:
                token = page.parents[token]
            paths[block] = page.tokens[token].split("#")[0] if token >= 0 else ""
        blocks.setdefault(block, []).append(part)
    joined = {block: " ".join("".join(p).split()) for block, p in blocks.items()}
    return {block: (paths[block], text) for block, text in joined.items() if text}


def template_texts(pages: list[Page]) -> set[tuple[str, str]]:
    """Paths and texts of the blocks that most of the stories hold. Pages that have half of their blocks, outside what most pages have, in common are one story:
    near copies of an article share its paragraphs, and that makes them no template."""
    blocks = [set(block_texts(p).values()) for p in pages]
    holders = Counter(t for own in blocks for t in own)
    common = {t for t, n in holders.items() if n >= LEAST_PAGES and 2 * n > len(pages)}
    if not common:
        return common
    leaders: list[set[tuple[str, str]]] = []
    stories: list[int] = []
    for page, own in zip(pages, blocks, strict=True):
        # A page is known by the blocks that few others have, or by all if those are less than a quarter of them.
        states, texts = _states(page), block_texts(page)
        plain = {texts[block] for token, link, block, _ in page.texts if block in texts and not link and (token < 0 or not states[token][0])}
        known = plain - common
        known = known if 4 * len(known) >= len(plain) else plain
        near = next((i for i, x in enumerate(leaders) if 2 * len(x & known) >= max(1, min(len(x), len(known)))), None)
        if near is None:
            near = len(leaders)
            leaders.append(known)
        stories.append(near)
    told = Counter(t for story in set(stories) for t in set().union(*(own & common for own, at in zip(blocks, stories, strict=True) if at == story)))
    return {t for t in common if told[t] >= LEAST_PAGES and 2 * told[t] > len(leaders)}


def _joined(parts: list[tuple[int, str]]) -> str:
    """Blocks, white space made single, by newline."""
    blocks: dict[int, list[str]] = {}
    for block, part in parts:
        blocks.setdefault(block, []).append(part)
    lines = (" ".join("".join(p).split()) for p in blocks.values())
    return "\n".join(line for line in lines if line)


def _inherited(page: Page, start, step) -> list:
    """A value for each token, made by step(value of the element around it, token): parents come before their children."""
    out: list = []
    for i, parent in enumerate(page.parents):
        out.append(step(out[parent] if parent >= 0 else start, i))
    return out


def _states(page: Page) -> list[tuple[bool, bool]]:
    """(left out, names the article) of each token and what is around it."""
    return _inherited(page, (False, False), lambda above, i: (above[0] or page.roles[i] in ("out", "aside"), above[1] or page.roles[i] == "in"))


def settle_asides(pages: list[Page]) -> None:
    """Elements that only their class puts aside stay in where they hold an element that is the article by its name, or, over all
    pages, at least half of the text outside links: such a class names a layout."""
    total, held, holds_article = 0, Counter(), set()
    for page in pages:
        hard = _inherited(page, False, lambda above, i, page=page: above or page.roles[i] == "out")
        own = [0] * len(page.tokens)
        for token, link, _, part in page.texts:
            if token >= 0 and not hard[token] and not link:
                own[token] += len(part.strip())
        total += sum(own)
        named = [element(t) in NAMES_ARTICLE and r == "in" and not h for t, r, h in zip(page.tokens, page.roles, hard, strict=True)]
        for i in range(len(page.tokens) - 1, -1, -1):
            if page.roles[i] == "aside":
                held[page.tokens[i]] += own[i]
                if named[i]:
                    holds_article.add(page.tokens[i])
            if page.parents[i] >= 0:
                own[page.parents[i]] += own[i]
                named[page.parents[i]] = named[page.parents[i]] or named[i]
    for page in pages:
        for i, (token, role) in enumerate(zip(page.tokens, page.roles, strict=True)):
            if role == "aside" and (token in holds_article or 2 * held[token] >= max(1, total)):
                page.roles[i] = ""


def container(pages: list[Page], frame: set[str], repeated: set[tuple[str, str]]) -> str | None:
    """The frame's element that is the article's container (see the module's docstring), or None."""
    held: Counter[str] = Counter()
    named: set[str] = set()
    above: dict[str, str] = {}
    headings: Counter[str] = Counter()
    total = 0
    for page in pages:
        states, texts = _states(page), block_texts(page)
        own, heads = [0] * len(page.tokens), [0] * len(page.tokens)
        in_heading = _inherited(page, False, lambda value, i, page=page: value or element(page.tokens[i]) in HEADINGS)
        for token, link, block, part in page.texts:
            if token >= 0 and not states[token][0] and not link and texts.get(block) not in repeated:
                n = len(part.strip())
                own[token] += n
                heads[token] += n if in_heading[token] else 0
                total += n
        for i in range(len(page.tokens) - 1, -1, -1):
            parent = page.parents[i]
            if parent >= 0:
                own[parent] += own[i]
                heads[parent] += heads[i]
        up: list[str] = _inherited(page, "", lambda value, i, page=page: page.tokens[i] if page.tokens[i] in frame and element(page.tokens[i]) not in INLINE else value)
        for i, token in enumerate(page.tokens):
            if token in frame and not token.startswith("//") and not states[i][0] and own[i]:
                held[token] += own[i]
                headings[token] += heads[i]
                parent = page.parents[i]
                above[token] = up[parent] if parent >= 0 else ""
                if page.roles[i] == "in":
                    named.add(token)
    fit = [t for t in held if element(t) not in PROSE and element(t) not in INLINE and 2 * held[t] * (NAMED if t in named else 1) >= total]
    if not fit:
        return None

    def depth(token: str) -> int:
        n = 0
        while token:
            token, n = above.get(token, ""), n + 1
        return n

    found = min((t for t in fit if t in named) if any(t in named for t in fit) else fit, key=lambda t: (held[t], -depth(t), t))
    while (upper := above.get(found, "")) in held and element(upper) not in ("html", "body") and (found not in named or upper in named) and held[upper] - held[found] == headings[upper] - headings[found]:
        found = upper
    return found


def slot_text(page: Page, chosen: str | None, nested: dict[str, int], repeated: set[tuple[str, str]], plain_slots: set[tuple[str, int]]) -> str | None:
    """The texts of the container's slots on a page; None where the page has no such container, or nothing in it."""
    inside = _inherited(page, False, lambda above, i: above or page.tokens[i] == chosen)
    if chosen is None or not any(inside):
        return None
    states, slots = _states(page), _slots(page, nested)
    kept = [(states[token][1], slots[token], block, part) for token, _, block, part in page.texts if token >= 0 and inside[token] and not states[token][0]]
    if any(named and part.strip() for named, _, _, part in kept):
        kept = [k for k in kept if k[0]]
    texts = block_texts(page)
    return _joined([(block, part) for _, slot, block, part in kept if texts.get(block) not in repeated and slot in plain_slots]) or None


def _slots(page: Page, nested: dict[str, int]) -> list[tuple[str, int]]:
    """The innermost block element around each token, by its path, and the nested class it stands in."""
    return _inherited(page, ("", -1), lambda above, i: (page.tokens[i].split("#")[0] if element(page.tokens[i]) not in INLINE else above[0], nested.get(page.tokens[i], above[1])))


def plain_slots(pages: list[Page], nested: dict[str, int]) -> set[tuple[str, int]]:
    """Slots whose text, over all pages, is outside links for the most part: one paragraph full of links is no menu."""
    total, plain = Counter(), Counter()
    for page in pages:
        slots = _slots(page, nested)
        for token, link, _, part in page.texts:
            if token >= 0:
                n = len(part.strip())
                total[slots[token]] += n
                plain[slots[token]] += 0 if link else n
    return {slot for slot, n in total.items() if plain[slot] >= LEAST_PLAIN * n}


def main_text(page: Page, frame: set[str], nested: dict[str, int] | None = None, repeated: set[tuple[str, str]] | None = None) -> str:
    """The article of a page by itself: what names call the article, else the slots of the frame with enough text outside links."""
    states = _states(page)
    slots = _inherited(page, (-1, -1), lambda above, i: (i, -1) if page.tokens[i] in frame else (above[0], nested[page.tokens[i]]) if nested and page.tokens[i] in nested else above)
    kept = [(*(states[token] if token >= 0 else (False, False)), slots[token] if token >= 0 else (-1, -1), block, link, part) for token, link, block, part in page.texts]
    kept = [k[1:] for k in kept if not k[0]]
    if any(named and part.strip() for named, _, _, _, part in kept):
        return _joined([(block, part) for named, _, block, _, part in kept if named])
    if repeated:
        texts = block_texts(page)
        kept = [k for k in kept if texts.get(k[2]) not in repeated]
    total, plain = Counter(), Counter()
    for _, slot, _, link, part in kept:
        n = len(part.strip())
        total[slot] += n
        plain[slot] += 0 if link else n
    return _joined([(block, part) for _, slot, block, _, part in kept if total[slot] and plain[slot] >= LEAST_PLAIN * total[slot]])


def group_texts(sources: list[str]) -> list[str]:
    """The main texts of the pages of one group."""
    read = [read_page(h) for h in sources]
    settle_asides(read)
    frame, nested = template(read)
    distinct = list(dict(zip(sources, read, strict=True)).values())
    repeated = template_texts(distinct)
    chosen = container(distinct, frame, repeated) if len(distinct) > 1 else None
    plain = plain_slots(distinct, nested)
    found = (slot_text(p, chosen, nested, repeated, plain) for p in read)
    return [main_text(p, frame, nested, repeated) if text is None else text for p, text in zip(read, found, strict=True)]


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    sizes = materialise(rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).cast("int").alias("parts")).where("parts > 1"), "host-parts")
    cut = rows.join(sizes, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", F.when(F.col("page_id").isNull(), F.col("html"))), F.coalesce("parts", F.lit(1))).cast("int"))

    def solve(group: list[tuple[int | None, str | None, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"page_id": [g[0] for g in group], "url": [g[1] for g in group], "text": group_texts([g[2] for g in group])}, schema=_FOUND)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for host_, part, page, url, source in zip(*(batch[k].to_pylist() for k in ("host", "part", "page_id", "url", "html")), strict=True):
                if (host_, part) != key:
                    if group:
                        yield solve(group)
                    key, group = (host_, part), []
                group.append((page, url, source))
        if group:
            yield solve(group)

    dealt = cut.select("host", "part", "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part")
    return dealt.mapInArrow(in_slices(extract, "html"), "page_id long, url string, text string")
