"""Main text of web pages by equivalence classes of tokens across the pages of a host.

1. A page's tokens are its elements, named by their path of tags and classes, and its text blocks, named by path and text.
   Tokens of a host that occur equally often on each of its pages share an occurrence vector and form a class. Vectors are
   compared by sums of hashes over the pages, so no host's pages meet in one task. A class of two tokens or more that holds on
   a share of the host's pages is valid; valid classes nest by their paths into the host's template (templates()).
2. Elements that share a path have different roles: those that a template token marks off, by being inside them or before
   them, are told apart by it, so the role of an element needs neither class names nor telling tags. Roles have occurrence
   vectors as well. What the template does not hold are slots. The content container of a host is the deepest role that occurs
   once a page and holds most of the text in the slots, links not counted (containers()).
3. The slots of the container are a page's text, without text of the container's own class (site text that stands in it on
   every page), and without roles whose text is links (menus). A heading before a container without one is its title.

Names of elements and classes decide nothing above the container. Below it they mark parts that are no article (comments,
adverts, forms), and they choose between a container and one around it that holds nearly the same. Only pages whose host has
fewer than min_pages pages, or that lack their host's container, are judged by names alone.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, map_text

# Element names by role, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea select object canvas title video audio annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head option".split())
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: Never text, and no text unless nearly all of a page is in them.
NEVER = frozenset("nav footer button menu dialog head".split())
NOT_TEXT = frozenset("header aside form".split())
NOT_TEXT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent "
    "gdpr notice notices banner alert popup modal overlay ad ads advert adverts advertisement adsense sponsor sponsored promo "
    "promotion newsletter subscribe signup login form share sharing social comment comments disqus respond related recommended "
    "pagination pager toolbar skip copyright contentinfo complementary search".split()
)
CONTAINER = frozenset(["article", "main"])
CONTAINER_WORDS = frozenset("article main content post entry story articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = frozenset(["h1", "h2"])
#: Elements that may be a content container.
HOLDS = frozenset("article aside blockquote body center details dialog div fieldset figure footer form header main nav section td".split())
#: Share of a page's text from which an element is no notice, advert or the like, whatever its name.
WRAPPER = 0.8
#: Containers that hold so little more of a host's text are as good; then a name decides.
NEARLY = 0.1
#: Share of a role's text that makes it a menu if it is links.
LINKS = 0.9
#: Share of a host's text in slots below which its pages are copies of each other, and all their text counts.
COPIES = 0.1
#: Bytes of templates that are broadcast at most.
BROADCAST_BYTES = 32_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.DOTALL)
_UNQUOTED = re.compile(r"""[^<>"']*+""")
_TO_END = re.compile(r"[^<>]*+>")
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


def _tag_end(page: str, at: int, missing: dict[str, int]) -> int:
    """Place of the > that ends the tag whose attributes start at at, or -1; quoted values may be of any length.

    Where quotes do not close, the first > before any < ends the tag. missing holds from where on a quote does not occur.
    """
    k = at
    while (k := _UNQUOTED.match(page, k).end()) < len(page) and page[k] != "<":
        c = page[k]
        if c == ">":
            return k
        close = page.find(c, k + 1) if k < missing.get(c, len(page)) else -1
        if close < 0:
            missing[c] = min(k, missing.get(c, k))
            break
        k = close + 1
    loose = _TO_END.match(page, at)
    return loose.end() - 1 if loose else -1


#: What an element's tag and names say of it: nothing, an article, no text unless it wraps nearly all, or never text.
PLAIN, ARTICLE, PART, NO_TEXT = range(4)


def _element_of(tag: str, attributes: str) -> tuple[str, int]:
    """Name of an element, its tag and names sorted, and what they say."""
    names = [w.lower() for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()]
    words = {w for n in names for w in re.split(r"[^a-z0-9]+", n)}
    if tag in ("html", "body"):
        return tag, PLAIN
    name = ".".join([tag, *sorted(set(names))])
    if tag in NEVER or "hidden" in re.sub(r'"[^"]*"|\'[^\']*\'', "", attributes).lower().split():
        return name, NO_TEXT
    if tag in NOT_TEXT or words & NOT_TEXT_WORDS:
        return name, PART
    return name, ARTICLE if tag in CONTAINER or words & CONTAINER_WORDS else PLAIN


_cached_element = functools.lru_cache(maxsize=4096)(_element_of)


def _element(tag: str, attributes: str) -> tuple[str, int]:
    """_element_of(), kept for later unless the attributes are long."""
    return _cached_element(tag, attributes) if len(attributes) < 2_000 else _element_of(tag, attributes)


def _token(name: str, above: int) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), above)


class Page:
    """A page's block elements and text blocks in page order; element 0 stands for the page.

    tags, tokens, parents, levels, says, opens, closes: of elements; opens and closes are places in page order.
    of, texts, linked, places: of blocks: their element, text, length of the text in links, and place.
    """

    def __init__(self, page: str | None):
        page = page or ""
        self.tags, self.tokens, self.parents, self.levels, self.says = ["#"], [0], [-1], [0], [PLAIN]
        self.opens, self.closes = [0], [0]
        self.of: list[int] = []
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.places: list[int] = []
        stack: list[tuple[str, int]] = []  # tag, element (that of the block around it for an inline one)
        parts: list[str] = []
        clock, links, link_chars = 1, 0, 0

        def flush():
            nonlocal clock, link_chars
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    self.of.append(stack[-1][1] if stack else 0)
                    self.texts.append(text)
                    self.linked.append(min(link_chars, len(text)))
                    self.places.append(clock)
                    clock += 1
                link_chars = 0

        def pop(k):
            nonlocal clock, links
            if any(s[0] in BLOCK for s in stack[k:]):
                flush()
            for tag, element in stack[k:]:
                places[tag].pop()
                if tag == "a":
                    links -= 1
                elif tag in BLOCK:
                    self.closes[element] = clock
            clock += 1
            del stack[k:]

        places: dict[str, list[int]] = {}  # of the open elements of each tag

        def nearest(tags, stop):
            """The last open element of tags, unless one of stop was opened after it."""
            last = lambda of: max((places[t][-1] for t in of if places.get(t)), default=-1)
            k = last(tags)
            return k if k >= 0 and k >= last(stop) else None

        def push(tag, element):
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, element))

        def said(text):
            nonlocal link_chars
            parts.append(text)
            if links:
                link_chars += len(text)

        at, n, missing = 0, len(page), {}
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                said(page[at:])
                break
            if m.start() > at:
                said(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            if (end := _tag_end(page, at, missing)) < 0:
                said(m[0])
                continue
            attributes, at = page[at:end], end + 1
            tag = m[2].lower()
            if m[1]:
                k = nearest((tag,), ())
                if k is not None:
                    pop(k)
                continue
            if tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
                    at = close.end() if close else n
                continue
            if tag == "br":
                parts.append(" ")
            if tag in CLOSES_P and (k := nearest(("p",), CLOSES_P - {"p"})) is not None:
                pop(k)
            if tag in SIBLINGS and (k := nearest(SIBLINGS[tag], ("ul", "ol", "dl", "table", "menu"))) is not None:
                pop(k)
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            above = stack[-1][1] if stack else 0
            if tag in BLOCK:
                name, says = _element(tag, attributes)
                self.tags.append(tag)
                self.tokens.append(_token(name, self.tokens[above]))
                self.parents.append(above)
                self.levels.append(self.levels[above] + 1)
                self.says.append(says)
                self.opens.append(clock)
                self.closes.append(-1)
                clock += 1
                push(tag, len(self.tags) - 1)
            else:
                links += tag == "a"
                push(tag, above)
        flush()
        pop(0)
        self.closes[0] = clock

    def text_tokens(self) -> list[int]:
        return [_token(t, self.tokens[e]) for e, t in zip(self.of, self.texts, strict=True)]

    def sums(self, chars: list[int]) -> list[int]:
        """Of every element, the sum of its blocks' chars, those inside its own elements among them."""
        total = [0] * len(self.tags)
        for e, c in zip(self.of, chars, strict=True):
            total[e] += c
        for e in range(len(total) - 1, 0, -1):
            total[self.parents[e]] += total[e]
        return total

    def plain(self) -> list[int]:
        """Of every block, its characters that are not in links."""
        return [len(t) - n for t, n in zip(self.texts, self.linked, strict=True)]

    def left_out(self, chars: list[int], inside: int = 0) -> list[int]:
        """Of every element, the nearest one around it, itself included, that is no text by its names (-1: none).

        Only elements strictly inside the given one count. For the whole page, those of the kind PART with WRAPPER of all chars
        that are not in elements of the kind NO_TEXT do not count.
        """
        never = [False] * len(self.tags)
        for e in range(1, len(never)):
            never[e] = never[self.parents[e]] or self.says[e] == NO_TEXT
        total = self.sums([0 if never[e] else c for e, c in zip(self.of, chars, strict=True)])
        out = [-1] * len(self.tags)
        for e in range(1, len(out)):
            out[e] = out[self.parents[e]]
            if self.opens[e] > self.opens[inside] and self.closes[e] <= self.closes[inside]:
                if self.says[e] == NO_TEXT or self.says[e] == PART and (inside or total[e] < WRAPPER * total[0]):
                    out[e] = e
        return out

    def kept(self, block: int, out: list[int]) -> bool:
        """Whether a block is no part of what is left out; a heading in the header of an article is the article's."""
        e = self.of[block]
        by = out[e]
        return by < 0 or self.tags[e] in HEADINGS and self.tags[by] == "header" and (e == by or out[self.parents[by]] < 0)

    def roles(self, unique: frozenset[int]) -> list[int]:
        """Of every element its token if that is unique, else its token and the first unique token in it, or the last before it.

        unique: tokens of the template that pages of the host hold once.
        """
        marks = [(o, t) for o, t in zip(self.opens, self.tokens, strict=True) if t in unique]
        marks += [(o, t) for o, t in zip(self.places, self.text_tokens(), strict=True) if t in unique]
        marks.sort()
        places = [o for o, _ in marks]
        out = []
        for t, a, b in zip(self.tokens, self.opens, self.closes, strict=True):
            if t in unique:
                out.append(t)
                continue
            k = bisect.bisect_left(places, a)
            inside = k < len(marks) and places[k] < b
            mark = marks[k][1] if inside else marks[k - 1][1] if k else 0
            out.append(_token(f"{'>' if inside else '<'}{mark}", t))
        return out


def by_names(page: Page) -> str:
    """Text of a page by the names of its elements alone: what is in its containers, or all, without what is left out."""
    out = page.left_out(page.plain())
    own = [k for k in range(len(page.texts)) if page.kept(k, out)]
    held = [False] * len(page.tags)
    for e in range(1, len(held)):
        held[e] = held[page.parents[e]] or page.says[e] == ARTICLE and out[e] < 0
    inside = [k for k in own if held[page.of[k]]]
    return "\n".join(page.texts[k] for k in inside or own)


def by_template(page: Page, unique: frozenset[int], container: int, site: frozenset[int], menus: frozenset[int]) -> str | None:
    """Text of the container's slots, None if the page does not have it once; see the module's notes.

    Site text that is half of a page's container or more is taken for an article that the host repeats, and stays.
    """
    roles = page.roles(unique)
    found = [e for e, r in enumerate(roles) if r == container]
    if len(found) != 1:
        return None
    at = found[0]
    a, b = page.opens[at], page.closes[at]
    out = page.left_out(page.plain(), at)
    for e in range(1, len(out)):
        if out[page.parents[e]] >= 0 and out[e] < 0 or roles[e] in menus and a < page.opens[e] < b:
            out[e] = e
    tokens = page.text_tokens()
    own = [k for k in range(len(page.texts)) if a <= page.places[k] < b and page.kept(k, out)]
    size = lambda some: sum(len(page.texts[k]) for k in some)
    slots = [k for k in own if tokens[k] not in site]
    if 2 * size(slots) > size(own):
        own = slots
    if own and not any(page.tags[page.of[k]] in TITLES for k in own):
        around = page.left_out(page.plain())
        before = [
            k
            for k in range(len(page.texts))
            if page.places[k] < a and page.tags[page.of[k]] in TITLES and not page.linked[k] and tokens[k] not in site and page.kept(k, around)
        ]
        own = before[-1:] + own
    return "\n".join(page.texts[k] for k in own)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tokens(texts):
    rows = []
    for t in texts:
        p = Page(t)
        n, above = Counter(p.tokens), {t: (p.tokens[a] if a >= 0 else 0, level) for t, a, level in zip(p.tokens, p.parents, p.levels, strict=True)}
        row = [{"token": _signed(t), "n": n[t], "above": _signed(a), "level": level, "text": False} for t, (a, level) in above.items()]
        blocks = Counter(zip(p.text_tokens(), p.of, strict=True))
        by_token: dict[int, list] = {}
        for (t, e), k in blocks.items():
            by_token.setdefault(t, [0, p.tokens[e], p.levels[e]])[0] += k
        rows.append(row + [{"token": _signed(t), "n": k, "above": _signed(a), "level": level, "text": True} for t, (k, a, level) in by_token.items()])
    return [rows]


_TOKEN = "array<struct<token: long, n: long, above: long, level: int, text: boolean>>"


def _host(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), F.lit(""))


def _rows(pages: DataFrame) -> DataFrame:
    """host, page (a hash of the html, by which equal pages count alike), dealt (a hash of the row) and html."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(_host("url").alias("host"), F.xxhash64(body).alias("page"), F.xxhash64("page_id", body).alias("dealt"), body.alias("html"))


def _vector() -> list[Column]:
    """Two sums over pages that are equal for equal occurrence vectors, and for others only by chance; a row that occurs twice
    adds to those of all its tokens alike."""
    h, low = F.xxhash64("page", "n"), F.lit((1 << 31) - 1)
    return [F.sum(h.bitwiseAND(low)).alias("v1"), F.sum(F.shiftrightunsigned(h, 31).bitwiseAND(low)).alias("v2")]


def _hosts(pages: DataFrame, min_pages: int) -> DataFrame:
    """host, of (its rows), for hosts with min_pages different pages."""
    counted = _rows(pages).groupBy("host", "page").agg(F.count("*").alias("n"))
    return counted.groupBy("host").agg(F.sum("n").alias("of"), F.count("*").alias("pages")).filter(F.col("pages") >= min_pages).drop("pages")


def templates(pages: DataFrame, min_pages: int = 3, share: float = 0.5) -> DataFrame:
    """host, of, token, text (whether it is a text), most (occurrences a page), pages, v1, v2, class, level, parent: the tokens of
    valid classes.

    of: rows of the host; level: depth of the token's element; parent: class of the element around it. A class is valid if it
    has two tokens at least, and a share of the pages of a host, which has min_pages, holds it. A host keeps at most as many
    tokens as 1 / share of its pages have on average, so what is collected by host is bounded by the size of pages.
    """
    rows = map_text(_rows(pages), ["host", "page"], "html", _tokens, f"tokens {_TOKEN}")
    each = rows.select("host", "page", F.inline("tokens"))
    counted = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.max("n").alias("most"), *_vector(), F.first("above").alias("above"), F.first("level").alias("level"), F.first("text").alias("text")
    )
    frequent = cut(counted.join(_hosts(pages, min_pages), "host").filter(F.col("pages") >= share * F.col("of")))
    named = frequent.withColumn("class", F.hex(F.xxhash64("v1", "v2", "pages")))
    sizes = named.groupBy("host", "class").agg(F.count("*").alias("tokens")).filter("tokens >= 2").select("host", "class")
    valid = named.join(sizes, ["host", "class"])
    parents = valid.filter("NOT text").select("host", F.col("token").alias("above"), F.col("class").alias("parent"))
    return valid.join(parents, ["host", "above"], "left").select("host", "of", "token", "text", "most", "pages", "v1", "v2", "class", "level", "parent")


def _with(rows: DataFrame, by_host: DataFrame, keep: list[str], most: int = BROADCAST_BYTES) -> DataFrame:
    """rows(host, dealt, ...) with the columns of by_host(host, of, ...), null where there are none.

    by_host, a checkpoint, is broadcast if it has no more than most bytes. Otherwise both are shuffled by host; hosts with over a
    thousandth of all pages, of which there are no more than a thousand, are dealt out over 256 keys each.
    """
    held = [c for c in by_host.columns if c not in ("host", "of")]
    arrays = [c for c in held if dict(by_host.dtypes)[c].startswith("array")]
    size = F.octet_length("host") + sum((F.coalesce(F.size(c), F.lit(0)) * 8 for c in arrays), F.lit(64))
    total = by_host.agg(F.sum(size.cast("long")).alias("bytes"), F.sum("of").alias("pages")).first()
    if (total.bytes or 0) <= most:
        return rows.join(F.broadcast(by_host.drop("of")), "host", "left").select(*keep, *held)
    hot = by_host.filter(F.col("of") > total.pages / 1000).select("host", F.lit(256).alias("_keys"))
    copies = by_host.join(F.broadcast(hot), "host", "left").withColumn(
        "_key", F.explode(F.sequence(F.lit(0), F.coalesce("_keys", F.lit(1)) - 1))
    )
    dealt = rows.join(F.broadcast(hot), "host", "left").withColumn("_key", F.pmod("dealt", F.coalesce("_keys", F.lit(1))).cast("int"))
    return dealt.join(copies.drop("of", "_keys"), ["host", "_key"], "left").select(*keep, *held)


@functools.lru_cache(maxsize=64)
def _set(packed: bytes) -> frozenset[int]:
    return frozenset(memoryview(packed).cast("Q"))


def _pack(tokens) -> bytes:
    return b"".join(int(t).to_bytes(8, "little", signed=True) for t in tokens or ())


def _role_rows(batches):
    """host, page, html, unique, frequent to host, page, and of each role of an element that may hold text: token, n, level, says,
    chars (in slots, links and what is left out not counted), the same of all text, its links and all its characters."""
    import pyarrow as pa

    for batch in batches:
        columns: list[list] = [[] for _ in range(10)]
        for host, page, body, unique, frequent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if unique is None:
                continue
            p, known = Page(body), _set(_pack(frequent))
            slot = [t not in known for t in p.text_tokens()]
            plain = p.plain()
            held = [n * s for n, s in zip(plain, slot, strict=True)]
            out = p.left_out(held if sum(held) >= COPIES * sum(plain) else plain)
            own = [c if p.kept(k, out) else 0 for k, c in enumerate(plain)]
            chars, both = p.sums([c * s for c, s in zip(own, slot, strict=True)]), p.sums(own)
            links, every = p.sums(p.linked), p.sums([len(t) for t in p.texts])
            found: dict[int, list] = {}
            for e, r in enumerate(p.roles(_set(_pack(unique)))):
                held = found.setdefault(r, [0, p.levels[e], p.says[e] if p.tags[e] in HOLDS or not e else -1, 0, 0, 0, 0])
                held[0] += 1
                held[3] += chars[e]
                held[4] += both[e]
                held[5] += links[e]
                held[6] += every[e]
            for r, row in found.items():
                for c, x in zip(columns, (host, page, _signed(r), *row), strict=True):
                    c.append(x)
        kinds = [pa.string(), *[pa.int64()] * 9]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_ROLE_NAMES)


_ROLE_NAMES = ["host", "page", "token", "n", "level", "says", "chars", "both", "links", "every"]
_ROLE_ROW = "host string, page long, token long, n long, level long, says long, chars long, both long, links long, every long"


def containers(pages: DataFrame, found: DataFrame, share: float = 0.5) -> DataFrame:
    """host, of, unique, container, site, menus: what by_template() needs, for the hosts of found, a checkpoint of templates().

    container: the deepest role that a share of the host's pages holds, none twice, with over half of the text in all slots.
    Among roles around it with NEARLY as much, one whose name is an article's comes first, the deepest of them. Where all pages
    are copies, so that there is next to no text in slots, all text counts.
    """
    tokens = lambda test: F.array_sort(F.collect_list(F.when(test, F.col("token"))))
    by_host = cut(
        found.groupBy("host").agg(F.first("of").alias("of"), tokens(F.col("most") == 1).alias("unique"), tokens(F.col("text")).alias("frequent"))
    )
    rows = _with(_rows(pages), by_host, ["host", "page", "html"])
    each = rows.mapInArrow(_role_rows, _ROLE_ROW)
    roles = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.max("n").alias("most"), F.max("level").alias("level"), F.max("says").alias("says"),
        F.sum("chars").alias("chars"), F.sum("both").alias("both"), F.sum("links").alias("links"), F.sum("every").alias("every"), *_vector(),
    )
    of = by_host.select("host", "of")
    usual = cut(roles.join(of, "host").filter(F.col("pages") >= share * F.col("of")))
    copies = F.col("chars") < COPIES * F.col("both")
    whole = usual.filter("token = 0").select("host", copies.alias("copies"), F.when(copies, F.col("both")).otherwise(F.col("chars")).alias("whole"))
    best = usual.filter("most = 1 AND says >= 0").join(whole, "host")
    best = best.withColumn("chars", F.when(F.col("copies"), F.col("both")).otherwise(F.col("chars"))).filter("2 * chars > whole")
    deepest = best.groupBy("host").agg(F.max(F.struct("level", "chars", "token")).alias("d")).select("host", F.col("d.chars").alias("least"))
    named = F.when((F.col("says") == ARTICLE) & (F.col("chars") <= F.col("least") + NEARLY * F.col("whole")), F.col("level"))
    chosen = best.join(deepest, "host").groupBy("host").agg(
        F.max(F.struct(F.coalesce(named, F.lit(-1)), "level", "chars", "token", "v1", "v2", "pages")).alias("c")
    )
    chosen = chosen.select("host", F.col("c.token").alias("container"), F.col("c.v1").alias("v1"), F.col("c.v2").alias("v2"), F.col("c.pages").alias("pages"))
    site = found.filter("text AND most = 1").join(chosen, ["host", "v1", "v2", "pages"]).groupBy("host").agg(F.collect_list("token").alias("site"))
    menus = usual.filter((F.col("every") > 0) & (F.col("links") >= LINKS * F.col("every")) & (F.col("token") != 0))
    menus = menus.groupBy("host").agg(F.collect_list("token").alias("menus"))
    kept = by_host.drop("frequent").join(chosen.select("host", "container"), "host")
    return kept.join(site, "host", "left").join(menus, "host", "left")


def extract(pages: DataFrame, min_pages: int = 3, share: float = 0.5, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of pages(page_id, url, html) with text, its blocks joined by line feeds, empty if there is none, and by_template.

    Null and empty pages have empty text; a null url is one host. Repeated rows are extracted each; further columns are left
    out; an empty table gives no rows. by_template tells whether the host's template gave the text, or names alone.
    """
    found = cut(templates(pages, min_pages, share))
    by_host = cut(containers(pages, found, share))
    rows = pages.select("page_id", "url", F.struct("page_id", "url").alias("_row"), F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", "html", _host("url").alias("host"), F.xxhash64("_row", "html").alias("dealt"))
    joined = _with(rows, by_host, ["page_id", "url", "html"], broadcast_bytes)
    columns = ["page_id", "url", "html", "unique", "container", "site", "menus"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, ways = [], []
            for html, unique, container, site, menus in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                page, text = Page(html), None
                if container is not None:
                    text = by_template(page, _set(_pack(unique)), container % (1 << 64), _set(_pack(site)), _set(_pack(menus)))
                ways.append(text is not None)
                texts.append(by_names(page) if text is None else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(ways, pa.bool_())], names=["page_id", "url", "text", "by_template"]
            )

    kind = dict(joined.dtypes)
    return joined.select(*columns).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, by_template boolean")


def digests(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_template")
