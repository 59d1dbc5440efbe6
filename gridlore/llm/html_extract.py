"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree, whose nodes are element paths. A node's importance is
taken from entropies over the host's pages: of the ways its children are laid out (presentation), and of
where its texts occur (content). Branches that look and read alike on many pages are menus, notices
and other frame, inside the main element too; texts that few pages share stay even there. A main element
whose texts differ from page to page stands against a class or id word around it. Element roles decide
where counts can't: between advertisements, comments and articles, whose texts all differ. Counts weigh
the more the more pages of the host there are, by one rule for all hosts.

Both passes parse a page where it lies, in time and memory linear in its length. Only short counts per host
and path are shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridlore.llm.textkit import slices
from gridlore.session import materialize

DOUBT = 1.0
"""Pages' worth of doubt: what n pages say about a node counts n / (n + DOUBT), the rest speaks for keeping it."""
LEAST_IMPORTANCE = 0.3
HIGH_IMPORTANCE = 0.7
"""Importance from which a main element's branch overrules a word in the class or id of an element around it."""
PRESENTATION_WEIGHT = 0.2

# Elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe".split())
MUTED = set("svg canvas audio video select button".split())
FRAME = set("nav aside form footer header dialog menu option".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
SCOPE = set("html body article section main div td th table aside nav header footer form blockquote li dd dt figure ul ol dl details".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
FRAME_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header hero-nav menu modal nav navbar navigation newsletter notice pagination paging pager popup promo promoted promotion "
    "related replies reply respond share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe subscription "
    "tags toolbar widget widgets alert gdpr recommended recommendations masthead sidenav topbar login search".split()
)
INNER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner comment comments consent cookie cookies disqus newsletter notice popup promo promoted "
    "promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription".split()
)
WORDED_INSIDE = set("div section aside ul ol dl table figure details fieldset".split())
FRAME_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\s]+)"
"""The host of a url, in group 1, with a scheme or without."""

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# quotes count after an equals sign alone, so that a stray one doesn't swallow the page
_TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_ENDS = re.compile(rf"</({'|'.join(sorted(RAW | MUTED))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/>]|$)""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A run of text between block boundaries, in the element that ``node`` is the number of.

    ``lead`` is the path of the outermost main element around it if only class or id words of elements
    around that one make it frame, else 0.
    """

    __slots__ = ("node", "path", "text", "frame", "main", "lead")

    def __init__(self, node: int, path: int, text: str, frame: bool, main: bool, lead: int):
        self.node, self.path, self.text, self.frame, self.main, self.lead = node, path, text, frame, main, lead


class Page:
    """Blocks in order, and the block elements they stand in: hashes of their paths, linked to their parents, and
    per path the hash of its layout (its children's tags). Node 0 is the page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.layout: dict[int, int] = {}
        self.paths, self.parents = [0], [0]


def _mark(path: int, text: str) -> int:
    """A text at a path as one number."""
    return xxhash.xxh64_intdigest(text, seed=path) >> 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def _is_frame(tag: str, attributes: dict[str, str], inside_main: bool) -> bool | None:
    """Whether an element's role is that of a page's frame rather than its article; None if only a class or id word says so."""
    if tag in FRAME and not (tag == "header" and inside_main):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in FRAME_ROLES:
        return True
    if inside_main and tag not in WORDED_INSIDE:
        return False  # a paragraph of the article, whatever it is called
    words = INNER_WORDS if inside_main else FRAME_WORDS
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().replace("_", "-")
    return None if any(part in words for name in names.split() for part in [name, *name.split("-")]) else False


class _Stack:
    """Open elements: tag, node, inside a frame branch, inside the main element, inside a branch that a word makes frame and
    nothing else, the outermost main element inside that, inside something muted. The deepest open element of each
    kind is known without looking through them."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int, bool, bool, bool, int, bool]] = [("", 0, False, False, False, 0, False)]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []

    def push(self, entry: tuple) -> None:
        tag, depth = entry[0], len(self.held)
        self.held.append(entry)
        self.places.setdefault(tag, []).append(depth)
        if tag in SCOPE:
            self.scopes.append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)

    def cut(self, depth: int) -> None:
        while len(self.held) > depth:
            self.places[self.held.pop()[0]].pop()
            for kind in (self.scopes, self.blocks):
                if kind and kind[-1] == len(self.held):
                    kind.pop()

    def last(self, *tags: str) -> int:
        """Depth of the innermost open element of these, 0 if there is none."""
        return max((p[-1] for p in map(self.places.get, tags) if p), default=0)


def parse(page: str) -> Page:
    """One pass over a page; what isn't closed ends with what it stands in."""
    out, stack, parts = Page(), _Stack(), []
    ends = {m[1].lower(): m.start() for m in _ENDS.finditer(page)}
    at, simple = 0, False

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, node, frame, main, _, lead, _ = stack.held[-1]
                out.blocks.append(Block(node, out.paths[node], text, frame, main, lead))

    def close(depth: int) -> None:
        flush()
        stack.cut(depth)

    def add(text: str) -> None:
        if text and not stack.held[-1][6]:
            parts.append(text)

    while True:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        closing = page.startswith("/", start + 1)
        named = _NAME.match(page, start + 1 + closing)
        if not named:
            if page.startswith("<!--", start):
                add(page[at:start])
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?", "</"), start) and (end := page.find(">", start)) >= 0:
                add(page[at:start])
                at = end + 1
            else:
                add(page[at : start + 1])
                at = start + 1
            continue
        found = None if simple else _TAG_END.match(page, named.end())
        simple = found is None
        end = found.end() if found else page.find(">", named.end()) + 1
        if not end:
            add(page[at:])
            break
        add(page[at:start])
        tag, raw, at = named[0].lower(), page[named.end() : end - 1], end
        if closing:
            depth = stack.last(tag)
            if tag in BLOCK:
                flush()
                if depth:
                    stack.cut(depth)
            elif depth and not (stack.blocks and stack.blocks[-1] > depth):
                # an inline end tag doesn't reach over open blocks
                stack.cut(depth)
            continue
        empty = raw.rstrip().endswith("/")
        if tag in RAW:
            if not empty and ends.get(tag, -1) >= at:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end()
            elif tag in ("script", "style") and not empty:
                at = len(page)
            flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in CLOSES_P:
            flush()
            depth = stack.last("p")
            if depth and depth > (stack.scopes[-1] if stack.scopes else 0):
                close(depth)
        if tag in SIBLINGS:
            own = ("td", "th") if tag in ("td", "th") else ("dt", "dd") if tag in ("dt", "dd") else (tag,)
            depth = stack.last(*own)
            if depth > stack.last(*SIBLINGS[tag]):
                close(depth)
        if tag in BLOCK:
            flush()
        if tag in MUTED and (depth := stack.last(tag)):
            stack.cut(depth)
        _, node, frame, main, worded, lead, muted = stack.held[-1]
        attributes = _attributes(raw)
        if tag in BLOCK:
            above = out.paths[node]
            label = f"{above}/{tag}.{' '.join(sorted(attributes.get('class', '').split()))}#{attributes.get('role', '')}"
            out.layout[above] = (out.layout.get(above, 7) * 1000003 + (xxhash.xxh64_intdigest(tag) >> 1)) & 0x7FFFFFFFFFFFFFFF
            out.parents.append(node)
            out.paths.append(xxhash.xxh64_intdigest(label) >> 1)
            node = len(out.paths) - 1
        outside = not main
        main = main or tag in ("article", "main") or attributes.get("role", "") in ("main", "article") or attributes.get("itemprop", "") == "articleBody"
        role = _is_frame(tag, attributes, main)
        if role is not False:
            # inside the main element, or by more than a word, it is frame whatever stands around it
            worded, lead = role is None and outside and (worded or not frame), 0
        elif outside and main and worded and node:
            lead = out.paths[node]
        frame = frame or role is not False
        # without an end tag ahead it would mute all that follows
        muted = muted or tag in MUTED and ends.get(tag, -1) >= at or tag not in BLOCK and role is True
        if not empty or tag in BLOCK:
            stack.push((tag, node, frame, main, worded, lead, muted))
    flush()
    return out


def extract(page: str | None, noise: set[int] | frozenset[int] = frozenset(), valued: set[int] | frozenset[int] = frozenset()) -> str:
    """Main text of one page, given what its host's tree found: marks of unimportant texts, and main elements of high importance.

    A passage of the article may stand on many pages: it stays, as the texts around it differ.
    """
    blocks = parse(page or "").blocks
    free = [b for b in blocks if not b.frame]
    kept = [b for b in free if not b.path or _mark(b.path, b.text) not in noise]
    chosen = [b for b in kept if b.main]
    if not chosen:
        # words around an important main element don't count if the page has no other
        chosen = [b for b in blocks if b.lead in valued and _mark(b.path, b.text) not in noise]
    # a page on which nothing stands out is kept whole, one without anything else has its main element
    chosen = chosen or [b for b in free if b.main] or kept or free or [b for b in blocks if b.lead]
    return " ".join(b.text for b in chosen)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature) of each page: 0 the path itself, 1 its layout, 2 a text in it, 3 a text below it, of main elements with a word around them."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())])
    for whole in batches:
        for batch in slices(whole, "html"):
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page, seen, counted = parse(html or ""), set(), {0}
                for path, shape in page.layout.items():
                    if path:
                        seen.add((host, path, 1, shape))
                for b in page.blocks:
                    if b.path:
                        seen.add((host, b.path, 2, _mark(b.path, b.text)))
                    node = b.node
                    while node not in counted:  # up to what an earlier block stands in
                        counted.add(node)
                        seen.add((host, page.paths[node], 0, 0))
                        node = page.parents[node]
                    if b.lead:
                        seen.add((host, b.lead, 3, xxhash.xxh64_intdigest(b.text) >> 1))
                rows += seen
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _host() -> Column:
    """The host of ``url`` in lower case; null or broken urls have the host without a name."""
    return F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))


def _counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature, c): on how many pages each feature occurs."""
    seen = pages.select(_host().alias("host"), "html").mapInArrow(_features, "host string, path long, kind int, feature long")
    return seen.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))


def style_tree(counts: DataFrame) -> DataFrame:
    """(host, path, pages, importance, branch): the merged tree of every host, one row per node.

    Content importance is 1 minus the mean over a node's texts of log(pages with the text) / log(pages);
    presentation importance is the entropy of its layouts over log(pages). What pages share counts pages / (pages + DOUBT). ``branch`` is the content
    importance of all texts below a main element with a word around it, null for other nodes.
    """
    total = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    c, log = F.col("c"), F.log(F.col("c").cast("double"))
    nodes = counts.groupBy("host", "path").agg(
        F.coalesce(total(0, c), F.lit(0)).alias("pages"),
        total(1, c).alias("shown"), total(1, c * log).alias("shown_log"),
        total(2, c).alias("texts"), total(2, c * log).alias("texts_log"),
        total(3, c).alias("below"), total(3, c * log).alias("below_log"),
    )
    m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    trust = F.col("pages") / (F.col("pages") + DOUBT)
    content = 1 - trust * F.col("texts_log") / F.col("texts") / m
    presentation = 1 - trust * (1 - (F.log(F.col("shown").cast("double")) - F.col("shown_log") / F.col("shown")) / m)
    importance = (
        F.when(F.col("texts").isNull(), presentation)
        .when(F.col("shown").isNull(), content)
        .otherwise(PRESENTATION_WEIGHT * presentation + (1 - PRESENTATION_WEIGHT) * content)
    )
    branch = 1 - trust * F.col("below_log") / F.col("below") / m
    return nodes.select(
        "host", "path", "pages", F.when(F.col("pages") >= 2, F.coalesce(importance, F.lit(1.0))).otherwise(1.0).alias("importance"), branch.alias("branch")
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for whole in batches:
        for batch in slices(whole, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "noise", "valued")))
            texts = [extract(page, frozenset(x or ()), frozenset(y or ())) for page, x, y in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema=schema,
            )


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html is an empty page with empty text; a null or broken url belongs to the host without a
    name. Repeated rows are extracted each; ties can't occur, since no page depends on another's
    order. Other columns are ignored; an empty table gives an empty result.
    """
    counts = materialize(_counts(pages), "counts")
    tree = style_tree(counts).where(F.col("pages") >= 2)
    tree = materialize(tree.where((F.col("importance") < LEAST_IMPORTANCE) | (F.col("branch") >= HIGH_IMPORTANCE)), "tree")
    low = tree.where(F.col("importance") < LEAST_IMPORTANCE).select("host", "path", "pages")
    # a text that few of the node's pages share is protected
    shared = 1 - F.col("pages") / (F.col("pages") + DOUBT) * F.log(F.col("c").cast("double")) / F.log(F.col("pages").cast("double")) < LEAST_IMPORTANCE
    noise = counts.where("kind = 2").join(low, ["host", "path"]).where(shared).select("host", F.col("feature").alias("noise"), F.lit(None).cast("long").alias("valued"))
    valued = tree.where(F.col("branch") >= HIGH_IMPORTANCE).select("host", F.lit(None).cast("long"), "path")
    # written first, so that the planner knows its size and joins it to the scan if it is small
    sets = (F.collect_set(x).alias(x) for x in ("noise", "valued"))
    noise = materialize(noise.union(valued).groupBy("host").agg(*sets), "noise")
    joined = pages.select("page_id", "url", "html", _host().alias("host")).join(noise, "host", "left")
    return joined.select("page_id", "url", "html", "noise", "valued").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
