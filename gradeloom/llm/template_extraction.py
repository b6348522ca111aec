"""Main text of web pages by equivalence classes of template tokens.

A token is a block element in its place in the page (its path).  Over the pages of one
host with one layout, tokens with equal occurrence vectors, as often as each other on
every page, form an equivalence class; vectors are compared by the exclusive or of the
hashes of (page, count).  The class of the page body is the outer template; from the
body, the template is followed inwards through elements of that class as long as one of
them holds most of the text that differs between pages.  What is left is the slot of the
article: its blocks are kept but for menus, footers and the like by their element, for
named slots that say one and the same on different pages, and for elements with a name
of adverts, comments and the like as long as most of the varying text lies elsewhere.
"""

from __future__ import annotations

import html as entities
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gradeloom.llm.blocks import result_schema, with_results
from gradeloom.llm.words import slices
from gradeloom.staging import stage

_SLICE_BYTES = 4 << 20
MAX_BROADCAST = 100_000
# Share of the varying text that an element needs for the template to be followed into it.
MOST = 0.5
# A slot is constant if it has one single text on this many different pages or more.
CONSTANT_PAGES = 10
# An element is not left out for its name if it has more than this share of its group's text.
NAMED_MOST = 0.8
# Ends the step of an element in a path that has such a name.
_NAMED = "!"

# Elements by their role in the standard.
_BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks that are the article's own if they have no name and stand beside its varying text.
_PLAIN = re.compile(r"/(?:p|h[1-6]|li|dt|dd|t[dh]|caption|figcaption|pre|blockquote)$")
_RAW = frozenset("script style noscript template svg math iframe textarea select button option object title head".split())
_LEFT_OUT = frozenset("nav footer aside form".split())
_CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_NAMES = (
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|discussion|footer|gdpr|"
    r"%slegal|login|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|related|replies|reply|share|sharing|sidebar|signup|"
    r"social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])"
)
_NAMES_LEFT_OUT = re.compile(_NAMES % "header|")
# Inside an article, and for headings, a header is that of the article.
_NAMES_INSIDE = re.compile(_NAMES % "")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/]?[A-Za-z!?/](?:\"[^\"]*\"|'[^']*'|[^>\"'])*(?:>|\Z)|<\Z", re.S)
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
_NAME = re.compile(r"""\s(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ROOT = "/html/body"
# Columns that the joined pages need.
_OWN = ("_group", "_region", "_constant", "_named")


def blocks_of(html: str) -> Iterator[tuple[str, bool, str]]:
    """(path, left out, text) of all blocks in order, and with empty text each opened element.

    Steps of elements with a name of menus, adverts and the like end with ``_NAMED``.
    """
    stack: list[tuple[str, str, bool]] = []
    words: list[str] = []
    place, n = 0, len(html)

    def flush() -> str:
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        return text

    def here() -> tuple[str, bool]:
        return ("", False) if not stack else (stack[-1][1], stack[-1][2])

    def close(tags: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                del stack[i:]
                return

    while place < n:
        mark = _MARK.search(html, place)
        end = mark.start() if mark else n
        if end > place:
            words.append(html[place:end])
        if not mark:
            break
        place, found = mark.end(), mark.group()
        tag = _TAG.match(found)
        if not tag or (place == n and not found.endswith(">")):
            continue
        name, closing = tag.group(1).lower(), found[1] == "/"
        if name == "br":
            words.append(" ")
        elif name in _RAW and not closing:
            if name == "head" or found.endswith("/>"):
                continue
            shut = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, place)
            place = shut.end() if shut else n
            words.append(" ")
        elif name in _BLOCKS:
            if text := flush():
                yield *here(), text
            if closing:
                close({name})
                continue
            # A paragraph ends where another block begins, an item where the next one does.
            if stack and stack[-1][0] == "p":
                stack.pop()
            if stack and stack[-1][0] in _CLOSES_ITSELF.get(name, ()):
                stack.pop()
            if name in ("html", "body") and any(tag_ == name for tag_, _, _ in stack):
                continue
            path, out = here()
            labels = [(kind.lower(), (a or b or c).lower()) for kind, a, b, c in _NAME.findall(found)]
            label = " ".join(value for _, value in labels)
            first = re.sub(r"\d+", "0", label.split()[0]) if label.split() else ""
            inside = any(tag_ in ("article", "main") for tag_, _, _ in stack)
            first = first.replace("/", "").replace(_NAMED, "")
            path = f"{path}/{name}" + (f".{first}" if first and name not in ("html", "body") else "")
            listed = _NAMES_INSIDE if inside or name in _HEADINGS else _NAMES_LEFT_OUT
            if name not in ("html", "body", "main") and any(_is_listed(listed, name, *value) for value in labels):
                path += _NAMED
            out = out or name in _LEFT_OUT or (name == "header" and not inside)
            if name != "hr":
                stack.append((name, path, out))
                yield path, out, ""
    if text := flush():
        yield *here(), text


def _is_listed(listed: re.Pattern[str], element: str, kind: str, value: str) -> bool:
    """Whether an attribute names an element as a menu, an advert and the like.

    An id says so as a whole only, and never for a heading, where it is the place a link goes to.
    """
    if kind == "id":
        return element not in _HEADINGS and listed.fullmatch(value.strip()) is not None
    return listed.search(value) is not None


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _group(url: str | None, blocks: Sequence[tuple[str, bool, str]]) -> int:
    """Pages of one host with the same elements in the body, as a number."""
    layout = sorted({path for path, _, text in blocks if not text and path.startswith(_ROOT) and path.count("/") <= 3})
    return xxhash.xxh64_intdigest("\n".join([host_of(url), *layout]).encode("utf-8", "replace")) >> 1


def _tokens(df: DataFrame, url: str, html: str) -> DataFrame:
    """(group, page, words, path, left_out, n, text, chars): the elements and texts of every page; pages of the same texts have the same ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, _SLICE_BYTES):
                rows: list[tuple] = []
                for link, value in zip(part.column(url).to_pylist(), part.column(html).to_pylist()):
                    blocks = list(blocks_of(value or ""))
                    group, page = _group(link, blocks), uuid.uuid4().int >> 65
                    counts = Counter((p, out, xxhash.xxh64_intdigest(t.encode()) >> 1 if t else None, len(t)) for p, out, t in blocks)
                    shown = sorted(t for (_, out, t, _) in counts if t is not None and not out)
                    words = xxhash.xxh64_intdigest(repr(shown)) >> 1
                    rows += [(group, page, words, p, out, c, t, size) for (p, out, t, size), c in counts.items()]
                columns = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = pa.schema(
        [("group", pa.int64()), ("page", pa.int64()), ("words", pa.int64()), ("path", pa.string()), ("left_out", pa.bool_()), ("n", pa.int64()), ("text", pa.int64()), ("chars", pa.int64())]
    )
    return df.select(url, html).mapInArrow(run, "group long, page long, words long, path string, left_out boolean, n long, text long, chars long")


def _named_roots(path: str) -> list[str]:
    """The elements on a path that have a listed name, the outermost first."""
    steps = path.split("/")
    return ["/".join(steps[: i + 1]) for i, step in enumerate(steps) if step.endswith(_NAMED)]


def _is_article(root: str) -> bool:
    """Whether a named element is an article in no other one; its page decides about it."""
    *above, last = (re.match(r"[a-z0-9]*", step).group() for step in root.split("/"))
    return last == "article" and not {"article", "main"} & set(above)


def _template(slots: pa.Table) -> pa.Table:
    """Where the article lies on the pages of a group, the slots there that never change, and the named elements to keep."""
    rows = {(r["path"], r["left_out"]): r for r in slots.to_pylist()}
    shown = {p: r for (p, out), r in rows.items() if not out}
    outer = (shown.get(_ROOT) or {}).get("vector")

    def mass(path: str, paths: Iterable[str]) -> int:
        return sum(shown[p]["mass"] or 0 for p in paths if p == path or p.startswith(path + "/"))

    whole = sum(r["mass"] or 0 for r in shown.values())
    roots = {root for p in shown for root in _named_roots(p)}
    named = {root for root in roots if _is_article(root) or mass(root, shown) > NAMED_MOST * whole}
    inside = [p for p in shown if all(root in named for root in _named_roots(p))]
    here = _ROOT if _ROOT in shown else ""
    while True:
        inner = [p for p in inside if p.rpartition("/")[0] == here]
        # Only elements that come once wherever the body does belong to the outer template.
        once = [p for p in inner if shown[p]["vector"] == outer and outer is not None]
        best = max(once, key=lambda p: (mass(p, inside), p), default=None)
        if best is None or best.rpartition("/")[2].startswith(("p", "h")) or mass(best, inside) <= MOST * mass(here, inside):
            break
        here = best
    varying = {p.rpartition("/")[0] for p in inside if (shown[p]["texts"] or 0) > 1}
    constant = [
        p
        for p in inside
        if (shown[p]["pages"] or 0) >= CONSTANT_PAGES
        and shown[p]["texts"] == 1
        and p.startswith(here + "/")
        and not (_PLAIN.search(p) and p.rpartition("/")[0] in varying)
    ]
    lists = [pa.array(["\n".join(sorted(paths))]) for paths in (constant, named)]
    return pa.table({"group": slots["group"][:1], "region": pa.array([here]), "constant": lists[0], "named": lists[1]})


def find_templates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(group, region, constant, named): the template of every group of pages.

    The tokens of a page are counted there and meet as sums; one task gets the paths of a
    group, not its pages.
    """
    tokens = stage(_tokens(pages, url, html), "page_tokens")
    elements = (
        tokens.filter("text IS NULL")
        .groupBy("group", "path", "left_out")
        .agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count_distinct("words").alias("pages"))
    )
    texts = tokens.filter("text IS NOT NULL").groupBy("group", "path", "left_out", "text").agg(F.max("chars").alias("chars"))
    slots = texts.groupBy("group", "path", "left_out").agg(F.sum("chars").alias("mass"), F.count("*").alias("texts"))
    joined = elements.join(slots, ["group", "path", "left_out"], "left")
    schema = "group long, region string, constant string, named string"
    return stage(joined.groupBy("group").applyInArrow(_template, schema), "templates")


def extract_main_text(
    pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) and the main text of every page.

    Blocks are joined by line feeds, white space inside a block is one space and
    character references are decoded.  Null and empty pages and pages without an article
    have ``""``.  Pages are judged with all pages of their host that have their layout;
    a null or broken url is a host of its own, repeated rows count repeatedly.  A column
    named ``text`` is replaced, those in ``_OWN`` are dropped.  An empty table gives an
    empty result.
    """
    names = [n for n in (pages.columns if keep is None else keep) if n not in _OWN]
    templates = find_templates(pages, url, html)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, _SLICE_BYTES):
                at = [part.schema.get_field_index(c) for c in (url, html)]
                values = zip(part.column(at[0]).to_pylist(), part.column(at[1]).to_pylist())
                groups = [_group(link, list(blocks_of(value or ""))) for link, value in values]
                yield with_results(part, {"_group": pa.array(groups, pa.int64())})

    numbered = pages.select(*dict.fromkeys([*names, url, html])).mapInArrow(
        number, result_schema(pages.select(*dict.fromkeys([*names, url, html])), StructType([StructField("_group", LongType())]))
    )
    known = templates.withColumnsRenamed({"group": "_group", "region": "_region", "constant": "_constant", "named": "_named"})
    known = F.broadcast(known) if templates.count() <= MAX_BROADCAST else known
    placed = numbered.join(known, "_group", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html, _SLICE_BYTES):
                column = {n: part.column(part.schema.get_field_index(n)).to_pylist() for n in (html, *_OWN[1:])}
                found = [_main(*row) for row in zip(column[html], *(column[n] for n in _OWN[1:]))]
                yield with_results(part.select(names), {text: pa.array(found, pa.string())})

    return placed.mapInArrow(read, result_schema(pages.select(*names), StructType([StructField(text, StringType())])))


def _main(html: str | None, region: str | None, constant: str | None, named: str | None) -> str:
    region, never_change, kept = region or "", {p for p in (constant or "").split("\n") if p}, set((named or "").split("\n"))
    found = [
        (path, text)
        for path, out, text in blocks_of(html or "")
        if text and not out and path not in never_change and all(root in kept for root in _named_roots(path))
    ]
    whole = sum(len(text) for _, text in found)
    # An article with a listed name is left out where most of its page is elsewhere.
    small = [
        root
        for root in {root for path, _ in found for root in _named_roots(path) if _is_article(root)}
        if sum(len(text) for path, text in found if path == root or path.startswith(root + "/")) <= MOST * whole
    ]
    return "\n".join(
        text
        for path, text in found
        if (path == region or path.startswith(region + "/")) and not any(root in small for root in _named_roots(path))
    )
