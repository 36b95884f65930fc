"""The element tree of landed HTML pages.

Each page becomes one row: its visible text, and its elements in document order as
nested ranges. An element's descendants are the elements numbered from its own
number + 1 to ``last``; its text is a range of the page's text. What is asked of a tree
(descendants by tag or class, first match, text) is then a slice of the page's arrays.

Comments, declarations and the contents of script and style elements hold no
elements and no text; a ``>`` inside a quoted attribute ends nothing. Void elements
have no content. An end tag closes the innermost open element of its name and all
inside it, or nothing if there is none. End tags that HTML lets authors leave out are
implied: of a paragraph before a block, of list items, cells, rows, options and terms
before the next of their kind. What is open at the end is closed there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.functions import text as T
from litspark.functions.constants import CARD_DEFAULTS
from litspark.session import bound_batches

# FIXED VALUES — element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul".split())
#: a start tag → the open elements it ends, unless one of the scope tags is open inside them
IMPLIED_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th")} | {tag: ("p",) for tag in BLOCKS}
SCOPE = frozenset("article body button dl div html ol section table ul select".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style)\b(?P<rattrs>(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^\"'>]++|\"[^\"]*\"|'[^']*')*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

#: Characters of pages whose trees are Python objects at once (a longer page alone).
PARSE_CHARS = 1 << 20

ELEMENT = "struct<tag:string,attrs:map<string,string>,parent:int,last:int,depth:int,start:int,end:int>"


def attributes(source: str) -> dict[str, str]:
    """Names in lower case, values decoded; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def parse(page: str) -> tuple[str, list[dict]]:
    """A page's visible text and its elements in document order."""
    text, length, elements, stack, at = [], 0, [], [], 0

    def close(upto: int) -> None:
        for n in stack[upto:]:
            elements[n]["last"], elements[n]["end"] = len(elements) - 1, length
        del stack[upto:]

    def add(tag: str, attrs: str) -> None:
        elements.append({"tag": tag, "attrs": attributes(attrs), "parent": stack[-1] if stack else -1, "last": len(elements),
                         "depth": len(stack), "start": length, "end": length})

    for token in _TOKEN.finditer(page):
        piece = html.unescape(page[at: token.start()])
        text.append(piece)
        length, at = length + len(piece), token.end()
        if token["raw"]:
            add(token["raw"].lower(), token["rattrs"])
        elif token["tag"]:
            tag = token["tag"].lower()
            if token["end"]:
                upto = next((i for i in range(len(stack) - 1, -1, -1) if elements[stack[i]]["tag"] == tag), None)
                if upto is not None:
                    close(upto)
                continue
            for i in range(len(stack) - 1, -1, -1):
                if elements[stack[i]]["tag"] in IMPLIED_ENDS.get(tag, ()):
                    close(i)
                elif elements[stack[i]]["tag"] in SCOPE:
                    break
            add(tag, token["attrs"])
            if tag not in VOID:
                stack.append(len(elements) - 1)
    piece = html.unescape(page[at:])
    text.append(piece)
    length += len(piece)
    close(0)
    return "".join(text), elements


_KIND = pa.struct([("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), *[
    (name, pa.int32()) for name in ("parent", "last", "depth", "start", "end")]])


def parse_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(id, text, elements) of a batch (id, page), in batches of about ``PARSE_CHARS`` characters of pages:
    a tree takes many times its page's size until it is an Arrow row."""
    at, chars, texts, trees = 0, 0, [], []
    for n, page in enumerate(batch.column(1), 1):
        page = page.as_py()
        text, found = (None, []) if page is None else parse(page)
        texts.append(text)
        trees.append([e | {"attrs": list(e["attrs"].items())} for e in found])
        chars += len(page or "")
        if chars >= PARSE_CHARS or n == batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n - at), pa.array(texts, pa.string()), pa.array(trees, pa.list_(_KIND))],
                names=[batch.schema.names[0], "text", "elements"])
            at, chars, texts, trees = n, 0, [], []


def parse_pages(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(id, text, elements) of every page; a null page has no text and no elements."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parse_batch(batch)

    given = pages.select(id_col, F.col(html_col).cast("string"))
    return given.mapInArrow(run, f"`{id_col}` {given.schema[0].dataType.simpleString()}, text string, elements array<{ELEMENT}>")


def matches(element: Column, selector: str) -> Column:
    """Whether an element fits ``tag``, ``.class`` or ``tag.class`` (any number of classes)."""
    tag, *classes = selector.split(".")
    test = element["tag"] == tag.lower() if tag else F.lit(True)
    own = F.split(F.coalesce(element["attrs"]["class"], F.lit("")), r"\s+")
    for name in classes:
        test = test & F.array_contains(own, name)
    return test


def elements(parsed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per element: (id, node, tag, attrs, parent, last, depth, text); parent is null at the top."""
    rows = parsed.select(id_col, F.col("text").alias("_text"), F.posexplode("elements").alias("node", "e"))
    return rows.select(id_col, "node", "e.tag", "e.attrs", F.when(F.col("e.parent") >= 0, F.col("e.parent")).alias("parent"), "e.last",
                       "e.depth", F.substr("_text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("text"))


CARD = "article"
FIELDS = {"title": ("h1", None), "url": ("a", "href"), "source": ("cite", None), "year": ("time", None), "abstract": ("p", None)}


def extract_cards(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", card: str = CARD,
                  fields: dict[str, tuple[str, str | None]] | None = None, base_url: str = "") -> DataFrame:
    """One row per card, as ``html.extract_cards`` returns them, read off the tree: cards may be nested.
    A field is a selector and an attribute (null: the text). It is the first descendant that fits and
    has visible text (or the attribute); without one it takes its default."""
    wanted = FIELDS if fields is None else fields
    page = parse_pages(pages, html_col, id_col)
    numbered = F.transform("elements", lambda e, i: F.struct(i.alias("node"), e.alias("e")))
    cards = page.select(id_col, "text", "elements", F.posexplode(F.filter(numbered, lambda c: matches(c["e"], card))).alias("card_no", "c"))
    inner = cards.select(id_col, "card_no", "text", F.slice("elements", F.col("c.node") + 2, F.col("c.e.last") - F.col("c.node")).alias("inner"))

    def value(name: str) -> Column:
        if name not in wanted:
            return F.lit(None).cast("string")
        selector, attribute = wanted[name]
        fits = F.filter("inner", lambda e: matches(e, selector))
        if attribute:
            found = F.transform(fits, lambda e: e["attrs"][attribute])
        else:
            found = F.transform(fits, lambda e: T.unicode_trim(F.substr("text", e["start"] + 1, e["end"] - e["start"])))
        return F.try_element_at(F.filter(found, lambda t: F.length(t) > 0), F.lit(1))

    rows = inner.select(id_col, "card_no", *[value(name).alias(f"_{name}") for name in CARD_DEFAULTS])
    title, url, _, year, abstract = (F.coalesce(f"_{name}", F.lit(default)) for name, default in CARD_DEFAULTS.items())
    return rows.select(id_col, "card_no", title.alias("Title"), abstract.alias("Abstract"),
                       F.concat(F.lit(base_url), url).alias("Source"), year.alias("Year"))
