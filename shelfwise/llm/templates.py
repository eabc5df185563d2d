"""Main text of web pages by equivalence-class template deduction.

Pages of one host share a template. A page is read as a sequence of markup tokens, each a start or an end
tag together with the path of elements above it, and texts between them. Tokens with the same occurrence
vector over the host's pages (so many times on this page, so many on that one) form an equivalence class; a
vector is kept as its number of pages, its sum and a sum of hashes of (page, count), so it is gathered by a
plain aggregation however many pages a host has. A class that is frequent and whose tokens come in one order,
round by round, on ``MOSTLY`` of its pages is valid. Valid classes nest: of those whose tokens come once on as large a
share, the one of an article or main element is the place of the main text, so that single pages of another build do not
decide for their host. The texts between its tokens are the
slots to extract, but for those inside elements below the place that the page marks as something else (menus, adverts, forms
and so on); what stands around the place, and the place itself, may bear any mark. Where a host's template has no such
class, all slots of the page count, also those of a form that holds the whole page.

Words are always data here: a passage that many pages of a host share stays part of their texts. Hosts with
fewer than ``LEAST_PAGES`` pages cannot show a template; they are deduced together.

Rows: a missing html is an empty page, with an empty text; a missing or odd address belongs to the small
hosts; broken markup is read as far as it goes; repeated rows keep a row each and count once for the template;
extra columns are dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import slices, stored

LEAST_PAGES = 3
FREQUENT = 0.2  # least share of a host's pages on which a template token stands
MOSTLY = 0.8  # least share of those pages on which it must come as the template says

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([A-Za-z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s>/]*)([^>]*)>""",
    re.DOTALL,
)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "template", "svg"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre"
    " section table ul".split()
)
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
WALLS = frozenset(("article", "main", "section", "div", "td", "th", "li", "table", "body", "html", "aside", "nav", "header", "footer", "form"))
OTHER_TAGS = frozenset(("head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu")) | RAW
OTHER_MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo"
    " cookie cookies disclaimer footer masthead menu modal nav navbar navigation newsletter notice popup promo promotion"
    " search share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
STATES = frozenset("has is js no with without".split())  # a name that begins so tells of a state, not what the element is
RELATED = re.compile(r"related(?:[-_](?:articles?|content|items|links|news|pages|posts?|reading|stories|topics))?")
MAIN_TAGS = ("article", "main")


def _is_other(mark: str) -> bool:
    """Whether a class, id or role says that its element is no part of the text."""
    parts = re.split(r"[-_]+", mark)
    return parts[0] not in STATES and (not OTHER_MARKS.isdisjoint(parts) or bool(RELATED.fullmatch(mark)))


class Element:
    __slots__ = ("tag", "path", "other", "inside")

    def __init__(self, tag: str, path: str, other: bool, inside: bool) -> None:
        self.tag, self.path, self.other, self.inside = tag, path, other, inside  # other: by its own tag or marks


def _marks(rest: str) -> list[str]:
    found = {name.lower(): a or b or c for name, a, b, c in MARKS.findall(rest)} if "=" in rest else {}
    return [w for name in ("role", "class", "id") for w in found.get(name, "").lower().split()]


def read(page: str) -> Iterator[tuple[str, str, list[Element]]]:
    """``(kind, value, open elements)`` in page order: ``+``/``-`` with a path, ``text`` with the text, ``break``."""
    root = Element("", "", False, False)
    stack, at = [root], 0

    def close(down_to: int) -> Iterator[tuple[str, str, list[Element]]]:
        while len(stack) > down_to:
            gone = stack.pop()
            yield "-", gone.path, stack
            if gone.tag not in INLINE:
                yield "break", "", stack

    while True:
        found = TAG.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            yield "text", text, stack
        if not found:
            break
        at = found.end()
        slash, name, rest = (found.group(1), found.group(2), found.group(3)) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if place:
                yield from close(place)
            elif tag not in INLINE:
                yield "break", "", stack
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    yield from close(i)
                    break
                if stack[i].tag in WALLS:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in SIBLINGS else ():
            if stack[i].tag == tag:
                yield from close(i)
                break
            if stack[i].tag in SIBLINGS[tag]:
                break
        if tag not in INLINE:
            yield "break", "", stack
        if tag in VOID or rest.endswith("/"):
            continue
        above = stack[-1]
        marks = _marks(rest)
        named = tag not in ("html", "body") and any(map(_is_other, marks))
        other = tag in OTHER_TAGS or named or (tag == "header" and not above.inside)
        inside = above.inside or tag in MAIN_TAGS or "main" in marks
        element = Element(tag, f"{above.path}>{'.'.join([tag, *marks])}", other, inside)
        stack.append(element)
        yield "+", element.path, stack
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            yield from close(len(stack) - 1)
    yield from close(1)


def tokens(page: str) -> list[str]:
    """The markup tokens of a page in order."""
    return [kind + value for kind, value, _ in read(page) if kind in "+-"]


def main_text(page: str, places: set[str]) -> str:
    """The texts inside the elements ``places`` (all, if there are none on the page), without marked others."""

    def blocks(only: set[str], forms: bool = False) -> list[str]:
        done, block = [], []
        opened: list[tuple[bool, bool]] = []  # of each open element: whether it is a place, and whether it hides its texts
        depth = hidden = 0
        for kind, value, stack in read(page):
            if kind == "+":
                top = stack[-1]
                place = value in only
                hides = top.other and not place and (depth > 0 or not only) and not (forms and top.tag == "form")
                opened.append((place, hides))
                depth, hidden = depth + place, hidden + hides
            elif kind == "-":
                place, hides = opened.pop()
                depth, hidden = depth - place, hidden - hides
            elif kind == "text":
                if not hidden and (depth or not only):
                    block.append(entities.unescape(value))
            elif block:
                done.append("".join(block))
                block = []
        return [" ".join(b.split()) for b in [*done, "".join(block)] if b.strip()]

    found = blocks(places) if places else []
    return " ".join(found or blocks(set()) or blocks(set(), forms=True))


def in_rounds(sequence: list[str], of: dict[str, int]) -> dict[int, bool]:
    """Whether the tokens of each class come in one order, round by round, on a page."""
    seen: dict[int, list[str]] = {}
    for token in sequence:
        if token in of:
            seen.setdefault(of[token], []).append(token)
    result = {}
    for number, found in seen.items():
        width = len(set(found))
        first = found[:width]
        result[number] = len(set(first)) == width and found == first * (len(found) // width)
    return result


def _named(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\w+://([^/?#]+)", 1))
    return pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host.alias("host"),
    )


def _sequences(named: DataFrame) -> DataFrame:
    """``(host, page, tokens)`` with a hash that stands for the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = pa.array([tokens(h) for h in batch.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["host", "page", "tokens"])

    pages = named.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")
    return pages.mapInArrow(run, "host string, page long, tokens array<string>").dropDuplicates(["host", "page"])


def deduce(named: DataFrame, least: int = LEAST_PAGES, frequent: float = FREQUENT) -> DataFrame:
    """``(site, template)``: the tokens of each site's valid classes, with ``class`` and ``times`` a page.

    A site is a host with ``least`` pages or more; the empty string stands for all other hosts together.
    """
    read_once = stored(_sequences(named), "markup")
    large = read_once.groupBy("host").count().where((F.col("count") >= least) & (F.col("host") != "")).select("host", F.col("host").alias("site"))
    found = read_once.join(large, "host", "left").select(F.coalesce("site", F.lit("")).alias("site"), "page", "tokens")
    sizes = found.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    each = found.select("site", "page", F.explode("tokens").alias("token")).groupBy("site", "page", "token").count()
    vectors = each.groupBy("site", "token").agg(
        F.count(F.lit(1)).alias("support"), F.sum("count").alias("total"),
        F.when(F.count_if(F.col("count") == 1) >= MOSTLY * F.count(F.lit(1)), 1).otherwise(F.max("count")).cast("long").alias("times"),
        F.sum(F.xxhash64("page", "count").cast("decimal(38,0)")).alias("mark"),
    )
    often = vectors.join(sizes, "site").where(F.col("support") >= F.greatest(F.lit(2), F.col("pages") * frequent))
    numbered = often.select("site", "token", "times", F.xxhash64("support", "total", "mark").alias("class"))
    classes = numbered.groupBy("site").agg(F.collect_list(F.struct("token", "class", "times")).alias("classes"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sites, numbers, valid, pages = [], [], [], []
            for site, sequence, n, members in zip(*(c.to_pylist() for c in batch.columns)):
                for number, good in in_rounds(sequence, {m["token"]: m["class"] for m in members}).items():
                    sites.append(site), numbers.append(number), valid.append(n if good else 0), pages.append(n)
            if sites:
                columns = [pa.array(sites), *(pa.array(c, pa.int64()) for c in (numbers, valid, pages))]
                yield pa.RecordBatch.from_arrays(columns, ["site", "class", "valid", "pages"])

    # pages alike in markup are checked once
    kinds = found.groupBy("site", "tokens").agg(F.count(F.lit(1)).alias("n"))
    checked = kinds.join(classes, "site").select("site", "tokens", "n", "classes").mapInArrow(check, "site string, class long, valid long, pages long")
    valid = checked.groupBy("site", "class").agg(F.sum("valid").alias("good"), F.sum("pages").alias("all"))
    valid = valid.where(F.col("good") >= MOSTLY * F.col("all")).select("site", "class")
    template = numbered.join(valid, ["site", "class"])
    return template.groupBy("site").agg(F.collect_list(F.struct("token", "class", "times")).alias("template"))


def place_of_text(template: list[dict]) -> set[str]:
    """Paths of the outermost article or main elements whose start and end tags come in a class once a page."""
    once = {t["token"] for t in template if t["times"] == 1}
    paths = {t[1:] for t in once if t[0] == "+" and "-" + t[1:] in once}
    main = {p for p in paths if any(p.rpartition(">")[2].split(".")[0] == tag or "main" in p.rpartition(">")[2].split(".")[1:] for tag in MAIN_TAGS)}
    return {p for p in main if not any(p.startswith(q + ">") for q in main)}


def extract(pages: DataFrame, least: int = LEAST_PAGES, frequent: float = FREQUENT) -> DataFrame:
    """``(page_id, url, text)`` with the main text of each page."""
    named = _named(pages)
    templates = deduce(named, least, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            out = []
            for page, main in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("html", "main"))):
                out.append(main_text(page, set(main or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main = [sorted(place_of_text(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main, pa.list_(pa.string()))], ["site", "main"])

    places = stored(templates.select("site", "template").mapInArrow(chosen, "site string, main array<string>"), "places")
    rest = places.where("site = ''").first()  # what hosts without a template of their own use
    of_host = places.where("site <> ''").withColumnRenamed("site", "host")
    main = F.coalesce("main", F.array(*[F.lit(p) for p in (rest["main"] if rest else [])]).cast("array<string>"))
    joined = named.join(of_host, "host", "left").select("page_id", "url", "html", main.alias("main"))
    return joined.mapInArrow(run, "page_id long, url string, text string")


def op3_main_text(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
