"""Main text of web pages by deducing the page template of each host.

A page is a sequence of tokens: its block tags with their paths, and its texts. Tokens of a host whose occurrence
vectors over the host's pages agree form an equivalence class; a class is valid if its tokens stand in most pages,
once each, in one order. Valid classes nest by path into the host's template, and what lies between the template's
tokens are slots. A slot's place in the template tells its role: texts that are template tokens themselves, and slots
under menus, headers, footers, side bars, notices, adverts, forms and comments are left out; of the rest the slots of
the template's article are extracted, or all if it has none.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stable
from .tables import small_side

MIN_PAGES = 3
SUPPORT = 0.6
SMALL_HOSTS = 20_000

# fixed values: elements of HTML by their role
RAW = "script style noscript template textarea iframe svg math object select"
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
DROPPED = "head nav footer aside form button dialog menu fieldset title"
MAIN = "article main"
ENDS_P = (
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main "
    "menu nav ol p pre section table ul"
)
ROLES = (
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification overlay pagination pager popup promo promoted related "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags "
    "toolbar topbar widget widgets"
)

LABELS = "h1 h2 h3 h4 h5 h6 dt th caption summary label legend figcaption"

_RAW, _INLINE, _VOID, _DROPPED, _MAIN, _ENDS_P, _ROLES, _LABELS = (
    frozenset(x.split()) for x in (RAW, INLINE, VOID, DROPPED, MAIN, ENDS_P, ROLES, LABELS)
)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:\bclass|\bid|\brole)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    """A text between block tags: its path, whether it lies in a region to drop, or in the article."""

    path: str
    dropped: bool
    main: bool
    text: str


def _role(tag: str, attrs: str, in_main: bool) -> str:
    """Why an element's texts are left out: its tag, a word of its class, id or role, or nothing."""
    if tag in _DROPPED or (tag == "header" and not in_main):
        return "tag"
    if not attrs or tag in ("html", "body"):
        return ""
    words = _SPLIT.split(" ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower())
    if in_main:
        words = [w for w in words if w != "header"]
    found = _ROLES.intersection(words)
    return "comment" if any(w.startswith("comment") for w in found) else "name" if found else ""


def blocks(page: str) -> tuple[list[str], list[Block]]:
    """The paths of a page's block tags, in order, and its texts. Never fails: whatever is open at the end is closed."""
    tags: list[str] = []
    out: list[Block] = []
    stack: list[tuple[str, str, str, bool]] = [("", "", "", False)]
    seen_main = False
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        held.clear()
        if text:
            _, path, dropped, main = stack[-1]
            out.append(Block(path, bool(dropped), main, text))

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag or tag in _INLINE:
            continue
        flush()
        if tag in _VOID:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in _ENDS_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
            stack.pop()
        _, path, dropped, main = stack[-1]
        path = f"{path}/{tag}"
        if tag in _MAIN and dropped == "name" and not seen_main:
            dropped = ""  # a frame around everything that is named after one of its parts
        dropped = dropped or _role(tag, m["attrs"], main)
        seen_main = seen_main or (tag in _MAIN and not dropped)
        stack.append((tag, path, dropped, main or tag in _MAIN))
        tags.append(path)
    held.append(page[at:])
    flush()
    return tags, out


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def _text_token(b: Block) -> int:
    return _hash(b.path, b.text)


def _sequence(page: str) -> tuple[list[tuple[int, str]], list[Block]]:
    """A page's tokens that can belong to a template, with paths: its block tags and its texts."""
    tags, texts = blocks(page)
    return [(_hash(t), t) for t in tags] + [(_text_token(b), b.path + "/#") for b in texts], texts


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for host, key, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found, _ = _sequence(page)
            counts, path = Counter(t for t, _ in found), dict(found)
            for place, (token, n) in enumerate(counts.items()):
                for c, v in zip(cols, (host, key, token, path[token], n, place), strict=True):
                    c.append(v)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "page", "token", "path", "n", "place"])


def _with_host(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col(url_col), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("*", F.when(host != "", host).alias("_host"), F.coalesce(html_col, F.lit("")).alias("_html"))


def page_templates(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, support: float = SUPPORT
) -> DataFrame:
    """(host, token, path, cls, place): the tokens of each host's template, by equivalence class.

    A token's occurrence vector, one entry for each distinct page of the host, is compared by the XOR of hashes of
    its entries, which partial sums make without bringing a host's pages together. Kept are tokens found once each
    in at least ``min_pages`` pages and ``support`` of the host's pages, in classes of two or more. So a template
    has no more tokens than ``1 / support`` average pages. An article element in that many pages is kept however
    often some page has it, in a class of its own if need be. Pages without a host have no template.
    """
    rows = _with_host(pages, url_col, html_col).where("_host IS NOT NULL")
    rows = rows.select(F.col("_host").alias("host"), F.xxhash64("_html").alias("page"), F.col("_html").alias("html"))
    kinds = "host string, page long, token long, path string, n long, place long"
    tokens = rows.mapInArrow(_tokens, kinds).withColumn("entry", F.xxhash64("page", "n"))
    size = rows.groupBy("host").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    found = tokens.groupBy("host", "token").agg(
        F.min("path").alias("path"),
        F.max("n").alias("most"),
        F.avg("place").alias("place"),
        F.expr("count(DISTINCT entry)").alias("n"),
        F.expr("bit_xor(DISTINCT entry)").alias("cls"),
    )
    article = F.col("path").rlike(f"/({'|'.join(sorted(_MAIN))})$")
    found = found.where(((F.col("most") == 1) | article) & (F.col("n") >= min_pages)).join(size, "host")
    found = found.where(F.col("n") >= support * F.col("pages"))
    per_class = found.groupBy("host", "cls").agg(F.count(F.lit(1)).alias("k"))
    return found.join(per_class, ["host", "cls"]).where((F.col("k") > 1) | article).select("host", "token", "path", "cls", "place")


def matched(template: list[dict], sequence: list[int]) -> set[int]:
    """Tokens of a page that its host's template explains.

    A class counts if all its tokens are there in its order. Classes are taken from the longest on, and one that
    crosses a class taken before, instead of lying in one of its slots or outside, is not valid on this page.
    """
    first: dict[int, int] = {}
    for i, token in enumerate(sequence):
        first.setdefault(token, i)
    classes: dict[int, list[int]] = {}
    for t in template:
        classes.setdefault(t["cls"], []).append(t["token"])
    taken: list[list[int]] = []
    for _, tokens in sorted(classes.items(), key=lambda x: (-len(x[1]), x[0])):
        at = [first.get(t, -1) for t in tokens]
        if at[0] < 0 or any(a >= b for a, b in zip(at, at[1:], strict=False)):
            continue
        nested = all(
            bisect(x, at[0]) == bisect(x, at[-1]) or bisect(at, x[0]) == bisect(at, x[-1]) for x in taken
        )
        if nested:
            taken.append(at)
    return {sequence[i] for x in taken for i in x}


def _article(path: str) -> str:
    """The outermost article element of a path, or nothing."""
    parts = path.split("/")
    return next(("/".join(parts[: k + 1]) for k, tag in enumerate(parts) if tag in _MAIN), "")


def _without_notices(texts: list[Block], known: set[int]) -> list[Block]:
    """An article's texts without the template's own at its beginning and end; headings and labels always stay.

    What all pages of a host say inside their articles is a section's heading or a field's name, if it isn't a notice put
    before or after the article's own text.
    """
    kept = [_text_token(b) not in known or b.path.rsplit("/", 1)[-1] in _LABELS for b in texts]
    own = [i for i, k in enumerate(kept) if k]
    return texts[own[0] : own[-1] + 1] if own else []


def _headed(texts: list[Block], known: set[int]) -> list[Block]:
    """The slots, with headings of the template that stand right before one of them in the same element."""
    slot = [not b.dropped and _text_token(b) not in known for b in texts]
    keep = list(slot)
    for i in range(len(texts) - 2, -1, -1):
        parent, _, tag = texts[i].path.rpartition("/")
        heads = tag in _LABELS and not texts[i].dropped and texts[i + 1].path.rpartition("/")[0] == parent
        keep[i] = slot[i] or (heads and keep[i + 1])
    return [b for b, k in zip(texts, keep, strict=True) if k]


def main_text(page: str, template: list[dict]) -> str:
    """The texts in the template's article slots.

    Slots are what the template's tokens leave of a page; texts that are template tokens or lie in a region to leave
    out belong to none. An article is the template's if it or any element in it is; texts between its slots belong to
    it, whether other pages have them too or not. If no slot lies in an article of the template, an article of the
    page's own counts (few or odd pages), then, if the template covers all of the page's articles (copies of one page),
    their texts all the same, and after that all slots with the headings right before them.
    """
    found, texts = _sequence(page)
    known = matched(template, [t for t, _ in found]) if template else set()
    articles = {_article(path) for token, path in found if token in known} - {""}
    inside = [(_article(b.path), b) for b in texts if b.main and not b.dropped]
    own = [b for _, b in inside]
    slots = [b for b in own if _text_token(b) not in known]
    if slots:
        of_template = {_article(b.path) for b in slots} & articles
        chosen = [b for name, b in inside if name in of_template] if of_template else own
        return " ".join(b.text for b in _without_notices(chosen, known))
    return " ".join(b.text for b in own or _headed(texts, known))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, t or []) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        cols = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text"])


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **limits: float
) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; ``limits`` go to :func:`page_templates`.

    A null html counts as empty and gives an empty text; a null or odd url has no host, so that the page's own tags
    decide alone, as they do on hosts with fewer than ``min_pages`` different pages. Repeated rows repeat their
    results; other columns are ignored. White space in a block becomes one space, blocks are joined by one.
    """
    token = F.struct("place", "token", "cls")
    per_host = page_templates(pages, url_col, html_col, **limits).groupBy("host")
    templates = stable(per_host.agg(F.array_sort(F.collect_list(token)).alias("template")))
    rows = _with_host(pages, url_col, html_col).select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), "_html", F.col("_host").alias("host")
    )
    rows = rows.join(small_side(templates, SMALL_HOSTS)(templates), "host", "left")
    out = rows.select("page_id", "url", "_html", "template").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
