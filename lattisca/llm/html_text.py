"""Main text of web pages by block rules in two passes: stop-word density, length and link density decide blocks; short or
middling blocks then take the label of their nearest decided neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lattisca.llm.common import table, with_text

#: Characters below which a block is short, and from which one with many stop words is decided alone.
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINK_HIGH = 0.33

# Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    (
        "the of and to a in is that it was for on are as with his they at be this from have or by had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than been its who now my over did down only way find use may "
        "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
        "le la les de des et est un une du en que qui dans pour pas sur au avec ce il elle par plus ne se son sa ses ou mais comme nous vous ils été être cette aux sont leur même fait "
        "el la los las de y que en un una es se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante"
    ).split()
)
# Elements that end a block; whose content is not text; that hold no main text; and words of class, id and role
# that mark such parts.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp|noscript|template"
DROPPED = frozenset("nav footer aside form button select svg math object head menu dialog canvas audio video map fieldset search".split())
ALWAYS = "comment advert adsense sponsor promo cookie consent newsletter subscri disqus gdpr".split()  # beginnings of words
MARKS = frozenset("ad ads adv reply replies respond share sharing social related recommended recommendations signup login popup modal overlay pagination pager skip copyright disclaimer".split())
#: Marks that name a place; beside a word of CONTAINERS they describe the layout of what holds the article too.
PLACES = frozenset("banner notice notices alert sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar widget tags legal".split())
CONTAINERS = frozenset("main content wrapper wrap container layout page site body article post entry with has no left right".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

# Every part goes on to its end or to that of the page and gives nothing back, so a page is read once, however broken.
_INSIDE = r"(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>=]++|=)*+"  # of a tag; quotes count behind an equals sign
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_INSIDE}>.*?(?:</\1(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_INSIDE})(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++)))?")
_PART = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    dropped: bool
    article: int  # which article or main part holds it; 0: none
    heading: bool
    label: str = ""


def _named(words: list[str]) -> bool:
    if not MARKS.isdisjoint(words) or any(w.startswith(a) for w in words for a in ALWAYS):
        return True
    return not PLACES.isdisjoint(words) and CONTAINERS.isdisjoint(words)


def _marked(tag: str, attributes: str) -> bool:
    """Whether class, id, role or visibility mark an element as none of the article."""
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if tag not in ("article", "main", "body", "html") and _named(_PART.findall(value)):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space as single spaces."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    held: Counter[str] = Counter()  # the stack's tags; closers of others are passed over without a look
    parts: list[str] = []
    links: list[str] = []
    in_link = 0
    articles = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                out.append(Block(text, linked, dropped, article, any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])))
        parts.clear()
        links.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                links.append(piece)
        at = m.end()
        if m[3] is None:  # a comment, a declaration or an element of raw text
            continue
        tag = m[3].lower()
        if tag == "br":
            parts.append("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        block = tag in BLOCKS or tag in DROPPED
        if block:
            flush()
        if not m[2]:
            if tag == "a":
                in_link += 1
                continue
            if not block and not m[4]:
                continue
            if block:  # a paragraph's end need not be written
                while stack and stack[-1][0] == "p":
                    stack.pop()
                    held["p"] -= 1
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            if tag in ("article", "main") and not dropped:
                articles += not article
                article = article or articles
            dropped = dropped or tag in DROPPED or (tag == "header" and not article) or _marked(tag, m[4])
            if block or dropped:
                if not block:
                    flush()
                stack.append((tag, dropped, article))
                held[tag] += 1
        elif tag == "a":
            in_link = max(0, in_link - 1)
        elif held[tag]:
            if not block:
                flush()
            while stack:
                last = stack.pop()[0]
                held[last] -= 1
                if last == tag:
                    break
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(b: Block) -> str:
    """good or bad, where a block decides alone; near or short, where its neighbours must."""
    if b.dropped:
        return "bad"
    if b.link_chars > LINK_HIGH * len(b.text):
        return "bad"
    if not b.article and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    density = stop_density(b.text)
    if density >= STOP_HIGH or (b.article and density >= STOP_LOW):
        return "good" if len(b.text) >= LONG or b.article else "near"
    if density >= STOP_LOW or b.article:
        return "near"
    return "bad"


def second_pass(blocks: list[Block], inside: bool) -> None:
    """Undecided blocks take the labels of the nearest decided ones. Inside an article its marked parts do not speak for
    the others, and a block with no decided neighbour is text."""
    n = len(blocks)
    before, after = [""] * n, [""] * n
    last = ""
    for i in range(n):
        before[i] = last
        if blocks[i].label in ("good", "bad") and not (inside and blocks[i].dropped):
            last = blocks[i].label
    last = ""
    for i in range(n - 1, -1, -1):
        after[i] = last
        if blocks[i].label in ("good", "bad") and not (inside and blocks[i].dropped):
            last = blocks[i].label
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            continue
        around = {x for x in (before[i], after[i]) if x}
        if inside:
            good = not around or "good" in around
        elif b.label == "near":
            good = "good" in around
        else:  # short: both sides, or a heading before text
            good = around == {"good"} or (b.heading and after[i] == "good")
        b.label = "good" if good else "bad"


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    blocks = blocks_of(page or "")
    for b in blocks:
        b.label = first_pass(b)
    parts = {b.article for b in blocks if b.article and not b.dropped}
    for part in parts:
        second_pass([b for b in blocks if b.article == part], True)
    rest = [b for b in blocks if b.article not in parts]
    if parts:  # a page that marks its article has none elsewhere
        for b in rest:
            b.label = "bad"
    else:
        second_pass(rest, False)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (its code points) to the columns ``keep`` (all but the page) of ``pages``; own columns of those
    names go.

    Null, empty and textless pages give an empty text; broken mark-up is read as far as it goes, an unclosed tag or quoted
    value to the end of the page; a very long page takes time in proportion; repeated rows are read each; an empty table
    gives none.
    """
    keep = [c for c in ([c for c in pages.columns if c != page] if keep is None else keep) if c not in ("text", "n_chars")]
    rows, kept = with_text(pages, page, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, kept.add("text", "string").add("n_chars", "long"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")
