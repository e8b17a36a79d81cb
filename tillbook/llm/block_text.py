"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by link density, length, stop-word density and the kind of
element that holds them. The second gives each block that stayed open, short ones mostly,
the label of the nearest decided neighbour in its section of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_LINKS = 0.5
#: A block of fewer characters is short; one with this share of stop words is prose.
SHORT_CHARS, PROSE_SHARE = 70, 0.25

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that for it was on with as be by are this at from or an have not
    der die das und ist in den von zu mit sich des auf für nicht ein eine als auch dem im
    de la le et les des est en un une du que dans pour qui sur pas au par avec plus
    el los las y en que se del por con una para no su al lo como más""".split()
)
#: Elements that never hold article text.
OUTSIDE = frozenset("nav footer aside form menu dialog head button select option label".split())
#: Elements whose content is not markup, or not text.
RAW = frozenset("script style textarea title noscript template iframe svg math object xmp".split())
SECTIONS = frozenset("article main".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt
    ruby s samp small span strike strong sub sup time tt u var wbr""".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that tell of menus, notices, adverts and the like.
MARKS = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar
    navigation newsletter notice popup promo promoted related respond search share sharing
    sidebar signup social sponsor sponsored subscribe toolbar widget complementary
    contentinfo""".split()
)
#: Marks that, as a whole class, id or role, also rule out prose: it is not the author's.
ALIEN = frozenset(
    """ad ads advert adverts advertisement comment comments consent cookie cookies disqus gdpr
    newsletter popup promo promoted sponsor sponsored""".split()
)
#: Marks that, as any part of a class, id or role in a section, rule out an element that holds
#: neither a title nor most of the section's text.
STRANGE = ALIEN | frozenset("notice related respond sidebar signup subscribe".split())
#: With one of these in the same class, "header" is that of the text and not of the site.
OF_TEXT = frozenset("article content entry post story".split())
#: Marks that say nothing inside a section, where titles and builders have them.
NEUTRAL = frozenset("header widget".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|\Z)", re.I)
_NO_DISPLAY = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s>]*)display\s*:\s*none", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    section: int  # 0 outside articles
    outside: bool  # in an element that never holds article text
    heading: bool
    mark: int = 0  # the marked element of a section that holds it, 0 without
    strange: tuple[int, ...] = ()  # the elements of a section with a mark of STRANGE
    title: bool = False


def _named(attributes: str) -> str:
    return " ".join(x.strip("\"'") for x in _NAMED.findall(attributes)).lower()


def _marked(name: str, attributes: str, section: int) -> tuple[bool, bool, bool]:
    """Whether an element rules its text out, does so if it holds little, or speaks against it."""
    if _HIDDEN.search(_QUOTED.sub('""', attributes)) or _NO_DISPLAY.search(attributes):
        return True, False, False
    named = _named(attributes)
    if not named or name in ("html", "body", *SECTIONS):
        return False, False, False
    parts = {*re.split(r"[\s_-]+", named)}
    marks = MARKS & parts
    if not section:
        if OF_TEXT & parts:
            marks = marks - NEUTRAL
        return bool(marks), False, False
    alien = bool(ALIEN & {*named.split()})
    strange = bool(STRANGE & parts) and not alien
    return alien, strange, bool(marks - NEUTRAL) and not alien


def _without_strangers(found: list[Block]) -> list[Block]:
    """Blocks of strange elements are outside, unless the element has a title or most text."""
    of_section: Counter[int] = Counter()
    of_element: Counter[int] = Counter()
    kept: set[int] = set()
    for b in found:
        if not b.outside:
            of_section[b.section] += len(b.text)
            of_element.update(dict.fromkeys(b.strange, len(b.text)))
            if b.title:
                kept.update(b.strange)
    for b in found:
        kept.update(e for e in b.strange if 2 * of_element[e] > of_section[b.section])
    return [replace(b, outside=True) if {*b.strange} - kept else b for b in found]


def blocks(page: str) -> list[Block]:
    """Runs of text between block elements, in page order; empty ones are left out."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    # name, outside, section, mark, strange
    stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = []
    sections, marks, in_link, heading, title, at = 0, 0, False, False, False, 0
    para: tuple[bool, int, tuple[int, ...]] = (False, 0, ())  # outside, mark, strange of the open <p>

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            links = len(" ".join(html.unescape("".join(linked)).split()))
            _, outside, section, mark, strange = stack[-1] if stack else ("", False, 0, 0, ())
            mark = 0 if title else para[1] or mark
            outside = outside or para[0]
            found.append(Block(text, links, section, outside, heading, mark, para[2] or strange, title))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link:
            linked.append(text)

    while at < len(page):
        m = _MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in RAW:
            # a slash ends an element only in foreign markup
            if not ends and not (name in ("svg", "math") and attributes.endswith("/")):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name == "a":
            in_link = not ends
        elif name == "br":
            add(" ")
        elif name in INLINE:
            continue
        else:
            close()
            heading = not ends and name in ("h1", "h2", "h3", "h4", "h5", "h6")
            title, para = not ends and name == "h1", (False, 0, ())
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                in_link = False
            elif name not in VOID:
                _, outside, section, mark, strange = stack[-1] if stack else ("", False, 0, 0, ())
                if name in SECTIONS and not outside and not section:
                    sections += 1
                    section = sections
                if name in OUTSIDE or name == "header" and not section:
                    outside = True
                alien, odd, marked = _marked(name, attributes, section)
                outside = outside or alien
                if marked or odd:
                    marks += 1
                    mark = marks if marked else mark
                    strange = (*strange, marks) if odd else strange
                if name == "p":
                    para = (outside, mark, strange)
                    continue
                stack.append((name, outside, section, mark, strange))
    close()
    return _without_strangers(found)


def _decided(block: Block, has_section: bool) -> bool | None:
    """Article text or not; None is open."""
    if block.outside or has_section and not block.section:
        return False
    if block.linked > MOST_LINKS * len(block.text):
        return False
    if len(block.text) < SHORT_CHARS or block.heading:
        return None
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return True if share >= PROSE_SHARE else None


def main_blocks(page: str) -> list[str]:
    """The blocks of the article, in page order."""
    found = blocks(page)
    has_section = any(b.section and not b.outside for b in found)
    labels = [_decided(b, has_section) for b in found]
    if not has_section and True not in labels:
        # no prose in a language with a list: length and links alone decide
        labels = [
            True if label is None and not b.heading and len(b.text) >= SHORT_CHARS else label
            for b, label in zip(found, labels, strict=True)
        ]
    settled = list(labels)
    votes = [_votes(found, labels, i) for i in range(len(found))]
    for i, block in enumerate(found):
        if labels[i] is None:
            settled[i] = _inherited(found, votes, i, default=bool(block.section and not block.mark))
    return [b.text for b, good in zip(found, settled, strict=True) if good]


def _votes(found: list[Block], labels: list[bool | None], i: int) -> bool | None:
    """The label that block ``i`` can hand on.

    In a section, adverts, menus and the like say nothing about their neighbours, and
    links do only as a list of several. Marked elements say nothing about what is around.
    """
    block = found[i]
    if not block.section or labels[i] is not False:
        return labels[i]
    beside = [k for k in (i - 1, i + 1) if 0 <= k < len(found)]
    several = any(labels[k] is False and not found[k].outside for k in beside)
    return False if several and not block.outside and not block.mark else None


def _inherited(found: list[Block], votes: list[bool | None], i: int, default: bool) -> bool:
    """Label of the nearest decided block of the same section; article text wins a tie.

    A block in a marked element hears only those of the same element.
    """
    for step in range(1, len(found)):
        near = [
            votes[k]
            for k in (i - step, i + step)
            if 0 <= k < len(found)
            and votes[k] is not None
            and found[k].section == found[i].section
            and found[i].mark in (0, found[k].mark)
        ]
        if near:
            return any(near)
    return default


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks joined by a line feed), n_chars.

    A null or empty page has an empty text, as has one without article text. Rows that
    repeat repeat; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_blocks(p.as_py() or "")) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
