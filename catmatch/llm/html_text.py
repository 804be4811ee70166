"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks alone: places that
never hold the article (navigation, page headers, footers, asides, forms, adverts, notices,
comments), and mostly linked text, are bad; long text with function words or little linked text
is good; short or unclear text stays open. The second pass gives open blocks the label of their
nearest decided neighbours. Inside an <article> or <main> only what the first pass calls bad goes.

Defined cases: null html has an empty text; text without tags is one block; unclosed or crossed
tags never lose text, but a script, style or comment that is not closed goes to the end of the page; rows that repeat a page_id are pages of their own; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page: plain ones hold no tags of their own, nested ones do.
_PLAIN = "noscript|iframe|title|textarea"
_NESTED = "template|object|svg|math|canvas|audio|video|select|button"
_END = r"(?=[\s/>])"  # so that svg-icon is no svg
#: A tag ends before the next "<" outside of quotes, and no part of a pattern is tried twice, so that broken pages cost no more than whole ones.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style){_END}[^<>]*+>.*?(?:</\1\s*+>|\Z)"
    rf"|<({_PLAIN}){_END}[^<>]*+>(?:(?!<\2{_END}).)*?</\2\s*+>|<[!?][^>]*+(?:>|\Z)"
    rf"|<({_NESTED}){_END}((?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+)>|<(/?)([a-z][a-z0-9:-]*+)([^<>]*+)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))|\b(hidden)\b", re.I)
#: Decimal references of more digits than any code point has: Python refuses to read very long numbers.
_ZEROS, _LONG_NUMBER = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}")
_BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROOTS = frozenset(["article", "main"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Elements that never hold the article; a header only outside of one.
_ASIDE_TAGS = frozenset("nav aside footer form menu dialog fieldset".split())
#: Words of class, id or role that mark such places.
_ASIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent
gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup sidebar widget related recommended recommendations
share sharing social nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments
commentlist reply replies respond disqus discussion login search contentinfo complementary copyright disclaimer hidden""".split())
_COMMENT_WORDS = frozenset(["comment", "comments", "commentlist", "reply", "replies", "respond", "disqus"])
#: With these a class says what a wrapper has, not what it is: has-sidebar, no-ads.
_ABOUT_WORDS = frozenset(["has", "with", "no", "without"])
#: Elements that end where the next of their kind begins.
_SELF_ENDING = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6".split())
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""the of and to in is that it for on with as was be by at this are from or an a he she not but have had they you which
de la le les et des un une du que qui en est pour dans par sur au avec ne pas plus se ce il elle
der die das und ist von den zu mit sich des auf für nicht ein eine als auch dem im werden aus er es an
el los las y que del se por con una su para es al lo como más o pero sus no""".split())
SHORT, LONG = 70, 200
MOSTLY_LINKS, SOME_LINKS = 0.5, 0.2
STOPS_HIGH, STOPS_LOW = 0.30, 0.15
GOOD, OPEN, BAD = 1, 0, -1


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    aside: bool
    root: int  # number of the article or main it stands in, 0 for none
    heading: bool


def _marked_aside(tag: str, attributes: str, in_root: bool) -> int:
    """0: no; 1: by a word of its class; 2: by its tag, hidden, or holding comments, and then for all inside."""
    if tag in _ASIDE_TAGS or tag == "header" and not in_root:
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    words: set[str] = set()
    for name, double, single, bare, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), double or single or bare
        if hidden or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in _CAMEL.findall(value))
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return 2
    if words & _COMMENT_WORDS:
        return 2
    return int(tag not in _ROOTS and not words & _ABOUT_WORDS and bool(words & _ASIDE_WORDS))


def _skipped(tokens: list[re.Match]) -> dict[int, int]:
    """Number of an opening tag of _NESTED → end of its closing tag; self-closed and unclosed ones stand for nothing else."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for number, token in enumerate(tokens):
        if token[3]:
            if not token[4].endswith("/"):
                opened.setdefault(token[3].lower(), []).append(number)
        elif token[5] or token[8]:
            numbers = opened.get((token[6] or token[9]).lower())
            if numbers:
                ends[numbers.pop()] = token.end()
    return ends


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    parts: list[str] = []
    linked = link_depth = 0
    stack: list[tuple[str, int, int]] = []  # open block elements: tag, and aside and root around them
    named: Counter[str] = Counter()  # how many of them have a name
    aside, root, roots = 0, 0, 0
    tag_now = ""

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, linked, aside > 0, root, tag_now in _HEADINGS))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if "&#" in raw:
            raw = _LONG_NUMBER.sub("&#9999999", _ZEROS.sub("&#", raw))
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_depth:
            linked += len("".join(text.split()))

    at = 0
    tokens = list(_TOKEN.finditer(page))
    skipped = _skipped(tokens)
    for number, token in enumerate(tokens):
        if token.start() < at:
            continue
        if token.start() > at:
            add(page[at:token.start()])
        at = skipped.get(number, token.end())
        tag = (token[6] or token[9] or "").lower()
        if not tag:
            continue
        closing, attributes = token[5] or token[8], token[7] or token[10] or ""
        if tag == "a":
            link_depth = max(0, link_depth - 1) if closing else 1  # links do not nest
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            close_block()
            link_depth = 0
            if not closing:
                if stack and stack[-1][0] in _SELF_ENDING and (stack[-1][0] == tag or stack[-1][0] == "p"):
                    name, aside, root = stack.pop()
                    named[name] -= 1
                if tag == "p" or tag in _HEADINGS or tag in _VOID:
                    tag_now = tag
                    if not attributes or not _marked_aside(tag, attributes, root > 0):
                        continue
                if tag in _ROOTS:
                    roots += 1
                stack.append((tag, aside, root))
                named[tag] += 1
                marked = _marked_aside(tag, attributes, root > 0)
                if tag in _ROOTS:
                    root = root or roots
                    aside = 0 if aside == 1 else aside  # a wrapper whose class misled
                aside = max(aside, marked)
                tag_now = tag
            else:
                tag_now = ""
                while named[tag]:  # what was opened inside and not closed ends with it
                    name, aside, root = stack.pop()
                    named[name] -= 1
                    if name == tag:
                        break
    if at < len(page):
        add(page[at:])
    close_block()
    return found


def _stops(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()*$%&#|") in STOP_WORDS for w in words) / len(words)


def _alone(block: Block) -> int:
    """First pass."""
    letters = max(1, len(block.text) - block.text.count(" "))
    links = block.linked / letters
    if block.aside or links > MOSTLY_LINKS and not (block.heading and block.root):
        return BAD
    if block.root:
        return GOOD if len(block.text) >= SHORT or block.heading else OPEN
    if len(block.text) < SHORT:
        return OPEN
    stops = _stops(block.text)
    if stops >= STOPS_HIGH and links <= SOME_LINKS or len(block.text) >= LONG and (stops >= STOPS_LOW or links <= SOME_LINKS):
        return GOOD
    return OPEN if stops >= STOPS_LOW else BAD


def labels(found: list[Block]) -> list[int]:
    """Both passes; every block is good or bad in the end."""
    first = [_alone(b) for b in found]
    rooted = any(b.root and label == GOOD for b, label in zip(found, first)) or any(b.root and not b.aside for b in found)
    if rooted:  # what stands outside of the article is not it
        first = [label if b.root else BAD for b, label in zip(found, first)]
    # Places marked aside are no evidence about their neighbours.
    decided = [i for i, (b, label) in enumerate(zip(found, first)) if label != OPEN and not b.aside]
    out, k = [], 0
    for i, (block, label) in enumerate(zip(found, first)):
        while k < len(decided) and decided[k] < i:
            k += 1
        if label == OPEN:
            left = decided[k - 1] if k else None
            right = decided[k] if k < len(decided) else None
            if block.root or left is None and right is None:
                label = GOOD  # open blocks of an article ask nobody else; on a page of open blocks nothing speaks against
            elif block.heading and right is not None:
                label = first[right]  # a heading goes with what follows
            elif left is None or right is None:
                label = first[right if left is None else left]
            elif i - left == right - i:
                label = max(first[left], first[right])
            else:
                label = first[left if i - left < right - i else right]
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(block.text for block, label in zip(found, labels(found)) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    def run(batches):
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
