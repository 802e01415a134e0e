"""HTML main text by two-pass block rules.

Pass one cuts the page into blocks and judges each by where it stands (menus, footers, forms and the like are out), its
length, its link density and its density of stop words. Pass two gives short and undecided blocks the label of the
nearest decided neighbour. Blocks inside an article or main element take their neighbours from that element.

What is no text of the page: scripts, styles, templates, titles, frames, drawings (svg, canvas), controls (button, select,
option, textarea), what stands in for a player or plug-in (object, video, audio) or for scripts (noscript), and the source
notation of formulas (annotation). A formula (math) is text. Scripts and the like end at their first end tag, whatever
stands before it; "/" at the end of a tag closes a drawing, or another such element only if no end tag follows.

Defined results: a null or empty page, and one without text, gives the empty string; a page cut off inside a tag, comment
or script loses that part only; further columns of pages are not read; repeated rows each give their own row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import map_texts

#: A comment, a tag (quoted values may hold ">"), or text; a "<" that starts neither is text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg annotation annotation-xml object select button option canvas video audio title".split())
#: Those of them whose content is no markup: it ends at the first end tag of that name, whatever stands before it. Inside
#: svg only scripts and styles are read so.
PLAIN = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in "script style noscript textarea iframe title".split()}
#: Those of them that are seen, and so stand between words.
SPACED = frozenset("button select option textarea iframe object canvas video audio".split())
#: Elements that are never main text.
OUT = frozenset("nav footer aside form menu dialog head".split())
#: Elements that start and end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul dialog".split())
#: Blocks that are closed by what follows and so are not kept on the stack.
LOOSE = frozenset("p li dd dt td th tr tbody thead tfoot hr caption h1 h2 h3 h4 h5 h6 html body figcaption legend summary".split())

NAMES = "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments respond replies disqus promo promotion sponsor sponsored widget copyright legal login signup search toolbar skip masthead site-header page-header top-header global-header"
_NAME = "|".join(sorted(NAMES.split(), key=len, reverse=True))
BAD_NAME = re.compile(rf"(?:(?:site|page|main|top|bottom|left|right|global|user|reader|post|article)[-_])?(?:{_NAME})(?:[-_](?:{_NAME}|box|list|area|section|container|wrapper|bar|block|inner|links|item|form|text|policy|body|content|thread|slot|unit|\d+))*", re.I)
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())

#: Common words of the languages served.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui nous comme mais leur y ont été cette aux sans elle tout fait même ces "
    "el que y los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde está".split()
)
LETTERS = re.compile(r"[^\W\d_]+")

SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.5, 0.1, 0.25


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    out: bool  # stands where no main text is
    home: int  # number of the article or main element around it, 0 if none
    heading: bool
    label: str = ""


def is_out(name: str, attributes: str, inside: bool) -> bool:
    """Does this element hold no main text? inside: it stands in an article or main element."""
    if name in OUT or name == "header" and not inside:
        return True
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" and name != "html" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key == "role" and value.lower() in BAD_ROLE:
            return True
        if key in ("class", "id") and any(BAD_NAME.fullmatch(x) for x in value.split()):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    blocks: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, out, home
    linked = homes = 0
    link = out_here = heading = False

    def close() -> None:
        nonlocal parts, linked, out_here
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, linked, out_here or bool(stack and stack[-1][1]), stack[-1][2] if stack else 0, heading))
        parts, linked, out_here = [], 0, False

    skip, at = "", 0
    inside: Counter[str] = Counter()  # elements opened in an option and not closed in it
    unclosed: set[str] = set()

    def ends(name: str) -> bool:
        """Does an end tag of this name follow?"""
        if name not in unclosed and not re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at):
            unclosed.add(name)
        return name not in unclosed

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if name in PLAIN and not m[1] and (skip != "svg" or name in ("script", "style") and not m[3].endswith("/")):
            end = None if name in unclosed else PLAIN[name].search(page, at)
            if end:
                at = end.start()
            elif not skip:
                at = len(page)
            else:
                unclosed.add(name)
        if skip == "option" and name != skip:  # its end tag may be left out: it ends with its parent, or at an optgroup
            if name == "optgroup" or name and m[1] and not inside[name]:
                skip = ""
            elif name:
                inside[name] += -1 if m[1] else 1
        if skip:
            if name == skip and m[1]:
                skip = ""
            continue
        if not name:
            if not m[0].startswith("<") or m[0] == "<":
                parts.append(m[0])
                linked += len(m[0].strip()) * link
            continue
        opens = not m[1]
        if name in RAW:
            if name in SPACED:
                parts.append(" ")
            empty = m[3].endswith("/") and (name == "svg" or name not in PLAIN and not ends(name))
            skip = name if opens and not empty else ""
            inside.clear()
        elif name == "a":
            link = opens
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            close()
            link = False
            heading = opens and name[0] == "h" and name[1:].isdigit()
            if opens:
                bad, home = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                if name == "body":  # what a head left open ends here
                    stack.clear()
                    continue
                own = name != "html" and is_out(name, m[3], home > 0)
                if name in LOOSE:
                    out_here = own
                else:
                    if name in ("article", "main"):
                        homes += 1
                        home = homes
                    stack.append((name, bad or own, home))
            elif name not in LOOSE:
                place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if place is not None:
                    del stack[place:]
    close()
    return blocks


def first_pass(b: Block) -> str:
    """good, bad, near (leaning to good) or short."""
    if b.out:
        return "bad"
    density = b.linked / len(b.text)
    if density > LINKS:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if density > 0.3 or not b.home and "©" in b.text else "short"
    words = [w.lower() for w in LETTERS.findall(b.text)]
    stops = sum(w in STOP for w in words) / max(len(words), 1)
    if stops >= MANY:
        return "good" if len(b.text) > LONG or b.home else "near"
    if stops >= FEW:
        return "near"
    return "near" if b.home else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Short and near blocks take the label of the nearest decided neighbour; the sides differing at equal distance,
    near blocks and headings above good text are good. With none decided, near blocks and all of an article are good."""
    decided = [b.label in ("good", "bad") for b in blocks]

    def neighbours(order: range) -> list[int | None]:
        """For each block the last decided one before it in this order, of its own article if it is in one."""
        last: dict[int, int] = {}
        out: list[int | None] = [None] * len(blocks)
        for i in order:
            b = blocks[i]
            out[i] = last.get(b.home)
            if decided[i] and not b.out:  # what is out by its place says nothing of what stands beside it
                last[0] = last[b.home] = i
        return out

    before, after = neighbours(range(len(blocks))), neighbours(range(len(blocks) - 1, -1, -1))
    labels = [b.label for b in blocks]
    for i, b in enumerate(blocks):
        if decided[i]:
            continue
        sides = [(abs(i - j), labels[j]) for j in (before[i], after[i]) if j is not None]
        if not sides:
            b.label = "good" if b.home or labels[i] == "near" else "bad"
        elif len(sides) == 1 or sides[0][1] == sides[1][1] or sides[0][0] != sides[1][0]:
            b.label = min(sides)[1]
        else:
            b.label = "good" if labels[i] == "near" or b.heading and sides[1][1] == "good" else "bad"


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    for b in blocks:
        b.label = first_pass(b)
    second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return map_texts(source, make, "page_id long, url string, text string, n_chars long", text="html")
