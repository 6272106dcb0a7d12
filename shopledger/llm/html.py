"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides what is clear: parts
marked as menus, notices and the like are boilerplate, as are blocks that are mostly links;
a form or a part that is only marked in part of its name gives way to an article inside, and
a form that is wrapped around most of the page is no mark at all; a mark in part of a name
also yields to a long text, dense in stop words, with few links;
in the article's own element, blocks of some length are content; elsewhere length and the
density of stop words decide. The stop words are English, French, German and Spanish ones. If
no block of the page is dense in them, and for a block in another script, the language counts
as unknown: then length and links decide alone. The second pass gives each short, undecided block the label
of its nearest decided neighbours in the same part of the page.

Defined cases: a null or empty page has no text; markup that is never closed ends with the
page; repeated rows are read alike; an empty table gives no rows; columns other than those
named are ignored. Pages are read whole, one at a time, in time that grows with their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame

from .tables import as_text, exact_ids

#: Elements whose content is never text of a page.
_SILENT = "script|style|noscript|template|svg|math|iframe|object|select|textarea|title|canvas|audio|video"
#: Elements that start and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold other blocks, so that their ends matter.
_HOLDS = frozenset(
    "article aside blockquote body dd details dialog div dl fieldset figure footer form header main menu nav "
    "ol section table td ul".split()
)
#: Elements and words in class, id or role that mark parts beside the article.
_ASIDE = frozenset("nav footer aside menu dialog button head".split())
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr"
    r"|notices?|alert|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|comments?|replies"
    r"|disqus|respond|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|popup|modal"
    r"|overlay|toolbar|footer|masthead|site-header|page-header|topbar|skip-link|widget|copyright|complementary"
    r"|contentinfo|banner|hidden|tags?)(?=$|[\s_-])",
    re.I,
)
#: Names that tell how a part is laid out or what state it is in, not what it holds.
_LAYOUT = re.compile(
    r"(?:has|no|with|without|show|hide|hidden|overflow)[_-].*"
    r"|(?:content|main|layout)(?:[_-]\w+)*[_-](?:wrap|wrapper|container|layout)"
    r"|.*[_-](?:open|opened|closed|active|enabled|disabled|visible|collapsed|expanded|layout)",
    re.I,
)
#: Words beside a mark that tell its place or shape, so that the whole name is still a mark.
_NEUTRAL = frozenset(
    "area bar bars block body bottom box button buttons container content form group header heading icons inner item items "
    "left link links list outer panel placeholder primary right row secondary section site slot text title top unit wrap wrapper".split()
)
#: Parts whose entries are often articles of their own.
_LISTS = re.compile(r"(?:^|[_-])(?:comments?|replies|disqus|respond|related|recommended|sponsor(?:ed)?|promo(?:tion)?|ads?)(?=$|[_-])", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: What puts a part beside the article, by what undoes it: a form and a mark in a part of a
#: name are undone by an article inside, a mark that is a whole name by main, others by nothing.
_FORM, _PARTLY, _WHOLLY, _SURE = 1, 2, 4, 8
#: The commonest words of English, French, German and Spanish.
_STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had "
    "they you were their one all we can has there been if more when will would who so no "
    "le la les de des du et un une en que qui dans pour pas sur au aux est par ce il elle ne se plus avec son sont "
    "der die das und den von zu mit sich ist des im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "el los las y del se con no una su para al lo como más pero sus o este sí porque esta entre cuando muy".split()
)
#: Attributes of a tag that closes itself; the slash of an unquoted value is part of the value.
_CLOSED = re.compile(r"(?:\s*+[^\s=>/\"']++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+|\s++|/(?!\Z))*+/")
_QUIET = re.compile(rf"(?:{_SILENT})\b", re.I)
_LETTER = re.compile("[A-Za-z]")
_NAME_END, _HALT = re.compile(r"[\s/>]"), re.compile("[>\"']")
_WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200
DENSE, SPARSE = 0.30, 0.15
#: What a long text must have if part of a name speaks against it.
MARKED = 0.22
MOST_LINKS = 0.5
#: Of a block in an unknown language that is content, the most that may be links.
FEW_LINKS = 0.2


class _Block:
    __slots__ = ("text", "links", "article", "aside", "weak", "heading", "part", "form")

    def __init__(self, text, links, article, marks, heading, part, form):
        self.text, self.links, self.article = text, links, article
        self.heading, self.part, self.form = heading, part, form
        self.aside, self.weak = marks > _FORM, marks | _FORM == _FORM | _PARTLY  # weak: by part of a name only


def _is_mark(token: str) -> bool:
    """Whether a name holds nothing but marks and words that go with them."""
    if _MARKED.fullmatch(token):
        return True
    return all(w.lower() in _NEUTRAL or w.isdigit() or _MARKED.fullmatch(w) for w in re.split("[_-]+", token) if w)


def _marks(name: str, raw: str, article: bool) -> int:
    """What puts an element beside the article."""
    # an article's own header holds its title; a page's header is beside it
    out = _SURE if name in _ASIDE or (name == "header" and not article) else _FORM if name == "form" else 0
    if not raw or raw.isspace():
        return out
    told: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(raw):
        told.setdefault(key.lower(), "".join(values))
    if "hidden" in told or told.get("aria-hidden", "").strip().lower() == "true" or _NOT_SHOWN.search(told.get("style", "")):
        return out | _SURE
    if name not in ("article", "main", "body", "html"):
        for token in " ".join(told.get(k, "") for k in ("class", "id", "role")).split():
            found = _MARKED.search(token)
            if found and not _LAYOUT.fullmatch(token):
                out |= _WHOLLY if _is_mark(token) or _LISTS.search(token) else _PARTLY
    return out


class _Scan:
    """The tags of a page in one pass: what was found not to follow a place is not looked for again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.cut_off: set[int] = set()  # places outside quotes from which no tag ends
        self.name_end = -1

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or -1."""
        seen = []
        while at <= self.last and at not in self.cut_off:
            seen.append(at)
            halt = _HALT.search(self.page, at)
            if halt is None:
                break
            if halt[0] == ">":
                return halt.start()
            close = self.page.find(halt[0], halt.end())
            if close < 0:
                break
            at = close + 1
        self.cut_off.update(seen)
        return -1

    def name(self, at: int) -> str:
        if self.name_end < at:
            found = _NAME_END.search(self.page, at)
            self.name_end = found.start() if found else len(self.page)
        return self.page[at : self.name_end]

    def __iter__(self):
        """(start, end, whether an end tag, name, attributes); the name is None for other markup."""
        page, at = self.page, 0
        closed: dict[str, int] = {}  # where the end tags of a silent element begin to lack
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("!--", at):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, False, None, ""
                continue
            ends = page.startswith("/", at)
            first = at + ends
            if not _LETTER.match(page, first):
                end = page.find(">", at) if page[at : at + 1] in ("!", "?", "/") and at <= self.last else -1
                if end >= 0:
                    at = end + 1
                    yield start, at, False, None, ""
                continue
            if start > self.last:
                continue
            name = self.name(first)
            end = self.tag_end(first + len(name))
            if end < 0:
                continue
            raw, at = page[first + len(name) : end], end + 1
            quiet = None if ends else _QUIET.match(name)
            if quiet is None:
                yield start, at, ends, name, raw
                continue
            kind = quiet[0].lower()
            if not (name.lower() in ("svg", "math") and raw.endswith("/") and _CLOSED.fullmatch(raw)):
                close = None
                if closed.get(kind, len(page)) > at:
                    close = re.compile(rf"</{kind}\s*>", re.I).search(page, at)
                    if close is None:
                        closed[kind] = at
                at = close.end() if close else len(page)
            yield start, at, False, None, ""


def blocks(page: str) -> list[_Block]:
    """The page's blocks with text, in order."""
    out: list[_Block] = []
    held: list[tuple[str, int, bool, int, int]] = []  # element, marks, in the article, part, outermost form
    opened: Counter[str] = Counter()  # elements in held
    words: list[str] = []
    linked, in_link, own_mark, heading, part, forms, at = 0, False, 0, False, 0, 0, 0

    def flush():
        nonlocal linked, own_mark, heading
        text = " ".join("".join(words).split())
        if text:
            _, marks, article, where, form = held[-1] if held else ("", 0, False, 0, 0)
            own = own_mark if own_mark != _FORM else _SURE
            out.append(_Block(text, linked, article, own | marks, heading, where, form if own | marks == _FORM else 0))
        words.clear()
        linked, own_mark, heading = 0, 0, False

    def read(raw):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            words.append(text)
            if in_link:
                linked += len(" ".join(text.split()))

    for start, end, ends, name, raw in _Scan(page):
        read(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if name == "a":
            in_link = not ends
        elif name == "br":
            words.append(" ")
        elif name in _BLOCK or name == "button":
            flush()
            in_link = False
            if ends:
                while opened[name]:
                    last = held.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                continue
            _, around, article, where, form = held[-1] if held else ("", 0, False, 0, 0)
            own = _marks(name, raw, article)
            if name in _HOLDS or name == "button":
                inner, marks = article or name in ("article", "main"), around
                if name == "main":
                    marks &= _SURE
                elif name == "article" and not opened["article"]:
                    marks &= _SURE | _WHOLLY
                marks |= own
                if marks & _FORM and not around & _FORM:
                    forms += 1
                    form = forms
                if (marks != 0) != (around != 0) or inner != article:
                    part += 1
                    where = part
                held.append((name, marks, inner, where, form))
                opened[name] += 1
            else:
                own_mark = own
                heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
    read(page[at:])
    flush()
    return _without_forms(out)


def _without_forms(found: list[_Block]) -> list[_Block]:
    """A form is beside the article, unless it is wrapped around the page: it has a long text and most of what isn't beside."""
    total = sum(len(b.text) for b in found if not b.aside)
    within: dict[int, list[_Block]] = {}
    for b in found:
        if b.form and not b.aside:
            within.setdefault(b.form, []).append(b)
    for own in within.values():
        wraps = 2 * sum(len(b.text) for b in own) > total
        if not wraps or not any(len(b.text) >= LONG and b.links <= MOST_LINKS * len(b.text) for b in own):
            for b in own:
                b.aside = True
    return found


def _density(text: str) -> float | None:
    """The share of stop words, None for a text in another script than theirs."""
    found = _WORD.findall(text.lower())
    letters = "".join(found)
    if 2 * sum(c > "\u024f" for c in letters) > len(letters):
        return None
    return sum(w in _STOP for w in found) / max(1, len(found))


def _labels(found: list[_Block]) -> list[bool | None]:
    """True for content, False for boilerplate, None if a block alone doesn't tell."""
    out: list[bool | None] = []
    open_: dict[int, float | None] = {}
    for k, b in enumerate(found):
        n = len(b.text)
        if b.links > MOST_LINKS * n or (b.aside and not (b.weak and n >= LONG and b.links <= FEW_LINKS * n)):
            out.append(False)
        elif b.aside:  # a mark in part of a name yields to a long, dense text with few links
            out.append(False)
            open_[k] = _density(b.text)
        elif b.article:
            out.append(True if n >= SHORT else None)
        else:
            out.append(None)
            if n >= SHORT:
                open_[k] = _density(b.text)
    known = any(d is not None and d >= SPARSE for d in open_.values())
    for k, dense in open_.items():
        n = len(found[k].text)
        if dense is None or not known:
            out[k] = True if found[k].links <= FEW_LINKS * n else None
        elif dense >= DENSE or (n >= LONG and dense >= (MARKED if found[k].aside else SPARSE)):
            out[k] = True
        else:
            out[k] = None if dense >= SPARSE and not found[k].aside else False
    parts = {b.part for b, good in zip(found, out) if good and b.weak and b.aside}
    for k, b in enumerate(found):
        if b.weak and b.aside and not out[k] and b.part in parts and len(b.text) < LONG and b.links <= FEW_LINKS * len(b.text):
            out[k] = None
    return out


def extract(page: str | None) -> str:
    """The article of a page: its blocks joined by line ends.

    Stop words are known for English, French, German and Spanish; see above for other languages.
    """
    found = blocks(page or "")
    labels = _labels(found)
    n = len(found)
    # the nearest decided neighbour on each side, within the same part
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, tuple[int, bool]] = {}
        for k in order:
            near[k] = last.get(found[k].part)
            if labels[k] is not None:
                last[found[k].part] = (k, labels[k])
    kept = []
    for k, b in enumerate(found):
        good = labels[k]
        if good is None:
            a, z = before[k], after[k]
            if a and z and a[1] != z[1]:
                ahead = z[0] - k < k - a[0] or (z[0] - k == k - a[0] and b.heading)
                good = z[1] if ahead else a[1] if k - a[0] < z[0] - k else b.article
            else:
                good = (a or z)[1] if a or z else b.article
        if good:
            kept.append(b.text)
    return "\n".join(kept)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            texts = [extract(p) for p in frame["html"]]
            yield pd.DataFrame(
                {
                    "page_id": exact_ids(frame["page_id"]),
                    "url": frame["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                }
            )

    shape = "page_id long, url string, text string, n_chars long"
    return as_text(pages.select("page_id", "url", "html"), "page_id").mapInPandas(run, shape)
