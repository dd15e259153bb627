"""One HTML page as a list of containers and text blocks, and the score of each container.

Made for pages as they are found: unclosed tags, unquoted attributes, cut-off ends. One pass over
the text without backtracking; every step is bounded by the length of the page.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash

# fixed values: element names by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike"
    " strong sub sup time tt u var br img input wbr".split())
BLOCK = frozenset(
    "address article aside base blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg object canvas audio video select button".split())
IN_HEAD = frozenset("base link meta title script style noscript template".split())
TEXT_ONLY = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr thead tbody tfoot pre blockquote caption figcaption summary ul ol dl header".split())
NEVER_TEXT = frozenset("nav footer aside head dialog menu search".split())
CLOSED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset("table tbody thead tfoot".split())),
    "td": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
}
# fixed values: words in classes, ids and roles that tell what a container is for
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent gdpr notice notices banner newsletter subscribe"
    " popup modal share sharing social related recommended pagination pager toolbar widget".split())
EXACT_WORDS = frozenset("header masthead topbar alert skip login signup search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CONTENT_WORDS = frozenset("article content post entry story main body text".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"\w")
_TELLING = re.compile("class|id|role|style|hidden", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
KEY_CHARS = 300    # longer paths go by their digest

KEPT, HARD, SOFT = 0, 1, 2


def words_of(names: str) -> tuple[set[str], set[str]]:
    """Whole names, and the first and last parts of names such as ``post-comments``."""

    whole = set(names.lower().split())
    ends: set[str] = set()
    for name in whole:
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if parts and parts[0] not in ("has", "no", "with", "is"):
            ends |= {parts[0], parts[-1]}
    return whole, ends


def step_of(tag: str, classes: str, name: str) -> str:
    """A step of a path: tag and classes (else the id), without the digits that tell pages apart."""

    marks = sorted({_DIGITS.sub("#", c) for c in classes.lower().split()}) or [f"#{_DIGITS.sub('#', c)}" for c in name.lower().split()]
    return ".".join([tag, *marks])


@lru_cache(maxsize=4096)
def part_of(name: str, attributes: str) -> tuple[int, int, str]:
    """Role, bonus in percent, and path step of an element; a header counts as furniture here."""

    values = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    classes, ident = values.get("class", ""), values.get("id", "")
    step = step_of(name, classes, ident) if classes or ident else name
    bonus = 150 if name == "article" else 130 if name == "main" or values.get("role") == "main" else 90 if name in ("html", "body") else 100
    if name in NEVER_TEXT or "hidden" in values or _UNSEEN.search(values.get("style", "")):
        return HARD, bonus, step
    if name in ("html", "body", "main"):
        return KEPT, bonus, step
    whole, ends = words_of(f"{classes} {ident}") if classes or ident else (set(), set())
    if ends & COMMENT_WORDS or ends & ADVERT_WORDS:
        return HARD, bonus, step
    if name in ("form", "header") or values.get("role", "").lower() in ROLES or (name != "article" and (ends & SIDE_WORDS or whole & EXACT_WORDS)):
        return SOFT, bonus, step
    if bonus == 100 and ends & CONTENT_WORDS:
        bonus = 125
    return KEPT, bonus, step


class Page:
    """Containers in page order (parent, key of the path, role), and text blocks with their container."""

    def __init__(self, source: str) -> None:
        self.parent, self.key, self.tag = [-1], [""], [""]
        self.role, self.bonus = [KEPT], [90]
        self.blocks: list[tuple[int, str, int, int, bool]] = []    # container, text, letters in links, letters, words outside links
        self.links = [0]                                     # links that begin in a container itself
        self._stack, self._open = [0], {}
        self._pieces: list[str] = []
        self._linked, self._letters, self._outside = 0, 0, False
        self._held: dict[int, tuple] = {}
        self._in_link = False
        self._read(source)
        self._flush()
        self._judge()

    # --- reading

    def _read(self, s: str) -> None:
        at, end, no_more = 0, len(s), set()
        while at < end:
            lt = s.find("<", at)
            if lt < 0:
                self._text(s[at:])
                return
            if lt > at:
                self._text(s[at:lt])
            tag = _TAG.match(s, lt)
            if not tag:
                if s.startswith("<!--", lt):
                    close = s.find("-->", lt + 4)
                    at = end if close < 0 else close + 3
                elif s.startswith(("<!", "<?", "</"), lt):
                    close = s.find(">", lt)
                    at = end if close < 0 else close + 1
                else:
                    self._text("<")
                    at = lt + 1
                continue
            close = self._tag_end(s, tag.end(), no_more)
            name, attributes = tag[2].lower(), s[tag.end():close]
            at = close + 1
            if tag[1]:
                self._close(name)
            elif name in RAW:
                stop = None if name in no_more else _RAW_END[name].search(s, at)
                if stop:
                    close = s.find(">", stop.end())
                    at = end if close < 0 else close + 1
                elif name in ("script", "style", "title", "textarea"):
                    at = end
                else:      # never closed: what follows is still the page
                    no_more.add(name)
            else:
                self._start(name, attributes)

    @staticmethod
    def _tag_end(s: str, at: int, no_more: set) -> int:
        """Place of the > that ends a tag; those within quoted values do not."""

        while True:
            gt = s.find(">", at)
            if gt < 0:
                return len(s)
            equals = s.find("=", at, gt)
            if equals < 0:
                return gt
            value = equals + 1
            while value < gt and s[value].isspace():
                value += 1
            quote = s[value]
            if quote not in "\"'":
                at = value
                continue
            close = -1 if quote in no_more else s.find(quote, value + 1)
            if close < 0:
                no_more.add(quote)
                return gt
            at = close + 1

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        letters = len(text) - text.count(" ")
        self._letters += letters
        if self._in_link:
            self._linked += letters
        elif not self._outside:
            self._outside = bool(_WORD.search(text))

    def _flush(self) -> None:
        """Ends a block: what was read since the last one."""

        text = " ".join("".join(self._pieces).split())
        if text:
            self.blocks.append((self._stack[-1], text, self._linked, self._letters, self._outside))
        self._pieces, self._linked, self._letters, self._outside = [], 0, 0, False

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._pieces.append(" ")
            return
        if name == "a":
            self._in_link = True
            self.links[self._stack[-1]] += 1
        elif name in VOID:
            if name == "hr":
                self._flush()
            return
        inline = name not in BLOCK
        role, bonus, step = part_of(name, attributes if attributes and _TELLING.search(attributes) else "")
        if inline and role == KEPT and (self.tag[self._stack[-1]] in BLOCK or len(self._stack) == 1):
            return
        if name == "header" and role == SOFT and self._open.get("article"):
            role = KEPT
        if name not in IN_HEAD and self._open.get("head") and name != "head":
            self._pop("head")
        if inline:
            # dropped text inside a block: the block goes on behind it
            self._push(name, step, role, bonus)
            return
        self._flush()
        if self._open.get("p"):
            self._pop("p")
        if name in CLOSED_BY:
            closers, stops = CLOSED_BY[name]
            for depth in range(1, min(len(self._stack), 16)):
                above = self.tag[self._stack[-depth]]
                if above in closers:
                    self._pop(above)
                    break
                if above in stops:
                    break
        if name in ("html", "body") and self._open.get(name):
            return
        self._push(name, step, role, bonus)

    def _push(self, name: str, step: str, role: int, bonus: int) -> None:
        above = self._stack[-1]
        if name not in BLOCK:
            # text before a dropped inline element waits and joins what follows it
            self._held[len(self.parent)] = self._pieces, self._linked, self._letters, self._outside
            self._pieces, self._linked, self._letters, self._outside = [], 0, 0, False
        before = self.key[above]
        key = before if before.rpartition("/")[2] == step else f"{before}/{step}"
        self.parent.append(above)
        self.key.append(key if len(key) <= KEY_CHARS else f"/{xxhash.xxh3_128_hexdigest(key)}")
        self.tag.append(name)
        self.role.append(role)
        self.bonus.append(bonus)
        self.links.append(0)
        self._stack.append(len(self.parent) - 1)
        self._open[name] = self._open.get(name, 0) + 1

    def _close(self, name: str) -> None:
        if name == "a" or name in BLOCK:
            self._in_link = False
        if self._open.get(name):
            if name in BLOCK:
                self._flush()
            self._pop(name)
        elif name in BLOCK:
            self._flush()

    def _pop(self, name: str) -> None:
        while True:
            node = self._stack[-1]
            if node in self._held:
                self._flush()
                self._pieces, self._linked, self._letters, self._outside = self._held.pop(node)
            self._stack.pop()
            self._open[self.tag[node]] -= 1
            if self.tag[node] == name:
                return

    # --- what containers are for

    def _judge(self) -> None:
        """Marks what is left out, and adds up text from the leaves to the root."""

        n = len(self.parent)
        main = [tag in ("article", "main") for tag in self.tag]
        letters, outside, links = [0] * n, [False] * n, list(self.links)
        for node, _, _, own, words in self.blocks:
            letters[node] += own
            outside[node] = outside[node] or words
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            main[up] = main[up] or main[k]
            letters[up] += letters[k]
            outside[up] = outside[up] or outside[k]
            links[up] += links[k]
        # a dropped form or box around the article is a frame of the page; a list of nothing but links is a menu
        gone = [False] * n
        for k in range(1, n):
            menu = links[k] >= 3 and letters[k] and not outside[k] and self.tag[k] in ("ul", "ol", "dl", "div", "section", "table", "p")
            gone[k] = gone[self.parent[k]] or self.role[k] == HARD or menu or (self.role[k] == SOFT and not main[k])
        if all(gone[node] for node, *_ in self.blocks):
            # nothing but boxes: the page's text is in one that only looks like furniture
            for k in range(1, n):
                gone[k] = gone[self.parent[k]] or self.role[k] == HARD
        self.gone = gone
        good, bad = [0] * n, [0] * n
        for node, text, linked, own, _ in self.blocks:
            (bad if gone[node] or 2 * linked > own else good)[node] += len(text)
        # a container that adds less than a tenth to the best one below it stands back for that, unless its name speaks for it
        below, self.score = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            worth = max(good[k] - bad[k], 0)
            stands = not gone[k] and self.tag[k] not in TEXT_ONLY and (9 * worth > 10 * below[k] or self.bonus[k] > 100)
            self.score[k] = worth * self.bonus[k] if stands else 0
            if k:
                up = self.parent[k]
                below[up] = max(below[up], worth if stands else below[k])
                good[up] += good[k]
                bad[up] += bad[k]
        self.good = good

    # --- results

    def votes(self) -> list[tuple[str, int, int]]:
        """(path, points of 1,000, 1 for the best) of containers with at least half the best score."""

        best = max(self.score)
        if not best:
            return []
        top = len(self.score) - 1 - self.score[::-1].index(best)
        points: dict[str, int] = {}
        for k, score in enumerate(self.score):
            if 2 * score >= best:
                points[self.key[k]] = max(points.get(self.key[k], 0), 1000 * score // best)
        return [(path, p, int(path == self.key[top])) for path, p in points.items()]

    def text(self, paths: list[str]) -> tuple[str, str | None]:
        """Text below the first of ``paths`` that has some here, else below the best container; and that path."""

        found = {self.key[k] for k in range(len(self.key)) if self.good[k] > 0 and not self.gone[k]}
        own = [path for path, _, best in self.votes() if best]
        for path in [*paths, *own]:
            if path in found:
                inside = [False] * len(self.key)
                for k, key in enumerate(self.key):
                    inside[k] = key == path or (k > 0 and inside[self.parent[k]])
                return "\n".join(text for node, text, *_ in self.blocks if inside[node] and not self.gone[node]), path
        return "", None
