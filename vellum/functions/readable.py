"""The readable part of a page and what the page says about itself, in time in proportion to the page.

A tree of elements is built in one pass of the tag scanner. Text belongs to its innermost block. Blocks of running text score by length and
commas and pass that on to their parents, by halves to their grandparents and by less further up; containers also score by kind
and by the words of their class and id, and lose in proportion to the text that lies in links. The best container is the content, with those of its
siblings that score like content or are plain paragraphs; page furniture and lists of links inside are cut out of it.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from .html import Tag, scan

#: Characters that a readable part has at least.
MIN_TEXT = 250
#: Characters of running text from which a block scores.
RUN = 25
#: How far up a score is passed on, and how far open elements are looked through for one that a new tag ends.
LEVELS, LOOK = 5, 8

_SPACE = re.compile(r"\s+")
_COMMAS = re.compile(r"[,،、，﹐︐;；]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math q s samp small span strike strong sub sup time tt u var".split())
_DROP = frozenset("head nav header footer aside form noscript button select svg canvas object iframe dialog menu template script style".split())
_PARAGRAPH = frozenset("p pre blockquote td th dd dt li figcaption caption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same group ends.
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_KIND = {"article": 10, "main": 10, "section": 3, "div": 5, "td": 3, "pre": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "table": 0, "body": 0}
_GOOD = re.compile(r"article|content|entry|post|story|text|main|body|blog|prose")
_BAD = re.compile(r"comment|sidebar|footer|header|nav|menu|share|social|related|promo|sponsor|banner|widget|popup|cookie|subscribe|newsletter|breadcrumb|pagination|(?:^|[\s_-])ads?(?:$|[\s_-])")


class Node:
    __slots__ = ("name", "parent", "start", "inner", "inner_end", "end", "weight", "names", "drop", "link", "block", "blocks", "flow", "commas", "text", "linked", "score", "candidate")

    def __init__(self, name: str, parent: int, start: int, inner: int, drop: bool, link: bool, weight: int, names: str):
        self.name, self.parent, self.start, self.inner, self.inner_end, self.end = name, parent, start, inner, -1, -1
        self.drop, self.link, self.weight, self.names = drop, link, weight, names
        self.block = self.blocks = self.flow = self.commas = self.text = self.linked = 0
        self.score, self.candidate = 0.0, False


def _hidden(tag: Tag) -> bool:
    style = (tag.get("style") or "").replace(" ", "").lower()
    return tag.get("hidden") is not None or (tag.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def tree(text: str) -> list[Node]:
    """Elements in the order of their start tags; number 0 is the page."""
    nodes = [Node("", -1, 0, 0, False, False, 0, "")]
    stack, opened, last = [0], Counter(), 0

    def close(count: int, at: int, end: int | None = None) -> None:
        for k in range(count):
            node = nodes[stack.pop()]
            opened[node.name] -= 1
            node.inner_end, node.end = at, at if end is None or k + 1 < count else end

    def ended_by(name: str) -> int:
        """How many open elements a start tag ends first."""
        group = _SAME.get(name, ())
        for k, i in enumerate(reversed(stack[-LOOK:])):
            inside = nodes[i].name
            if inside in group or (inside == "p" and name not in _INLINE) or (inside == "head" and name not in ("head", "title", "meta", "link", "base", "script", "style", "noscript", "template")):
                return k + 1
            if inside not in _INLINE and not (group and inside in _SAME):
                break
        return 0

    def take(segment: str) -> None:
        node = nodes[stack[-1]]
        if node.drop or not segment or segment.isspace():
            return
        size = len(_SPACE.sub(" ", segment).strip())
        node.text += size
        if node.link:
            node.linked += size
        else:
            block = nodes[node.block]
            block.flow += size
            block.commas += len(_COMMAS.findall(segment))

    for tag in scan(text):
        take(text[last : tag.start])
        last = tag.end if tag.inner is None else tag.inner
        if not tag.name:
            break
        if tag.closing:
            if opened[tag.name]:
                depth = next(k for k, i in enumerate(reversed(stack)) if nodes[i].name == tag.name)
                close(depth + 1, tag.start, tag.end)
            continue
        if tag.name in _VOID:
            continue
        if n := ended_by(tag.name):
            close(n, tag.start)
        up = nodes[stack[-1]]
        names = f"{tag.get('class') or ''} {tag.get('id') or ''}".lower()
        weight = 25 * (bool(_GOOD.search(names)) - bool(_BAD.search(names))) if len(names) > 1 else 0
        node = Node(tag.name, stack[-1], tag.start, tag.end, up.drop or tag.name in _DROP or _hidden(tag), up.link or tag.name == "a", weight, names)
        nodes.append(node)
        place = len(nodes) - 1
        if tag.name in _INLINE:
            node.block = up.block
        else:
            node.block = place
            nodes[up.block].blocks += 1
        stack.append(place)
        opened[tag.name] += 1
    else:
        take(text[last:])
    close(len(stack), len(text))
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.text += node.text
        above.linked += node.linked
    return nodes


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _pass_on(nodes: list[Node]) -> None:
    for place, node in enumerate(nodes):
        if node.drop or node.flow < RUN or node.block != place or node.name in _HEADING:
            continue
        score = 1 + node.commas + min(node.flow // 100, 3)
        # a block with blocks inside holds its own running text; one without is a paragraph of its parent
        above = node.parent if node.name in _PARAGRAPH or (not node.blocks and node.parent > 0) else place
        level = 0
        above = nodes[above].block  # inline elements between do not count
        while above > 0 and level < LEVELS:
            container = nodes[above]
            if not container.candidate:
                container.candidate, container.score = True, _KIND.get(container.name, 0) + container.weight
            container.score += score / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level += 1
            above = nodes[container.parent].block


def _final(node: Node) -> float:
    return node.score * (1 - _density(node)) if node.candidate and not node.drop else float("-inf")


def _like_content(node: Node, best: Node, floor: float) -> bool:
    if node.drop or node.weight < 0 or not node.text:
        return False
    if node.candidate and _final(node) + (0.2 * _final(best) if node.names.strip() and node.names == best.names else 0) >= floor:
        return True
    return node.name == "p" and node.text > 80 and _density(node) < 0.25


def _furniture(node: Node) -> bool:
    """Parts inside the content that do not belong to it."""
    if node.drop:
        return True
    if node.name in _INLINE or node.name in _HEADING:
        return False
    if node.weight < 0 and not node.candidate or node.weight < 0 and _final(node) < 10:
        return True
    return node.name in ("ul", "ol", "dl", "div", "section", "table") and node.text > 0 and node.weight <= 0 and _density(node) > 0.5


def _furniture_in(nodes: list[Node], first: int, end: int) -> Iterator[Node]:
    """The outermost furniture among the nodes from `first` on that begin before an offset."""
    at = -1
    for i in range(first, len(nodes)):
        node = nodes[i]
        if node.start >= end:
            break
        if node.start >= at and _furniture(node):
            at = node.end
            yield node


def _slices(nodes: list[Node], first: int, begin: int, end: int) -> Iterator[tuple[int, int]]:
    """What is left between two offsets when furniture is cut out; nodes from `first` on lie behind the begin."""
    at = begin
    for node in _furniture_in(nodes, first, end):
        if node.start > at:
            yield at, node.start
        at = max(at, min(node.end, end))
    if at < end:
        yield at, end


def readable(text: str) -> str | None:
    """HTML of the readable part, or null if none holds enough."""
    nodes = tree(text)
    _pass_on(nodes)
    place = max(range(len(nodes)), key=lambda i: (_final(nodes[i]), -i))
    best = nodes[place]
    if _final(best) <= 0:
        return None
    floor = max(10.0, 0.2 * _final(best))
    kept = [i for i, n in enumerate(nodes) if i == place or (i and n.parent == best.parent and _like_content(n, best, floor))]
    alone = kept == [place]
    parts, size = [], 0
    for i in kept:
        begin, end = (nodes[i].inner, nodes[i].inner_end) if alone else (nodes[i].start, nodes[i].end)
        pieces = [text[a:b] for a, b in _slices(nodes, i + 1, begin, end)]
        parts.append("".join(pieces).strip())
        size += nodes[i].text - sum(n.text for n in _furniture_in(nodes, i + 1, nodes[i].end))
    return "\n".join(parts) if size >= MIN_TEXT else None


# what a page says about itself


@dataclass(frozen=True)
class Metadata:
    title: str | None = None
    excerpt: str | None = None
    image: str | None = None
    published: str | None = None


#: Names of meta elements, the first that has a value counts.
_META = {
    "title": ("og:title", "twitter:title", "dc.title", "dcterms.title", "parsely-title"),
    "excerpt": ("og:description", "twitter:description", "dc.description", "dcterms.description", "description"),
    "image": ("og:image", "og:image:secure_url", "twitter:image", "twitter:image:src"),
    "published": ("article:published_time", "og:published_time", "dc.date", "dcterms.created", "parsely-pub-date", "date"),
}
_ARTICLE = re.compile(r"(?:^|[/#:])(?:\w*Article|BlogPosting|LiveBlogPosting|Report|Review|SocialMediaPosting)$")


def _text(value: object) -> str | None:
    """A JSON-LD value as text: itself, its URL, or the first of a list."""
    while isinstance(value, (list, dict)):
        value = (value[0] if value else None) if isinstance(value, list) else value.get("url") or value.get("@id")
    return entities.unescape(value).strip() or None if isinstance(value, str) else None


def _articles(found: object) -> Iterator[dict]:
    """Objects of a JSON-LD document that are articles, outermost first."""
    todo = [found]
    while todo:
        item = todo.pop(0)
        if isinstance(item, list):
            todo += item
        elif isinstance(item, dict):
            kinds = item.get("@type")
            if any(isinstance(k, str) and _ARTICLE.search(k) for k in (kinds if isinstance(kinds, list) else [kinds])):
                yield item
            todo += [item[k] for k in ("@graph", "mainEntity", "mainEntityOfPage") if isinstance(item.get(k), (list, dict))]


def metadata(text: str) -> Metadata:
    """Title, excerpt, image and publication time from JSON-LD, else from meta elements; the JSON that does not parse is passed over."""
    meta: dict[str, str] = {}
    linked: dict[str, str] = {}
    for tag in scan(text):
        if tag.closing:
            continue
        if tag.name == "meta" and (value := tag.get("content")) and value.strip():
            for key in (tag.get("property"), tag.get("name"), tag.get("itemprop")):
                for name in (key or "").lower().split():
                    meta.setdefault(name, entities.unescape(value).strip())
        elif tag.name == "script" and not linked and (tag.get("type") or "").strip().lower() == "application/ld+json":
            try:
                found = json.loads(text[tag.end : tag.inner].strip().removeprefix("<![CDATA[").removesuffix("]]>"))
            except (ValueError, RecursionError):
                continue
            for item in _articles(found):
                values = {"title": _text(item.get("headline")) or _text(item.get("name")), "excerpt": _text(item.get("description")), "image": _text(item.get("image")), "published": _text(item.get("datePublished"))}
                linked = {k: v for k, v in values.items() if v}
                break
    named = {k: next((meta[n] for n in names if n in meta), None) for k, names in _META.items()}
    named["published"] = named["published"] or meta.get("datepublished")
    return Metadata(**{k: linked.get(k) or v for k, v in named.items()})
