"""HTML fragments: sanitizing, asset references, srcset choice and readable extraction.

A small scanner finds tags and attributes as browsers do, in one pass, and leaves everything it does not change as it
was, byte for byte. All steps of a capture run in one vectorised UDF, so that a page crosses to Python once.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls

SRCSET_WIDTH = 1200
DENSITY_WIDTH = 800
#: Attributes whose URL can run script.
URL_ATTRIBUTES = frozenset(("href", "src", "action", "xlink:href", "formaction"))
PLACEHOLDER_CLASS = "iframe-placeholder"

_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\t\n\f\r />]*)|/)")
_COMMENT_END = re.compile(r"--!?>")
_GAP = re.compile(r"[\t\n\f\r /]*")
_NAME = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
_PLAIN_NAME = re.compile(r"[^\t\n\f\r\"'<>/=\0]+")
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in (*_RAW, "noscript")}


@dataclass
class Tag:
    name: str  # empty: a tag that the text ends in
    start: int
    end: int
    closing: bool
    attributes: list[tuple[str, str, int, int, int, int]] = field(default_factory=list)  # name, value, its start and end, value's start and end
    inner: int | None = None  # where the content of a raw-text element ends

    def get(self, name: str) -> str | None:
        return next((a[1] for a in self.attributes if a[0] == name), None)


def _attributes(text: str, at: int) -> tuple[list[tuple[str, str, int, int, int, int]], int | None]:
    """Attributes from `at` to the end of the tag, and that end; none if the text ends first. A quote opens a value only after =."""
    out = []
    while True:
        at = _GAP.match(text, at).end()
        if at == len(text):
            return out, None
        if text[at] == ">":
            return out, at + 1
        start, at = at, _NAME.match(text, at).end()
        name, lo, hi = text[start:at].lower(), at, at
        if m := _EQUALS.match(text, at):
            lo = at = m.end()
            if text[at : at + 1] in ('"', "'"):
                lo, hi = at + 1, text.find(text[at], at + 1)
                if hi < 0:
                    return out, None
                at = hi + 1
            else:
                hi = at = _BARE.match(text, at).end()
        out.append((name, text[lo:hi], start, at, lo, hi))


def scan(text: str, raw: frozenset = _RAW) -> Iterator[Tag]:
    """Tags in order, as browsers find them; the content of raw-text elements holds none. One pass over the text."""
    at = 0
    while m := _MARKUP.search(text, at):
        if m[2] is None:
            if m[0] == "<!--" and (short := re.compile("-?>").match(text, m.end())):
                at = short.end()
                continue
            close = (_COMMENT_END if m[0] == "<!--" else re.compile(">")).search(text, m.end())
            if not close:
                return
            at = close.end()
            continue
        attributes, end = _attributes(text, m.end())
        if end is None:
            yield Tag("", m.start(), len(text), False)
            return
        tag, at = Tag(m[2].lower(), m.start(), end, bool(m[1]), [] if m[1] else attributes), end
        if not tag.closing and tag.name in raw:
            close = _RAW_END[tag.name].search(text, at)
            tag.inner = at = close.start() if close else len(text)
        yield tag


def dangerous_url(raw: str) -> bool:
    """javascript: and data:text/html, however they are written."""
    text = re.sub(r"[\t\n\r]", "", entities.unescape(raw).strip("".join(map(chr, [*range(0x21), *range(0x7F, 0xA0)])))).lower()
    return text.startswith(("javascript:", "data:text/html"))


def has_token(value: str, token: str) -> bool:
    return token in value.lower().split()


def refresh_target(content: str) -> str | None:
    _, mark, rest = content.partition(";")
    rest = rest.strip()
    return rest[4:].strip().strip("'\"") if mark and rest[:4].lower() == "url=" else None


def escape(text: str) -> str:
    return entities.escape(text).replace("&#x27;", "&#39;")


def iframe_placeholder(src: str | None, css_class: str = PLACEHOLDER_CLASS) -> str:
    link = f': <a href="{escape(src)}">{escape(src)}</a>' if src else ""
    return f'<div class="{css_class}">Frame left out of the archive{link}</div>'


def sanitize(text: str, css_class: str = PLACEHOLDER_CLASS, raw: frozenset = _RAW | {"noscript"}) -> str:
    """Without anything that can run: scripts, base, handlers, dangerous URLs, script preloads, refreshes to them; frames become links.

    What some parsers take for text (the content of style, title, noscript and the like) is sanitized as a fragment of
    its own, so it is harmless read either way. A tag that the text ends in goes, as it does in browsers.
    """
    out, at = [], 0
    for tag in scan(text, raw):
        end, new = tag.end, None
        if not tag.name:
            new = ""
        elif tag.name in ("script", "iframe"):
            src = tag.get("src")
            new = iframe_placeholder(src if src and not dangerous_url(src) else None, css_class) if tag.name == "iframe" and not tag.closing else ""
            end = tag.inner or tag.end
        elif tag.name == "base":
            new = ""
        elif tag.name == "link" and not tag.closing:
            rel = tag.get("rel") or ""
            if has_token(rel, "modulepreload") or has_token(rel, "serviceworker") or (has_token(rel, "preload") and (tag.get("as") or "").lower() == "script"):
                new = ""
        elif tag.name == "meta" and not tag.closing and (tag.get("http-equiv") or "").lower() == "refresh":
            target = refresh_target(tag.get("content") or "")
            if target is not None and dangerous_url(target):
                new = ""
        if new is None:
            new = _harmless(text, tag)
            if tag.inner is not None:
                new, end = new + sanitize(text[tag.end : tag.inner], css_class, raw - {tag.name}), tag.inner
        out += [text[at : tag.start], new]
        at = end
    return "".join(out) + text[at:]


def _harmless(text: str, tag: Tag) -> str:
    """The tag as it is, or written anew without handlers and dangerous URLs. Left-over pieces such as a name that begins
    with = go too, lest they join what stood before the attribute that went."""
    bad = {a for name, value, a, *_ in tag.attributes if (name.startswith("on") and len(name) > 2) or (name in URL_ATTRIBUTES and dangerous_url(value))}
    if not bad:
        return text[tag.start : tag.end]
    kept = [f" {text[a:b]}" for name, _, a, b, _, _ in tag.attributes if a not in bad and _PLAIN_NAME.fullmatch(name)]
    return text[tag.start : tag.start + 1 + len(tag.name)] + "".join(kept) + (" />" if text[tag.end - 2] == "/" else ">")


def srcset_choice(raw: str) -> str | None:
    """The candidate worth fetching: the narrowest of at least SRCSET_WIDTH, else the widest; the first of equals."""
    best: tuple | None = None
    for entry in raw.split(","):
        url, *rest = entry.split(maxsplit=1)[:2] or [""]
        if not url:
            continue
        width, mark = DENSITY_WIDTH, "".join(rest).strip()
        if re.fullmatch(r"\+?\d+w", mark):
            width = int(mark[:-1])
        elif mark.endswith("x"):
            try:
                width = int(DENSITY_WIDTH * float(mark[:-1]) + 0.5)
            except ValueError:
                pass
        rank = (0, width) if width >= SRCSET_WIDTH else (1, -width)
        if best is None or rank < best[0]:
            best = (rank, url)
    return best[1] if best else None


def _assets(tag: Tag) -> Iterator[tuple[str, str | None, int, int]]:
    """Attributes of a tag that hold assets: kind, reference, and where the value stands."""
    for name, value, _, _, lo, hi in tag.attributes:
        if (tag.name, name) in (("img", "src"), ("video", "poster")):
            yield "url", value, lo, hi
        elif name == "srcset" and tag.name in ("img", "source"):
            yield "srcset", srcset_choice(value), lo, hi


def references(text: str, base: urls.Url | None) -> list[str]:
    """Distinct absolute asset URLs of a fragment, in order."""
    found: dict[str, None] = {}
    for tag in scan(text):
        if not tag.closing:
            for _, raw, _, _ in _assets(tag):
                if url := urls.resolve(raw, base):
                    found.setdefault(url)
    return list(found)


def rewrite_assets(text: str, base: urls.Url | None, place: Callable[[str], str | None]) -> str:
    """Asset references through `place`; those it does not know keep their text, srcsets keep one candidate."""
    out, at = [], 0
    for tag in scan(text):
        if tag.closing:
            continue
        for kind, raw, lo, hi in _assets(tag):
            url = urls.resolve(raw, base)
            new = place(url) if url else None
            if new is None and kind == "srcset":
                new = raw
            if new is not None:
                out += [text[at:lo], new]
                at = hi
    return "".join(out) + text[at:]


# the parts of a page


def inner_text(text: str, name: str) -> str | None:
    """What stands between the first start tag of a name and the first end tag behind it, as written; in time in proportion to the text."""
    start = text.find(f"<{name}")
    begin = text.find(">", start) + 1 if start >= 0 else 0
    end = text.find(f"</{name}>", begin) if begin else -1
    return text[begin:end].strip() if end >= 0 else None


# columns


@F.pandas_udf(T.StringType())
def sanitized(html: pd.Series) -> pd.Series:
    return html.map(lambda x: None if x is None else sanitize(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def asset_references(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else references(h, urls.parse(b)) for h, b in zip(html, base, strict=True)])


@F.pandas_udf(T.StringType())
def srcset_pick(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else srcset_choice(x))


@F.pandas_udf(T.BooleanType())
def is_dangerous(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else dangerous_url(x))


@F.pandas_udf(T.StringType())
def localized(html: pd.Series, base: pd.Series, paths: pd.Series) -> pd.Series:
    """paths: entries (url, path) of the assets that were stored for the page."""

    def one(h, b, p):
        known = {} if p is None else {x["url"]: x["path"] for x in p}
        return rewrite_assets(h, urls.parse(b), known.get)

    return pd.Series([None if h is None else one(h, b, p) for h, b, p in zip(html, base, paths, strict=True)])


