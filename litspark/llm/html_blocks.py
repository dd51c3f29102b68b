"""The leaf blocks of a web page: runs of text between block-level tags, each
with the path of open elements it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: A comment, a declaration, or a tag with its attributes. An unfinished one
#: runs to the end of the page.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Elements by how a browser lays them out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text of the page (a title inside a drawing is).
RAW = set("script style template title".split())
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
            "select summary table tbody td textarea tfoot th thead tr ul".split())
#: An opening tag of the key closes an open one of these, unless a list, table
#: or box lies between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
BOXES = set("article aside body div dl footer form header main nav ol section table tbody tfoot thead ul".split())
CONTAINERS = BLOCK - {"p", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "pre"}


@dataclass
class Block:
    path: tuple[str, ...]  # distinct tokens of the open elements, outermost first
    text: str
    linked: int = 0        # code points inside links
    inner: str = ""        # the innermost token


@dataclass
class _Open:
    name: str
    tokens: tuple[str, ...]


@dataclass
class _Reader:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    standing: dict[str, int] = field(default_factory=dict)  # tokens of the open elements, how often each
    names: Counter = field(default_factory=Counter)         # and their names

    def drop(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for e in self.stack[k:]:
            self.names[e.name] -= 1
            for t in e.tokens:
                self.standing[t] -= 1
                if not self.standing[t]:
                    del self.standing[t]
        del self.stack[k:]

    def text(self, raw: str) -> None:
        if raw:
            decoded = html.unescape(raw)
            self.parts.append(decoded)
            if self.names["a"]:
                self.linked += len(decoded.strip())

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not any(e.name == "head" for e in self.stack[:2]):
                inner = self.stack[-1].tokens[-1] if self.stack else ""
                self.blocks.append(Block(tuple(self.standing), text, self.linked, inner))
            self.parts, self.linked = [], 0

    def close(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.names[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name in names:
                self.drop(k)
                return
            if self.stack[k].name in bounds:
                return

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.end_block()
            if name not in ("br", "button", "select", "textarea"):
                self.close({"p"}, CONTAINERS)
            if name in CLOSES:
                self.close(CLOSES[name], BOXES)
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            return
        self.names[name] += 1
        self.stack.append(_Open(name, _tokens(name, attributes)))
        for t in self.stack[-1].tokens:
            self.standing[t] = self.standing.get(t, 0) + 1

    def shut(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
        if not self.names[name]:  # not open: nothing to search for
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                self.drop(k)
                return


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    """The element's name, and the words of its class, id and role."""
    out = [name]
    if "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            if key.lower() in ("class", "id", "role", "aria-label", "itemprop", "hidden"):
                value = next((v for v in values if v), "").lower()
                out += ["." + w for w in re.split(r"[^a-z]+", value) if w]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    reader, at = _Reader(), 0
    while m := _MARKUP.search(page, at):
        reader.text(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            reader.shut(name)
        elif name in RAW and not m[3].rstrip().endswith("/") and not (name == "title" and reader.names["svg"]):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
        else:
            reader.open(name, m[3])
    reader.text(page[at:])
    reader.end_block()
    return reader.blocks
