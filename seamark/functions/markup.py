"""Elements of a page: one pass over its tags with a stack of those that are open."""

from __future__ import annotations

import re

# Comments, declarations, elements whose inside is no markup, end tags, start tags; in this order at every "<".
_TOKEN = re.compile(rb"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>
    |<(?P<raw>script|style)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)
    |</(?P<end>[A-Za-z][\w:.-]*)[^>]*>
    |<(?P<start>[A-Za-z][\w:.-]*)(?:[^<>"']++|"[^"]*"|'[^']*')*+>""", re.S | re.I | re.X)
_XML_TOKEN = re.compile(_TOKEN.pattern.replace(rb"(?P<raw>script|style)\b", rb"(?P<raw>(?!))"), re.S | re.X)

# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# An open element of this name ends where one of these begins in it.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option", "optgroup"),
    "p": ("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre",
          "section", "table", "ul"),
}
KINDS = ("element", "script", "style")


def elements(code: bytes, language: str = "html") -> list[tuple[int, int, str, int, int]]:
    """(begin, end, kind, begin and end of the name) of every element, in byte offsets, by their beginning; nested ones overlap.

    An end tag closes the nearest open element of its name, and those open inside of it end in front of it; without any
    such it is passed over.  What is open at the end of the page ends there.
    """
    html = language == "html"
    fold = bytes.lower if html else bytes
    void, ended = ({v.encode() for v in VOID}, {a.encode(): {b.encode() for b in bs} for a, bs in ENDED_BY.items()}) if html else (set(), {})
    out: list[tuple[int, int, str, int, int]] = []
    open_tags: list[tuple[bytes, int, int, int]] = []      # name, beginning, where the name stands
    count: dict[bytes, int] = {}                           # how many of a name are open

    def close(end: int) -> bytes:
        name, begin, a, b = open_tags.pop()
        count[name] -= 1
        out.append((begin, end, "element", a, b))
        return name

    for token in (_TOKEN if html else _XML_TOKEN).finditer(code):
        if token["raw"] is not None:
            out.append((*token.span(), token["raw"].decode().lower(), *token.span("raw")))
        elif token["start"] is not None:
            name = fold(token["start"])
            if open_tags and name in ended.get(open_tags[-1][0], ()):
                close(token.start())
            if name in void or code[token.end() - 2:token.end() - 1] == b"/":
                out.append((*token.span(), "element", *token.span("start")))
            else:
                open_tags.append((name, token.start(), *token.span("start")))
                count[name] = count.get(name, 0) + 1
        elif token["end"] is not None and count.get(fold(token["end"])):
            name = fold(token["end"])
            while open_tags[-1][0] != name:
                close(token.start())
            close(token.end())
    while open_tags:
        close(len(code))
    return sorted(out)
