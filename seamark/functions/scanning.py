"""Definitions in source text: strings and comments are masked, heads found, blocks matched, gaps kept.

A file crosses to Python once, as bytes, and comes back as numbers: where each definition begins and ends,
its kind, and where its name stands.  Every step is one pass of a pattern or one sort over the file, so time grows
with its length (times its logarithm for the brackets), however many definitions it has.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import markup

_ID = r"[\w$\x80-\xff]+"

# ------------------------------------------------------------------ strings and comments

_BLOCK_COMMENT = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
# Possessive, so that a long string leaves nothing to go back to.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"?', r"'(?:[^'\\\n]++|\\.)*+'?"
_TRIPLE = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\Z)'

# What opens a comment or a string in each language; the rest of it is in the pattern, but for nested comments.
_TOKENS = {
    "rust": r'(?P<comment>//[^\n]*)|(?P<nested>/\*)|(?P<string>\bb?r(?P<mark>\#*)".*?(?:"(?P=mark)|\Z)|"(?:[^"\\]++|\\.)*+"?'
            r"|'(?:\\[^\n][^'\n]*|[^\\'\n][\x80-\xbf]*)')",
    "python": rf"(?P<comment>\#[^\n]*)|(?P<string>{_TRIPLE}|'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\Z)|{_DOUBLE}|{_SINGLE})",
    "javascript": rf"{_BLOCK_COMMENT}|(?P<string>`(?:[^`\\]++|\\.)*+`?|{_DOUBLE}|{_SINGLE})",
    "go": rf"{_BLOCK_COMMENT}|(?P<string>`[^`]*`?|{_DOUBLE}|{_SINGLE})",
    "java": rf"{_BLOCK_COMMENT}|(?P<string>{_TRIPLE}|{_DOUBLE}|{_SINGLE})",
    "c": rf"{_BLOCK_COMMENT}|(?P<string>{_DOUBLE}|{_SINGLE})",
    "cpp": rf'{_BLOCK_COMMENT}|(?P<string>\bR"(?P<mark>\w*)\(.*?(?:\)(?P=mark)"|\Z)|{_DOUBLE}|{_SINGLE})',
    "csharp": rf'{_BLOCK_COMMENT}|(?P<string>\$?@"(?:[^"]++|"")*+"?|{_TRIPLE}|{_DOUBLE}|{_SINGLE})',
    "bash": r"""(?P<comment>(?<![\w$\\{])\#[^\n]*)|(?P<string>"(?:[^"\\]++|\\.)*+"?|'[^']*'?)""",
    "powershell": r"""(?P<comment><\#.*?(?:\#>|\Z)|\#[^\n]*)|(?P<string>"(?:[^"`]++|`.)*+"?|'[^']*'?)""",
    "sql": r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^']++|'')*+'?|(?P<mark>\$\w*\$).*?(?:(?P=mark)|\Z))",
    "other": rf"{_BLOCK_COMMENT}|(?P<string>{_DOUBLE})",
}
_SAME = {"typescript": "javascript", "tsx": "javascript"}
_INSIDE = b"\x01"                                                # the inside of a string, from its second byte on
_WRITTEN = bytes(c if c == 10 else 1 for c in range(256))       # line feeds stay, so lines keep their numbers
_BLANKED = bytes(c if c == 10 else 32 for c in range(256))
_COMMENT_EDGE = re.compile(rb"/\*|\*/")


def masked(code: bytes, language: str) -> bytes:
    """`code` with comments blank and strings as a quote and its inside, byte for byte in place."""
    pattern, out, at = _LEXERS.get(language, _LEXERS["other"]), bytearray(code), 0
    while token := pattern.search(code, at):
        start, at = token.span()
        if token.lastgroup == "nested":
            depth = 1
            while depth:
                edge = _COMMENT_EDGE.search(code, at)
                at = edge.end() if edge else len(code)
                depth = depth + (1 if edge[0] == b"/*" else -1) if edge else 0
        comment = token["comment"] is not None or token.lastgroup == "nested"
        out[start:at] = code[start:at].translate(_BLANKED if comment else _WRITTEN)
        if not comment:
            out[start] = 34
    return bytes(out)


# ------------------------------------------------------------------ heads

def _words(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


def _modifiers(*words: str) -> str:
    return rf"(?:{_words(*words)}\s+)*"


_NOT_A_TYPE = r"(?!(?:return|else|new|throw|if|for|while|switch|catch|do|case|assert|yield|await|using|lock|in|is|as|goto|delete|typedef|package|import|extends|implements)\b)"
_NOT_A_NAME = r"(?!(?:if|for|while|switch|catch|function|return|with|super|new|typeof|await)\b)"
_JAVA_WORDS = ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "sealed", "transient")
_SHARP_WORDS = ("public", "private", "protected", "internal", "static", "abstract", "async", "override", "virtual", "sealed", "partial", "readonly", "unsafe", "extern", "new")
_C_WORDS = ("static", "inline", "extern", "virtual", "explicit", "constexpr", "friend", "unsigned", "signed", "long", "short", "const", "struct", "enum")
_SCRIPT = rf"""{_modifiers("export", "default", "declare", "abstract", "async")}(?:(?P<kw>function|class|interface|enum|namespace|type)\b(?:\s*\*)?(?:[ \t]+(?P<name>{_ID}))?(?=\s*[({{<=\w$]|$)
    |(?:const|let|var)[ \t]+(?P<arrow>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*\)|{_ID})\s*(?::[^=\n{{]+)?=>))
    |{_modifiers("public", "private", "protected", "static", "async", "get", "set", "readonly", "abstract", "override")}(?:\*\s*)?{_NOT_A_NAME}(?P<bare>\#?{_ID})\s*(?:<[^>\n]*>)?\("""
_TYPED = rf"(?:<[^>\n]+>\s+)?{_NOT_A_TYPE}[\w.$?<>,\[\]\x80-\xff]+(?:\s*\[\s*\])*\s+"

# What a definition begins with; `bare` are those without a keyword of their own.
_HEADS = {
    "rust": rf"""(?:(?:pub(?:[ \t]*\([^)\n]*\))?|default|const|async|unsafe|extern(?:[ \t]+"\x01*)?)[ \t]+)*(?:(?P<kw>fn|struct|enum|trait|mod|union)\s+(?P<name>{_ID})
        |(?P<impl>impl)\b(?:[ \t]*<[^{{;\n]*?>)?\s+(?:[^{{;\n]*?\sfor\s+)?(?P<type>{_ID}))""",
    "python": rf"(?:async[ \t]+)?(?P<kw>def|class)[ \t]+(?P<name>{_ID})",
    "javascript": _SCRIPT,
    "go": rf"(?P<kw>func)\b[ \t]*(?:\([^)\n]*\)[ \t]*)?(?P<name>{_ID})|(?P<impl>type)[ \t]+(?P<type>{_ID})",
    "java": rf"{_modifiers(*_JAVA_WORDS)}(?:(?P<kw>class|interface|enum|record)\s+(?P<name>{_ID})|{_TYPED}(?P<bare>{_ID})\s*\()",
    "csharp": rf"{_modifiers(*_SHARP_WORDS)}(?:(?P<kw>class|interface|enum|record|struct|namespace)\s+(?P<name>[\w$.\x80-\xff]+)|{_TYPED}(?:(?P<bare>{_ID})\s*\(|(?P<property>{_ID})\s*\{{))",
    "c": rf"""(?:typedef\s+)?(?P<kw>struct|class|union|namespace|enum(?:\s+class)?)\b\s*(?P<name>{_ID})?(?=[^;(){{}}=]*\{{)
        |{_modifiers(*_C_WORDS)}{_NOT_A_TYPE}[\w:<>,\x80-\xff]+(?:\s*[*&]+\s*|\s+)(?P<bare>~?[\w:~\x80-\xff]+)\s*\(""",
    "bash": r"(?P<kw>function)[ \t]+(?P<name>[\w:.-]+)|(?P<bare>[\w:.-]+)[ \t]*\([ \t]*\)",
    "powershell": r"(?i:(?P<kw>function|filter|workflow|class|enum)\s+(?P<name>[\w:-]+))",
    "sql": r"""(?i:create(?:\s+or\s+replace)?(?:\s+(?:temp|temporary|unique|materialized|global|local))*\s+(?P<kw>function|procedure|table|view|index|trigger)\s+
        (?:if\s+not\s+exists\s+)?(?P<name>[\w."\x80-\xff]+))""",
    "other": rf"""{_modifiers("public", "private", "protected", "internal", "static", "final", "abstract", "async", "export", "open", "override", "sealed", "data", "inline", "suspend",
        "case", "pub", r"pub\(crate\)")}(?P<kw>fn|def|function|func|fun|sub|class|struct|enum|interface|impl|trait|type|object|protocol|module|namespace|record|union)[ \t]+(?P<name>{_ID})
        (?=[ \t]*(?:[({{<:=;]|->|$|(?:extends|implements|where)\b))""",
}
_SAME_HEAD = {**_SAME, "cpp": "c"}
# Data: nothing in it is a definition.
NO_DEFINITIONS = ("json", "yaml")
MARKUP = ("html", "xml")

KINDS = ["", "function", "method", "class", "struct", "enum", "trait", "impl", "module", "interface", "type", "union", "namespace", "record", "property",
         "procedure", "table", "view", "index", "trigger", "filter", "workflow", "object", "protocol", *markup.KINDS]
_WORD_KINDS = {b"fn": "function", b"def": "function", b"func": "function", b"fun": "function", b"sub": "function", b"mod": "module"}
CALLED = ("function", "method", "procedure", "filter", "workflow")
HOLDERS = ("class", "struct", "enum", "trait", "impl", "interface", "type", "union", "record", "object", "protocol")

# A line feed ends a definition that has no block yet, unless the next line goes on with one of these.
_BY_LINES = ("javascript", "typescript", "tsx", "go", "other")
_GOES_ON = re.compile(rb"\s*(?:\{|extends\b|implements\b|where\b|throws\b|[|&=:.?+])")


def _compiled(table: dict[str, str], same: dict[str, str], wrap: str, flags: int) -> dict[str, re.Pattern]:
    found = {name: re.compile((wrap % pattern).encode("latin-1"), flags) for name, pattern in table.items()}
    return {**found, **{name: found[like] for name, like in same.items()}}


_LEXERS = _compiled(_TOKENS, _SAME, "%s", re.S)
_HEAD_PATTERNS = _compiled(_HEADS, _SAME_HEAD, "%s", re.M | re.X)
# Where a statement can begin; heads are looked for there alone.
_STARTS = re.compile(rb"[\n;{}][ \t]*(?=[^\s;{}\x01])")


@dataclass(frozen=True)
class Head:
    start: int          # of the first modifier or keyword
    end: int
    kind: str
    name: tuple[int, int]
    bare: bool


def heads(text: bytes, language: str) -> list[Head]:
    """What looks like the beginning of a definition, in masked text."""
    out, at = [], 0
    match = _HEAD_PATTERNS.get(language, _HEAD_PATTERNS["other"]).match
    for start in [len(text) - len(text.lstrip(b" \t")), *(m.end() for m in _STARTS.finditer(text))]:
        m = match(text, start) if start >= at else None
        if m is None:
            continue
        found, at = m.groupdict(), m.end()
        of = next((g for g in ("name", "type", "arrow", "bare", "property") if found.get(g) is not None), None)
        word = (found.get("kw") or found.get("impl") or b"function").split()[0].lower()
        kind = "property" if of == "property" else _WORD_KINDS.get(word, word.decode())
        out.append(Head(m.start(), at, kind, m.span(of) if of else (0, 0), of == "bare"))
    return out


# ------------------------------------------------------------------ blocks

def _partners(text: np.ndarray, opening: int, closing: int) -> dict[int, int]:
    """The closing bracket of each opening one that has any: events of one depth alternate once sorted by it."""
    at = np.flatnonzero((text == opening) | (text == closing))
    opens = text[at] == opening
    depth = np.cumsum(np.where(opens, 1, -1))
    order = np.argsort(depth - opens, kind="stable")      # the depth outside of the pair
    at, opens, level = at[order], opens[order], (depth - opens)[order]
    pairs = np.flatnonzero(opens[:-1] & ~opens[1:] & (level[:-1] == level[1:]))
    return dict(zip(at[pairs].tolist(), at[pairs + 1].tolist()))


def _brace_ends(text: bytes, found: list[Head], language: str, whole: int) -> list[tuple[int, bool]]:
    """End of each definition and whether it has a block: behind that (an open one ends at `whole`), or behind the sign that ends it without one."""
    data = np.frombuffer(text, dtype=np.uint8)
    step = np.zeros(256, dtype=np.int64)
    step[[40, 91]], step[[41, 93]] = 1, -1
    nested = np.cumsum(step[data])
    by_lines = language in _BY_LINES
    stops = np.flatnonzero((data == 123) | (data == 59) | (data == 125) | ((data == 10) if by_lines else False))
    signs, inside, stops = data[stops].tolist(), nested[stops].tolist(), stops.tolist()
    partner = _partners(data, 123, 125)
    out = []
    for k, head in enumerate(found):
        limit = found[k + 1].start if k + 1 < len(found) else len(text)
        level = int(nested[head.start - 1]) if head.start else 0
        i, end, block = bisect_left(stops, head.end if text[head.end - 1:head.end] != b"{" else head.end - 1), None, False
        while end is None and i < len(stops) and stops[i] < limit:
            at, sign = stops[i], signs[i]
            i += 1
            if inside[i - 1] > level:
                continue
            if sign == 123:
                end, block = partner.get(at, whole - 1) + 1, True
            elif sign == 59:
                end = at + 1
            elif sign == 125:
                end = at
            elif not _GOES_ON.match(text, at + 1):
                end = at
        out.append((max(head.end, len(text[:limit].rstrip()) if end is None else end), block))
    return out


def _indent_ends(text: bytes, found: list[Head]) -> list[int]:
    """End of each definition: the last line of code before the next one that is not deeper."""
    data = np.frombuffer(text, dtype=np.uint8)
    step = np.zeros(256, dtype=np.int64)
    step[[40, 91, 123]], step[[41, 93, 125]] = 1, -1
    nested = np.cumsum(step[data])
    first = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    begin, depth, last = [], [], []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(text) + 1]):
        line = text[a:b - 1]
        bare = line.strip()
        if not bare:
            continue
        # a line that begins inside brackets or a string only goes on with the one before it
        if begin and (nested[a - 1] > 0 or line[:1] == _INSIDE):
            last[-1] = a + len(line.rstrip())
        else:
            begin.append(a)
            depth.append(len(line) - len(line.lstrip()))
            last.append(a + len(line.rstrip()))
    after, waiting = [len(begin)] * len(begin), []
    for i, own in enumerate(depth):      # the next line that is not deeper, for every line
        while waiting and depth[waiting[-1]] >= own:
            after[waiting.pop()] = i
        waiting.append(i)
    return [last[after[i] - 1] for i in (bisect_right(begin, head.start) - 1 for head in found)]


def _plain_ends(text: bytes, found: list[Head]) -> list[int]:
    """End of each definition: behind a semicolon outside of brackets, or in front of the next one."""
    return [min(end, nxt) for (end, _), nxt in zip(_brace_ends(text.replace(b"{", b" ").replace(b"}", b" "), found, "sql", len(text)), [*[h.start for h in found[1:]], len(text)])]


_SOLID = re.compile(rb"\S(?:.*\S)?", re.S)
_TELLING = re.compile(rb"[0-9A-Za-z\x80-\xff]")

def _with_gaps(code: bytes, kept: list[tuple[int, int, str, int, int]]) -> list[tuple[int, ...]]:
    """Spans with their lines, and between the outermost what holds a letter or a digit; nothing if there is no span."""
    if not kept:
        return []
    feeds = np.flatnonzero(np.frombuffer(code, dtype=np.uint8) == 10).tolist()
    gaps, covered = [], 0
    for a, b, *_ in [*sorted(kept), (len(code), len(code))]:
        solid = _SOLID.search(code, covered, a) if a > covered else None
        if solid and _TELLING.search(code, *solid.span()):
            gaps.append((*solid.span(), "", 0, 0))
        covered = max(covered, b)
    return [(a, b, bisect_left(feeds, a) + 1, bisect_left(feeds, max(a, b - 1)) + 1, KINDS.index(kind), c, d) for a, b, kind, c, d in sorted(kept + gaps)]


# Byte range, line range, kind as a place in KINDS, byte range of the name.
FIELDS = ["byte_start", "byte_end", "start_line", "end_line", "kind", "name_start", "name_end"]


def definitions(code: bytes, language: str, style: str) -> list[tuple[int, ...]]:
    """All definitions (of a page: all elements) and, without a kind, what lies between the outermost; nothing if there are none.

    Nested definitions overlap those around them.  A stretch between definitions that holds no letter or digit (a bracket,
    a separator) is left out.
    """
    if language in NO_DEFINITIONS:
        return []
    if language in MARKUP:
        return _with_gaps(code, markup.elements(code, language))
    text = masked(code, language)
    found = heads(text, language)
    if not found:
        return []
    if style == "braces":
        ends = _brace_ends(text, found, language, len(code.rstrip()))
    else:
        ends = [(end, True) for end in (_indent_ends if style == "indent" else _plain_ends)(text, found)]
    kept: list[tuple[int, int, str, int, int]] = []
    around: list[tuple[int, str]] = []      # end and kind of the definitions a head lies in
    for head, (end, block) in zip(found, ends):
        while around and around[-1][0] <= head.start:
            around.pop()
        if head.bare and language != "bash":
            within = around[-1][1] if around else ""
            # without a keyword it is a call where it stands in a function; scripts have such only in classes
            if within in CALLED or (_SAME.get(language, language) == "javascript" and (within not in HOLDERS or not block)):
                continue
        kind = "method" if head.kind == "function" and any(k in HOLDERS for _, k in around) else head.kind
        kept.append((head.start, end, kind, *head.name))
        around.append((min(end, around[-1][0]) if around else end, kind))
    return _with_gaps(code, kept)



_TYPE = "array<struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">>"


def definition_spans(content: Column, language: Column, style: Column) -> Column:
    """The definitions of a file as an array of numbers (FIELDS); empty for a null text and where there is none.

    `content` should be a column: it is named twice, which keeps its computation in a projection of its own, and sent once.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, languages, styles, _same in batches:
            # Arrow holds the texts as UTF-8: bytes are taken as they are
            rows = [definitions(code, of, how) if code is not None and of is not None else []
                    for code, of, how in zip(contents.cast(pa.binary()).to_pylist(), languages.to_pylist(), styles.to_pylist())]
            flat = np.array([span for row in rows for span in row], dtype=np.int64).reshape(-1, len(FIELDS))
            spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(FIELDS))], FIELDS)
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)], dtype=np.int32)), spans)

    return F.arrow_udf(run, _TYPE).asNondeterministic()(content, F.coalesce(language, F.lit("")), style, content)
