"""Text helpers with the byte and line conventions of the index."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import let, running_starts, struct

CONTEXT_LINES = 3
DEFAULT_RADIUS = 20


def normalize_newlines(content: Column) -> Column:
    return F.replace(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(content: Column) -> Column:
    """Lines without their terminators; a final newline opens no further line."""
    parts = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def join_lines(array: Column) -> Column:
    return F.array_join(array, "\n")


def contains_nul(content: Column) -> Column:
    return F.contains(content, F.decode(F.unhex(F.lit("00")), "UTF-8"))


def _ranges(content: Column, needle: str, size) -> Column:
    parts = F.split(F.lower(content), F.lit(quoted(needle.lower())), -1)
    width = size(F.lit(needle))

    def found(before: Column) -> Column:
        starts = running_starts(F.transform(before, lambda n: n + width))
        return F.zip_with(starts, before, lambda start, n: struct(
            start=(start + n).cast("int"), end=(start + n + width).cast("int")))

    # lengths of the text in front of each hit
    return let(F.transform(parts, lambda part: size(part)), lambda n: let(F.slice(n, F.lit(1), F.size(n) - 1), found))


def highlight_ranges(content: Column, query: str) -> Column:
    """Byte ranges of every non-overlapping, case-insensitive hit of the whole query."""
    return _ranges(content, query, F.octet_length)


def highlight_char_ranges(content: Column, query: str) -> Column:
    """The same hits counted in characters."""
    return _ranges(content, query, F.char_length)


def line_range(all_lines: Column, line: int | None, radius: int | None = None) -> Column:
    """Struct of the excerpt around `line` and its line info; the whole file for no or an outside line.

    `all_lines` should be a column already computed: it is read several times.
    """
    total = F.size(all_lines)
    reach = DEFAULT_RADIUS if radius is None else radius
    wanted = F.lit(line).cast("int")
    hit = (wanted > 0) & (wanted <= total) if line is not None else F.lit(False)
    # `line` comes from the request, so sums are done wide enough not to overflow
    start = F.when(hit, F.greatest(F.lit(1), F.lit((line or 0) - reach))).otherwise(1).cast("int")
    end = F.when(hit, F.least(total.cast("long"), F.lit((line or 0) + reach).cast("long"))).otherwise(total).cast("int")
    start = F.when(total == 0, 0).otherwise(start)
    end = F.when(total == 0, 0).otherwise(end)
    content = F.when(total == 0, "").otherwise(join_lines(F.slice(all_lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))))
    return struct(content=content, start=start, end=end, requested=wanted, total=total)


def surrounding_lines(all_lines: Column, start_line: Column, end_line: Column, n: int = CONTEXT_LINES) -> Column:
    """Up to `n` lines of the file before and after a chunk, null where there are none."""
    total = F.size(all_lines)
    first = F.greatest(start_line - n, F.lit(1))
    before_len = F.greatest(F.least(start_line - 1, total) - first + 1, F.lit(0))
    after_len = F.greatest(F.least(end_line + n, total) - end_line, F.lit(0))
    before = F.when(before_len > 0, join_lines(F.slice(all_lines, first, before_len)))
    after = F.when(after_len > 0, join_lines(F.slice(all_lines, F.greatest(end_line + 1, F.lit(1)), after_len)))
    return struct(before=before, after=after)


def symbols(name: Column, kind: Column) -> Column:
    """The chunk's own name and `kind:name`."""
    tagged = F.when(kind.isNotNull(), F.concat(kind, F.lit(":"), F.coalesce(name, F.lit("anonymous"))))
    return F.array_compact(F.array(name, tagged))


def ascii_lower(content: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(content, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_ascii_ci(content: Column, needle: str) -> Column:
    """Whether the text holds `needle`, A to Z matching either case and nothing else folded."""
    return content.rlike("(?i)" + quoted(needle))


def quoted(needle: str) -> str:
    """`needle` as a literal pattern."""
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def decode_bytes(raw: Column) -> Column:
    """Struct (content, encoding) of a binary column, null where it is not text.

    NUL bytes mean binary, valid UTF-8 is taken as it is, otherwise a byte-order
    mark decides.  UTF-16 text holds NUL bytes for every ASCII character, so in
    practice only UTF-16 without any ASCII passes.
    """
    mark = F.hex(F.substring(raw, 1, 3))
    text = raw.cast("string")
    utf16 = lambda name, charset: struct(
        content=F.decode(F.substring(raw, 3, F.octet_length(raw)), charset), encoding=F.lit(name))
    return F.when(
        ~F.contains(raw, F.unhex(F.lit("00"))),
        F.when(F.is_valid_utf8(text), struct(content=text, encoding=F.lit("UTF-8")))
        .when(mark.startswith("FFFE"), utf16("UTF-16LE", "UTF-16LE"))
        .when(mark.startswith("FEFF"), utf16("UTF-16BE", "UTF-16BE")),
    )
