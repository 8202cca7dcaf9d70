"""Text of web pages as Column expressions: one pass over the markup, then blocks with their link density.

All stays inside the JVM.  The quantifiers of the markup's pattern are
possessive, so that a tag or a comment of any length is matched in a loop and
nothing is tried twice.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: elements whose content is no markup and isn't shown.
RAW_TEXT = ["iframe", "noembed", "noframes", "script", "style", "textarea", "xmp"]
#: Fixed: elements that begin and end a block of text.
BLOCK = (
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "tfoot th thead title tr ul"
).split()
#: What a block must have to be main text.
MIN_WORDS, MAX_LINK_SHARE = 5, 0.5

_VALUE = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+"""
#: The rest of a tag after its name: attributes, whose values may hold ``>`` in quotes; a tag that never ends takes all that follows.
_REST = rf"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+(?:>|\z)"
_HIDDEN = "|".join(rf"<{name}(?=[\s/>]){_REST}[\s\S]*?(?:</{name}(?=[\s/>])[^>]*+(?:>|\z)|\z)" for name in RAW_TEXT)
_COMMENT = r"<!--(?:-?+>|[\s\S]*?(?:--!?+>|\z))"
_DECLARATION = r"<(?:[!?]|/[^A-Za-z>])[^>]*+(?:>|\z)|</>"
_MARKUP = rf"(?i){_COMMENT}|{_HIDDEN}|</?+[a-z][^\s/>]*+{_REST}|{_DECLARATION}"
PIECES = rf"{_MARKUP}|[^<]++|<"
_GONE, _NEXT, _OPEN, _CLOSE = "", "\x01", "\x02", "\x03"
_REPLACEMENT = "�"


def named() -> dict[str, str]:
    """The names of HTML 4 and ``apos``, for the characters that they stand for now."""
    return {name: html5[name + ";"] for name in [*name2codepoint, "apos"]}


def unclosed() -> list[str]:
    """The names that need no semicolon, longest first."""
    return sorted((name for name in named() if name in html5), key=len, reverse=True)


def _windows() -> dict[int, str]:
    """What numbers 128 to 159 stand for: the characters of code page 1252."""
    return {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def _table(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for entry in entries.items() for x in entry])


def _numbered(entity: Column) -> Column:
    hex_ = F.regexp_extract(entity, "^&#[xX]0*+([0-9a-fA-F]{1,6});?$", 1)
    dec = F.regexp_extract(entity, "^&#0*+([0-9]{1,7});?$", 1)
    n = F.when(hex_ != "", F.conv(hex_, 16, 10).cast("bigint")).when(dec != "", dec.cast("bigint"))
    point = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    dropped = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127)
    return F.when(bad, F.lit(_REPLACEMENT)).when(dropped, F.lit("")).when(n.between(128, 159), F.element_at(_table(_windows()), n.cast("int"))).otherwise(point)


def unescaped(text: Column) -> Column:
    """Character references resolved, once each.

    Numbers, and the names that HTML lets, may lack their semicolon.  Unknown
    names stay as they are; numbers of no character become U+FFFD, control
    characters go.
    """
    names = _table(named())
    reference = rf"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|(?:{'|'.join(named())});|(?:{'|'.join(unclosed())}))"

    def one(piece: Column) -> Column:
        name = F.regexp_extract(piece, "^&([A-Za-z0-9]++);?$", 1)
        return F.when(piece.startswith("&#"), _numbered(piece)).when(name != "", F.element_at(names, name)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(rf"{reference}|[^&]++|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _marked(piece: Column) -> Column:
    """A piece of a page as text, or as the mark of what its tag does."""
    block = piece.rlike(rf"^(?i)</?+(?:{'|'.join(BLOCK)})(?=[\s/>])")
    is_tag = piece.rlike(r"^<[A-Za-z/!?]")
    tag = F.when(block, F.lit(_NEXT)).when(piece.rlike(r"^(?i)<a(?=[\s/>])"), F.lit(_OPEN)).when(piece.rlike(r"^(?i)</a(?=[\s/>])"), F.lit(_CLOSE)).otherwise(F.lit(_GONE))
    return F.when(is_tag, tag).otherwise(unescaped(piece))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}]+", " "))


def page_blocks(html: Column) -> Column:
    """Blocks of a page that have text, in order: text, chars, link_chars, words.

    A block ends where a block element begins or ends.  Comments, declarations
    and the content of scripts, styles and their like are no text; an unclosed
    comment, script or tag takes the rest of the page; ``<`` before anything but
    a letter, ``/``, ``!`` or ``?`` is text.  A link goes on over blocks until
    it is closed or another begins.  White space counts once.  Null and empty
    pages have no blocks.  Pages of any length are read whole.
    """
    clean = F.translate(html, _NEXT + _OPEN + _CLOSE, "   ")
    marked = F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(PIECES), F.lit(0)), _marked), "")
    # a link's mark is said again in each block that it goes on in
    stretches = F.regexp_extract_all(marked, F.lit(r"[\x02\x03][^\x02\x03]*+|[^\x02\x03]++"), F.lit(0))
    linked = F.array_join(F.transform(stretches, lambda s: F.when(s.startswith(_OPEN), F.replace(s, F.lit(_NEXT), F.lit(_NEXT + _OPEN))).otherwise(s)), "")

    def block(b: Column) -> Column:
        links = F.array_join(F.regexp_extract_all(b, F.lit(r"\x02([^\x02\x03]*+)"), F.lit(1)), "")
        return F.struct(_squeezed(F.translate(b, _OPEN + _CLOSE, "")).alias("text"), F.char_length(_squeezed(links)).cast("bigint").alias("link_chars"))

    def counted(b: Column) -> Column:
        words = F.size(F.split(b["text"], " ")).cast("bigint")
        return F.struct(b["text"].alias("text"), F.char_length(b["text"]).cast("bigint").alias("chars"), b["link_chars"].alias("link_chars"), words.alias("words"))

    found = F.filter(F.transform(F.split(linked, _NEXT), block), lambda b: b["text"] != "")
    return F.coalesce(F.transform(found, counted), F.array().cast("array<struct<text:string,chars:bigint,link_chars:bigint,words:bigint>>"))


def main_blocks(blocks: Column, min_words: int = MIN_WORDS, max_link_share: float = MAX_LINK_SHARE) -> Column:
    """Blocks of at least so many words, of whose characters at most that share is links."""
    return F.filter(blocks, lambda b: (b["words"] >= min_words) & (b["link_chars"] <= b["chars"] * max_link_share))


def joined(blocks: Column) -> Column:
    """The blocks' texts, a line each."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
