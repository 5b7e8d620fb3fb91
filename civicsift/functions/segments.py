"""Sentences, placeholders and page markup as columns."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicsift.functions.text import bind

# white space as scripts in a page know it
_BLANK = r"\t\n\x0B\f\r\x{FEFF}\p{Z}"

SENTENCE = rf"[^.!?\n\r]+[.!?\x{{2026}}]*[{_BLANK}]*"

MARK = 'data-masked="placeholder"'

# Elements whose text is never looked at: not shown, or already masked. The head is not among them, since
# its end tag may be missing; whatever text it can hold lies in one of these.
_OPAQUE = (
    r"<(title|script|style|noscript|textarea|template)\b[^>]*+>.*?(?:</\1\s*>|\z)"
    rf"|<span [^>]*{MARK}[^>]*>.*?(?:</span>|\z)"
)
# a quote opens a value only right after the equals sign
_TAG = r"""</?[a-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>|</?[a-z][^>]*+>"""
_TEXT = r"(?:[^<]++|<(?![a-z/!?]))++"
PIECE = rf"(?is){_OPAQUE}|<!--.*?(?:-->|\z)|<[!?/][^>]*+>|{_TAG}|{_TEXT}|<"

_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def sentences(text: Column) -> Column:
    """Sentence segments with trailing white space; a text without any is one segment."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.when(F.size(found) == 0, F.array(text)).otherwise(found)


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{_BLANK}]+|(?<![{_BLANK}])[{_BLANK}]+\z", "")


def trailing_blank(text: Column) -> Column:
    return F.regexp_extract(text, rf"((?<![{_BLANK}])[{_BLANK}]+)\z", 1)


def placeholder(segment: Column, labels: Column) -> Column:
    """Text put in place of a sentence; white space after the sentence stays."""
    return F.concat(
        F.lit("<this sentence was removed for "), F.array_join(labels, ", "), F.lit(">"), trailing_blank(segment))


def pieces(page: Column) -> Column:
    """Markup taken apart into opaque elements, tags and texts; joined they give the page back."""
    return F.regexp_extract_all(page, F.lit(PIECE), F.lit(0))


def is_text(piece: Column) -> Column:
    return ~piece.rlike(r"(?i)\A<(?:[a-z/!?]|\z)")


# fixed values: elements that have no content and no end tag
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

_EDITABLE = r"""(?i)\scontenteditable(?:\s*=\s*(?:["']?(?:true|plaintext-only)|""|'')|\s*+[^=\s])"""
_FIXED = r"""(?i)\scontenteditable\s*=\s*["']?false"""


def editable_changes(parts: Column) -> Column:
    """The pieces after which being editable changes: array of (after, on), in order.

    Elements with ``contenteditable`` form a stack; the innermost decides. Each knows how many
    elements of its own name are open inside it, so that it closes with the right end tag. The time grows with the
    tags of a page, and with the square of its editable regions.
    """
    def step(state: Column, part: Column) -> Column:
        piece, at = part["piece"], part["at"]
        name = F.lower(F.regexp_extract(piece, r"\A</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        opens = piece.rlike(r"\A<[a-zA-Z]") & ~piece.endswith("/>") & ~name.isin(*_VOID)
        closes = piece.rlike(r"\A</")
        on, off = piece.rlike(_EDITABLE), piece.rlike(_FIXED)
        stack = state["stack"]
        top = F.get(stack, F.size(stack) - 1)
        rest = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        same = (F.size(stack) > 0) & (top["name"] == name)

        def entry(depth: Column, editable: Column) -> Column:
            return F.array(F.struct(name.alias("name"), depth.alias("depth"), editable.alias("on")))

        grown = F.when(opens & (on | off), F.concat(stack, entry(F.lit(1), on))) \
            .when(opens & same, F.concat(rest, entry(top["depth"] + 1, top["on"]))) \
            .when(closes & same & (top["depth"] > 1), F.concat(rest, entry(top["depth"] - 1, top["on"]))) \
            .when(closes & same, rest).otherwise(stack)

        def state_of(after: Column) -> Column:
            before = F.coalesce(top["on"], F.lit(False))
            now = F.coalesce(F.get(after, F.size(after) - 1)["on"], F.lit(False))
            change = F.array(F.struct(at.alias("after"), now.alias("on")))
            changes = F.when(before != now, F.concat(state["changes"], change)).otherwise(state["changes"])
            return F.struct(after.alias("stack"), changes.alias("changes"))

        return F.when(opens | closes, bind(grown, state_of)).otherwise(state)

    zero = F.struct(
        F.array().cast("array<struct<name:string,depth:int,on:boolean>>").alias("stack"),
        F.array().cast("array<struct<after:int,on:boolean>>").alias("changes"))
    tags = F.filter(
        F.transform(parts, lambda piece, at: F.struct(piece.alias("piece"), at.alias("at"))),
        lambda part: part["piece"].rlike(r"\A</?[a-zA-Z]"))
    return F.aggregate(tags, zero, step, lambda state: state["changes"])


def editable_flags(parts: Column, changes: Column) -> Column:
    """For every piece whether it lies in an editable element, given ``editable_changes``; one step per change."""
    count = F.size(parts)
    after = F.transform(changes, lambda change: change["after"])
    ends = F.concat(F.slice(after, F.lit(2), F.greatest(F.size(after) - 1, F.lit(0))), F.array(count - 1))
    runs = F.zip_with(changes, ends, lambda change, end: F.array_repeat(change["on"], F.greatest(end - change["after"], F.lit(0))))
    first = F.array_repeat(F.lit(False), F.coalesce(F.get(after, F.lit(0)) + 1, count))
    return F.flatten(F.concat(F.array(first), F.when(F.size(changes) > 0, runs).otherwise(
        F.array().cast("array<array<boolean>>"))))


def aligned(entries: Column, at: str, value: str) -> Column:
    """Field ``value`` of ``entries``, structs in ascending order of the distinct numbers ``at``, as an array in which each
    stands at its number; nulls between. A list beside such an array is matched in one pass."""
    numbers = F.transform(entries, lambda entry: entry[at])
    before = F.slice(F.concat(F.array(F.lit(-1)), numbers), F.lit(1), F.size(entries))
    return F.flatten(F.zip_with(entries, before, lambda entry, last: F.concat(
        F.array_repeat(F.when(F.lit(False), entry[value]), entry[at] - last - 1), F.array(entry[value]))))


def unescape(text: Column) -> Column:
    """Character references decoded; unknown names stay as they are."""
    names = {f"&{name}": char for name, char in html5.items() if name.endswith(";")}
    # code points 128 to 159 stand for other characters than their numbers say
    codes = {str(code): html.unescape(f"&#{code};") for code in range(128, 160)}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    remapped = F.from_json(F.lit(json.dumps(codes)), "map<string,string>")

    def decode(part: Column) -> Column:
        digits = F.regexp_extract(part, r"\A&#0*([0-9]{1,9});\z", 1)
        hexes = F.regexp_extract(part, r"\A&#[xX]0*([0-9a-fA-F]{1,7});\z", 1)
        code = F.when(digits != "", digits.try_cast("long")).when(
            hexes != "", F.conv(hexes, 16, 10).try_cast("long"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.coalesce(
            F.element_at(remapped, code.cast("string")),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        )
        numeric = F.when(valid, char).otherwise(F.lit("�"))
        return F.when(part.startswith("&#") & part.endswith(";"), numeric) \
            .when(part.startswith("&"), F.coalesce(F.try_element_at(table, part), part)).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, decode), "")).otherwise(text)


def escape(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
