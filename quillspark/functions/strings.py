"""String expressions whose results agree with the usual text semantics of URLs and titles."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a file name may not hold.
FORBIDDEN = '\\/*?:"<>|'


def strip(x: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def squeeze_name(title: Column, most: int = 150) -> Column:
    """A title as a file name: forbidden characters out, white space to ``_``, at most ``most`` characters and ``.pdf``."""
    kept = F.translate(title, FORBIDDEN, "")
    return F.concat(F.left(F.regexp_replace(kept, r"(?U)[\s\x1c-\x1f]+", "_"), F.lit(most)), F.lit(".pdf"))


def preview(text: Column, most: int = 200) -> Column:
    """The first ``most`` characters and dots; null for null or empty text."""
    return F.when(text != "", F.concat(F.left(text, F.lit(most)), F.lit("...")))


def yes(x: Column) -> Column:
    """Whether an answer says yes."""
    return F.lower(strip(x)).isin("y", "yes")


def number_or(x: Column, default: float) -> Column:
    """A number, or the default where it is none."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def prompt_lines(typed: Column) -> Column:
    """A prompt typed line by line: what stands before the first two empty lines, or everything."""
    ended = F.concat(F.lit("\n"), typed, F.lit("\n\n\n"))
    return F.substring(F.substring_index(ended, "\n\n\n", 1), F.lit(2), F.length(ended))


#: Character references by name, from the standard library's table.
_NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def _char(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))


def unescape(x: Column) -> Column:
    """Character references decoded once: by name, decimal or hexadecimal; others stay as they are."""
    names = F.create_map(*[F.lit(v) for pair in _NAMED.items() for v in pair])

    def piece(p: Column) -> Column:
        decimal = F.regexp_extract(p, r"^#([0-9]{1,9});?", 1)
        hexa = F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,7});?", 1)
        name = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        known = F.try_element_at(names, name)
        return (
            F.when(decimal != "", F.concat(_char(decimal.cast("bigint")), F.regexp_replace(p, r"^#[0-9]{1,9};?", "")))
            .when(hexa != "", F.concat(_char(F.conv(hexa, 16, 10).cast("bigint")), F.regexp_replace(p, r"^#[xX][0-9a-fA-F]{1,7};?", "")))
            .when(known.isNotNull(), F.concat(known, F.substring(p, F.length(name) + 2, F.length(p))))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(x, "&", -1)
    decoded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
    return F.when(F.contains(x, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))).otherwise(x)


def strip_tags(html: Column) -> Column:
    """The text of a fragment: tags out, character references and no-break spaces decoded, ends stripped."""
    return strip(F.replace(unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "")), F.lit("\u00a0"), F.lit(" ")))
