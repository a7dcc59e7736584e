"""Text functions of addresses and POIs: folding, name matching, languages, contact columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters that fold to one ASCII letter, as two aligned strings, and those that fold to several."""
    one, to, many = "", "", {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th"}
    plain = {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i"}
    for code in range(0xC0, 0x250):
        c = chr(code)
        base = plain.get(c) or unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(base) == 1 and c not in many:
            one, to = one + c, to + base
    return one, to, many


_ONE, _TO, _MANY = _folding()


def fold_ascii(text: Column) -> Column:
    """Accented Latin letters by their plain ones."""
    out = F.translate(text, _ONE, _TO)
    for c, plain in _MANY.items():
        out = F.replace(out, F.lit(c), F.lit(plain))
    return out


def names_match(name: Column, names: Column) -> Column:
    """A value is among the values of an object's name tags."""
    return F.coalesce(F.array_contains(F.map_values(names), name), F.lit(False))


def street_names_match(a: Column, b: Column) -> Column:
    """Folded lower-case names of which one contains the other."""
    x, y = F.lower(fold_ascii(a)), F.lower(fold_ascii(b))
    return F.contains(x, y) | F.contains(y, x)


def languages(tags: Column, known: tuple[str, ...]) -> Column:
    """Known language codes in the keys of name tags, such as name:de or name:pt-BR."""
    keys = F.filter(F.map_keys(tags), lambda k: F.contains(k, F.lit("name")) & F.contains(k, F.lit(":")))
    codes = F.transform(keys, lambda k: F.regexp_extract(k, r":([A-Za-z]+)", 1))
    return F.array_sort(F.array_intersect(codes, F.array(*[F.lit(x) for x in known])))


def translated(tags: Column, language: str) -> Column:
    """Name in a language, else the plain name."""
    return F.coalesce(tags[f"name:{language}"], tags["name"])


def contact(tags: Column, what: str) -> Column:
    """phone, fax, website or email: the contact tag first; blank is absent."""
    return F.coalesce(F.nullif(F.trim(tags[f"contact:{what}"]), F.lit("")), F.nullif(F.trim(tags[what]), F.lit("")))


def part_named(parts: Column, level: str) -> Column:
    """Name of the first part of a level."""
    return F.get(F.transform(F.filter(parts, lambda p: p["lvl"] == level), lambda p: p["name"]), F.lit(0))


def readable_size(size: Column) -> Column:
    """Bytes in the largest unit that gives one or more, to one place."""
    unit = F.least(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)).cast("double")) + 1e-12), F.lit(4)).cast("int")
    number = F.call_function("format_number", size / F.pow(F.lit(1024.0), unit), F.lit("#,##0.#"))
    return F.when(size <= 0, "0").otherwise(F.concat(number, F.lit(" "), F.element_at(F.array(*[F.lit(u) for u in ("B", "kB", "MB", "GB", "TB")]), unit + 1)))


def geometry_type(kind: Column, geojson: bool) -> Column:
    """A geometry's type as GeoJSON writes it, or in small letters."""
    return kind if geojson else F.lower(kind)
