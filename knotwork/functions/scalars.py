"""Column expressions shared by the operators."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

PROPERTY_MAP = "map<string,variant>"


def strip(c: Column) -> Column:
    """Trim every Unicode white space character, not only the blank."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_type(c: Column) -> Column:
    return F.lower(strip(c))


def nocase(c: Column) -> Column:
    """Fold ASCII letters only, so that names differing in an accented letter stay apart."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def tolerant_double(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float(default)))


def props_map(c: Column) -> Column:
    """JSON object text as a map; NULL, broken JSON and non-objects give an empty map."""
    return F.coalesce(F.from_json(c, PROPERTY_MAP), F.from_json(F.lit("{}"), PROPERTY_MAP))


def props_json(c: Column) -> Column:
    """Map back to JSON text with its keys in order."""
    ordered = F.array_sort(F.map_keys(c))
    return F.to_json(F.map_from_arrays(ordered, F.transform(ordered, lambda k: c[k])))


def overlay_props(old: Column, new: Column) -> Column:
    """Shallow overlay of two JSON objects: keys of ``new`` win."""
    new_map = props_map(new)
    kept = F.map_filter(props_map(old), lambda k, _: ~F.map_contains_key(new_map, k))
    return props_json(F.map_concat(kept, new_map))


def nonempty_props(c: Column) -> Column:
    """Drop properties whose value is null or an empty string."""
    return F.map_filter(
        props_map(c), lambda _, v: ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""')
    )


def append_text(old: Column, new: Column) -> Column:
    """Append on a new line unless the text is already contained."""
    text = strip(F.coalesce(new, F.lit("")))
    base = F.coalesce(old, F.lit(""))
    return F.when(
        (text != "") & (F.instr(base, text) == 0), strip(F.concat(base, F.lit("\n"), text))
    ).otherwise(base)


def embedding_text(name: Column, entity_type: Column, description: Column) -> Column:
    return F.concat_ws(
        " ",
        name,
        F.concat(F.lit("("), entity_type, F.lit(")")),
        F.nullif(description, F.lit("")),
    )


def new_id(*parts: Column) -> Column:
    """Id derived from the natural key, hence the same when a task is run again."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks and the letters without."""
    marked = [chr(c) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]]
    parts = [(c, unicodedata.normalize("NFD", c)) for c in marked if c.islower()]
    pairs = [(c, p[0]) for c, p in parts if len(p) > 1 and p[0].isascii()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics; the same rule for index and query.

    Marks fold whether a letter is written as one character or as letter and combining mark.
    """
    bare = F.regexp_replace(F.translate(F.lower(c), *_plain_letters()), r"[\u0300-\u036F]", "")
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
