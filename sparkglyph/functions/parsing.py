"""Parsers of encoded strings, as column expressions; text-format messages in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_list(cell: Column) -> Column:
    """SF-09: `[p1]`, `[p1, p2]` and `['p1', 'p2']` to distinct items; `[]` holds one empty string."""
    return F.array_distinct(F.transform(F.split(F.regexp_replace(cell, r"[\[\]']", ""), ","), lambda x: F.trim(x)))


def short_name(permission: Column) -> Column:
    """SF-10: what follows the last dot."""
    return F.substring_index(permission, ".", -1)


def signatures(text: Column) -> Column:
    """SF-11: everything in angle brackets."""
    return F.regexp_extract_all(text, F.lit("<(.*?)>"), F.lit(1))


def widget_id(view: Column) -> Column:
    """SF-12: (id, name) of WID[id|name], null without one."""
    p = r"WID\[(\d+)\|([^\]]+)\]"
    return F.when(view.rlike(p), F.struct(F.regexp_extract(view, p, 1).cast("long").alias("id"), F.regexp_extract(view, p, 2).alias("id_name")))


def layout_name(window: Column, default: str = "gator") -> Column:
    """FLT-04, SF-12: LID[id|layout_x] to x.xml; windows without one share the default."""
    p = r"LID\[\d+\|([^\]]+)\]"
    return F.when(window.rlike(p), F.concat(F.regexp_replace(F.regexp_extract(window, p, 1), "^layout_", ""), F.lit(".xml"))).otherwise(F.lit(default))


def drawable_name(image: Column) -> Column:
    """FLT-05, SF-13: DrawableID[id|drawable_x]n to x, null for others."""
    p = r"DrawableID\[\d+\|drawable_([^\]]+)\]"
    return F.when(image.rlike(p), F.regexp_extract(image, p, 1))


def strip_prefix(value: Column, prefix: str) -> Column:
    """SF-14."""
    return F.regexp_replace(value, "^" + re.escape(prefix), "")


def class_of(signature: Column) -> Column:
    """SF-15: between `<` and `:`, quotes removed."""
    return F.regexp_extract(F.replace(signature, F.lit("'"), F.lit("")), "^<?([^:<]+):", 1)


def decode_int(value: Column) -> Column:
    """Hexadecimal (0x) or decimal."""
    return F.when(value.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(value, 3, 16), 16, 10).cast("long")).when(value.rlike(r"^-?\d+$"), value.cast("long"))


def api_level(name: Column) -> Column:
    """SF-35: android-N or google-N to N, else -1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(?:android|google)-(\d+)$", 1), F.lit("")).cast("int"), F.lit(-1))


def quote(text: Column) -> Column:
    """SF-36: backslashes and quotes escaped, in quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def with_defaults(base: Column, override: Column, append: Column) -> Column:
    """SF-27: the override unless empty, else base and what is appended."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(override), some(F.concat_ws(" ", some(base), some(append))), base)


def clamp(value: Column, domain: list, fallback) -> Column:
    """FLT-15."""
    return F.when(value.isin(*domain), value).otherwise(F.lit(fallback))


def text_or_hint(text: Column, hint: Column) -> Column:
    """SF-33."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("; ", some(text), some(hint))


def log_tags(value: Column) -> list[Column]:
    """SRC-25: tag and value of a device-log line."""
    rules = [
        ("BEGIN", r"^--- BEGIN\s+(.*)$"),
        ("END", r"^--- END\s*(.*)$"),
        ("REP", r"^REP:?\s+(\d+)"),
        ("THREAD", r"^THREAD:\s*(\d+)"),
        ("MEM", r"^\s*allocated:\s*(.*)$"),
        ("UPTIME", r"^Uptime:\s*(\d+)"),
    ]
    tag, got = F.lit("OTHER"), value
    for name, pattern in reversed(rules):
        tag = F.when(value.rlike(pattern), F.lit(name)).otherwise(tag)
        got = F.when(value.rlike(pattern), F.trim(F.regexp_extract(value, pattern, 1))).otherwise(got)
    return [tag.alias("tag"), got.alias("value")]


_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}])|([A-Za-z_][\w.]*)\s*(:?)|([-+]?[\d.]+)|#[^\n]*')


def text_message(file: str, body: str) -> list[tuple]:
    """(file, order, path, node, value) of every scalar of a text-format message; node numbers the message a field stands in."""
    out: list[tuple] = []
    path: list[str] = []
    nodes = ["0"]
    name, waiting, made = "", False, 0
    for m in _TOKEN.finditer(body):
        string, brace, word, colon, number = m.groups()
        if brace == "{":
            made += 1
            path.append(name)
            nodes.append(f"{nodes[-1]}/{made}")
            waiting = False
        elif brace == "}":
            if path:
                path.pop()
                nodes.pop()
        elif word is not None and not waiting:
            name, waiting = word, bool(colon)
        elif string is not None or word is not None or number is not None:
            value = string.encode().decode("unicode_escape") if string is not None else word or number
            out.append((file, len(out), ".".join([*path, name]), nodes[-1], value))
            waiting = False
    return out
