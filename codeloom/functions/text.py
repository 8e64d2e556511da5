"""Text expressions.  All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx


def strip(text: Column) -> Column:
    """Remove all white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def blank_to_null(text: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def decode_source(content: Column) -> Column:
    """Bytes as UTF-8 where valid, else as Latin-1; never fails."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def module_name(rel_path: Column) -> Column:
    """Dotted module of a relative path; a root ``__init__.py`` gives ''."""
    stem = F.regexp_replace(rel_path, r"\.py$", "")
    return F.replace(F.regexp_replace(stem, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def slug(text: Column) -> Column:
    runs = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(runs, "^-|-$", ""), F.lit("")), F.lit("node"))


def title_label(name: Column) -> Column:
    """Title case where every letter run starts upper case (``v2x`` -> ``V2X``).

    ``initcap`` alone only looks at white space, so the name is cut into runs of
    letters and non-letters first.
    """
    pieces = F.regexp_extract_all(
        F.lower(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)
    )
    return F.array_join(F.transform(pieces, F.initcap), "")


def node_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha1(value), 1, 10))


def first_segment_file(symbol: Column) -> Column:
    """File guessed from a symbol: its first dotted segment plus ``.py``."""
    return F.when(
        F.contains(symbol, F.lit(".")), F.concat(F.substring_index(symbol, ".", 1), F.lit(".py"))
    ).otherwise(F.lit("unknown.py"))


def parent_module(symbol: Column) -> Column:
    """Everything before the last dot, or the symbol itself."""
    return F.regexp_replace(symbol, r"\.[^.]*$", "")


def has_entry_hint(short_name: Column) -> Column:
    return lx.contains_any(F.lower(short_name), lx.ENTRY_POINT_HINTS)


def entity_from_text(text: Column) -> Column:
    """Entity named in a sentence: back-ticks, then quotes, then a capitalised word."""
    patterns = [r"[Ee]ntity\s+`([^`]+)`", r'[Ee]ntity\s+"([^"]+)"', r"[Ee]ntity\s+([A-Z][a-zA-Z]*)"]
    return F.coalesce(
        *[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in patterns]
    )


def crud_from_text(text: Column) -> Column:
    """Create / Read / Update / Delete words in a sentence, in this order."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(
            *[
                F.when(lx.contains_any(lowered, words), F.lit(label))
                for label, words in lx.DISPLAY_CRUD_WORDS.items()
            ]
        )
    )


def humanise_label(text: Column) -> Column:
    """Readable label: split camel case, drop a framework suffix, verb first."""
    spaced = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.split(F.replace(spaced, F.lit("_"), F.lit(" ")), r"\s+")

    suffixed = (F.size(words) > 1) & F.element_at(words, -1).isin(lx.FRAMEWORK_SUFFIXES)
    words = F.when(suffixed, F.slice(words, 1, F.size(words) - 1)).otherwise(words)

    verb = F.get(F.filter(words, lambda w: w.isin(lx.LABEL_VERBS)), F.lit(0))
    at = F.array_position(words, verb).cast("int")
    verb_first = F.concat(
        F.array(verb),
        F.slice(words, F.lit(1), F.greatest(at - 1, F.lit(0))),
        F.slice(words, at + 1, F.size(words)),
    )
    reordered = F.when(at > 1, verb_first).otherwise(words)
    already_readable = F.contains(text, F.lit(" ")) & ~text.rlike("[a-z][A-Z]")
    return F.when(already_readable, text).otherwise(F.array_join(reordered, " "))


def display_class(symbol: Column) -> Column:
    """The parent segment of a symbol, or the symbol when it has no dot."""
    parts = F.split(symbol, r"\.")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), symbol)


def modules_of_files(files: Column) -> Column:
    """First path segment per file, distinct; the whole name if the segment is empty."""
    head = lambda f: F.coalesce(F.nullif(F.substring_index(f, "/", 1), F.lit("")), f)
    return F.array_distinct(F.transform(files, head))


def platform_label(explicit: Column, url: Column) -> Column:
    """Known label wins; otherwise decide by host text (substring, as specified)."""
    name = F.lower(strip(F.coalesce(explicit, F.lit(""))))
    link = F.lower(url)
    return (
        F.when(name.isin(lx.PLATFORMS), name)
        .when(name == "twitter", F.lit("x"))
        .when(F.contains(link, F.lit("reddit.com/")), F.lit("reddit"))
        .when(F.contains(link, F.lit("x.com/")) | F.contains(link, F.lit("twitter.com/")), F.lit("x"))
        .otherwise(F.lit("other"))
    )
