"""Column functions over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise_query(text: Column) -> Column:
    """Lower-case and squeeze every run of blanks, Unicode ones too, to one space."""
    return F.trim(F.regexp_replace(F.lower(text), "(?U)[\\s\\x1c-\\x1f]+", " "))


def split_lines(text: Column) -> Column:
    """Lines of ``text``; a closing newline adds no empty line, '' has no lines."""
    return let(
        F.split(text, "\\r\\n|\\n|\\r"),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
        ).otherwise(parts),
    )


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end`` (1-based, inclusive) joined by newlines."""
    return F.array_join(F.slice(lines, start, end - start + 1), "\n")


def count_tokens(text: Column) -> Column:
    """Default token count: runs of non-blank characters."""
    return F.regexp_count(text, F.lit("\\S+")).cast("long")


def cache_key(text: Column, model: Column) -> Column:
    """Key of the embedding cache."""
    return F.md5(F.concat(text, F.lit("-"), model))


def chunk_id(path, type, name, start_line, text) -> Column:
    """Content-derived id: the same chunk gets the same id in every run."""
    return F.sha2(F.concat_ws("|", path, type, name, start_line, text), 256)


def is_text(content: Column, sniff_bytes: int) -> Column:
    """No NUL byte among the first ``sniff_bytes`` bytes of binary ``content``."""
    return ~F.contains(F.substring(content, 1, sniff_bytes), F.lit(b"\x00"))


def decode_utf8(content: Column) -> Column:
    """UTF-8 text of binary ``content``, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))
