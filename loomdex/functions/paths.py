"""Column functions over paths, and ignore rules as one Column expression."""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """'.py' of 'a/b.py'; '' for 'a/.env' and names without a dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_path(path: Column, root: str) -> Column:
    """POSIX path below ``root``; paths outside it stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def has_suffix(path: Column, suffixes) -> Column:
    """Any of ``suffixes`` ends the path; None means every path; a string is one suffix."""
    if suffixes is None:
        return F.lit(True)
    wanted = [suffixes] if isinstance(suffixes, str) else sorted(set(suffixes))
    return reduce(lambda a, b: a | b, (path.endswith(s) for s in wanted), F.lit(False))


def _segment_regex(segment: str) -> str:
    """One path segment of a rule; stars and question marks stop at '/'."""
    out, i = "", 0
    while i < len(segment):
        char = segment[i]
        close = segment.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out += "[^/]*"
        elif char == "?":
            out += "[^/]"
        elif close > 0:
            body = segment[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]"
            i = close
        elif char == "\\" and i + 1 < len(segment):
            i += 1
            out += re.escape(segment[i])
        else:
            out += re.escape(char)
        i += 1
    return out


def rule_regex(rule: str) -> tuple[str, bool]:
    """Regex over relative paths and the 'negated' flag of one ignore rule."""
    negated = rule.startswith("!")
    body = rule[1:] if negated else rule
    inside_only = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    segments = body.lstrip("/").split("/")
    regex = "^" if anchored else "^(?:.*/)?"
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            regex += ".+" if last else "(?:.*/)?"
        else:
            regex += _segment_regex(segment) + ("" if last else "/")
    return regex + ("/.*$" if inside_only else "(?:/.*)?$"), negated


def parse_rules(text: str) -> list[str]:
    """Rules of an ignore file: trimmed lines without blanks and comments."""
    return [line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")]


def is_ignored(path: Column, rules) -> Column:
    """True where the last rule that matches is not a negated one.

    Neighbouring rules of one polarity become one alternation, and the runs are
    tried from the last to the first, so no join with a rule table is needed.
    """
    runs = [
        (negated, "|".join(f"(?:{regex})" for regex, _ in group))
        for negated, group in groupby(map(rule_regex, rules), key=lambda r: r[1])
    ]
    verdict = F.lit(False)
    for negated, regex in runs:
        verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict
