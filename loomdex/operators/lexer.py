"""What of a source in a brace language is code: comments, strings, templates and regular expressions are blanked.

A pushdown automaton that jumps from one mark to the next: a template's ``${``
opens code again, up to the brace that closes it, to any depth. Blanked text
keeps its length and its line ends, so places and line numbers stay.
"""

from __future__ import annotations

import re

STRING = {q: re.compile(rf"(?:\\(?:.|\Z)|[^{q}\\\n])*(?:{q}|(?=\n)|\Z)", re.S) for q in "\"'"}
TEXT_BLOCK = re.compile(r'(?:\\(?:.|\Z)|[^\\])*?(?:"""|\Z)', re.S)
RAW = re.compile(r"[^`]*(?:`|\Z)")
TEMPLATE = re.compile(r"(?:\\(?:.|\Z)|\$(?!\{)|[^`$\\])*(?:`|\$\{|\Z)", re.S)
COMMENT = {"//": re.compile(r"[^\n]*"), "/*": re.compile(r".*?(?:\*/|\Z)", re.S)}
REGEX = re.compile(r"(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
SCRIPTS = ("javascript", "typescript")
MARKS = {
    "java": re.compile(r'//|/\*|"""|"|\'|[{}]'),
    "go": re.compile(r"//|/\*|\"|'|`|[{}]"),
    **{name: re.compile(r"//|/\*|\"|'|`|/|[{}]") for name in SCRIPTS},
}
#: After these a value is due, so a slash begins a regular expression; elsewhere it divides.
VALUE_DUE = re.compile(r"(?:[=(,:;!&|?\[{}+\-*%~^<>]|(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|await|yield))\Z|\A\Z")
NOT_LINE_END = re.compile(r"[^\n]")


def code_only(source: str, language: str) -> str:
    """``source`` with everything but code as blanks; line ends are LF only.

    A string ends with its line; comments and templates without an end go on to
    the end of the source. Languages that are not known are read as Java.
    """
    text = source.replace("\r\n", "\n").replace("\r", "\n")
    marks = MARKS.get(language, MARKS["java"])
    script = language in SCRIPTS
    out, at, depth, opened, last = [], 0, 0, [], ""

    def drop(end: int) -> None:
        nonlocal at
        out.append(NOT_LINE_END.sub(" ", text[at:end]))
        at = end

    def template(begin: int) -> None:
        """Drop template text from ``at`` on, whose characters are read from ``begin``."""
        found = TEMPLATE.match(text, begin)
        if found.group().endswith("${"):
            opened.append(depth)
        drop(found.end())

    while at < len(text):
        mark = marks.search(text, at)
        stop = mark.start() if mark else len(text)
        if stop > at:
            out.append(text[at:stop])
            last = text[at:stop].rstrip()[-12:] or last
            at = stop
        if mark is None:
            break
        token, after = mark.group(), mark.end()
        if token in COMMENT:
            drop(COMMENT[token].match(text, after).end())
        elif token == '"""':
            drop(TEXT_BLOCK.match(text, after).end())
            last = '"'
        elif token in STRING:
            drop(STRING[token].match(text, after).end())
            last = '"'
        elif token == "`":
            if script:
                template(after)
                last = "(" if opened and text[at - 2 : at] == "${" else '"'
            else:
                drop(RAW.match(text, after).end())
                last = '"'
        elif token == "/":
            found = REGEX.match(text, after) if VALUE_DUE.search(last) else None
            if found:
                drop(found.end())
                last = '"'
            else:
                out.append("/")
                at, last = after, "/"
        elif token == "}" and opened and opened[-1] == depth:
            opened.pop()
            template(after)
            last = "(" if opened and text[at - 2 : at] == "${" else '"'
        else:
            depth += 1 if token == "{" else -1
            out.append(token)
            at, last = after, token
    return "".join(out)
