"""Outline of Python source without recursion, for files too deep for the parser.

One pass over tokens keeps a stack of open brackets and open f-strings and joins physical lines
to logical ones; a second stack of indentation turns logical lines into nested blocks. Depth costs
stack entries, not calls. Only blocks, their headers and their last lines are found; what
expressions mean is not looked at.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"(?P<space>[ \t\f\r]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<line>\n)"
    r"|(?P<string>(?P<prefix>(?i:[bru]|br|rb|[ft]r?|r[ft])?)(?P<quote>'''|\"\"\"|'|\"))|(?P<open>[\[({])|(?P<close>[\])}])|(?P<word>\w+)|(?P<other>.)")
_HEADER = re.compile(r"(?:(async)\s+)?(def|class)\s+(\w+)")
_PAIRS = {")": "(", "]": "[", "}": "{"}
_TAB = 8


class Block(NamedTuple):
    """A definition or other compound statement: ``kind`` is def, async def, class or other."""

    kind: str
    name: str  # of other ones only "except"
    start: int  # line of the header, from 0
    parent: int  # number of the enclosing block, -1 at the top


class Broken(ValueError):
    """Brackets, strings or indentation that fit no Python file."""


def _text_end(source: str, at: int, quote: str, raw_field: bool) -> tuple[int, bool]:
    """Where string text from ``at`` on ends: (position, does it end the string or open a replacement field)."""
    while at < len(source):
        if source.startswith(quote, at):
            return at + len(quote), True
        char = source[at]
        if char == "\\":
            at += 2
        elif char == "\n" and len(quote) == 1:
            break
        elif raw_field and char == "{":
            if not source.startswith("{{", at):
                return at + 1, False
            at += 2
        else:
            at += 1
    raise Broken("string")


def _logical_lines(source: str):
    """(indentation, first line, last line, header text, does a block follow) of each logical line."""
    at, row, stack = 0, 0, []  # stack: brackets, and quotes of f-strings whose field is open
    begun = None  # (offset, row) of the logical line
    indent, fresh, last_row, last_char = 0, True, 0, ""
    while at < len(source):
        if fresh:
            indent, fresh = 0, False
            while at < len(source) and source[at] in " \t\f":
                indent = indent + 1 if source[at] == " " else (indent // _TAB + 1) * _TAB if source[at] == "\t" else 0
                at += 1
            continue
        match = _TOKEN.match(source, at)
        at, kind = match.end(), match.lastgroup
        if kind == "line":
            row += 1
            if not stack:
                if begun:
                    yield indent, begun[1], last_row, source[begun[0]:begun[0] + 400], last_char == ":"
                begun, fresh = None, True
            continue
        if kind in ("space", "comment"):
            row += match[0].count("\n")
            continue
        begun = begun or (match.start(), row)
        last_char = match[0][-1]
        if kind == "open":
            stack.append(match[0])
        elif kind == "close":
            if match[0] == "}" and stack and stack[-1][-1] in "'\"":  # the field of an f-string ends
                at, over = _text_end(source, at, stack[-1], True)
                row += source.count("\n", match.end(), at)
                if over:
                    stack.pop()
            elif not stack or stack.pop() != _PAIRS[match[0]]:
                raise Broken("bracket")
        elif match[0] == ":" and stack and stack[-1][-1] in "'\"":  # the format of a field: literal text up to its brace
            depth = 1
            while depth:
                if at >= len(source):
                    raise Broken("format")
                depth += (source[at] == "{") - (source[at] == "}")
                at += depth > 0
        elif match["quote"]:
            field = match["prefix"].lower().strip("r") in ("f", "t")
            at, over = _text_end(source, at, match["quote"], field)
            row += source.count("\n", match.end(), at)
            if not over:
                stack.append(match["quote"])
        last_row = row
    if stack:
        raise Broken("end")
    if begun:
        yield indent, begun[1], last_row, source[begun[0]:begun[0] + 400], last_char == ":"


def outline(source: str) -> tuple[list[Block], list[int]]:
    """Blocks in the order of their headers, and the line behind the last statement of each."""
    blocks, ends = [], []
    open_ = []  # (indentation of the header, number)
    for indent, first, last, text, opens in _logical_lines(source):
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        header = _HEADER.match(text)
        for _, number in open_:
            ends[number] = last + 1
        if header or opens:
            kind = f"{header[1]} {header[2]}" if header and header[1] else header[2] if header else "other"
            name = header[3] if header else "except" if re.match(r"except\b", text) else ""
            blocks.append(Block(kind, name, first, open_[-1][1] if open_ else -1))
            ends.append(last + 1)
            open_.append((indent, len(blocks) - 1))
    return blocks, ends


def definitions(source: str) -> list[str]:
    """Dotted paths of plain ``def``/``class`` inside such only, sorted."""
    blocks, _ = outline(source)
    paths: list[str | None] = []
    for block in blocks:
        above = "" if block.parent < 0 else paths[block.parent]
        known = block.kind in ("def", "class") and above is not None
        paths.append((f"{above}." if above else "") + block.name if known else None)
    return sorted({path for path in paths if path})


def elements(source: str) -> list[tuple[str, str, int, int]]:
    """(code type, name, start, end) of classes, functions outside classes, and methods, each with its first span."""
    blocks, ends = outline(source)
    depth, owners = [], []
    for block in blocks:
        above = block.parent
        # the parser hangs the body of a handler one level lower than that of its try
        depth.append((0 if above < 0 else depth[above] + 1) + (block.name == "except"))
        inside = () if above < 0 else owners[above]
        owners.append(inside + (block.name,) if block.kind == "class" else inside)
    classes, functions, inside, methods = {}, {}, {}, []
    for number in sorted(range(len(blocks)), key=lambda k: depth[k]):  # outer levels first, as far as they reach
        block = blocks[number]
        above = () if block.parent < 0 else owners[block.parent]
        if block.kind == "class":
            classes.setdefault(block.name, number)
        elif block.kind != "other":
            if not above:
                functions.setdefault(block.name, number)
            for owner in above:
                inside.setdefault((owner, block.name), number)
    for number in sorted(range(len(blocks)), key=lambda k: (depth[k], k)):
        block = blocks[number]
        if block.parent >= 0 and blocks[block.parent].kind == "class" and block.kind in ("def", "async def"):
            methods.append((blocks[block.parent].name, block.name))
    found = [("class", name, k) for name, k in classes.items()] + [("function", name, k) for name, k in functions.items()]
    found += [("method", ".".join(key), inside[key]) for key in dict.fromkeys(methods)]
    return [(kind, name, blocks[k].start, ends[k]) for kind, name, k in found]
