"""Script text to tokens, with positions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import VtlSyntaxError

PATTERN = re.compile(
    r"""(?P<space>\s+|/\*.*?\*/|//[^\n]*)
      |(?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+)
      |(?P<string>"[^"]*")
      |(?P<quoted>'[^']*')
      |(?P<name>[A-Za-z][A-Za-z0-9_.]*|_)
      |(?P<op>:=|<-|<>|<=|>=|\|\||[-+*/=<>()\[\]{},;:\#])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, name, quoted, op, end
    text: str
    pos: tuple[int, int]


def tokens(script: str) -> list[Token]:
    out, at, line, start = [], 0, 0, 0
    while at < len(script):
        m = PATTERN.match(script, at)
        pos = (line, at - start)
        if not m:
            raise VtlSyntaxError(f"unexpected character {script[at]!r}", pos)
        text = m.group()
        if m.lastgroup == "quoted":
            out.append(Token("quoted", text[1:-1], pos))
        elif m.lastgroup == "string":
            out.append(Token("string", text[1:-1], pos))
        elif m.lastgroup != "space":
            out.append(Token(m.lastgroup, text, pos))
        breaks = text.count("\n")
        if breaks:
            line, start = line + breaks, at + text.rfind("\n") + 1
        at = m.end()
    out.append(Token("end", "", (line, at - start)))
    return out
