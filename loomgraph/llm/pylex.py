"""A tolerant lexer for Python source: comments, string literals and the code between them.

It never fails: an unterminated literal ends at the line's or text's end. The same states serve
``pieces``, which lexes a file in blocks: for each block it gives the state after the block for
each state before it, so that the blocks of one file are lexed apart and composed by prefix.
"""

from __future__ import annotations

import re

import numpy as np

_TRIPLE = r'{q}{q}{q}[^{q}\\]*(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*)*(?:{q}{q}{q}|\\?\Z)'
_SINGLE = r'{q}[^{q}\\\r\n]*(?:\\(?:\r\n|.)[^{q}\\\r\n]*)*(?:{q}|(?=[\r\n])|\\?\Z)'
_PREFIX = r"(?:(?<![A-Za-z0-9_])[rRbBuUfFtT]{1,2}(?=[\"']))?"
STRING = _PREFIX + "(?:" + "|".join(x.format(q=q) for x in (_TRIPLE, _SINGLE) for q in "\"'") + ")"
#: Group 1: comment; group 2: literal.
PIECES = re.compile(r"(#[^\r\n]*)|(" + STRING + ")", re.S)
_HEAD = re.compile(r"([A-Za-z]{0,2})('''|\"\"\"|'|\")", re.S)
_ESCAPE = re.compile(r"\\(\r\n|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|.)", re.S)
# What a one-letter escape stands for.
_SHORT = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"', "\n": "", "\r\n": "", "\r": ""}


def _unescape(m: re.Match) -> str:
    x = m[1]
    if x in _SHORT:
        return _SHORT[x]
    if x[0] in "01234567":
        return chr(int(x, 8))
    if x[0] in "xuU" and len(x) > 1:
        code = int(x[1:], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return " " if x[0] == "N" and len(x) > 1 else "\\" + x


def split_literal(literal: str) -> tuple[str, str, str]:
    """Prefix in lower case, quotes and body of a literal as the lexer cuts it."""
    m = _HEAD.match(literal)
    if m is None:
        return "", "", literal
    body = literal[m.end() :]
    if body.endswith(m[2]):
        body = body[: -len(m[2])]
    return m[1].lower(), m[2], body


def value(literal: str) -> str:
    """The text a program would read from a literal; of an f-string, fields in braces become a blank."""
    prefix, _, body = split_literal(literal)
    if "f" in prefix or "t" in prefix:
        body = re.sub(r"\{[^{}]*\}", " ", body.replace("{{", "\x01").replace("}}", "\x02")).replace("\x01", "{").replace("\x02", "}")
    return body if "r" in prefix or "\\" not in body else _ESCAPE.sub(_unescape, body)


def lex(text: str):
    """(kind, start, end) of each comment (``c``) and literal (``s``) of ``text``, in order."""
    for m in PIECES.finditer(text):
        yield ("c" if m[1] is not None else "s"), m.start(), m.end()


#: States in which a line can start: code, inside either triple quote, inside a quote continued by a backslash.
STATES = ("code", '"""', "'''", '"', "'")
_FROM = [PIECES] + [re.compile("".join((x.format(q=s[0])).removeprefix(s[0] * len(s))), re.S) for s, x in zip(STATES[1:], (_TRIPLE, _TRIPLE, _SINGLE, _SINGLE))]


def _after(literal: str, quotes: str, open_at: int) -> int:
    """The state after a literal that ends with its block, or 0 if it was closed."""
    body = literal[open_at:]
    if len(quotes) == 3:
        return 0 if re.fullmatch(_FROM[STATES.index(quotes)].pattern.replace(r"|\\?\Z)", ")"), body, re.S) else STATES.index(quotes)
    return STATES.index(quotes) if re.search(r"\\(\r\n|\r|\n)\Z", body) and not re.fullmatch(_FROM[STATES.index(quotes)].pattern.replace(r"|(?=[\r\n])|\\?\Z)", ")"), body, re.S) else 0


def run_block(block: str, state: int) -> tuple[list[tuple[str, int, int]], int]:
    """The pieces of a block that starts at a line's start in ``state``, and the state after it.

    A piece that began in an earlier block has kind ``t`` (tail). Blocks end at line ends.
    """
    out: list[tuple[str, int, int]] = []
    at = 0
    if state:
        m = _FROM[state].match(block)
        end = m.end() if m else 0
        out.append(("t", 0, end))
        after = _after(block[:end], STATES[state], 0) if end == len(block) else 0
        if after:
            return out, after
        at = end
    last = None
    for m in PIECES.finditer(block, at):
        last = m
        out.append(("c" if m[1] is not None else "s", m.start(), m.end()))
    if last is None or last[2] is None or last.end() < len(block):
        return out, 0
    head = _HEAD.match(last[2])
    return out, _after(last[2], head[2], head.end()) if head else 0


def block_map(block: str) -> list[int]:
    """The state-transition function of a block: the state after it for each state before it."""
    return [run_block(block, s)[1] for s in range(len(STATES))]


def compose(maps: list[list[int]]) -> list[int]:
    """The states before each of the blocks with these maps, and after the last, by parallel prefix.

    In round k each map is composed with the one 2^k before it, which by then stands for the 2^k blocks up to that one.
    """
    n = len(maps)
    prefix = np.array(maps, np.int64).reshape(n, len(STATES))
    step = 1
    while step < n:
        prefix[step:] = np.take_along_axis(prefix[step:], prefix[:-step], 1)
        step *= 2
    return [0, *prefix[:, 0].tolist()]


def pieces(text: str, size: int) -> list[tuple[str, int, int]]:
    """What ``lex`` gives, from blocks of about ``size`` characters that are lexed apart.

    Each block but the last gives its state-transition function; composed, they give the state in which each block begins.
    A piece that goes on over blocks is put together again, so the result does not depend on ``size``.
    """
    parts = blocks(text, size)
    out: list[tuple[str, int, int]] = []
    offset = 0
    for block, state in zip(parts, compose([block_map(x) for x in parts[:-1]])):
        for kind, start, end in run_block(block, state)[0]:
            if kind == "t":
                out[-1] = (*out[-1][:2], offset + end)
            else:
                out.append((kind, offset + start, offset + end))
        offset += len(block)
    return out


def blocks(text: str, size: int) -> list[str]:
    """``text`` in blocks of at least ``size`` characters that end at line ends (the last one may be shorter)."""
    out, at = [], 0
    while at < len(text):
        cut = text.find("\n", at + size - 1)
        cut = len(text) if cut < 0 else cut + 1
        out.append(text[at:cut])
        at = cut
    return out
