"""Finding sentences and phrases of natural language in prose, comments, docstrings, literals and code."""

from __future__ import annotations

import ast
import re
import warnings

from loomgraph.llm import pylex

WORDS, HAN = 4, 8
_CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3005-\u3007"
_CJK_CHAR = re.compile(f"[{_CJK}]")
#: A word of an alphabet; Korean syllables count as letters, and its words are set apart by blanks.
_WORD = re.compile(rf"(?:(?![{_CJK}])[^\W\d_])+(?:['’ʼ`´-](?:(?![{_CJK}])[^\W\d_])+)*\.?")
#: The same for text without Chinese and Japanese, which needs no look ahead at each letter.
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ`´-][^\W\d_]+)*\.?")
_CODE_SPAN = re.compile(r"``.*?``|`[^`\n]*`")
#: What is no word although it has letters: addresses, paths, dotted or underscored or mixed-case names, calls, tags, numbers with letters.
_IDENTIFIER = re.compile(
    r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://|www\.)\S+|\S+@\S+\.\S+"
    r"|(?<!\w)[~.]{0,2}(?:[\w.-]*/)+[\w.:-]+|(?<!\w)@[\w.]+"
    r"|\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b|\b_+\w+|\b[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)+\b"
    r"|\b[A-Za-z]+[a-z][A-Z]\w*\b|\b[A-Za-z_]\w*\([^()\s]*\)|\b(?=[A-Za-z-]*\d)[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+\b|\b(?=[A-Za-z]*\d)[A-Za-z0-9]{2,}\b|%[sdrfi]\b|<[^<>\s]*>|\{[^{}\n]*\}|--?[a-z][\w-]*(?==|\b)(?<=\s)"
)
#: Without one of these no part of a text is such a thing.
_MAYBE_IDENTIFIER = re.compile(r"[/@_:(%<{\d]|\w\.\w|[a-z][A-Z]|www")
_CAPITALS = re.compile(r"[A-Z]{3}|BY")
_MARK = re.compile(r"^\s*(?:(?:[>#*•·+|=~-]+|\d{1,3}[.)])\s+)*(?:(?:Q|A|Step \d+)\s*:\s+|\[\w+\]\s+)?")
_TAG = re.compile(r"^\s*(?::(?:param|return|returns|raises|type|rtype|arg|yield)\b[^:\n]*:|@(?:param|return|returns|throws)\b(?:\s+\w+)?|\*?\w{1,40}(?:\s*\([^)]*\))?:(?=\s|$)|\*\*[^*\n]{1,40}:?\*\*:?)\s*")
_QUERY = re.compile(r"\b(?:SELECT\b.+\bFROM\b|INSERT\s+INTO\b|UPDATE\b.+\bSET\b|DELETE\s+FROM\b|CREATE\s+(?:TABLE|INDEX|VIEW)\b|MATCH\s*\(|MERGE\s*\(|UNWIND\b|ALTER\s+TABLE\b|DROP\s+TABLE\b|GROUP\s+BY\b|ORDER\s+BY\b)", re.S)
_FRAME = re.compile(r"^\s*-{4,}[A-Z0-9 ]+-{4,}\s*$")  # marks of an encoded block
_CODEISH = re.compile(r"[=(){}\[\]:;<>|%]|^\s*(?:return|pass|del|assert|import|from|raise|global|nonlocal|yield|break|continue|else|try|finally)\b")
_HARD_CODE = re.compile(r"[\w\])'\"]\s*(?:[+*/%|&^-]|//|\*\*|>>|<<)?=(?!=)\s*\S|\)\s*:\s*$|\)\s*->|^\s*(?:def|class|async def|import|from \S+ import|except|elif|else:|try:|with .* as |while .*:|for .* in .*:|if .*:|case .*:|match .*:|@\w)|\w\([^)]*\)\s*$|^\s*[\])}]|[\[({]\s*$|^\s*[\"'][^\"']*[\"']\s*[:,]|;\s*$")
#: Where sentences part. Group 1 still belongs to the one before.
_STOP = re.compile(rf"([.!?…])[\"'»”’)\]]*\s+|([。！？])|([!?])(?=[{_CJK}])|\s\s+(?=[-–—]\s)")


def units(text: str) -> tuple[int, int]:
    """Words of alphabets, and characters of Chinese and Japanese, in ``text``."""
    n = 0 if text.isascii() else len(_CJK_CHAR.findall(text))
    words = (_WORD if n else _PLAIN_WORD).findall(text)
    return len(words) - len([w for w in words if not w[1:] and w.lower() not in _SINGLE]), n


# The letters that are words.
_SINGLE = set("aeiouyàéèôóòíìоуіаивікяzw")


def is_phrase(text: str) -> bool:
    """At least four words, or eight characters of Chinese or Japanese; mixed text counts two characters as a word."""
    return _phrase(text) is not None


def _phrase(text: str) -> tuple[int, int] | None:
    """The ``units`` of a phrase; None of what is none."""
    if text.isascii() and len(text.split()) < WORDS:
        return None
    words, han = units(text)
    if han < 4 and len(text.split()) < WORDS:
        return None
    return (words, han) if words >= WORDS or han >= HAN or (han >= 4 and words + han // 2 >= WORDS) else None


def plain(text: str) -> str:
    """``text`` without code spans, addresses, paths and identifiers."""
    if "`" in text:
        text = _CODE_SPAN.sub(" ", text)
    return _IDENTIFIER.sub(" ", text) if _MAYBE_IDENTIFIER.search(text) else text


def parses(line: str) -> bool:
    """Whether a line is Python by itself, as a block's head, or as the inside of brackets."""
    line = line.strip()
    if line.endswith(":") and not line.startswith("#"):
        line = _BEFORE.get(_FIRST.match(line)[0], "") + line + _AFTER.get(_FIRST.match(line)[0], "\n pass")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(line)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False


_FIRST = re.compile(r"\w*")
#: What a head that cannot stand alone stands behind, and what follows it.
_BEFORE = {"elif": "if x:\n pass\n", "else": "if x:\n pass\n", "except": "try:\n pass\n", "finally": "try:\n pass\n", "case": "match x:\n "}
_AFTER = {"case": "\n  pass", "try": "\n pass\nfinally:\n pass"}


def is_code(line: str) -> bool:
    """Whether a line of text or of a comment is code rather than language."""
    if not line.strip():
        return False
    if _CAPITALS.search(line) and _QUERY.search(line):
        return True
    if line.isupper():
        line = line.lower()
    if not _CODEISH.search(line):
        return False
    bare = _CODE_SPAN.sub("x", line) if "`" in line else line
    if _HARD_CODE.search(bare) and (counted := units(plain(bare)))[1] < HAN:
        words = counted[0]
        symbols = len(re.findall(r"[=(){}\[\]<>|%:;\"'+*/]", bare))
        if words < 6 or symbols * 2 >= words:
            return True
    return ("=" in bare or "(" in bare or "[" in bare or bare.rstrip().endswith(":") or bare.split()[0] in _KEYWORDS) and parses(bare)


# The statement keywords of Python.
_KEYWORDS = {"return", "pass", "del", "assert", "import", "from", "raise", "global", "nonlocal", "yield", "break", "continue", "else", "try", "finally", "if", "for", "while", "with", "match", "case"}


def code_flags(lines: list[str]) -> list[bool]:
    """Which lines are code; brackets that code leaves open make the lines up to their end code too."""
    out, depth = [], 0
    for line in lines:
        code = depth > 0 or is_code(line)
        if code:
            depth += len(_OPEN.findall(line)) - len(_CLOSE.findall(line))
            if depth > 0 and units(plain(line))[0] >= 8:
                depth, code = 0, False  # prose after all
        else:
            depth = 0
        out.append(code)
    return out


_OPEN, _CLOSE = re.compile(r"[(\[{]"), re.compile(r"[)\]}]")


def without_code(lines: list[str]) -> list[str]:
    """The lines that are not code."""
    return [line for line, code in zip(lines, code_flags(lines)) if not code]


def _parts(line: str) -> list[str]:
    out, at = [], 0
    for m in _STOP.finditer(line):
        out.append(line[at : m.end(m.lastindex) if m.lastindex else m.start()])
        at = m.end()
    out.append(line[at:])
    return out


_SYMBOLS = re.compile(r"[=(){}\[\]<>|%\\^$_+*/~#&]")
_LINES = re.compile(r"[\r\n\u2028\x0b\x0c]+")


def _split(text: str) -> list[str]:
    return [x for x in _LINES.split(text) if x.strip() and not _FRAME.match(x)]


def _in_line(line: str) -> list[str]:
    """The sentences and phrases of a line that is not code."""
    out = []
    line = line[_MARK.match(line).end() :]
    tag = _TAG.match(line)
    line = line[tag.end() :] if tag else line
    for s in _parts(line):
        if s.isascii() and len(s.split()) < WORDS:
            continue
        p = plain(s)
        if counted := _phrase(p):
            words, han = counted
            if len(_SYMBOLS.findall(p)) * 2 <= words + han // 2:
                out.append(" ".join(p.split()))
    return out


def sentences(text: str, code: bool = True) -> list[str]:
    """The sentences and phrases of ``text``, without marks, tags and code.

    ``code``: whether lines of code may occur among them, as in comments and documents.
    """
    lines = _split(text)
    kept = without_code(lines) if code else [x for x in lines if not (_CAPITALS.search(x) and _QUERY.search(x))]
    return [s for line in kept for s in _in_line(line)]


def document_sentences(text: str) -> list[str]:
    """As ``sentences`` of a document, in which lines of code hold language too: in their comments and literals, which the lexer tells from the code."""
    out, lines = [], _split(text)
    for line, code in zip(lines, code_flags(lines)):
        if not code:
            out += _in_line(line)
        elif "#" in line or '"' in line or "'" in line:
            for kind, a, b in pylex.lex(line):
                out += sentences(line[a + 1 : b]) if kind == "c" else sentences(pylex.value(line[a:b]), False)
    return out


_JOIN = re.compile(r"[\s\\]*\+?[\s\\]*")


#: Characters of the blocks in which source is lexed.
BLOCK = 1 << 16
_ENDS_LINE = re.compile(r"[ \t;]*(?:[\r\n#]|\Z)")


def spans(code: str, size: int = BLOCK) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of the comments, docstrings and other literals of Python source.

    Source is lexed in blocks of ``size`` characters, which the result does not depend on. kind is ``comment``, ``docstring`` or ``literal``. Literals that a program joins (side by side or by
    a plus) are one span; comments on lines of their own that follow each other are one span.
    """
    out: list[tuple[str, int, int, str]] = []
    pieces = pylex.pieces(code, size)
    i = 0
    while i < len(pieces):
        kind, a, b = pieces[i]
        start = max(code.rfind("\n", 0, a), code.rfind("\r", 0, a)) + 1
        alone = not code[start:a].strip()
        if kind == "c":
            text = [code[a:b].lstrip("#!:").strip() if not code.startswith("#!", a) else ""]
            while alone and i + 1 < len(pieces) and pieces[i + 1][0] == "c" and not code[b : pieces[i + 1][1]].strip() and len(re.findall(r"\r\n|\r|\n", code[b : pieces[i + 1][1]])) == 1:
                i += 1
                b = pieces[i][2]
                text.append(code[pieces[i][1] : b].lstrip("#").strip())
            out.append(("comment", a, b, "\n".join(text)))
        else:
            text = [pylex.value(code[a:b])]
            while i + 1 < len(pieces) and pieces[i + 1][0] == "s" and _JOIN.fullmatch(code, b, pieces[i + 1][1]):
                i += 1
                b = pieces[i][2]
                text.append(pylex.value(code[pieces[i][1] : b]))
            doc = alone and _ENDS_LINE.match(code, b) is not None
            out.append(("docstring" if doc else "literal", a, b, "".join(text)))
        i += 1
    return out


def code_sentences(code: str, size: int = BLOCK) -> list[tuple[str, int, int, list[str]]]:
    """Of each span of source that holds a sentence: kind, start, end, sentences."""
    out = []
    for kind, a, b, text in spans(code, size):
        if (found := sentences(text, kind != "literal" or "\n" in text)):
            out.append((kind, a, b, found))
    return out
