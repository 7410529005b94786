"""Source files that do not parse (problem 6): a parser judges every file, lexers with a pushdown stack name the fault.

The language's parser alone decides whether a file is invalid. The lexers read the rejected files and name the first
fault they see: an unreadable encoding, a null byte, an unterminated literal, an unbalanced delimiter, a merge-conflict
marker, a premature end, a broken block or two operands without an operator. A fault that they do not see is ``syntax``.
"""

from __future__ import annotations

import ast
import codecs
import io
import json
import keyword
import re
import tokenize
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import pylex

MARKER = re.compile(rb"^(?:<{7}(?: |\r?$)|\|{7}(?: |\r?$)|={7}\r?$|>{7}(?: |\r?$))", re.M)

# --- Python ---------------------------------------------------------------------------------------------------------

_STRING = re.compile(r"(#[^\r\n]*)|(" + pylex.STRING + r")|\\(?:\r\n|\r|\n)", re.S)
_NAME = re.compile(r"\b(?!(?:%s)\b)[^\W\d]\w*" % "|".join(sorted(set(keyword.kwlist) - {"True", "False", "None"})))
_DIGITS = r"\d(?:_?\d)*"
_EXPONENT = rf"[eE][+-]?{_DIGITS}"
_NUMBER = re.compile(
    rf"(?<![\w.])(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_DIGITS})?\.{_DIGITS}(?:{_EXPONENT})?[jJ]?|{_DIGITS}\.(?:{_EXPONENT})?[jJ]?"
    rf"|{_DIGITS}{_EXPONENT}[jJ]?|{_DIGITS}[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)(?!\w)"
)
_SIMPLE_NUMBER = re.compile(r"(?<![\w.])(?:0|[1-9]\d*|\d+\.\d+)(?![\w.])")
_TOKEN = re.compile(r"\s*(?:([^\W\d]\w*)|(\d[\w.]*|\.\d[\w.]*)|(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])|(\S))")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_BINARY = {"/", "//", "%", "@", "&", "|", "^", "<<", ">>", "==", "!=", "<", ">", "<=", ">=", "=", "->", ":=", ".", "and", "or", "in", "is", "if", "else", "for", "as", "+=", "-=", "*=", "/=", "//=", "%=", "&=", "|=", "^=", ">>=", "<<=", "**=", "@="}
_HEADS = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async"}
_ALONE = {"return", "pass", "break", "continue", "raise", "yield", "else", "try", "finally", "except"}
_AFTER = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "try", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}
_SHAPES: dict[str, tuple[str, str, bool]] = {}


def _line_shape(shape: str) -> tuple[str, str, bool]:
    """Fault (or none), opening keyword and whether it ends with a colon, of a logical line's shape.

    The machine alternates between needing an operand and needing an operator; brackets and lambdas are pushed.
    """
    need, previous, stack, lambdas = True, "", [], 0
    head, colon, n, top_comma, conditional = "", False, 0, False, [0]
    for m in _TOKEN.finditer(shape):
        name, number, op, other = m.groups()
        t = m.group().strip()
        if not t:
            continue
        colon = False
        if other:
            return "stray character", head, False
        if n == 0:
            head = t
        n += 1
        if number and t != "0":
            return "number", head, False
        if (name and t not in keyword.kwlist) or number or t == "..." or t in ("True", "False", "None"):
            if not need and not (t == "s" == previous):
                return "two operands", head, False
            need = False
        elif op in ("(", "[", "{"):
            if not need and op == "{":
                return "two operands", head, False
            stack.append(op)
            conditional.append(0)
            need = True
        elif op in _CLOSERS:
            if not stack or stack.pop() != _CLOSERS[op]:
                return "unbalanced delimiter", head, False
            if conditional.pop() > 0:
                return "no else", head, False
            if need and previous not in ("(", "[", "{", ",", ":", "*", "/") and not (previous == "yield"):
                return "no operand", head, False
            need = False
        elif op == ",":
            if need and previous not in ("*", "/", ":", "yield"):
                return "no operand", head, False
            if not stack:
                top_comma = True
            need = True
        elif op == ":":
            if need and not (stack and stack[-1] == "[") and previous not in ("else", "try", "finally", "except", "lambda", "*", "/", ",") and not lambdas:
                return "no operand", head, False
            if lambdas:
                lambdas -= 1
            elif not stack:
                colon = True
            need = True
        elif op == ";":
            if stack:
                return "unbalanced delimiter", head, False
            need = True
        elif op in ("+", "-", "~", "*", "**", "*=") or t in ("not", "await"):
            if op == "~" and not need or t == "await" and not need:
                return "two operands", head, False
            need = True
        elif t == "lambda":
            if not need:
                return "two operands", head, False
            lambdas += 1
            need = True
        elif t in _BINARY:
            first = n == 1 or previous == "async" or previous == ";" or (colon is False and previous == ":" and not stack)
            if t == "in" and previous == "not" or t == "@" and n == 1:
                pass
            elif t == "/" and previous in (",", "("):
                pass
            elif t == "." and (previous in ("from", ".", "...") or need and head == "from"):
                need = True
            elif t in ("if", "for") and first or t == "else" and first:
                pass
            elif t == "for" and previous == "async":
                pass
            elif t == "in" and head == "n":
                pass
            elif need:
                return "no operand", head, False
            elif t in ("=", ":=", "+=", "-=") and previous == "0":
                return "assignment", head, False
            elif t == "=" and not stack and previous in (")", "s"):
                return "assignment", head, False
            if t == "if" and not first:
                conditional[-1] += 0 if "for" in shape else 1
            if t == "else" and not first and conditional[-1]:
                conditional[-1] -= 1
            need = True
        elif t == "import":
            need = True
        elif t == "from":
            need = True
        elif t in ("def", "class", "del", "global", "nonlocal", "assert", "return", "raise", "import", "while", "with", "elif", "try", "except", "finally", "pass", "break", "continue", "async", "yield"):
            if not need and t not in ("async",) or stack and t not in ("yield", "async"):
                return "two operands", head, False
            need = True
        previous = t
    if stack:
        return "premature end", head, False
    if conditional[0] > 0:
        return "no else", head, False
    if need and not colon and previous not in _ALONE and previous not in (",", ";", "*", "...") and not (previous == "." and head == "from"):
        return "no operand", head, False
    if head in ("raise", "except") and top_comma:
        return "comma", head, False
    if head in _HEADS and not colon and not re.search(r":\s*\S", shape):
        return "no colon", head, False
    if head in ("*", "+=") or (previous == "*" and head != "from"):
        return "no operand", head, False
    return "", head, colon


def _shape(line: str) -> tuple[str, str, bool]:
    got = _SHAPES.get(line)
    if got is None:
        if len(_SHAPES) > 200_000:
            _SHAPES.clear()
        got = _SHAPES[line] = _line_shape(line)
    return got


def _decode_python(content: bytes) -> str | None:
    if b"\x00" in content:
        return None
    try:
        if content.startswith(codecs.BOM_UTF8):
            content = content[3:]
        head = content[:400].split(b"\n")[:2]
        if any(b"coding" in x for x in head):
            encoding, _ = tokenize.detect_encoding(io.BytesIO(content).readline)
            return content.decode(encoding)
        return content.decode("utf-8")
    except (SyntaxError, UnicodeDecodeError, LookupError):
        return None


def _blank(m: re.Match) -> str:
    if m[1] is not None:
        return ""
    text = m[0]
    if m[2] is None:
        return " "
    head = pylex._HEAD.match(text)
    q = head[2]
    if len(text) < head.end() + len(q) or not text.endswith(q) or (len(q) == 1 and text[-2:-1] == "\\" and (len(text) - len(text[:-1].rstrip("\\")) - 1) % 2 == 1):
        return "\x01"
    if "\\N" in text or "\\x" in text or "\\u" in text or "\\U" in text or (head[1] and head[1].lower() in ("f", "fr", "rf") and ("{" in text or "}" in text)) or (head[1].lower() in ("b", "br", "rb") and not text.isascii()) or (head[1] and head[1].lower() not in _PREFIXES):
        return _odd(text, head[1].lower()) or _literal(m)
    return _literal(m)


def _literal(m: re.Match) -> str:
    """The letter s for a literal, apart from a word before it."""
    at = m.start()
    return " s " if at and (m.string[at - 1].isalnum() or m.string[at - 1] == "_") else "s "


_PREFIXES = {"r", "u", "b", "f", "br", "rb", "fr", "rf"}
_BAD_ESCAPE = re.compile(r"(?:^|[^\\])(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[A-Za-z0-9 -]+\}))")


def _odd(text: str, prefix: str) -> str:
    """The shape of a literal with escapes or fields; a byte no shape allows where it looks broken."""
    if prefix and prefix not in _PREFIXES or "b" in prefix and not text.isascii():
        return "\x02"
    if "r" not in prefix and _BAD_ESCAPE.search(text):
        return "\x02"
    if "f" in prefix:
        rest = re.sub(r"\{\{|\}\}", "", text)
        fields = re.findall(r"\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", rest)
        if re.search(r"[{}]", re.sub(r"\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "", rest)):
            return "\x02"
        for field in fields:
            expr = re.sub(r"(?:![rsa])?(?::[^\[\](){}]*(?:\{[^{}]*\}[^{}]*)*)?\s*$", "", field).rstrip("= ")
            if _shape(_names("(" + _STRING.sub(_blank, expr) + ")"))[0] or not expr.strip():
                return "\x02"
    return ""


def _names(text: str) -> str:
    text = _NAME.sub(lambda m: m[0] if m[0] == "s" else "n", text) if "s " in text else _NAME.sub("n", text)
    text = _SIMPLE_NUMBER.sub("0", text)
    return _NUMBER.sub("0", text) if re.search(r"\d\w|\.\d|\d\.", text) else text


_SOFT = re.compile(r"^(?:match|case|type)\b(?!\s*(?:[=.,)\]:+*/%&|^<>]|$|\[.*\]\s*=|\(.*\)\s*(?:$|[=.])))")


def python_fault(content: bytes) -> str:
    """The first fault that the lexer suspects in Python source, or an empty string."""
    text = _decode_python(content)
    if text is None:
        return "encoding"
    text = _STRING.sub(_blank, text)
    if "\x01" in text:
        return "unterminated literal"
    if "\x02" in text:
        return "literal"
    shapes = _names(text)
    if MARKER.search(content):
        return "merge conflict"
    raw = re.split(r"\r\n|\r|\n", text)
    lines = re.split(r"\r\n|\r|\n", shapes)
    levels, heads = [0], [""]
    opened, block_of = False, ""
    depth, joined, first_at = 0, [], 0
    for i, line in enumerate(lines):
        body = line.strip()
        if not body and not joined:
            continue
        if not joined:
            first_at = i
        joined.append(body)
        depth += body.count("(") + body.count("[") + body.count("{") - body.count(")") - body.count("]") - body.count("}")
        if depth > 0:
            continue
        depth = 0
        whole = " ".join(joined)
        joined = []
        start = raw[first_at]
        soft = _SOFT.match(start.lstrip())
        if soft:
            whole = ("while " if soft[0][0] in "mc" else "del ") + re.sub(r"^n\s*", "", whole)
            if soft[0] == "case":
                whole = re.sub(r"\bas n\b", "", whole)
            if soft[0] == "type":
                whole = whole.replace("del n =", "n =").replace("del n[", "n[")
        fault, head, colon = _shape(whole)
        if fault:
            return fault
        lead = lines[first_at][: len(lines[first_at]) - len(lines[first_at].lstrip(" \t\f"))]
        if "\t" in lead and " \t" in lead:
            return "indentation"
        width = len(lead.rpartition("\f")[2].expandtabs(8))
        if opened:
            if width <= levels[-1]:
                return "no block"
            levels.append(width)
            heads.append("")
        elif width > levels[-1]:
            return "indentation"
        else:
            while width < levels[-1]:
                levels.pop()
                heads.pop()
            if width != levels[-1]:
                return "indentation"
        head = soft[0] if soft else ("for" if head == "async" and " for " in whole[:11] else head)
        if len(heads) > 1 and heads[-2] == "match" and head != "case":
            return "no case"
        if heads[-1] == "@" and head not in ("@", "def", "class", "async", "for"):
            return "no definition"
        if heads[-1] == "try" and head not in ("except", "finally"):
            return "no handler"
        if head in _AFTER and heads[-1] not in _AFTER[head]:
            return "no block"
        heads[-1] = head
        opened = colon and (head in _HEADS or bool(soft))
        if colon and not opened and head not in ("n",):
            return "no operand"
        if colon and head == "n":
            return "no operand"
    if joined or depth:
        return "premature end"
    if opened:
        return "premature end"
    if "try" in heads:
        return "no handler"
    if "@" in heads:
        return "no definition"
    return ""


# --- JSON and TOML --------------------------------------------------------------------------------------------------

_JSON = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b|NaN\b|-?Infinity\b)|([\[\]{},:]))')


def json_fault(content: bytes) -> str:
    """The first fault of a JSON text, by a pushdown automaton over its tokens."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return "encoding"
    stack, state, at = [], "value", 0
    while True:
        m = _JSON.match(text, at)
        if m is None:
            break
        at = m.end()
        string, scalar, op = m.groups()
        if state == "end":
            return "trailing text"
        if string or scalar:
            if state in ("key", "key or }"):
                if not string:
                    return "key"
                state = ":"
            elif state in ("value", "value or ]"):
                state = ", or close" if stack else "end"
            else:
                return "two values"
        elif op in "[{":
            if state not in ("value", "value or ]"):
                return "two values"
            stack.append(op)
            state = "value or ]" if op == "[" else "key or }"
        elif op in "]}":
            if not stack or stack.pop() != ("[" if op == "]" else "{") or state not in (", or close", "value or ]" if op == "]" else "key or }"):
                return "unbalanced delimiter"
            state = ", or close" if stack else "end"
        elif op == ":":
            if state != ":":
                return "colon"
            state = "value"
        else:
            if state != ", or close":
                return "comma"
            state = "value" if stack[-1] == "[" else "key"
    rest = text[at:].strip(" \t\r\n")
    if rest:
        return "merge conflict" if MARKER.search(content) else ("unterminated literal" if rest[0] == '"' else "stray character")
    return "" if state == "end" else "premature end"


_TOML_STRING = r'"""(?:[^\\]|\\.)*?"{3,5}(?!")|\'\'\'(?:.)*?\'{3,5}(?!\')|"(?:[^"\\\n\r]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*"|\'[^\'\n\r]*\''
_TOML_LEX = re.compile(r"(" + _TOML_STRING + r")|(#[^\n\r]*)|(\r?\n)|([ \t]+)|([\[\]{},=.])|([A-Za-z0-9_+:-]+)|(.)", re.S)
_TOML_VALUE = re.compile(r"[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|true|false|[+-]?(?:inf|nan)")


def toml_fault(content: bytes) -> str:
    """The first fault that the lexer suspects in a TOML text."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return "encoding"
    stack: list[str] = []
    line: list[str] = []
    seen: set[str] = set()
    table = ""
    for m in [*_TOML_LEX.finditer(text + "\n")]:
        string, comment, newline, blank, op, bare, other = m.groups()
        if other:
            return "merge conflict" if MARKER.search(content) else ("unterminated literal" if other in "\"'" else "stray character")
        if blank or comment or (newline and stack and stack[-1] == "[" and line and "=" in line):
            if comment and re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", comment):
                return "stray character"
            continue
        if string is not None:
            if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", string):
                return "stray character"
            line.append("s")
            line.append(string)
            continue
        if newline:
            if stack:
                return "unbalanced delimiter"
            if line:
                got = _toml_line(line)
                if got:
                    return "merge conflict" if MARKER.search(content) else got
                keys = "".join(line[: line.index("=")]) if "=" in line else "".join(line)
                if "=" in line:
                    if (full := f"{table}\x00{keys}") in seen:
                        return "repeated key"
                    seen.add(full)
                elif keys.startswith("[["):
                    table = f"{keys}{m.start()}"
                else:
                    table = keys
                    if keys in seen:
                        return "repeated key"
                    seen.add(keys)
            line = []
            continue
        if op in ("[", "{"):
            stack.append(op)
        elif op in ("]", "}"):
            if not stack or stack.pop() != ("[" if op == "]" else "{"):
                return "unbalanced delimiter"
        line.append(op or bare)
    return "premature end" if stack or line else ""


def _toml_line(line: list[str]) -> str:
    """The fault of a line of TOML tokens (a literal is ``s`` and its text)."""
    flat = [x for i, x in enumerate(line) if not (i and line[i - 1] == "s" and x[:1] in "\"'")]
    if flat[0] == "[":
        return "" if re.fullmatch(r"(\[\[?) (?:s|[\w-]+)(?: \. (?:s|[\w-]+))* (\]|\] \])", " ".join(flat)).__class__ is re.Match and flat.count("[") == flat.count("]") or re.fullmatch(r"\[ \[ (?:s|[\w-]+)(?: \. (?:s|[\w-]+))* \] \]", " ".join(flat)) else "table"
    if "=" not in flat:
        return "no value"
    key, value = " ".join(flat[: flat.index("=")]), flat[flat.index("=") + 1 :]
    if not re.fullmatch(r"(?:s|[A-Za-z0-9_-]+)(?: \. (?:s|[A-Za-z0-9_-]+))*", key):
        return "key"
    stack, need = [], True
    i = 0
    while i < len(value):
        t = value[i]
        if stack and stack[-1] == "{" and need and t not in "{}":
            if i + 2 > len(value) or "=" not in value[i:]:
                return "key"
            i = value.index("=", i) + 1
            if i >= len(value):
                return "no value"
            t = value[i]
        if t in "[{" and t:
            if not need:
                return "two values"
            stack.append(t)
        elif t in "]}":
            if not stack:
                return "unbalanced delimiter"
            stack.pop()
            need = False
            i += 1
            continue
        elif t == ",":
            if need or not stack:
                return "comma"
            need = True
            i += 1
            continue
        elif t == "s":
            if not need:
                return "two values"
            need = False
        else:
            run = t
            while i + 1 < len(value) and value[i + 1] not in ("[", "]", "{", "}", ",", "s", "="):
                i += 1
                run += value[i]
            if not need or not (_TOML_VALUE.fullmatch(run) or re.match(r"\d\d\d\d-\d\d-\d\d|\d\d:\d\d", run)):
                return "value"
            need = False
        if t in "[{":
            need = True
        i += 1
    return "no value" if need and not (value and value[-1] in "]}") else ""


# --- Files ----------------------------------------------------------------------------------------------------------

# Extension and language.
LANGUAGES = {"py": "python", "json": "json", "toml": "toml"}
_FAULTS = {"python": python_fault, "json": json_fault, "toml": toml_fault}


def rejected(content: bytes, language: str) -> bool:
    """Whether the language's parser rejects the bytes.

    Depth, and in JSON the length of a number, are limits of parsers, not faults: JSON of any depth is judged by the
    automaton, which is exact, TOML by its lexer.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            if language == "python":
                ast.parse(content)
            elif language == "json":
                json.loads(content.decode("utf-8"), parse_int=float)
            else:
                tomllib.loads(content.decode("utf-8"))
        except RecursionError:
            return language != "python" and bool(_FAULTS[language](content))
        except MemoryError:
            return True  # nested too deeply for the parser
        except (SyntaxError, ValueError):
            return True
    return False


def fault(content: bytes | None, language: str | None) -> str:
    """Why a file is invalid, or an empty string. Null content counts as empty; other languages are not judged."""
    if language is None:
        return ""
    content = bytes(content) if content is not None else b""
    return _FAULTS[language](content) or "syntax" if rejected(content, language) else ""


def language_of(path) -> F.Column:
    """The language that the extension of a path gives, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return pairs[ext]


def checked_files(files: DataFrame) -> DataFrame:
    """(file_path, repo, language, fault): every file, with the fault of the invalid ones (else empty).

    ``files``: file_path, repo, content (bytes). The extension alone gives the language. Null and empty contents are
    an empty file, which is valid Python and TOML but not JSON. Files are judged one by one; repeated rows stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["fault"] = [fault(c, x) for c, x in zip(pdf["content"], pdf["language"])]
            yield pdf[["file_path", "repo", "language", "fault"]]

    rows = files.select("file_path", "repo", language_of(F.col("file_path")).alias("language"), "content")
    return rows.mapInPandas(run, "file_path string, repo string, language string, fault string")


def fault_rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, rate) of every repo and language, by partial sums."""
    bad = F.sum((F.col("fault") != "").cast("bigint"))
    return checked.groupBy("repo", "language").agg(F.count("*").alias("files"), bad.alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
