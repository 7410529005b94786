"""Functions paired with their documentation (problem 1), from lexed tokens by windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import prose, pylex

_TOKEN = "pos int, kind string, line int, end_line int, start int, end int, indent int, delta int, text string, word string, params string"
_LEXED = f"chunk_id bigint, tokens array<struct<{', '.join(':'.join(x.split()) for x in _TOKEN.split(', '))}>>"
#: Texts that a worker lexes at a time, which bounds its memory.
_ROWS = 500
#: Groups: comment, literal, opening and closing bracket, line end with the blanks after it.
_LEXER = re.compile(r"(?P<c>#[^\r\n]*)|(?P<s>" + pylex.STRING + r")|(?P<o>[(\[{])|(?P<x>[)\]}])|(?P<n>(?:\r\n|\r|\n)[ \t\f]*)", re.S)
_LITERAL = re.compile(pylex.STRING, re.S)
#: Literals that are one text: side by side, or in brackets of their own over lines.
_BARE = re.compile(f"{pylex.STRING}(?:(?:[ \\t\\f]|\\\\(?:\\r\\n|\\r|\\n))*{pylex.STRING})*", re.S)
_BRACKETED = re.compile(rf"(?P<open>(?:\((?:\s|#[^\r\n]*)*)+){pylex.STRING}(?:(?:\s|\\|#[^\r\n]*)*{pylex.STRING})*(?P<close>(?:(?:\s|#[^\r\n]*)*\))+)", re.S)
_BLANKS = re.compile(r"[ \t\f]*")
_HEAD = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)|(class)\b|(@)")
#: All but brackets.
_UNCOMMENTED = re.compile(r"#[^\r\n]*|[^()]")
_ENDS_LINE = re.compile(r"[ \t;]*(?:[\r\n#]|\Z)")
_PARAMS = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_PARAM = re.compile(r"(?:^|,)\s*\*{0,2}(\w+)")
_BREAK = re.compile(r"\r\n|\r|\n")


def lex_tokens(code: str) -> list[tuple]:
    """The tokens of one text that matter for documentation, as ``_TOKEN``.

    Kinds: ``c`` a comment that begins a line, ``s`` a literal, or several that are one text, with no other code on its lines, ``k`` the first code of any other line (``word``: def, class, @
    or empty), ``l`` a literal elsewhere, ``o`` and ``x`` an opening and a closing bracket (delta 1 and -1). Only what begins a
    line has an indent. Lines count from 0; start and end are characters, of the token's whole lines.
    """
    out: list[tuple] = []
    line, begin = 0, 0

    def line_end(at: int) -> int:
        m = _BREAK.search(code, at)
        return m.start() if m else len(code)

    def joined(m: re.Match | None) -> str | None:
        """The text of literals that are all code of their lines."""
        if m is None or _ENDS_LINE.match(code, m.end()) is None:
            return None
        if "open" in m.groupdict() and len(_UNCOMMENTED.sub("", m["open"])) != len(_UNCOMMENTED.sub("", m["close"])):
            return None
        return "".join(pylex.value(code[a:b]) for kind, a, b in ((k, m.start() + x, m.start() + y) for k, x, y in pylex.lex(m[0])) if kind == "s")

    def open_line(at: int, first: int) -> None:
        """Emits the code that begins a line, unless a comment, a literal or nothing does."""
        if first >= len(code) or code[first] in "\r\n#" or (code[first] in "\"'rRbBuUfFtT" and _LITERAL.match(code, first)):
            return
        text = joined(_BRACKETED.match(code, first)) if code[first] == "(" else None
        if text is not None:
            out.append((len(out), "s", line, line, at, line_end(first), len(code[at:first].expandtabs(8)), 0, text, "", ""))
            return
        m = _HEAD.match(code, first)
        word = "" if m is None else "def" if m[1] else m[2] or m[3]
        head = _PARAMS.search(code, first) if word == "def" else None
        params = " ".join(_PARAM.findall(head[1])) if head else ""
        out.append((len(out), "k", line, line, at, line_end(first), len(code[at:first].expandtabs(8)), 0, m[1] if word == "def" else None, word, params))

    first = _BLANKS.match(code).end()
    open_line(0, first)
    for m in _LEXER.finditer(code):
        kind = m.lastgroup
        if kind == "n":
            line += 1
            begin, first = m.start() + (2 if m[0].startswith("\r\n") else 1), m.end()
            open_line(begin, first)
        elif kind in "ox":
            out.append((len(out), kind, line, line, begin, begin, None, 1 if kind == "o" else -1, None, "", ""))
        elif kind == "c":
            if m.start() == first:
                out.append((len(out), "c", line, line, begin, m.end(), len(code[begin:first].expandtabs(8)), 0, m[0], "", ""))
        else:
            n = len(_BREAK.findall(m[0]))
            leads = m.start() == first
            text = joined(_BARE.match(code, m.start())) if leads else None
            indent = len(code[begin:first].expandtabs(8)) if leads else None
            out.append((len(out), "s" if text is not None else "k" if leads else "l", line, line + n, begin, line_end(m.end()), indent, 0, text, "", ""))
            line += n
    return out


def tokens(chunks: DataFrame) -> DataFrame:
    """One row for each token of ``chunks`` (chunk_id, content); see ``lex_tokens``. Null and empty contents have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _TOKEN.split(", ")]
        # A few texts at a time, as their tokens take many times their size.
        for pdf in (b.iloc[i : i + _ROWS] for b in batches for i in range(0, len(b), _ROWS)):
            found = [[dict(zip(names, t)) for t in lex_tokens(c)] if isinstance(c, str) else [] for c in pdf["content"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "tokens": found})

    return chunks.select("chunk_id", "content").mapInPandas(run, _LEXED).select("chunk_id", F.inline("tokens"))


def functions(rows: DataFrame) -> DataFrame:
    """(chunk_id, pos, name, params, line, end_line, start, end, docstring, comments): every function in the tokens of each text.

    * Brackets summed up to a token tell which of those that begin a line begin a statement; tokens up to the next such are its island.
    * Comments and decorators that follow each other without a gap form an island with the definition that ends it:
      by lag windows; its comments are the function's.
    * For each indent at which the text defines functions, statements no further in than it start a new island: a definition
      at that indent and its body. The first statement of the body, if it is a literal, is the docstring.

    start and end are characters of the text, from the first comment or decorator to the last line of the body. All windows
    are by text, so one exchange does.
    """
    by_text = Window.partitionBy("chunk_id")
    by_pos = by_text.orderBy("pos")
    depth = F.coalesce(F.sum("delta").over(by_pos.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lexed = rows.withColumn("begins", F.col("indent").isNotNull() & (depth <= 0)).withColumn("statement", F.sum(F.col("begins").cast("int")).over(by_pos))
    last = Window.partitionBy("chunk_id", "statement")
    statements = lexed.withColumn("end_line", F.max("end_line").over(last)).withColumn("end", F.max("end").over(last)).where("begins").drop("begins", "statement", "delta")

    loose = (F.col("kind") == "c") | (F.col("word") == "@")
    follows = F.lag(loose).over(by_pos) & (F.col("line") - F.lag("end_line").over(by_pos) <= 1) & (F.lag("indent").over(by_pos) == F.col("indent"))
    statements = statements.withColumn("run", F.sum(F.when(follows, 0).otherwise(1)).over(by_pos))
    run = Window.partitionBy("chunk_id", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    statements = statements.withColumn("comments", F.collect_list(F.when(F.col("kind") == "c", F.col("text"))).over(run)).withColumn("start", F.min("start").over(run))

    levels = F.collect_set(F.when(F.col("word") == "def", F.col("indent"))).over(by_text)
    placed = statements.where("kind <> 'c'").withColumn("levels", levels).withColumn("level", F.explode("levels"))
    outer = F.col("indent") <= F.col("level")
    placed = placed.withColumn("island", F.sum(F.when(outer, 1).otherwise(0)).over(Window.partitionBy("chunk_id", "level").orderBy("pos")))
    own = outer & (F.col("word") == "def") & (F.col("indent") == F.col("level"))
    head = F.max(F.when(own, F.struct("pos", F.col("text").alias("name"), "params", "line", "start", F.array_join("comments", "\n").alias("comments"))))
    body = F.min(F.when(~outer, F.struct("pos", "kind", "text")))
    found = placed.groupBy("chunk_id", "level", "island").agg(head.alias("f"), body.alias("body"), F.max("end_line").alias("end_line"), F.max("end").alias("end")).where("f is not null")
    return found.select("chunk_id", "f.pos", "f.name", "f.params", "f.line", "end_line", "f.start", "end", F.when(F.col("body.kind") == "s", F.col("body.text")).alias("docstring"), "f.comments")


# --- Which texts describe -------------------------------------------------------------------------------------------

_DIRECTIVE = re.compile(r"^\s*(?:noqa|type:\s*ignore|pylint|mypy|flake8|pragma|fmt|isort|ruff|nosec|yapf|pyright|pytype|coding[:=]|-\*-|!|vim:|eslint|sonar|cython:|region\b|endregion\b|%%)", re.I)
_TAG = re.compile(r"^\s*(?::(?:param|return|returns|raises|raise|type|rtype|arg|yields?|keyword|ivar|var|cvar)\b[^:\n]*:?|@(?:param|returns?|throws|raises|type)\b(?:[ \t]+\w+[ \t]*:?)?|(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields?|Examples?|Notes?|Attributes|See Also|Todo)\s*:?\s*$|\*{0,2}\w+(?:\s*\([^)]*\))?\s*:(?=\s|$))", re.I)
# Texts that stand for missing documentation, and words for it in the languages in use.
_EMPTY = re.compile(r"^\W*(?:to-?do|fix-?me|xxx|tbd|tba|wip|stub|placeholder|docstring|doc ?string|docs?|n/?a|none|null|nil|pass|ditto|undocumented|dummy|empty|test|description|see (?:above|below|the code|code|source|implementation|docs?|name)\b.*|(?:self[- ]?explanatory|obvious))\W*$", re.I)
_MARKED = re.compile(r"^\W*(?:to-?do|fix-?me|xxx|tbd|hack)\b|auto-?generated|automatically generated|generated (?:by|from|stub|code)|\bdo not edit\b|\bto be (?:replaced|written|documented|done|added|filled)\b|\bplaceholder\b|lorem ipsum", re.I)
_DOCUMENT = re.compile(r"\b(?:doc(?:s|ument\w*|string)?|descri\w+|beschreib\w*|doku\w*|document\w*|décri\w*|descrip\w*|descrever|descrição|descriç\w*|descri[zv]\w*|beschrij\w*|beskriv\w*|opis\w*|udokument\w*|описан\w*|описать|опису?|документ\w*|açıklama\w*|belgele\w*|dokümant\w*)\b|文档|文檔|说明|描述|注释|説明|ドキュメント|記述|설명|문서", re.I)
_MISSING = re.compile(r"\b(?:no|not|nobody|none|missing|add|later|write|written|yet|needs?|here|without|fehlt|noch|später|kein\w*|plus tard|manque|pas|aucun\w*|à|pendiente|falta|más adelante|sin|sem|aqui|depois|ainda|não|non|manca|ancora|più tardi|nessun\w*|geen|nog|ontbreekt|hier|komt|saknas|senare|ingen|ännu|brak|później|jeszcze|nie|нет|пока|позже|отсутств\w*|нужно|немає|поки|пізніше|ще|бракує|yok|henüz|sonra|eksik)\b|没有|暂无|待|稍后|缺|尚未|以后|ありません|未|後で|まだ|없|아직|나중|추후", re.I)
_FILLER = set("a an the of for to in on at by and or is are be this that it its function method helper routine procedure def class module object instance wrapper utility util implementation implements implement code does do what which self cls args kwargs param parameter parameters argument arguments return returns returned value values result init initialize initializes initialise constructor new simple main call calls called used use".split())
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _stem(word: str) -> str:
    """A word without endings, taken off again and again, so that all forms of a word meet."""
    w, before = word.lower(), ""
    while w != before:
        before = w
        for end in ("ing", "ies", "es", "ed", "s", "e", "d", "y"):
            if w.endswith(end) and len(w) - len(end) >= 3:
                w = w[: -len(end)]
                break
    return w


def describes(text: str | None, name: str | None, params: str | None = None) -> bool:
    """Whether a docstring or block of comments tells something beyond a function's name and parameters."""
    if not text or not text.strip():
        return False
    known = {_stem(w) for x in (name or "", params or "") for w in _SPLIT.findall(x)} | {(name or "").lower()}
    lines = [re.sub(r"^\s*#+[!:]?", "", x) for x in _BREAK.split(text)]
    for line in prose.without_code([x for x in lines if x.strip()]):
        if _DIRECTIVE.match(line):
            continue
        if _MARKED.search(line):
            continue  # before what stands in front of a colon is taken for a tag
        line = _TAG.sub("", line.strip()).strip()
        if not re.search(r"[^\W\d_]", line):
            continue
        if _EMPTY.match(line) or _MARKED.search(line):
            continue
        words = re.findall(r"[^\W\d_]+", line)
        short = len(words) <= 8 and len(line) <= 80
        if short and _DOCUMENT.search(line) and _MISSING.search(line) and not re.search(r"`|\w_\w|\w\.\w", line):
            continue
        own = [w for x in re.findall(r"\w+", line) for w in (_SPLIT.findall(x) if x.isascii() else [x])]
        if any(w.lower() not in _FILLER and _stem(w) not in known and not w.isdigit() for w in own):
            return True
    return False


_PAIR = "chunk_id bigint, name string, docstring string, source string, start int, end int"


def _described(chunks: DataFrame) -> DataFrame:
    found = functions(tokens(chunks))
    # What stands beside the text comes as a row of its own, so nothing is joined or lexed twice.
    node = F.regexp_extract("node_id", r"([^.:]+)$", 1) if "node_id" in chunks.columns else F.lit(None).cast("string")
    beside = chunks.select("chunk_id", F.lit(-1).alias("pos"), F.col("docstring").alias("doc"), F.coalesce("name", node).alias("own"))
    first = F.min_by(F.struct("name", "params", "docstring", "comments", "start", "end"), F.when(F.col("pos") >= 0, F.col("pos")))
    none = F.lit(None).cast("string")
    rows = found.select("chunk_id", "pos", "name", "params", "docstring", "comments", "start", "end", none.alias("doc"), none.alias("own"))
    merged = rows.unionByName(beside, allowMissingColumns=True).groupBy("chunk_id").agg(first.alias("f"), F.max("doc").alias("doc"), F.max("own").alias("own"))
    flat = merged.select("chunk_id", F.coalesce("f.name", "own").alias("name"), "f.params", "f.docstring", "f.comments", "f.start", "f.end", "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for text, source in ((r.docstring, "docstring"), (r.doc, "kept"), (r.comments, "comments")):
                    if isinstance(text, str) and describes(text, r.name, r.params):
                        out.append((r.chunk_id, r.name, text, source, r.start, r.end))
                        break
            rows = pd.DataFrame(out, columns=["chunk_id", "name", "docstring", "source", "start", "end"])
            yield rows.astype({"start": "Int64", "end": "Int64"})

    return flat.mapInPandas(run, _PAIR)


def documented(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, docstring, source): the functions that have a description of their own.

    ``chunks``: chunk_id (unique), name, docstring, content, of functions. A function's description is its docstring in the
    content, else the docstring kept beside it, else the comments right above the definition or its decorators;
    source says which. Descriptions that are trivial are passed over, and inner functions' are not the outer one's:
    the first definition of a text is the chunk's function. Null and empty contents leave the docstring beside them.
    """
    return _described(chunks).drop("start", "end")


def pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_id, name, docstring, source, content): description–code pairs of the documented functions.

    content is the function as delimited, from its first comment or decorator to the end of its body; the whole text where that
    holds no function.
    """
    rows = _described(chunks).join(chunks.select("chunk_id", F.col("content").alias("text")), "chunk_id")
    code = F.when(F.col("start").isNull(), F.col("text")).otherwise(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.select("chunk_id", "name", "docstring", "source", code.alias("content"))
