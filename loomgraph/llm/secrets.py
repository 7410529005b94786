"""Credentials in code and configuration (problem 7): found, confirmed over the corpus, and redacted."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import pylex
from loomgraph.storage import checkpointed

#: A literal that more than this share of all owners hold, and more than this many of them, is a placeholder, unless its form alone makes it a credential.
MOST_SHARE, FEW_OWNERS = 0.25, 3
#: Bits of entropy that the characters of a confirmed value have on average, and altogether.
LEAST_BITS, LEAST_ENTROPY = 1.5, 12.0

# Forms of credentials that providers publish.
FORMS = [
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"github_pat_[A-Za-z0-9_]{40,}", r"glpat-[A-Za-z0-9_-]{20}", r"xox[abeoprs]-[A-Za-z0-9-]{20,}",
    r"sk-[A-Za-z0-9_-]{20,}", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}", r"hf_[A-Za-z0-9]{30,}", r"AIza[A-Za-z0-9_-]{35}", r"npm_[A-Za-z0-9]{36}", r"pypi-[A-Za-z0-9_-]{40,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", r"ya29\.[A-Za-z0-9_-]{20,}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
]
_FORM = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(FORMS) + r")(?![A-Za-z0-9_/+=-])")
#: A short prefix, a mark and a long run of mixed letters and digits, as makers of tokens like.
_PREFIXED = re.compile(r"(?<![\w./+-])[a-z]{2,8}[._-](?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{24,64}(?![\w./+=-])")
_KEY40 = re.compile(r"(?=[^A-Z]*[A-Z])(?=[^a-z]*[a-z])(?=[^\d]*\d)[A-Za-z0-9/+]{40}")
_HEX40 = re.compile(r"(?=.*[a-f])(?=.*\d)[0-9a-f]{40}")
_ADDRESS = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]{1,20}://([^\s:/@\"'<>{}]*):([^\s@/\"'<>]+)@[^\s\"'/]+")
_PARAMETER = re.compile(r"[?&;]([A-Za-z_-]*(?:token|key|secret|sig|signature|password|passwd|pwd|auth|credential)[A-Za-z_-]*)=([^\s&;\"'#<>{}$]{6,})", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_HEADER = re.compile(r"\b(Basic|Bearer|Token|ApiKey)\s+([A-Za-z0-9+/=._~-]{8,})", re.I)
_SHELL = re.compile(r"(?:^|\s)(?:-u|--user|-U|--proxy-user)[ =]['\"]?([^\s:'\"]+):([^\s'\"@]+)")
_LOGIN = re.compile(r"\b(?:login|password|passwd|pwd|credentials?|creds|pass)\b[^:=\n]{0,40}?(?:is|:|=|are)\s+(?:[\w.@-]+\s*(?:/|:|,|\bwith\b|\band\b)\s*)(\S+)", re.I)
_NAMED = re.compile(r"(?<![\w$%])([\"']?)([A-Za-z][\w.-]{0,60})\1\s*(?:=>|:=|[:=])[ \t]*(?:([\"'])((?:(?!\3)[^\\\n])+)\3|([^\s,;\"'(){}\[\]<>]+))(?=[\s,;}\]]|\\n|$)")

_STRONG = re.compile(r"pass(?:word|wd|phrase|code)?$|pass(?:word|wd|phrase)(?![a-z])|(?:^|[_.-])(?:pwd|pw|pass|secret|creds?|credentials?|auth|sasl)(?:$|[_.-])|secret$|token$|api[_-]?key|access[_-]?key|private[_-]?key|signing[_-]?key|encrypt\w*[_-]?key|salt[_-]?key|account[_-]?key|shared[_-]?key|client[_-]?secret|auth(?:orization)?$|access[_-]?token|bearer|assertion$", re.I)
_WEAK = re.compile(r"(?:budget|limit|prefix|count|size|length|field|name|url|uri|path|file|dir|host|port|ttl|timeout|type|format|header|pattern|regex|policy|method|mode|level|enabled|min|max|expir\w*|pub(?:lic)?(?:[_-]?key)?|hint|model|digest|revision|version|id)$", re.I)
_HASHES = re.compile(r"(?:^|[_.-])(?:rev(?:ision)?|commit|digest|sha\d*|hash|etag|checksum|md5|version|build|id|uuid|guid|fingerprint|nonce|tree|ref)s?$", re.I)
_PUBLIC = re.compile(r"pub(?:lic)?(?:$|[_-])", re.I)
#: Marks of a place that something else fills, or of a value left out.
_TEMPLATE = re.compile(r"^(?:[<\[{(].*[>\]})]|\$\{?.*|%.*%|\{\{.*|%\(.*|([xX*.#_?0-])\1{2,}|\*+|.*\.\.\.)$")
_REFERENCE = re.compile(r"^(?:(?:vault|file|env|ssm|secret|secrets|aws|gcp|az|arn|kms|sops|op|ref|config|param|path|http|https)[:/]|[/~.]{1,2}[\w/]|[A-Z]:\\|/|process\.env|os\.)|^(?-i:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)$", re.I)
#: Words, numbers, names and calls have no structure of a secret.
_PLAIN = re.compile(r"^(?:[a-z]+(?:[_./:-][a-z]+){0,2}|[A-Z]?[a-z]+(?: [A-Za-z]+)*[:.]?\s*|[\d.,:_-]+|[A-Za-z_]\w*\(.*\)|[a-z_]+\.[a-z_.]+)$")


def is_secret(value: str, strong: bool, hashes: bool = False) -> bool:
    """Whether a value that stands at a name or place for secrets (``strong``: a telling one) has a secret's structure.

    No list of words decides: what people write where a secret would stand is told by how many owners hold it
    (``confirmed_values``). A value with blanks is a text and none.
    """
    v = value.strip()
    if len(v) < 6 or _TEMPLATE.match(v) or _REFERENCE.match(v) or " " in v or "://" in v or not v.isascii():
        return False
    if v.lower().startswith(("sha256:", "sha1:", "sha512:", "md5:", "data:", "idx:")) or re.search(r"\{[\w.]*\}|%s|%d", v):
        return False
    if re.fullmatch(r"[a-z]+(?:-[a-z]+){3,}", v) and strong:
        return True
    if _PLAIN.match(v):
        return False
    if hashes and re.fullmatch(r"[0-9a-fA-F-]{7,}", v):
        return False
    return bool(re.search(r"\d", v)) or bool(re.search(r"[^\w]", v)) or (bool(re.search(r"[a-z]", v)) and bool(re.search(r"[A-Z]", v[1:])) and len(v) >= 10)


def _telling(name: str) -> bool:
    return bool(_STRONG.search(name)) and not _WEAK.search(name) and not _PUBLIC.search(name)


def _inside(text: str, name: str) -> list[tuple[int, int, bool]]:
    """(start, end, sure) of the credentials in the text of one literal, comment or value; name is what it is assigned to.

    sure: the form or place alone makes it one, whoever else holds it.
    """
    out: list[tuple[int, int, bool]] = []

    def add(a: int, b: int, sure: bool) -> None:
        if not any(a < d and c < b for c, d, _ in out):
            out.append((a, b, sure))

    data = text.startswith("data:") or _PUBLIC.search(name or "") is not None
    pem, n = -1, len(text)
    equals, colon = "=" in text, ":" in text
    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        if m.start() < pem:
            continue
        end = _PEM_END.search(text, m.end())
        pem = end.end() if end else len(text)
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", text[m.end() : end.start() if end else pem])) >= 16:
            add(m.start(), pem, True)
    public = [m.span() for m in re.finditer(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)-----.*?(?:-----END [A-Z ]+-----|\Z)", text, re.S)] if "-----BEGIN" in text else []
    for m in _FORM.finditer(text) if n >= 20 else ():
        add(*m.span(), True)
    for m in _ADDRESS.finditer(text) if "://" in text else ():
        user, password = m[1], m[2]
        if is_secret(password, True) and not re.search(r"^\W*\{|[{}$<>]", password) and password.lower() != user.lower():
            add(*m.span(2), True)
    for m in _PARAMETER.finditer(text) if equals else ():
        if is_secret(m[2], True):
            add(*m.span(2), True)
    for m in _HEADER.finditer(text) if n >= 14 else ():
        if is_secret(m[2], True) and len(m[2]) >= 12 or re.search(r"=$", m[2]):
            add(*m.span(2), True)
    for m in _SHELL.finditer(text) if colon and "-" in text else ():
        if is_secret(m[2], True) and re.search(r"\b(?:curl|wget|http|ftp|ldap|mysql|psql|redis)\b|://", text):
            add(*m.span(2), True)
    for m in _LOGIN.finditer(text):
        value = m[1].rstrip(".,;:)'\"`")
        if is_secret(value, True):
            add(m.start(1), m.start(1) + len(value), False)
    if not data:
        for m in _PREFIXED.finditer(text) if n >= 27 else ():
            add(*m.span(), False)
        for m in _NAMED.finditer(text) if equals or colon else ():
            i = 4 if m[4] is not None else 5
            value = m[i]
            if _telling(m[2]) and is_secret(value, True, bool(_HASHES.search(m[2]))) and not value.endswith(("(", ".")) and not re.match(r"[A-Za-z_]+[.(\[]", value):
                add(*m.span(i), False)
    if name and not out and not data:
        v = text.strip()
        a = text.find(v)
        hashes = bool(_HASHES.search(name))
        if _telling(name) and is_secret(v, True, hashes):
            add(a, a + len(v), False)
    if not out and not data and not public:
        v = text.strip()
        if (_KEY40.fullmatch(v) or _HEX40.fullmatch(v) and name) and not _HASHES.search(name or "x"):
            add(text.find(v), text.find(v) + len(v), False)
    return [x for x in out if not any(a <= x[0] < b for a, b in public)]


_NAME_BEFORE = re.compile(r"([A-Za-z_][\w.]*)\s*(?::\s*[\w.\[\]]+\s*)?(?:=|!=|==|\bin\b|\+=)\s*\(?\s*(?:(?:[\w.]+\.)?(?:fromhex|b64decode|SecretStr|Secret|bytes|bytearray|str|unhexlify|quote)\(\s*)?$")
_INDEX_BEFORE = re.compile(r"^\s*\]\s*=\s*\(?\s*$")
_PAIR_BEFORE = re.compile(r"^\s*:\s*\(?\s*(?:(?:[\w.]+\.)?(?:fromhex|b64decode|SecretStr|Secret|bytes|bytearray|str|unhexlify|quote)\(\s*)?$")
_ARG_BEFORE = re.compile(r"^\s*,\s*(?:default\s*=\s*)?\(?\s*$")
_JOIN = re.compile(r"[\s\\]*\+?[\s\\]*")


def candidates_in_code(code: str, literals: set[str] | None = None) -> list[tuple[str, int, int, bool]]:
    """(value, start, end, sure) of the credentials in source; positions are those of the literal's raw text.

    A value split over several literals starts in the first and ends in the last. ``literals`` gets the value of every
    literal of six characters or more without blanks, credential or not.
    """
    out = []
    pieces = list(pylex.lex(code))
    i, last_value, last_end, call = 0, "", 0, ""
    while i < len(pieces):
        kind, a, b = pieces[i]
        if kind == "c":
            for s, e, sure in _inside(code[a:b], ""):
                out.append((code[a + s : a + e], a + s, a + e, sure))
            i += 1
            continue
        parts = [(a, b)]
        while i + 1 < len(pieces) and pieces[i + 1][0] == "s" and _JOIN.fullmatch(code, b, pieces[i + 1][1]) and (b < pieces[i + 1][1]):
            i += 1
            b = pieces[i][2]
            parts.append((pieces[i][1], b))
        texts = [pylex.value(code[x:y]) for x, y in parts]
        text = "".join(texts)
        # What a literal is assigned to stands before it on the line of the last code.
        before = code[last_end:a]
        before = before[max(before.rfind(x, 0, len(before.rstrip())) for x in "\r\n") + 1 :]
        name = ""
        m = _NAME_BEFORE.search(before)
        if m:
            name = m[1]
        elif last_value and (_PAIR_BEFORE.match(before) or _INDEX_BEFORE.match(before)):
            name = last_value
        elif last_value and _ARG_BEFORE.match(before):
            name = "password" if re.search(r"(?:login|auth|connect|sign_?in|credentials?)$", call, re.I) else (last_value if re.search(r"(?:get|getenv|setdefault|set|put|option|config|add|environ|header|property)\w*$", call, re.I) else "")
        if not _ARG_BEFORE.match(before):
            c = re.search(r"([\w.]+)\(\s*$", before)
            call = c[1].rpartition(".")[2] if c else ""
        if any("f" in pylex.split_literal(code[x : x + 8])[0] and "{" in code[x:y] for x, y in parts):
            name = ""  # made from other values at run time
        if len(text) >= 6:
            if literals is not None and len(text.split(None, 1)) == 1:
                literals.add(text.strip())
            starts = [0]
            for t in texts:
                starts.append(starts[-1] + len(t))
            for s, e, sure in _inside(text, name):
                p, q = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
                p, q = min(p, len(parts) - 1), min(q, len(parts) - 1)
                head = re.match(r"[A-Za-z]{0,2}(?:'''|\"\"\"|'|\")", code[parts[p][0] : parts[p][0] + 5]).end()
                tail = re.match(r"[A-Za-z]{0,2}(?:'''|\"\"\"|'|\")", code[parts[q][0] : parts[q][0] + 5]).end()
                exact = "\\" not in code[a:b]
                start = parts[p][0] + head + (s - starts[p] if exact else 0)
                end = parts[q][0] + tail + (e - starts[q]) if exact else parts[q][1] - (tail - len(re.match(r"[A-Za-z]*", code[parts[q][0] : parts[q][1]])[0]))
                out.append((text[s:e], start, max(end, start + 1), sure))
        last_value, last_end = text, b
        i += 1
    return out


def candidates_in_value(text: str, name: str) -> list[tuple[str, int, int, bool]]:
    """(value, start, end, sure) of the credentials in a setting's value."""
    return [(text[a:b], a, b, sure) for a, b, sure in _inside(text, name or "")]


_WORD = re.compile(r"\w+")
_MARKS = re.compile(r"[^\w\s]{6,}")
#: A map of so many bits (a power of 2; 4 MB) tells which parts of a text cannot be a known value's key.
KEY_BITS = 25


def key_of(value: str) -> int | None:
    """Hash of the part by which a known value is looked up: its longest two neighbouring words with what is between.

    A value stands in a text only where no letter, digit or underscore touches it, so all its words are whole words of
    that text. A value of one word is looked up by that word, one of marks alone by its first six in a row; a ruler,
    and marks that blanks break before the sixth, by nothing.
    """
    words = [m.span() for m in _WORD.finditer(value)]
    if len(words) > 1:
        part = max((value[a:d] for (a, _), (_, d) in zip(words, words[1:])), key=len)
    elif words:
        part = value[slice(*words[0])]
    else:
        marks = _MARKS.search(value)
        if marks is None or len(set(value)) == 1:
            return None
        part = marks[0][:6]
    return xxhash.xxh64_intdigest(part)


def read_literals(code: str) -> Iterator[list[tuple[str, int, int]]]:
    """Of each literal that a program reads otherwise than it is written, by escapes or because several are joined: what it reads, in pieces with their places.

    A piece is an escape, or text as it is written. Fields of f-strings stay as they are.
    """
    group: list[tuple[int, int]] = []
    for kind, a, b in [*pylex.lex(code), ("", len(code), len(code))]:
        if group and kind == "s" and group[-1][1] < a and _JOIN.fullmatch(code, group[-1][1], a):
            group.append((a, b))
            continue
        if len(group) > 1 or group and "\\" in code[slice(*group[0])]:
            out = []
            for x, y in group:
                prefix, quotes, body = pylex.split_literal(code[x:y])
                at = start = x + len(prefix) + len(quotes)
                end = start + len(body)
                for m in () if "r" in prefix else pylex._ESCAPE.finditer(code, start, end):
                    out += [(code[at : m.start()], at, m.start()), (pylex._unescape(m), *m.span())]
                    at = m.end()
                out.append((code[at:end], at, end))
            yield [x for x in out if x[0]]
        group = [(a, b)] if kind == "s" else []


def _places_read(pieces: list[tuple[str, int, int]], s: int, e: int) -> tuple[int, int]:
    """Where in the code the characters from s to e of what is read stand."""
    at, start = 0, None
    for text, a, b in pieces:
        whole = len(text) == b - a
        if start is None and s < at + len(text):
            start = a + (s - at if whole else 0)
        if e <= at + len(text):
            return start, a + (e - at) if whole else b
        at += len(text)
    raise ValueError("out of what is read")


def _touched(text: str, s: int, e: int) -> bool:
    """Whether a letter, digit or underscore touches a place of a text."""
    return bool(re.match(r"\w", text[e : e + 1] or " ") or re.match(r"\w", text[s - 1 : s] or " "))


def parts(text: str) -> set[str]:
    """All that could be the part of a text by which a known value is looked up."""
    words = [m.span() for m in _WORD.finditer(text)]
    out = {text[a:b] for a, b in words}
    out.update(text[a:d] for (a, _), (_, d) in zip(words, words[1:]))
    for m in _MARKS.finditer(text):
        out.update(text[i : i + 6] for i in range(m.start(), m.end() - 5))
    return out


def _line(text: str, at: int) -> int:
    """The line, from 1, of a position; a line ends with a line feed, a carriage return or both."""
    return len(re.findall(r"\r\n|\r|\n", text[:at])) + 1


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


_INDEX = "hash bigint, owner string, holder_id bigint, value string, sure boolean"


def literal_index(texts: DataFrame, code: bool) -> DataFrame:
    """The index of the corpus's literals: (hash, owner, holder_id, value, sure). ``texts``: holder_id, owner, name, text.

    A row for each literal of an owner, credential or not, once a batch of texts, by the hash of its value alone. Of what
    stands at a place or in a form of credentials, value and holder are kept too; ``sure``: the form alone makes it one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, seen = [], set()
            for r in pdf.itertuples(index=False):
                if not isinstance(r.text, str):
                    continue
                literals: set[str] = set()
                found = candidates_in_code(r.text, literals) if code else candidates_in_value(r.text, r.name)
                for value, sure in {(value, sure) for value, _, _, sure in found}:
                    rows.append((_signed(xxhash.xxh64_intdigest(value)), r.owner, r.holder_id, value, sure))
                if not code and len(r.text.strip()) >= 6:
                    literals.add(r.text.strip())
                for value in literals:
                    h = _signed(xxhash.xxh64_intdigest(value))
                    if (h, r.owner) not in seen:
                        seen.add((h, r.owner))
                        rows.append((h, r.owner, None, None, False))
            out = pd.DataFrame(rows, columns=["hash", "owner", "holder_id", "value", "sure"])
            out["holder_id"] = out["holder_id"].astype("Int64")
            yield out

    return texts.mapInPandas(run, _INDEX)


def _rich(value: str) -> bool:
    """Whether a value's characters vary enough to have been made up to be kept."""
    counts = np.unique(list(value), return_counts=True)[1] / len(value)
    bits = float(-(counts * np.log2(counts)).sum())
    return bits >= LEAST_BITS and bits * len(value) >= LEAST_ENTROPY


def confirmed_values(index: DataFrame, most_share: float = MOST_SHARE, few: int = FEW_OWNERS) -> DataFrame:
    """(value, hash, key): the confirmed credentials of ``literal_index``, with the key by which each is looked up, or null.

    Confirmed is a value that stood at a place for credentials, whose characters vary enough, and which at most ``few`` owners
    or ``most_share`` of all owners hold, wherever it stands among their literals; one whose form alone makes it a
    credential, whoever holds it. (hash, owner) pairs are made distinct before they are counted, so a value with a
    third of all sightings is one row a partition and owner.
    """
    owners = index.select("owner").distinct().count()
    held = index.groupBy("hash", "owner").agg(F.max("value").alias("value"), F.max("sure").alias("sure"))
    values = held.groupBy("hash").agg(F.count("*").alias("owners"), F.max("value").alias("value"), F.max("sure").alias("sure"))
    values = values.where(F.col("value").isNotNull() & (F.col("sure") | (F.col("owners") <= max(few, most_share * owners))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[bool(sure) or _rich(v) for v, sure in zip(pdf["value"], pdf["sure"])]]
            keys = [key_of(v) for v in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "hash": pdf["hash"], "key": pd.array([None if k is None else _signed(k) for k in keys], "Int64")})

    return values.select("value", "hash", "sure").mapInPandas(run, "value string, hash bigint, key bigint")


def _places(key: int) -> tuple[int, int]:
    return key & ((1 << KEY_BITS) - 1), (key >> 32) & ((1 << KEY_BITS) - 1)


def key_map(keyed: DataFrame) -> bytes:
    """A map of 2 ** KEY_BITS bits in which the two places of each key are set; each word of it is made by the executors."""
    mask = (1 << KEY_BITS) - 1
    places = keyed.where("key is not null").select(F.explode(F.expr(f"array(key & {mask}L, shiftrightunsigned(key, 32) & {mask}L)")).alias("at"))
    words = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (KEY_BITS - 6), "<i8")
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def _key_rows(texts: DataFrame, shared: Broadcast, code: bool) -> DataFrame:
    """(holder_id, key) of the parts of each text, as it is written and as its literals are read, that are in the map of the known keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["holder_id"], pdf["text"]):
                if not isinstance(t, str):
                    continue
                for part in parts(t).union(*(parts("".join(x[0] for x in p)) for p in read_literals(t))) if code else parts(t):
                    h = xxhash.xxh64_intdigest(part)
                    x, y = _places(h)
                    if bits[x >> 3] >> (x & 7) & 1 and bits[y >> 3] >> (y & 7) & 1:
                        rows.append((i, _signed(h)))
            yield pd.DataFrame(rows, columns=["holder_id", "key"])

    return texts.mapInPandas(run, "holder_id bigint, key bigint")


_FOUND = "holder_id bigint, line_no int, value string, redacted string"


def rescan(texts: DataFrame, known: DataFrame, code: bool, index: DataFrame, shared: Broadcast) -> DataFrame:
    """(holder_id, line_no, value, redacted): each credential in each text that holds one.

    ``known``: the corpus's ``confirmed_values``, ``shared``: their ``key_map``; ``index``: the ``literal_index`` of these texts. Every text is scanned: all its
    words are looked up in the map, and a text meets, by joins on keys, those confirmed values whose key it holds, and those that the index places in it.
    That stands for one automaton of all confirmed values, whose size would grow with the corpus: an automaton of the values that are met, made for each Arrow batch, scans the texts.
    No place of a confirmed value between blanks or marks is missed, whatever letters it is made of; in code it must begin in a literal or comment, as elsewhere it is a name.
    line_no is where a value begins; redacted is the whole text with every found value replaced, the same in each of its rows.
    """
    hits = _key_rows(texts, shared, code).join(known, "key").select("holder_id", "value")
    placed = index.where("value is not null").select("hash", "holder_id").join(known, "hash").select("holder_id", "value")
    lists = hits.unionByName(placed).groupBy("holder_id").agg(F.collect_set("value").alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            automaton = ahocorasick.Automaton()
            for values in pdf["values"]:
                for v in values:
                    automaton.add_word(v, v)
            if len(automaton):
                automaton.make_automaton()
            rows = []
            for r in pdf.itertuples(index=False):
                allowed, spans = set(r.values), []
                starts = [x[1:] for x in pylex.lex(r.text)] if code else [(0, len(r.text))]
                for end, v in automaton.iter(r.text):
                    s, e = end + 1 - len(v), end + 1
                    i = bisect_right(starts, s, key=lambda x: x[0]) - 1
                    if v in allowed and i >= 0 and s < starts[i][1] and not _touched(r.text, s, e):
                        spans.append((s, e, v))
                for pieces in read_literals(r.text) if code else ():
                    text = "".join(x[0] for x in pieces)
                    for end, v in automaton.iter(text):
                        if v in allowed and not _touched(text, end + 1 - len(v), end + 1):
                            spans.append((*_places_read(pieces, end + 1 - len(v), end + 1), v))
                spans.sort(key=lambda x: (x[0], -x[1]))
                kept: list[tuple[int, int, str]] = []
                for x in spans:
                    if not kept or x[0] >= kept[-1][1]:
                        kept.append(x)
                text = redact(r.text, [(s, e) for s, e, _ in kept])
                for s, _, v in kept:
                    rows.append((r.holder_id, _line(r.text, s), v, text))
            yield pd.DataFrame(rows, columns=["holder_id", "line_no", "value", "redacted"])

    return texts.join(lists, "holder_id").mapInPandas(run, _FOUND)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with letters and digits of the spans replaced by ``x``.

    Quotes, marks, line ends and the lines around a key's text stay, so literals that are joined, addresses, encodings
    of equal length and line numbers stay what they were.
    """
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append("\n".join(line if line.lstrip().startswith("-----") else _mask(line) for line in text[a:b].split("\n")))
        at = b
    return "".join(out) + text[at:]


def _mask(part: str) -> str:
    if not re.search(r"[\"'\s\\]", part):
        return re.sub(r"[^\W_]", "x", part)
    pieces = list(re.finditer(r"\\.|[\"']\s*\+?\s*(?:\\\s*)?[rRbBuUfF]{0,2}[\"']|\s+|[\"']|[^\W_]", part, re.S))
    out, at = [], 0
    for m in pieces:
        out.append(part[at : m.start()])
        out.append(m[0] if not m[0].isalnum() else "x")
        at = m.end()
    return "".join(out) + part[at:]


def chunk_texts(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, repo, content) as texts."""
    return chunks.select(F.col("chunk_id").alias("holder_id"), F.col("repo").alias("owner"), F.lit(None).cast("string").alias("name"), F.col("content").alias("text"))


def setting_texts(env_vars: DataFrame) -> DataFrame:
    """``env_vars`` (env_key, name, default_value, file_path) as texts; one row for each env_key, the first segment of the path is the owner."""
    rows = env_vars.where("env_key is not null and default_value is not null")
    return rows.groupBy(F.col("env_key").alias("holder_id")).agg(F.min(F.struct(F.split("file_path", "/")[0].alias("owner"), "name", F.col("default_value").alias("text"))).alias("x")).select("holder_id", "x.owner", "x.name", "x.text")


def credentials(chunks: DataFrame, env_vars: DataFrame, most_share: float = MOST_SHARE, few: int = FEW_OWNERS) -> DataFrame:
    """(holder, holder_id, line_no, value, redacted) of each credential in chunks' contents and settings' defaults.

    All literals are indexed by owner, widely shared ones are placeholders, rare structured ones at places for credentials are confirmed, and
    an automaton finds the confirmed ones in every text. Null and empty texts hold none; repeated env_keys count
    once (if their rows differ, the smallest counts).
    """
    code, settings = chunk_texts(chunks), setting_texts(env_vars)
    # The index holds hashes; kept, it spares reading every text again.
    in_code, in_settings = checkpointed(literal_index(code, True), costly=True), checkpointed(literal_index(settings, False), costly=True)
    known = checkpointed(confirmed_values(in_code.unionByName(in_settings), most_share, few), costly=True)
    shared = chunks.sparkSession.sparkContext.broadcast(key_map(known))  # 4 MB whatever the input
    found = rescan(code, known, True, in_code, shared).withColumn("holder", F.lit("chunk"))
    return found.unionByName(rescan(settings, known, False, in_settings, shared).withColumn("holder", F.lit("env_var"))).select("holder", "holder_id", "line_no", "value", "redacted")
