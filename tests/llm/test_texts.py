import ast
import random
import textwrap

import pytest

from loomgraph.llm import function_docs, invalid_files, prose, pylex, secrets, splitting


def whole(text):
    return list(pylex.lex(text))


def test_blocks_compose_to_the_whole():
    rng = random.Random(1)
    parts = ['"""', "'''", '"', "'", "#", "\\", "\n", "x = 1\n", "r", "\\\n", "text ", "''", '""', "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert pylex.pieces(text, rng.randrange(1, 12)) == whole(text), text


def test_prefix_of_state_functions():
    rng = random.Random(2)
    for n in range(20):
        maps = [[rng.randrange(5) for _ in range(5)] for _ in range(n)]
        states = [0]
        for m in maps:
            states.append(m[states[-1]])
        assert pylex.compose(maps) == states


def test_values_are_what_python_reads():
    for literal in (r"'a\n\x41\u00e9\101'", r"r'\n'", "'''a\nb'''", r'"\\ \" \q"', "u'x'", r"'a\
b'"):
        assert pylex.value(literal) == ast.literal_eval(literal)


def test_sentences_and_code():
    assert prose.sentences("The quick fox jumps over it. Yes.") == ["The quick fox jumps over it."]
    assert prose.sentences("它把两个方向合并成一个答案。短。") == ["它把两个方向合并成一个答案。"]
    for code in ("for item in chunk:", "query = SELECT a FROM b", "return x if (x := f()) else 0", "SELECT a, b FROM c WHERE d = ?", "", "def f(a, b, c, d):", "import a, b, c, d"):
        assert prose.sentences(code) == []
    assert prose.sentences("x = (\n    one\n    + two three four five\n)\nThis is a sentence here.") == ["This is a sentence here."]
    assert prose.sentences("fallback login: packet-bot / candle-harvest-anvil-cloud56") == []
    assert prose.sentences("-----BEGIN OPENSSH PRIVATE KEY-----") == []
    assert prose.sentences(":param x: the number of rows to read") == ["the number of rows to read"]
    source = 'x = ("The first half of it"\n     " and the second half.")\n# one comment of four words\n'
    assert [k for k, *_ in prose.code_sentences(source)] == ["literal", "comment"]


def test_sentences_in_code_of_documents():
    text = 'def f(a):\n    b = 63  # The resolver keeps only the newest version.\n    c = "Der Planer zerlegt lange Rümpfe."\n    d = "SELECT a, b FROM c WHERE d = 1"\n    e = (a + "one two", b)\nA plain line of prose here.\n    # x = f(a, b)  # no more'
    assert prose.document_sentences(text) == ["The resolver keeps only the newest version.", "Der Planer zerlegt lange Rümpfe.", "A plain line of prose here."]
    assert prose.sentences(text) == ["A plain line of prose here."] and prose.document_sentences("") == []


@pytest.mark.parametrize(
    ("text", "name", "want"),
    [
        (None, "f", False), ("", "f", False), ("TODO: describe what this does", "f", False), ("FIXME: explain the rows", "f", False), ("Note: keys are sorted.", "f", True), ("TODO: docs", "f", False), ("Helper for load_rows.", "load_rows", False), ("Loads the rows.", "load_rows", False), (":param x:\n:return:", "f", False), ("-----", "f", False),
        ("Idempotent.", "f", True), ("Nobody has written documentation yet.", "f", False), ("Hier fehlt noch die Beschreibung.", "f", False), ("# noqa: C901", "f", False), ("# x = f(y)", "f", False), ("# === load rows ===", "load_rows", False),
        (":param x: the number of retries before it fails", "f", True), ("Keys are sorted.", "f", True), ("пишет результат в файл", "f", True), ("x", None, True), ("# x = (\n#     state\n#     + f(3)\n# )", "g", False),
    ],
)
def test_describes(text, name, want):
    assert function_docs.describes(text, name) is want


def test_split_text_is_whole_and_within_limits():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b ", "\n", "\r\n", "\r", "é", "xyz", "日本", "\n\n", "    "]) for _ in range(rng.randint(1, 200)))
        limit, overlap = rng.randint(1, 40), rng.randint(0, 4)
        pieces, hard = splitting.split_text(text, limit, overlap)
        assert "".join(text[c:e] for c, _, e, _, _ in pieces) == text
        assert all(0 < e - s <= limit and s <= c < e for c, s, e, _, _ in pieces)
        assert hard == int(any(len(x) > limit for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")))
        if not hard and "\r\n" not in text:
            assert all(e == len(text) or text[e - 1] in "\r\n" or len(text[c:e]) == limit for c, _, e, _, _ in pieces)


def test_edits_move_only_cuts_nearby():
    rng = random.Random(3)
    lines = ["line %d %s\n" % (i, "x" * rng.randrange(60)) for i in range(400)]
    cuts = lambda ls: {"".join(ls)[c:e] for c, _, e, _, _ in splitting.split_text("".join(ls), 600, 2)[0]}
    a, b = cuts(lines), cuts([*lines[:200], "new line\n", *lines[200:]])
    assert len(a & b) > 0.8 * len(a)


def test_overlap_and_lines():
    text = "".join(f"{i:09d}\n" for i in range(30))
    pieces, _ = splitting.split_text(text, 100, 3)
    for (_, _, end, _, last), (cut, start, _, first, _) in zip(pieces, pieces[1:]):
        assert cut == end and cut - start == 30 and first == last - 2


def test_overlap_is_fewer_lines_only_for_the_limit():
    lines = ["x" * 349 + "\n"] * 12
    assert [(c - s) // 350 for c, s, _, _, _ in splitting.split_text("".join(lines), 1800, 3)[0][1:]] == [3] * (len(splitting.split_text("".join(lines), 1800, 3)[0]) - 1)
    rng = random.Random(6)
    for _ in range(500):
        lines = ["y" * rng.randrange(30) + "\n" for _ in range(rng.randint(2, 40))]
        limit, overlap = rng.randint(30, 90), rng.randint(1, 5)
        pieces, _ = splitting.split_text("".join(lines), limit, overlap)
        for (_, floor, _, _, last), (cut, start, _, first, _) in zip(pieces, pieces[1:]):
            count = last - first + 1
            assert count <= overlap and sum(map(len, lines[first : last + 1])) == cut - start
            if count < overlap and first > 0:
                more = sum(map(len, lines[first - 1 : last + 1]))
                assert cut - more < floor or more + len(lines[last + 1]) > limit


SOUND = [
    "", "x = 1\n", "def f(a, /, b: int = 1, *, c, **k) -> int:\n    return a if b else c\n", "match x:\n    case [a, *b] if a:\n        pass\n    case {'k': v, **r}:\n        pass\n    case _:\n        pass\n",
    "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "@a.b(c)\nasync def f():\n    async with a as b, c() as d:\n        await x\n    return [i async for i in y if i]\n",
    "x = lambda *a, b=1, **k: (a, b)\ny = {**a, 'b': [*c]}\nprint(f'{x!r:>{w}} {{}}')\n", "class A[T](B, metaclass=M): x: int\n", "type X = int\nmatch = 1\ntype = match\n", "if x: pass\nelif y: pass\nelse: pass\n", "a = b = c[1:2, ::3]\ndel a, b\nassert x, 'y'\nglobal q\n",
    "from . import x\nfrom .. a import (b as c,\n  d)\nimport e.f as g\n", "x = not a is not b not in c\n", "while (n := f()) > 0:\n\tx\n\n# c\n", "s = '''a\nb''' 'c' \\\n  'd'\n", "x = 0xFF + 1_000.5e-3j - 0b1\n", "with (a as b, c as d):\n    pass\n", "return_ = yield_ = 1\ndef g():\n    x = yield\n    yield from y\n",
]
BROKEN = ["def f(:\n", "x = (1\n", "x = 'a\n", '"""a', "if x\n    y\n", "try:\n    x\ny\n", "print 'x'\n", "raise A, 'b'\n", "x = 1 +\n", "  x\n y\n", "def f():\n", "x = [1, 2)\n", "<<<<<<< a\nx\n=======\ny\n>>>>>>> b\n", "x = 0777\n", "x = a if b\n", "f(a b)\n", "@x\n", "else:\n  x\n", "x = 1a\n", "f'{a'\n"]


@pytest.mark.parametrize("source", SOUND)
def test_lexer_finds_nothing_in_sound_python(source):
    ast.parse(source)
    assert invalid_files.fault(source.encode(), "python") == ""


@pytest.mark.parametrize("source", BROKEN)
def test_lexer_suspects_broken_python(source):
    with pytest.raises(SyntaxError):
        ast.parse(source)
    assert invalid_files.python_fault(source.encode())


UNSUSPECTED = [
    ("python", "if x = 1:\n    pass\n"), ("python", "while x = 1:\n    pass\n"), ("python", "def f:\n    pass\n"), ("python", "x = {'a': }\n"), ("python", "f(a=1, 2)\n"), ("python", "a + b = c\n"),
    ("toml", "a = 1\n[a]\n"), ("toml", "d = 2024-02-30\n"), ("toml", 'a = """\\q"""\n'), ("toml", 'a = "\\x41"\n'), ("json", '{"a": 1}}'),
]


@pytest.mark.parametrize(("language", "source"), UNSUSPECTED)
def test_parser_judges_what_the_lexer_does_not_suspect(language, source):
    assert invalid_files.fault(source.encode(), language)


def test_limits_of_the_parsers_are_no_faults():
    deep = b"[" * 100_000 + b"]" * 100_000
    assert invalid_files.fault(deep, "json") == "" and invalid_files.fault(deep[:-1], "json")
    assert invalid_files.fault(b"[" + b"1" * 5000 + b"]", "json") == ""
    assert invalid_files.fault(b"a = " + deep[99_000:101_000] + b"\n", "toml") == ""


def test_lexer_never_misses_a_damaged_library():
    import json.decoder
    import pathlib

    rng = random.Random(4)
    text = pathlib.Path(json.decoder.__file__).read_text()
    assert invalid_files.fault(text.encode(), "python") == ""
    missed = 0
    for _ in range(300):
        a = rng.randrange(len(text))
        damaged = text[:a] + rng.choice(["", ")", "(", '"', ":", " x y ", "\n  "]) + text[a + rng.randrange(3) :]
        missed += invalid_files.rejected(damaged.encode(), "python") and not invalid_files.python_fault(damaged.encode())
    assert missed <= 3


def test_json_and_toml():
    for text, want in (("{}", False), ('{"a": [1, 2.5e3, null, "\\u00e9"]}', False), ("", True), ("{'a': 1}", True), ('{"a": 1,}', True), ("[1 2]", True), ('{"a" 1}', True), ("1 2", True), ('"a\nb"', True), ("[", True)):
        assert bool(invalid_files.json_fault(text.encode())) == want == invalid_files.rejected(text.encode(), "json")
    for text, want in (("", False), ("a = 1\n[b.c]\n\"d e\" = [1, 2,\n 3] # x\n[[f]]\ng = {h = 1, i = 'j'}\nd = 2024-01-02T03:04:05Z\n", False), ("a = ", True), ("[a", True), ("a = 'x", True), ("a = 1 b = 2", True), ("a = 1\na = 2", True), ("=======", True), ("a = [1", True), ("a = x", True)):
        assert bool(invalid_files.toml_fault(text.encode())) == want == invalid_files.rejected(text.encode(), "toml")
    assert invalid_files.fault(None, "json") and not invalid_files.fault(None, "python") and not invalid_files.fault(b"(", None)
    assert invalid_files.fault("x = 'é'".encode("latin-1"), "python") == "encoding"


CREDENTIALS = [
    ('password = "hunter2!x"', 1), ("conf.set('a.auth.secret', 'KesAi3kgC+trel')", 1), ('c.login("bob", "Granite-6929")', 1), ('url = "redis://app:uRifmZzIK17@h:1/0"', 1), ('x = (\n    "ghp_qJnXYNsVKQru5J"\n    "RIw5Hmjkt2fHmkXqf3wug8"\n)', 2),
    ('h = {"Authorization": "Bearer abcdEFGH1234567890"}', 1), ('# fallback login: svc / Thistle-517', 1), ('os.getenv("A_TOKEN", "9f8Akd82hdk2")', 1), ('p = """\n[x]\npassword = saffron-8613\n"""', 3), ('if token != "XIVpeiscyPOlr_lT":', 1),
    ('k = """-----BEGIN RSA PRIVATE KEY-----\nMIIabcdefghijklmnop\n-----END RSA PRIVATE KEY-----"""', 1), ('creds = {"user": "a", "pass": "eMakUC1WuxvvDu"}', 1),
]
HARMLESS = ['password = ""', 'api_key = "your-api-key"', 'token = "${TOKEN}"', 'x = os.environ["SECRET"]', 'dsn = f"bolt://{user}:{password}@h"', 'url = "https://user:pass@h/"', 'etag = "2add80a50374f73abb0004b55fef4e16"', 'secret_name = "a/b"', 'csrf_field = "csrf_token"', 'os.getenv("TOKEN_LIMIT", "5000")', 'k = """-----BEGIN PUBLIC KEY-----\nMIIabcdefghijklmnop\n-----END PUBLIC KEY-----"""', 'token = re.compile(r"^a_[a-z0-9]+$")', 'commit = "5cfe7545cba3cd0cf0985567564f0928e222a470"', 'secret = "vault:a/b"', 'password = getpass("Password: ")']


@pytest.mark.parametrize(("code", "line"), CREDENTIALS)
def test_credentials(code, line):
    found = secrets.candidates_in_code(code)
    assert [secrets._line(code, a) for _, a, _, _ in found] == [line]
    clean = secrets.redact(code, [(a, b) for _, a, b, _ in found])
    assert len(clean) == len(code) and not any(v in clean for v, *_ in found) and secrets.candidates_in_code(clean) != found
    if not code.endswith(":"):
        ast.parse(textwrap.dedent(clean))


def test_known_values_are_looked_up_wherever_they_stand():
    rng = random.Random(5)
    for _ in range(3000):
        value = "".join(rng.choice("aB3_-!,;'\"()[]{}\\<=é") for _ in range(rng.randrange(6, 14)))
        text = "".join(rng.choice(["x", " ", "\n", "-", "'", ","]) for _ in range(5)) + rng.choice("\n '(") + value + rng.choice("\n ')")
        key = secrets.key_of(value)
        assert key is None or key in {secrets.xxhash.xxh64_intdigest(x) for x in secrets.parts(text)}, (value, text)


def test_places_of_what_literals_read():
    code = r"""f("a\x62c", r'\d', x, "one\"two" 'three' + "\u00e9")"""
    for pieces in secrets.read_literals(code):
        text = "".join(x[0] for x in pieces)
        at = [secrets._places_read(pieces, i, i + 1) for i in range(len(text))]
        assert [code[a:b] for a, b in at] in (["a", r"\x62", "c"], list(r"\d"), [*"one", '\\"', *"twothree", r"\u00e9"])


@pytest.mark.parametrize("code", HARMLESS)
def test_no_credentials(code):
    assert secrets.candidates_in_code(code) == []
