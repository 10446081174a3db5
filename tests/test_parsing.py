"""Definitions, the line machine, packing and splitting, against plain brute force where it is possible."""

import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from seamark.operators import chunking as C
from seamark.operators import parsers
from seamark.operators import parsing as P

RUST = "use x;\n\nfn main() {\n    println!(\"hi\");\n}\n\nstruct Point {\n    x: i32,\n}\n\nimpl Point {\n    fn new() -> Self {\n        Point { x: 0 }\n    }\n}\n"
PYTHON = "import os\n\ndef hello(a):\n    return a\n\nclass Greeter:\n    def greet(self):\n        pass\n\n    async def later(self):\n        pass\n\nasync def top():\n    pass\n"


def spans(spark, path, code, **kw):
    df = spark.createDataFrame([(path, code)], "file_path string, file_content string")
    return C.rows_of(P.parse_spans(df, **kw), "spans", "i").orderBy("i").collect()


def named(found):
    """Definitions, without what lies between them."""
    return [(r.kind, r.name, r.start_line, r.end_line) for r in found if r.kind]


def test_rust_definitions(spark):
    found = spans(spark, "a.rs", RUST)
    assert [r.content for r in found if not r.kind] == ["use x;"]
    assert named(found) == [
        ("function", "main", 3, 5), ("struct", "Point", 7, 9), ("impl", "Point", 11, 15), ("method", "new", 12, 14)]
    assert all(RUST.encode()[r.byte_start:r.byte_end].decode() == r.content for r in found)


def test_python_definitions(spark):
    found = spans(spark, "a.py", PYTHON)
    assert [r.content for r in found if not r.kind] == ["import os"]
    assert named(found) == [
        ("function", "hello", 3, 4), ("class", "Greeter", 6, 11), ("method", "greet", 7, 8), ("method", "later", 10, 11), ("function", "top", 13, 14)]
    assert all(PYTHON.encode()[r.byte_start:r.byte_end].decode() == r.content for r in found)


@pytest.mark.parametrize("path, code, expected", [
    ("a.js", "class A {\n  x() {\n  }\n}\nfunction f(\n  a,\n)\n{\n}\n", [("class", "A", 1, 4), ("method", "x", 2, 3), ("function", "f", 5, 9)]),
    ("a.ts", "import x from 'y';\nexport default class A extends B {\n  async get(b) {\n    if (b) { run(b); }\n    return `}${b}`;\n  }\n}\nexport const f = async (a, b) => {\n  call(a);\n};\n"
             "const g = x => x + 1\nlet z = 3;\ntype T = { a: number };\n",
     [("class", "A", 2, 7), ("method", "get", 3, 6), ("function", "f", 8, 10), ("function", "g", 11, 11), ("type", "T", 13, 13)]),
    ("b.rs", "pub(crate) struct Zed<T> { a: T }\nstruct Unit;\n/* a /* fn no() { */ b } */\npub const fn a(x: &'a str) -> char {\n  let s = \"}\"; // {\n  let r = r#\"fn fake() { \"#;\n  '}'\n}\n"
             "impl<T> Display for Zed<T>\n{\n  async fn new() -> Self { Zed { a: 1 } }\n}\n",
     [("struct", "Zed", 1, 1), ("struct", "Unit", 2, 2), ("function", "a", 4, 8), ("impl", "Zed", 9, 12), ("method", "new", 11, 11)]),
    ("b.py", "@dec\ndef hello(\n    a,\n):\n    \"\"\"doc\ndef fake():\n    \"\"\"\n    return {\n1: 2}\n# tail\nclass G(B):\n    x = '#'\n    async def later(self):\n        pass\n    # end\ndef top(): return 1\n",
     [("function", "hello", 2, 9), ("class", "G", 11, 14), ("method", "later", 13, 14), ("function", "top", 16, 16)]),
    ("b.java", "public final class W<T> extends Q {\n  private int n = 0;\n  @Override\n  public static <T> List<T> get(int a, T b) throws E {\n    return new Foo(a);\n  }\n  int x() { String s = \"{\"; foo(s); return 1; }\n}\ninterface I { void m(int a); }\n",
     [("class", "W", 1, 8), ("method", "get", 4, 6), ("method", "x", 7, 7), ("interface", "I", 9, 9), ("method", "m", 9, 9)]),
    ("b.c", "#include <a.h>\nstruct point { int x; };\nstatic int add(int a, int b) {\n  if (a) { return f(a); }\n  struct point p;\n}\nint main() { char c = '{'; return 0; }\n",
     [("struct", "point", 2, 2), ("function", "add", 3, 6), ("function", "main", 7, 7)]),
    ("b.cs", "public class A {\n  public int X { get; set; }\n  public async Task<int> F(int a) { return 1; }\n}\n", [("class", "A", 1, 4), ("property", "X", 2, 2), ("method", "F", 3, 3)]),
    ("b.sh", "x=1\nfoo() {\n  echo '}'\n}\nfunction bar { ls; }\n", [("function", "foo", 2, 4), ("function", "bar", 5, 5)]),
    ("b.ps1", "<# function no { #>\nfunction Get-It { \"}\" }\n", [("function", "Get-It", 2, 2)]),
    ("b.sql", "CREATE OR REPLACE FUNCTION f() AS $$ begin; end $$ language x;\n-- CREATE TABLE no\ncreate view v as select ';';\n", [("function", "f", 1, 1), ("view", "v", 3, 3)]),
    ("b.kt", "open class A {\n  fun f(a: Int) = a\n  fun g(): Int { return 1 }\n}\nclass action is no definition\n", [("class", "A", 1, 4), ("method", "f", 2, 2), ("method", "g", 3, 3)]),
    ("a.go", "func (s *T) Run() {\n}\n\ntype T struct {\n}\n", [("function", "Run", 1, 2), ("type", "T", 4, 5)]),
    ("a.c", "int add(int a);\nint add(int a) {\n  return a;\n}\n", [("function", "add", 1, 1), ("function", "add", 2, 4)]),
    ("a.sql", "CREATE TABLE t (\n a int\n);\nCREATE FUNCTION f() AS x;\n", [("table", "t", 1, 3), ("function", "f", 4, 4)]),
    ("a.rs", "fn f() {\n  loop {\n", [("function", "f", 1, 2)]),
])
def test_other_languages(spark, path, code, expected):
    found = spans(spark, path, code)
    assert named(found) == expected
    raw = code.encode()
    assert all(raw[r.byte_start:r.byte_end].decode() == r.content for r in found)


@pytest.mark.parametrize("path", ["a.rs", "a.py", "a.js", "a.java", "a.c", "a.zz", "a.sql", "a.json", "a.html"])
def test_spans_cover_every_word(spark, path):
    """Whatever a file holds, each letter and digit is in some span."""
    rng = random.Random(path)
    parts = ["fn a() {", "}", "class B {", "def c(x):", "    return 1", "public int d(int e) {", "use x;", "// é {", '"open', "/* x", "*/", "", "word ", "CREATE TABLE f (", ");", "# g", "'", "`", "  static void h();", "((", "#define k {"]
    codes = ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, path, c) for i, c in enumerate(codes)], "i int, file_path string, file_content string")
    for row in P.parse_spans(df).collect():
        raw = codes[row.i].encode()
        seen = bytearray(len(raw))
        for s in row.spans:
            assert raw[s.byte_start:s.byte_end].decode() == s.content
            seen[s.byte_start:s.byte_end] = b"1" * (s.byte_end - s.byte_start)
        assert all(seen[k] for k, byte in enumerate(raw) if chr(byte).isalnum() or byte > 127), codes[row.i]


def test_long_files_take_time_in_proportion():
    import time

    from seamark.functions.scanning import definitions
    for style, language, unit in (("braces", "rust", 'pub fn a(x: i32) -> i32 {\n    let s = "}"; // {\n    x\n}\n'), ("indent", "python", "class A:\n    def f(self):\n        return 'x'\n\n")):
        took = []
        for n in (10_000, 40_000):
            start = time.perf_counter()
            assert len(definitions((unit * (n // 4)).encode(), language, style)) >= n // 4
            took.append(time.perf_counter() - start)
        assert took[1] < 10 * took[0]

def test_unknown_language_becomes_one_span(spark):
    found = spans(spark, "notes.zz", "hello\r\nworld\r\n")
    assert [(r.kind, r.name, r.content, r.start_line, r.end_line) for r in found] == [(None, None, "hello\nworld", 1, 2)]


@pytest.mark.parametrize("code", ["", None])
def test_empty_file_has_no_spans(spark, code):
    assert spans(spark, "a.rs", code) == []


def test_line_machine_keeps_its_quirks(spark):
    """The depth returns to zero at the parameter list; text between goes to the next definition."""
    found = spans(spark, "a.rs", "use x;\nfn main() {\n    body();\n}\nstruct P {\n  a: i32,\n}\n", mode="heuristic")
    assert [(r.kind, r.name, r.content, r.start_line, r.end_line) for r in found] == [
        ("function", "main()", "use x;\nfn main() {", 2, 2), ("class", "P", "    body();\n}\nstruct P {\n  a: i32,\n}", 5, 7)]
    found = spans(spark, "a.py", "import os\ndef f(a):\n    return a\n", mode="heuristic")
    assert [(r.kind, r.content, r.start_line, r.end_line) for r in found] == [
        ("function", "import os", 2, 1), (None, "def f(a):\n    return a", 2, 3)]


def test_line_machine_flushes_long_text(spark):
    found = spans(spark, "a.zz", "word " * 20 + "\n" + "word " * 20 + "\nend", mode="heuristic", max_tokens=20)
    assert [(r.start_line, r.end_line) for r in found] == [(1, 1), (2, 2), (3, 3)]


def test_composite_parser_takes_the_first_that_fits(spark):
    df = spark.createDataFrame([("a.rs", RUST), ("a.py", PYTHON), ("a.zz", "text")], "file_path string, file_content string")
    machine = lambda files: P.parse_spans(files, "heuristic")
    whole = lambda files: P.parse_spans(files)
    rows = C.rows_of(P.parse_composite(df, [({"rust"}, whole), ({"rust", "python"}, machine)]), "spans", "i", "file_path").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.file_path, []).append(r.kind)
    assert kinds["a.rs"] == [None, "function", "struct", "impl", "method"] and kinds["a.zz"] == [None]
    assert kinds["a.py"] == [r.kind for r in spans(spark, "a.py", PYTHON, mode="heuristic")]


def test_parsers_as_a_table_function(spark):
    def words(content, language, path):
        if "never" in content:
            raise NotImplementedError
        at = 0
        for word in content.split(" "):
            yield at, at + len(word.encode()), "word", word
            at += len(word.encode()) + 1

    parsers.register_parsers(spark, "parse_words", [("words", {"python"}, words), ("second", {"python", "go"}, lambda c, l, p: [(0, 1, None, p)])])
    df = spark.createDataFrame([("a.py", "é b\nc"), ("b.py", "def never():\n    pass"), ("c.go", "xy"), ("d.rs", RUST), ("e.py", None), ("f.zz", "text"), ("g.py", "")], "file_path string, file_content string")
    rows = parsers.span_rows(df, "parse_words", "file_path")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Exchange" not in plan
    got = {}
    for r in rows.orderBy("file_path", "span").collect():
        got.setdefault(r.file_path, []).append((r.parser, r.kind, r.name, r.start_line, r.end_line, r.content))
    assert got["a.py"] == [("words", "word", "é", 1, 1, "é"), ("words", "word", "b\nc", 1, 2, "b\nc")]
    assert got["b.py"] == [("fallback", "function", "never", 1, 2, "def never():\n    pass")] and got["c.go"] == [("second", None, "c.go", 1, 1, "x")]
    assert [g[:4] for g in got["d.rs"]][:2] == [("fallback", None, None, 1), ("fallback", "function", "main", 3)]
    assert "e.py" not in got and got["f.zz"] == [("fallback", None, None, 1, 1, "text")]
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM parse_words(1, 'python', 'a.py')").collect()


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        spans(spark, "a.rs", "x", mode="other")


@pytest.mark.parametrize("html, expected", [
    ("<html><style>p{}</style><p>one</p><!-- <p>no</p> --><script>\nvar t='</p>';</script><b>two</b></html>",
     [("element", "html", None), ("style", "style", "<style>p{}</style>"), ("element", "p", "<p>one</p>"), ("script", "script", "<script>\nvar t='</p>';</script>"), ("element", "b", "<b>two</b>")]),
    ("top <div><p>a<br>b<p>c</div> tail </i>", [(None, None, "top"), ("element", "div", "<div><p>a<br>b<p>c</div>"), ("element", "p", "<p>a<br>b"), ("element", "br", "<br>"),
                                                ("element", "p", "<p>c"), (None, None, "tail </i>")]),
    ("<ul><li>1<li><b>2</ul>", [("element", "ul", "<ul><li>1<li><b>2</ul>"), ("element", "li", "<li>1"), ("element", "li", "<li><b>2"), ("element", "b", "<b>2")]),
    ("<a title='x>y'><img src=a/></a", [("element", "a", None), ("element", "img", "<img src=a/>")]),
    ("é <p>ü", [(None, None, "é"), ("element", "p", "<p>ü")])])
def test_markup(spark, html, expected):
    found = spans(spark, "a.html", html)
    assert [(r.kind, r.name) for r in found] == [e[:2] for e in expected]
    assert all(e[2] in (None, r.content) for r, e in zip(found, expected))
    assert all(html.encode()[r.byte_start:r.byte_end].decode() == r.content for r in found)


def test_xml_has_no_void_elements(spark):
    found = spans(spark, "a.xml", "<?xml version='1'?><A><br>x</br><a/><![CDATA[<no>]]></A>")
    assert [(r.kind, r.name) for r in found] == [(None, None), ("element", "A"), ("element", "br"), ("element", "a")]


@pytest.mark.parametrize("language, code", [
    ("python", 'def a():\n    """%s'), ("rust", 'fn a() { "%s'), ("javascript", "function a() { `%s"), ("c", "int a() { /* %s"), ("java", 'void a() { """%s'), ("sql", "CREATE VIEW a AS SELECT '%s"), ("html", '<p title="%s')])
def test_a_string_that_never_ends(language, code):
    import tracemalloc

    from seamark.functions.scanning import definitions
    long = (code % ("x \\ y\n{ ' " * 100_000)).encode()
    tracemalloc.start()
    found = definitions(long, language, {"python": "indent", "sql": "none"}.get(language, "braces"))
    assert tracemalloc.get_traced_memory()[1] < 60 * len(long)
    tracemalloc.stop()
    assert language == "html" or (found and found[-1][1] <= len(long))


def test_many_open_tags_take_time_in_proportion():
    import time

    from seamark.functions.markup import elements
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        assert len(elements(b"<div><p>x</i>" * n)) == 2 * n
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0]


# ------------------------------------------------------------------- packing

SPAN = "array<struct<content:string,start_line:int,end_line:int,byte_start:bigint,byte_end:bigint,kind:string,name:string>>"


def count(text):
    word = sum(ch.isalpha() or ch.isnumeric() for ch in text)
    space = sum(ch.isspace() for ch in text)
    punct = sum(ch in r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""" for ch in text)
    other = len(text) - word - space - punct
    return ceil(word / 4.0 + punct * 0.8 + other * 0.9 + space * 0.1)


def packed(spark, rows, budget):
    df = spark.createDataFrame([(rows,)], f"spans {SPAN}")
    return [tuple(r) for r in C.chunk_rows(C.pack_spans(df, budget)).drop("chunk_index").collect()]


def brute(rows, hard, soft, overlap):
    """A second statement of the rules, over texts instead of indices."""
    defs = {"function", "method", "class", "struct", "enum", "trait", "impl", "interface"}
    out, cur = [], None

    def flush():
        nonlocal cur
        if cur is not None and cur["content"]:
            out.append(tuple(cur.values()))
        cur = None

    for content, l0, l1, b0, b1, kind, name in rows:
        t = count(content)
        if t > hard:
            flush()
            lines, have, start, pos = content.split("\n"), [], l0, b0
            for line in lines:
                lt = count(line + "\n")
                if have and sum(x for _, x in have) + lt > soft:
                    body = "\n".join(x for x, _ in have)
                    size = len(body.encode())
                    out.append((body, start, start + len(have) - 1, pos, pos + size, kind, name, sum(x for _, x in have)))
                    keep = []
                    for item in reversed(have):
                        if sum(x for _, x in keep) + item[1] > overlap:
                            break
                        keep.insert(0, item)
                    pos += size - (len("\n".join(x for x, _ in keep).encode()) if keep else 0)
                    start += len(have) - len(keep)
                    have = keep
                have.append((line, lt))
            out.append(("\n".join(x for x, _ in have), start, l1, pos, b1, kind, name, sum(x for _, x in have)))
            continue
        if cur is not None and cur["content"]:
            apart = kind in defs and cur["kind"] in defs and name and cur["name"] and name != cur["name"] and cur["t"] * 4 >= soft
            if cur["t"] + t > soft or apart:
                flush()
        if cur is None or not cur["content"]:
            cur = dict(content=content, l0=l0, l1=l1, b0=b0, b1=b1, kind=kind, name=name, t=t)
        else:
            cur.update(content=cur["content"] + "\n" + content, l1=l1, b1=b1, t=cur["t"] + t)
            if kind in defs:
                cur.update(kind=kind, name=name)
    flush()
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("hard, overlap", [(20, 0), (20, 6), (40, 10)])
def test_packing_equals_brute_force(spark, seed, hard, overlap):
    rng = random.Random(seed)
    rows, line, pos = [], 1, 0
    for _ in range(25):
        n = rng.choice([1, 1, 2, 3, 8])
        content = "\n".join(" ".join("wörd"[: rng.randint(1, 4)] * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) for _ in range(n))
        size = len(content.encode())
        rows.append((content, line, line + n - 1, pos, pos + size, rng.choice(["function", "class", "comment", None]), rng.choice(["a", "b", None])))
        line, pos = line + n, pos + size + 1
    budget = C.TokenBudget(hard, overlap)
    assert packed(spark, rows, budget) == brute(rows, hard, budget.soft, overlap)


def test_definitions_of_different_name_part_only_when_substantive(spark):
    body = "x = compute the value of something large; " * 4
    big = [(body, 1, 1, 0, 168, "function", "a"), (body, 2, 2, 169, 337, "function", "b")]
    assert len(packed(spark, big, C.TokenBudget(160))) == 2
    same = [(body, 1, 1, 0, 168, "function", "a"), (body, 2, 2, 169, 337, "function", "a")]
    assert len(packed(spark, same, C.TokenBudget(160))) == 1
    tiny = [("fn a", 1, 1, 0, 4, "function", "a"), ("fn b", 2, 2, 5, 9, "function", "b")]
    assert len(packed(spark, tiny, C.TokenBudget(200))) == 1


def test_budget():
    assert C.TokenBudget(512).soft == 460 and C.TokenBudget(10).soft == 9


def parts(spark, unit, max_tokens, **kw):
    df = spark.createDataFrame([([unit],)], f"spans {SPAN}")
    return C.chunk_rows(C.split_large_spans(df, max_tokens, **kw)).collect()


def test_small_unit_stays_whole(spark):
    got = parts(spark, ("fn a() {}", 1, 1, 0, 9, "function", "a"), 100)
    assert [(r.content, r.kind, r.byte_start, r.byte_end) for r in got] == [("fn a() {}", "function", 0, 9)]


def test_windows_join_back_to_the_unit(spark):
    text = "\n".join("some words é here" for _ in range(40))
    got = parts(spark, (text, 5, 44, 100, 100 + len(text.encode()), "function", "f"), 30)
    assert "".join(r.content for r in got) == text
    assert [r.kind for r in got] == [f"function_part{i + 1}" for i in range(len(got))]
    assert got[0].byte_start == 100 and got[-1].byte_end == 100 + len(text.encode())
    assert all(a.byte_end == b.byte_start for a, b in zip(got, got[1:]))


def test_class_parts_repeat_the_header(spark):
    text = "class A {\n" + "\n".join(f"  method number {i} does work" for i in range(30)) + "\n}"
    got = parts(spark, (text, 1, 32, 0, len(text), "class", "A"), 40)
    assert len(got) > 2 and all(r.content.startswith("class A {\n    // ... (continued)\n") for r in got)
    body = [line for r in got for line in r.content.split("\n")[2:]]
    assert body == text.split("\n")[1:]
    assert all(text[r.byte_start:r.byte_end] == "\n".join(r.content.split("\n")[2:]) for r in got)
    assert len({(r.byte_start, r.byte_end) for r in got}) == len(got)


def test_halves_overlap(spark):
    text = "\n".join(f"line {i}" for i in range(100))
    got = parts(spark, (text, 1, 100, 0, len(text), "function", "f"), 50, tokenize=lambda c: F.array(c))
    first, second = (r.content.split("\n") for r in got)
    assert first == text.split("\n")[:60] and second == text.split("\n")[50:]
