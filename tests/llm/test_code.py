"""Problems 1, 3 and 6: functions with documentation, files that do not parse, files not written by hand."""

from __future__ import annotations

import pytest

from codelattice.llm import funcdocs, provenance, syntax
from codelattice.llm.grammars import folded, kinds_javascript, language_of, parses

VALID = {
    ("python", False): ["x = 1\n", "def f(a, *b, c=1):\n    return [i for i in b]\n", ""],
    ("python", True): ["def f(self):\n            return 1\n", "    @staticmethod\n    def f():\n        pass\n", "async def f():\n    pass"],
    ("javascript", False): [
        "const a = require('b')\nlet x = a.b(c)[0]\nfoo(x)\n", "class A extends B { static x = 1; get y() { return `a${this.x + `b`}`; } async *z() {} }\n", "for (const [k, v] of m) { if (/a[/]b/.test(k)) continue; }\n",
        "export default function () { return a ? b : (c) => ({ d: 1 }); }\n", "try { a() } catch { b() } finally { c() }\nswitch (x) { case 1: break; default: y() }\n", "do { x++ } while (x < 3)\nlabel: for (;;) { break label }\n",
    ],
    ("javascript", True): ["static async f(a, { b }, ...c) { return a / b / c }", "const f = (a) => { return a; };", "/** x */\nfunction f() {}\n", "get x() { return 1; }"],
    ("java", False): [
        "package a.b;\nimport java.util.*;\n@Anno(x = 1)\npublic class A<T extends B & C> implements D { int[] x = {1, 2}; A() { super(); } <U> U f(List<? super T> a, int... b) throws E { return (U) a.get(0); } }\n",
        "enum E { A(1) { void f() {} }, B; E() {} }\ninterface I { default int f() { return 1 > 2 ? 3 : 4; } int g(); }\n", "class A { void f() { for (Map.Entry<String, List<Integer>> e : m.entrySet()) { x = y -> z; } int a = b >> 2 >>> 1; String s = \"\"\"\n a \"b\" \"\"\"; } }\n",
    ],
    ("java", True): ["@Override\npublic static Map<String, Integer> f(final int a) { var x = new int[]{1}; return null; }", "private <T> void f(T t) throws A, B { synchronized (this) { g(); } }"],
    ("go", False): ['package a\n\nimport (\n\t"b"\n\tc "d"\n)\n\ntype S struct {\n\tx int `json:"x"`\n\t*T\n}\n\nfunc (s *S) F(a, b int, c ...string) (int, error) {\n\tif v, ok := m[a]; ok && v > 0 {\n\t\treturn v, nil\n\t}\n\tfor i := range []int{1, 2} {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int:\n\t\tbreak\n\tdefault:\n\t}\n\treturn S{x: 1}.x, nil\n}\n'],
    ("go", True): ["func f(a []string, m map[string]int) error {\n\treturn nil\n}\n"],
    ("php", False): ["<?php\nnamespace A\\B;\nuse C\\D as E;\nabstract class F extends G implements H { const X = ['a' => 1]; private ?int $y = null; public static function f(int|string $a, &...$b): ?self { return static::g(...$b)->h['k'] ?? new E($a); } }\n", "<p>x</p><?php foreach ($a as $k => &$v): echo $v; endforeach; ?>\n<b>"],
    ("php", True): ["public function f($a) { if ($a) { return 1; } elseif (!$a) { return fn($x) => $x . 'y'; } else { echo <<<EOT\n } {\nEOT; } }"],
    ("ruby", False): ["require 'a'\n\nmodule M\n  class A < B\n    attr_reader :x, :y\n    X = { a: 1, 'b' => [2] }.freeze\n    def f(a, b = 1, *c, d:, **e, &g)\n      return if a.nil?\n      puts \"x#{a + \"y\"}\" unless b\n      c.map { |i| i * 2 }.each do |j|\n        yield j\n      end\n    rescue E => err\n      raise\n    ensure\n      z\n    end\n  end\nend\n", "case x\nwhen 1, 2 then a\nelse\n  b\nend\nwhile i < 3 do i += 1 end\ny = if a then b else c end\nt = <<~EOS\n  end )\nEOS\n"],
    ("ruby", True): ["def self.f(a)\n  a ? 1 : 2\nend\n", "def x?; true; end"],
}
BROKEN = {
    "python": ["def f(:\n  pass", "print 'a'", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = (1,\n", "if a &gt; b:\n    pass\n"],
    "javascript": ["function f( { }", "let x = ;", "if (a) { b()", "class A { foo() }", "let = = 3;", "x = `a${b`", "def f():\n  pass\n", "a b c\n", "foo(1 2)", "1 = 2;", "x = 'a' = 3;"],
    "java": ["class A { void f() { return 1 } }", "class A { void f() { x = 1; }", "public class { }", "class A { return x; }", "class A { int x = ; }"],
    "go": ["package a\nfunc f() {\n", "package a\nfunc f() { x := }\n", "func f() {}\n", "package a\nvar x = \"a\n", "package a\n}\n"],
    "php": ["<?php function f( { }", "<?php $x = ;", "<?php if ($a) {", "no tag", "<?php class A { echo 1; }", "<?php 1 = 2;"],
    "ruby": ["def f\n  x\n", "class A\nend\nend\n", "x = (1 + \n", "if a\n  b\n", "foo(a b c\n", "class a\nend\n", "1 = 2\n"],
}


@pytest.mark.parametrize(("language", "unit"), sorted(VALID))
def test_valid_code_passes(language, unit):
    for text in VALID[language, unit]:
        assert parses(text, language, unit), text
        assert parses(text.replace("\n", "\r\n"), language, unit), text


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("javascript", "if (a) /re/.test(b);\n"), ("javascript", "while (a(b)) /[(]/.exec(c);\nvar y = (a) / b / c;\n"), ("javascript", "a.b = c[1] = 'x';\nf(a = 1);\nvar {q = 1} = z;\n"),
        ("php", "<?php function f() { yield from g(); yield; $x = yield $k => $v; foo(yield $a); return (yield); }\n"), ("php", "<?php $a->yield(); function from() {} from();\n"),
        ("ruby", "case x\nin {a: Integer => n}\n  puts n\nin {b:}\n  y\nend\n"), ("ruby", "class A < B\n  class << self\n    def x; end\n  end\nend\nmodule M::N\nend\nx.class\n"),
    ],
)
def test_more_valid_code_passes(language, text):
    assert parses(text, language, False)


def test_functions_after_patterns_and_open_brackets_are_found():
    text = "// Tells whether the text has a bracket.\nfunction a(s) { return /\\(/.test(s); }\n// Tells whether the text has another one.\nfunction b(s) { if (s) /[{]/.exec(s); return s / 2 / 1; }\n// Gives back the fourth of all numbers.\nfunction d() { return 1; }\n"
    assert [n for n, _ in funcdocs.documented(text, "javascript", None)] == ["a", "b", "d"]


@pytest.mark.parametrize("language", sorted(BROKEN))
def test_broken_code_fails(language):
    for text in BROKEN[language]:
        assert not parses(text, language, False), text


def test_a_unit_is_one_declaration():
    assert not parses("def f():\n    pass\ndef g():\n    pass\n", "python", True) and not parses("x = 1\n", "python", True)
    assert not parses("function f() {}\nfunction g() {}\n", "javascript", True)


def test_folding_keeps_the_verdict_and_shrinks():
    text = "function f(a) {\n" + "  let x = g(a.b(1), (a * 2));\n  if (x == 1) { y += x; } else { h(); }\n" * 50 + "}\n"
    kinds = kinds_javascript(text)
    assert len(folded(kinds, "javascript", False)) < 5 < len(kinds)


def test_language_falls_back_to_the_path():
    assert language_of(" PYTHON", "x.rb") == "python" and language_of(None, "a/b.Rb") == "ruby" and language_of("??", "x.go") == "go" and language_of(None, "README") is None


def test_syntax_rows(docs_of, odd):
    docs = docs_of(
        ("ok", "a.py", None, "x = 1\n"), ("cut", "a.py", None, "def f(:\n"), ("other", "a.py", None, "package a\n\nfunc f() int {\n\treturn 1\n}\n"), ("null", "a.py", None, None), ("empty", "a.py", None, ""),
        ("unknown", "a.txt", None, "x"), ("cut", "a.py", None, "def f(:\n"), ("none", None, None, "x"),
    )
    got = {r["doc_id"]: (r["valid"], r["parses_as"], r["cause"]) for r in syntax.check_syntax(odd(docs)).collect()}
    assert got == {"ok": (True, None, None), "cut": (False, None, "corrupt"), "other": (False, "go", "wrong language"), "unknown": (None, None, "unknown language"), "none": (None, None, "unknown language")}
    rates = {r["language"]: (r["files"], r["invalid_share"]) for r in syntax.invalid_rates(docs).collect()}
    assert rates == {"python": (3, 0.666667)}


def test_what_cannot_be_decided_is_told(docs_of, monkeypatch):
    monkeypatch.setattr(syntax, "parses", lambda text, language, unit: None if "deep" in text else True)
    assert syntax.verdict("deep", "go", False) == (None, None) and syntax.verdict("x", "go", False) == (True, None)
    rows = syntax._verdicts({n: [v] for n, v in (("doc_id", "a"), ("repo", "r"), ("path", "a.go"), ("func_name", None), ("code", "deep"), ("language", None))})
    assert rows["valid"] == [None] and rows["cause"] == ["undecided"]


PY = '''import os

text = """def inner():
    \'\'\'Words that are inside of a string.\'\'\'
"""

class A:
    def method(self):
        """Walks the tree and returns every leaf."""
        def nested():
            """This nested function does not count at all."""
        return nested

    def empty(self): pass

def load_all_items(a):
    """Load all items.

    Args:
        a: the thing that should be loaded in the end.

    Returns:
        a list of things which were loaded.
    """

def later():
    """TODO: write the documentation of this function."""

def promised():
    """Reads the file. TODO: close the handle as well."""
'''
JS = """/** Copyright notice of some length here. */

const a = 1;

// Adds two numbers and returns their sum.
// @param {number} a one of the numbers
const add = (a, b) => { return a + b; };

/*
 * Keeps track of every open window.
 */
class Store {
  /** Finds the item that has the key. */
  async find(key) { if (key) { return g(function inner() {}); } }

  // not directly before it

  plain() { return 1; }
}

function quiet() {} // said after the declaration only
"""
JAVA = "package a;\n\nclass A {\n  /** Builds the index out of all parts. */\n  @Override\n  public Map<String, Integer> build(int a) throws E { return new B() { void run() {} }; }\n\n  /** {@inheritDoc} */\n  int same() { return 1; }\n}\n"
GO = "package a\n\n// Run starts the worker and waits for it.\nfunc (w *Worker) Run(n int) error {\n\treturn nil\n}\n\n// run\nfunc run() {}\n"
RUBY = "class A\n  # Sorts the list in place, largest first.\n  # @return [Array] the sorted list\n  def sort_it(a)\n    a.each do |x|\n      if x then y end\n    end\n  end\n\n  # See above.\n  def other; end\nend\n\n# Prints all the rows of a table.\ndef show(t)\nend\n"
PHP = "<?php\nclass A {\n    /**\n     * Gives back the first of the rows.\n     * @param int $a some\n     * @return mixed the result\n     */\n    #[Pure]\n    public static function first($a) { return 1; }\n}\n\n// Opens the connection to a server.\nfunction open_it() { }\n"


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("python", PY, {"A.method", "promised"}), ("javascript", JS, {"add", "Store.find"}), ("java", JAVA, {"A.build"}), ("go", GO, {"Worker.Run"}), ("ruby", RUBY, {"A.sort_it", "show"}), ("php", PHP, {"A.first", "open_it"}),
    ],
)
def test_functions_with_documentation(language, text, want):
    assert {n for n, _ in funcdocs.documented(text, language, None)} == want
    assert {n for n, _ in funcdocs.documented(text.replace("\n", "\r\n"), language, None)} == want


def test_pairs_have_the_code_of_the_function(docs_of):
    code = lambda language, text: {n: c for n, _, c in funcdocs.documented_code(text, language, None)}
    py = code("python", PY.replace("    def method(self):", "    @cached(\n        1,\n    )\n    @other\n    def method(self):"))
    assert py["A.method"].startswith("    @cached(\n") and py["A.method"].endswith("return nested") and py["promised"].startswith("def promised():\n") and py["promised"].endswith('well."""')
    js = code("javascript", JS)
    assert js == {"add": "const add = (a, b) => { return a + b; }", "Store.find": "async find(key) { if (key) { return g(function inner() {}); } }"}
    assert code("javascript", "// Adds one to the given number.\nconst f = (a) => g(a,\n  1) + 1;\nconst b = 2;\n") == {"f": "const f = (a) => g(a,\n  1) + 1;"}
    assert code("java", JAVA) == {"A.build": "@Override\n  public Map<String, Integer> build(int a) throws E { return new B() { void run() {} }; }"}
    assert code("go", GO) == {"Worker.Run": "func (w *Worker) Run(n int) error {\n\treturn nil\n}"}
    assert code("ruby", RUBY) == {"A.sort_it": "  def sort_it(a)\n    a.each do |x|\n      if x then y end\n    end\n  end", "show": "def show(t)\nend"}
    assert code("php", PHP) == {"A.first": "#[Pure]\n    public static function first($a) { return 1; }", "open_it": "function open_it() { }"}
    twice = "class A {\n  /** Gives the number of open files. */\n  int f(int a) { return 1; }\n  /** Gives the number of open files. */\n  int f(long a) { return 2; }\n}\n"
    rows = funcdocs.function_docs(docs_of(("a", "A.java", None, twice), ("b", "A.java", "A.f", "// Gives the number of open files.\n@X\nint f() { return 1; }"))).collect()
    assert sorted(r["code"] for r in rows) == ["@X\nint f() { return 1; }", "int f(int a) { return 1; }", "int f(long a) { return 2; }"]


@pytest.mark.parametrize(
    ("doc", "real"),
    [
        ("Returns the sum of both.", True), ("", False), (None, False), ("load all items", False), ("TODO", False), ("Description goes here", False), ("Documentation to be written by the next maintainer.", False), ("[Insert summary of the function here]", False),
        ("Auto-generated method stub, please document.", False), ("Gibt die fertige Liste zurück.", True), (":param x: a very long text about it\n:return: another long text", False), ("Counts TODO markers in every file of it.", True),
        ("Parameters\n----------\na : int\n    the number of things to do", False), ("Splits the text.\n\nParameters\n----------\na : int\n", False),
    ],
)
def test_what_documentation_says(doc, real):
    assert funcdocs.is_real(doc, "load_all_items") is real


def test_function_rows(docs_of, odd):
    docs = docs_of(
        ("a", "x.py", "f", 'def f():\n    """Gives the number of open files."""\n    return 1\n'), ("a", "x.py", "f", 'def f():\n    """Gives the number of open files."""\n    return 1\n'),
        ("b", "x.js", "C.f", "// Gives the number of open files.\nf(a) { return a; }\n"), ("broken", "x.js", "C.f", "// Gives the number of open files.\nf(a) { return a;\n"), ("c", "x.java", "A.g", "/** Gives the number of open files. */\n@Override\nint g() { return 1; }"),
        ("n", "x.py", "f", None), ("e", "x.py", None, ""), ("far", "x.go", "f", "// Gives the number of open files.\n\nfunc f() {}\n"), ("p", None, "f", "def f(): pass"),
    )
    assert sorted(map(tuple, funcdocs.found(odd(docs)).collect())) == [("a", "f"), ("b", "C.f"), ("c", "A.g")]


def test_files_not_written_by_hand(docs_of, odd):
    blob = "DATA = [" + ", ".join(str(i * 7 % 997) for i in range(900)) + "]\n"
    small = "function f(a,b){if(a){return b}else{return a}};" * 30
    rows = {
        "vendor": ("lib/vendor/x.py", "x = 1\n"), "vendors": ("apps/vendors/x.py", "x = 1\n"), "codegen": ("codegen/x.py", "x = 1\n"), "pb": ("a/b_pb2.py", "x = 1\n"), "min": ("web/a.min.js", "x\n"), "bundle_word": ("a/my_bundle.js", "let x = 1;\n"),
        "notice": ("a/b.go", "// Code generated by protoc. DO NOT EDIT.\n\npackage a\n"), "mention": ("a/b.go", "package a\n\n// writes an auto-generated header: DO NOT EDIT\nfunc f() {}\n"), "own": ("a/b.py", "# Copyright the proj authors.\nx = 1\n"),
        "foreign": ("a/b.py", "# This module is part of other, not of proj.\n# Copyright the other developers.\nx = 1\n"), "text": ("a/b.py", 'note = """Code generated by x. DO NOT EDIT."""\n'), "blob": ("a/b.py", blob), "shrunk": ("a/b.js", small + "\n"), "table": ("a/b.py", "T = {'a': 1, 'b': 2}\n"),
        "foot": ("a/b.py", "x = 1\n\n# AUTO-GENERATED FILE - edit x.tmpl instead\n"), "foot_js": ("a/b.js", "let x = 1;\n\n/*\n * Autogenerated with gen on 2021-11-08\n */"), "foot_text": ("a/b.py", "x = '# do not edit'\n"),
        "german": ("a/b.rb", "# Diese Datei wurde automatisch erzeugt.\nx = 1\n"),
    }
    moved = "# Copyright the tool authors.\n# Part of else/tool, made to sort.\nx = 1\n"
    docs = docs_of(
        *((k, p, None, c) for k, (p, c) in rows.items()), ("null", None, None, None), ("nopath", None, None, "x = 1", None), ("original", "a/b.py", None, moved, "else/tool"), ("moved", "a/b.py", None, moved),
        ("away", "a/b.py", None, moved.replace("tool", "gone")), ("more", "a/b.py", None, moved + "# Bundled copy of it.\n"),
    )
    got = {r["doc_id"]: r["kind"] for r in provenance.not_handwritten(odd(docs)).collect()}
    assert {r["doc_id"] for r in provenance.found(docs).collect()} == set(got) - {"moved"} and [got.pop(x) for x in ("moved", "away", "more")] == ["moved", "copied", "copied"]
    assert got == {"vendor": "vendored", "pb": "generated", "min": "minified", "notice": "generated", "foreign": "copied", "blob": "data", "shrunk": "minified", "german": "generated", "foot": "generated", "foot_js": "generated"}


def test_empty_tables_and_long_texts(spark, docs_of):
    none = docs_of(("a", "x.py", None, "x")).where("false")
    assert funcdocs.found(none).count() == syntax.invalid(none).count() == provenance.found(none).count() == 0
    long = docs_of(("long", "x.js", None, "let a = f(1, [2, 3]);\n" * 60_000), ("deep", "y.js", None, "x = " + "(" * 3000 + "1" + ")" * 3000 + ";\n"), ("py", "z.py", None, "x = 1\n" * 60_000))
    assert syntax.invalid(long).count() == 0 and funcdocs.found(long).count() == 0 and provenance.found(long).count() == 0
