"""Token scanners and syntax grammars of the supported languages.

A scanner turns source text into a *kind string*: one character per token, so that a whole file's syntax is a
short string over a small alphabet.  A grammar is a recursive pattern over kind strings, written with possessive
quantifiers and atomic groups: it decides like a parsing-expression grammar, in one C-level pass and without
backtracking into matched rules.  Python is parsed by the interpreter's own parser.

Only syntax is judged, never names or types.
"""

from __future__ import annotations

import ast
import re
import warnings
from functools import lru_cache

import regex

LANGUAGES = ("python", "javascript", "java", "go", "php", "ruby")
EXTENSIONS = {
    "py": "python", "pyw": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "go": "go", "php": "php", "phtml": "php", "rb": "ruby", "rake": "ruby",
}
_SPELLINGS = {"py": "python", "python3": "python", "js": "javascript", "node": "javascript", "golang": "go", "rb": "ruby"}


@lru_cache(65536)
def language_of(language: str | None, path: str | None) -> str | None:
    """The row's language: its column if that names a supported language however written, else the path's extension."""
    name = (language or "").strip().lower()
    name = _SPELLINGS.get(name, name)
    if name in LANGUAGES:
        return name
    base = (path or "").rsplit("/", 1)[-1]
    return EXTENSIONS.get(base.rsplit(".", 1)[-1].lower()) if "." in base else None


class Broken(ValueError):
    """The text can't be cut into tokens."""


def _table(text: str) -> dict[str, str]:
    """Kinds by token; text holds a kind and then its tokens on each line."""
    return {t: line[0] for line in (x.strip() for x in text.strip().splitlines()) for t in line[1:].split()}


# ---------------------------------------------------------------- brace languages

_JS_WORDS = _table("""
    F function
    C class
    R return throw
    Y async
    J await typeof void delete new
    V var let const
    I if with
    L else
    W while
    D do
    O for
    f of
    g in instanceof
    T try
    K catch
    P finally
    S switch
    c case
    d default
    B break continue debugger
    X export
    M import
    m from as
    e extends
    t static get set
    y yield
    i this super null true false
""")
_JS_OPS = _table("""
    a += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
    b / % ** == != === !== <= >= && || ?? & | ^ << >> >>> < >
    + + -
    ^ ++ --
    ! ! ~
    > =>
    . ?.
    E ...
""")
_JAVA_WORDS = _table("""
    M public private protected static final abstract synchronized native transient volatile strictfp sealed
    d default
    p package
    Q import
    C class interface enum
    e extends implements permits
    h throws
    t int long boolean double float char byte short void
    R return throw
    w new
    I if
    L else
    W while
    D do
    O for
    T try
    K catch
    P finally
    S switch
    c case
    B break continue
    A assert
    q instanceof
    i this super
    n null true false
""")
_JAVA_OPS = _table("""
    a += -= *= /= %= <<= >>= >>>= &= |= ^=
    b / % == != <= >= && || ^ <<
    + + -
    ^ ++ --
    ! ! ~
    l ->
    u ::
    E ...
""")
_GO_WORDS = _table("""
    p package
    Q import
    F func
    t type
    s struct
    j interface
    m map
    h chan
    V var const
    R return
    I if
    L else
    O for
    x range
    S switch
    y select
    c case
    d default
    G go defer
    B break continue fallthrough
    g goto
""")
_GO_OPS = _table("""
    a += -= *= /= %= <<= >>= &= |= ^= &^=
    D :=
    b / % == != <= >= < > && || << >> | &^
    + + - ^
    ^ ++ --
    ! ! ~
    l <-
    E ...
""")
_PHP_WORDS = _table("""
    F function fn
    C class trait interface enum
    n new clone print include include_once require require_once throw
    y yield
    M public private protected static final abstract var readonly
    k const
    N namespace
    U use
    x extends implements
    R return echo
    B break continue
    I if elseif
    L else
    e endif endwhile endfor endforeach endswitch
    W while
    D do
    O for
    f foreach
    A as
    T try
    K catch
    P finally
    S switch
    c case
    d default
    g instanceof insteadof
    G global
    b and or xor
""")
_PHP_OPS = _table("""
    a += -= *= /= %= .= **= ??= <<= >>= &= |= ^=
    b / % ** == != === !== <> <= >= < > <=> && || ?? ^ << >> . *
    + + -
    ^ ++ --
    ! ! ~ @
    > =>
    p -> ?->
    q ::
    E ...
""")
_RUBY_WORDS = _table("""
    d def
    C class
    M module
    I if unless
    W while until
    O for
    c case
    w when
    B begin
    o do
    E end
    L else
    l elsif
    v rescue
    e ensure
    t then
    R return break next redo retry
    y yield
    q not
    k and or
    g in
    a alias undef
    ! defined?
    i self nil true false super __FILE__ __LINE__ __method__
""")
_RUBY_OPS = _table("""
    A += -= *= /= %= **= ||= &&= |= &= ^= <<= >>=
    b / % == != === =~ !~ <= >= <=> > << >> && || ^ .. ...
    + + -
    ! ! ~
    > =>
    . &.
    f ->
    u ::
    S **
""")

_SPACE = r"[^\S\n]+"
_NUMBER = r"0[xX][0-9a-fA-F_]+[lLn]?|0[bB][01_]+[lLn]?|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdDni]?"
_DQ = r'"(?:[^"\\\n]|\\[^\n]|\\\n)*+"'
_SQ = r"'(?:[^'\\\n]|\\[^\n]|\\\n)*+'"
_C_COMMENT = r"/\*(?s:.*?)\*/"


def _scanner(*parts: tuple[str, str], space: str = "") -> re.Pattern:
    """One pattern for any token; ``space`` is what may stand before it."""
    return re.compile(space + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in parts) + ")")


_SCAN = {
    "javascript": _scanner(
        ("w", r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\#[A-Za-z_]\w*"), ("l", r"\n\s*"), ("c", rf"//[^\n]*|{_C_COMMENT}"),
        ("q", rf"{_DQ}|{_SQ}"), ("n", _NUMBER), ("t", "`"),
        ("o", r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:.,;(){}\[\]]"), space=r"[^\S\n]*",
    ),
    "java": _scanner(
        ("w", r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"), ("c", rf"//[^\n]*|{_C_COMMENT}"),
        ("q", rf'"""[^\n]*\n(?s:(?:[^\\"]|\\.|"(?!""))*)"""|{_DQ}'), ("k", r"'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"), ("n", _NUMBER),
        ("o", r">>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:.,;(){}\[\]@]"), space=r"\s*",
    ),
    "go": _scanner(
        ("w", r"[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*"), ("l", r"\n\s*"), ("c", rf"//[^\n]*|{_C_COMMENT}"),
        ("q", rf'"(?:[^"\\\n]|\\.)*+"|`[^`]*`'), ("k", r"'(?:[^'\\\n]|\\[xuU]?[0-9a-fA-F]+|\\.)'"), ("n", _NUMBER),
        ("o", r"<<=|>>=|&\^=|\.\.\.|:=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^!~<>=:.,;(){}\[\]]"), space=r"[^\S\n]*",
    ),
    "php": _scanner(
        ("w", r"\\?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*(?:\\[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*)*\\?"), ("v", r"\$+[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*"),
        ("x", r"\?>"), ("c", rf"\#\[[^\]\n]*\]|(?://|\#)(?:(?!\?>)[^\n])*|{_C_COMMENT}"),
        ("h", r"<<<[ \t]*(?P<hq>[\"']?)(?P<ht>[A-Za-z_]\w*)(?P=hq)[ \t]*\n(?s:.*?)(?:^|(?<=\n))[ \t]*(?P=ht)\b"),
        ("q", r"\"(?s:[^\"\\]|\\.)*+\"|'(?s:[^'\\]|\\.)*+'|`(?s:[^`\\]|\\.)*+`"), ("n", _NUMBER),
        ("o", r"<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|=>|->|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:.,;(){}\[\]@$]"), space=r"\s*",
    ),
}

_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
#: Kinds after which a JavaScript slash starts a pattern, not a division.
_BEFORE_REGEX = set("(,=:[!&|?{};ab+-*>^RJcgfL")
#: Kinds that can end an operand, and kinds that carry an expression on after a line break.
_JS_ENDS, _JS_GOES_ON = set("insk)]}^BRtmfYdy"), set("})],;.:?=ab*>gELKP(")


def _template(text: str, at: int) -> int:
    """The place after the template literal whose backtick is just before ``at``."""
    depth: list[int] = []
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
            continue
        if not depth:
            if c == "`":
                return at + 1
            if c == "$" and text.startswith("${", at):
                depth.append(1)
                at += 2
                continue
        elif c == "{":
            depth[-1] += 1
        elif c == "}":
            depth[-1] -= 1
            if not depth[-1]:
                depth.pop()
        elif c == "`":
            at = _template(text, at + 1)
            continue
        elif c in "\"'":
            m = re.compile(_DQ if c == '"' else _SQ).match(text, at)
            if not m:
                raise Broken("string in template")
            at = m.end()
            continue
        at += 1
    raise Broken("template literal not closed")


def kinds_javascript(text: str) -> str:
    out: list[str] = []
    words, ops, match = _JS_WORDS, _JS_OPS, _SCAN["javascript"].match
    at, n, line, last = 0, len(text), False, ";"
    open_headers: list[bool] = []  # for each open parenthesis whether it is a control statement's
    header = False  # the last closed parenthesis was one
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    while at < n:
        m = match(text, at)
        if m is None:
            raise Broken(f"character {text[at]!r}")
        g, at = m.lastgroup, m.end()
        if g == "l" or g == "c":
            line = line or g == "l" or "\n" in m[0]
            continue
        if g == "w":
            k = words.get(m["w"], "i")
            if last == "." and k != "i":
                k = "i"
        elif g == "n":
            k = "n"
            if at < n and (text[at].isalpha() or text[at] == "_"):
                raise Broken("name after number")
        elif g == "q":
            k = "s"
        elif g == "t":
            at, k = _template(text, at), "k"
        else:
            o = m["o"]
            if o[0] == "/" and (last in _BEFORE_REGEX or last == ")" and header):
                r = _JS_REGEX.match(text, m.start("o"))
                if r is None:
                    raise Broken("pattern not closed")
                at, k = r.end(), "s"
            else:
                k = ops.get(o, o)
                if o == "(":
                    open_headers.append(last in "IWO")
                elif o == ")":
                    header = bool(open_headers) and open_headers.pop()
        if line:
            if last in _JS_ENDS and k not in _JS_GOES_ON and not (last == ")" and k == "{"):
                out.append("N")
            line = False
        out.append(k)
        last = k
    return "".join(out)


def kinds_java(text: str) -> str:
    out: list[str] = []
    words, ops = _JAVA_WORDS, _JAVA_OPS
    at = 0
    for m in _SCAN["java"].finditer(text):
        if m.start() != at:
            raise Broken(f"character {text[at]!r}")
        g, at = m.lastgroup, m.end()
        if g == "c":
            continue
        if g == "w":
            k = words.get(m["w"], "i")
            if k == "C" and out and out[-1] == ".":
                k = "i"
        elif g == "o":
            k = ops.get(m["o"], m["o"])
        elif g == "n":
            k = "n"
            if at < len(text) and (text[at].isalpha() or text[at] == "_"):
                raise Broken("name after number")
        else:
            k = "n"
        out.append(k)
    if at != len(text):
        raise Broken(f"character {text[at]!r}")
    return "".join(out)


_GO_ENDS = set("inRB^)]}")


def kinds_go(text: str) -> str:
    out: list[str] = []
    words, ops = _GO_WORDS, _GO_OPS
    at, last = 0, ";"
    for m in _SCAN["go"].finditer(text):
        if m.start() != at:
            raise Broken(f"character {text[at]!r}")
        g, at = m.lastgroup, m.end()
        if g == "l" or g == "c":
            if last in _GO_ENDS and (g == "l" or "\n" in m[0]):
                out.append(";")
                last = ";"
            continue
        if g == "w":
            k = words.get(m["w"], "i")
        elif g == "o":
            k = ops.get(m["o"], m["o"])
        elif g == "n":
            k = "n"
            if at < len(text) and (text[at].isalpha() or text[at] == "_"):
                raise Broken("name after number")
        else:
            k = "n"
        out.append(k)
        last = k
    if at != len(text):
        raise Broken(f"character {text[at]!r}")
    if last in _GO_ENDS:
        out.append(";")
    return "".join(out)


_PHP_OPEN = re.compile(r"<\?(?:php\b|=|(?=\s))", re.I)


def kinds_php(text: str, inside: bool = False) -> str:
    """``inside``: the text is code, an opening tag is not needed."""
    out: list[str] = []
    words, ops, scan = _PHP_WORDS, _PHP_OPS, _SCAN["php"]
    at, n = 0, len(text)
    if not inside or _PHP_OPEN.match(text.lstrip()):
        m = _PHP_OPEN.search(text)
        if m is None:
            raise Broken("no opening tag")
        at = m.end()
    while at < n:
        closed = False
        for m in scan.finditer(text, at):
            if m.start() != at:
                raise Broken(f"character {text[at]!r}")
            g, at = m.lastgroup, m.end()
            if g == "c":
                continue
            if g == "w":
                k = words.get(m["w"].lower(), "i")
                if out and out[-1] in "pq":
                    k = "i"
                elif out and out[-1] == "y" and m["w"].lower() == "from":
                    continue
            elif g == "v":
                k = "v"
            elif g == "o":
                k = ops.get(m["o"], m["o"])
            elif g == "x":
                out.append(";")
                m = _PHP_OPEN.search(text, at)
                at, closed = (m.end() if m else n), True
                break
            else:
                k = "0"
                if g == "n" and at < n and (text[at].isalpha() or text[at] == "_"):
                    raise Broken("name after number")
            out.append(k)
        if not closed:
            if at != n:
                raise Broken(f"character {text[at]!r}")
            break
    return "".join(out)


# ---------------------------------------------------------------- Ruby

_RUBY = _scanner(
    ("w", r"(?:@@?|\$)?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff]*(?:[?!](?![=~]))?|\$[0-9~!@&`'+*$?:\"<>,./;]"), ("s", r"(?:[^\S\n]|\\\n)+"), ("l", r"[\n;]+"), ("c", r"#[^\n]*"),
    ("n", r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*"),
    ("h", r"<<[~-]?(?P<hq>[\"'`]?)(?P<ht>[A-Za-z_]\w*)(?P=hq)"),
    ("y", r":[A-Za-z_]\w*[?!=]?(?![=>~:])|:[A-Za-z_]\w*[?!]?|:(?:\[\]=?|[+*/%<>!~^&|-]|<=>|==|=~|<<|>>)(?=[\s,)\].])"), ("p", r"%[wWiIqQr]?[\[({<|!/](?=\S|\s)"), ("t", r":?[\"'`]"),
    ("o", r"\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|=>|->|::|==|!=|=~|!~|<=|>=|&&|\|\||\.\.|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|&\.|[-+*/%&|^!~<>=?:.,(){}\[\]]"),
)
_RUBY_OPERAND = set("ins)]}E")
_RUBY_SKIPS_LINE = set("b+>.,([{AfuS!*<&=?:qkN")
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _ruby_quoted(text: str, at: int, quote: str) -> int:
    """The place after the string whose opening quote is just before ``at``."""
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\\":
            at += 2
        elif c == quote:
            return at + 1
        elif c == "#" and quote != "'" and text.startswith("#{", at):
            at, depth = at + 2, 1
            while at < n and depth:
                c = text[at]
                if c in "\"'`":
                    at = _ruby_quoted(text, at + 1, c)
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    raise Broken("string not closed")


def kinds_ruby(text: str) -> str:
    out: list[str] = []
    words, ops, match = _RUBY_WORDS, _RUBY_OPS, _RUBY.match
    text = re.sub(r"(?ms)^=begin\b.*?^=end\b[^\n]*$", "", text)
    text = re.sub(r"(?ms)^__END__$.*", "", text)
    at, n, last, header, space = 0, len(text), "N", False, False
    bodies: list[str] = []
    while at < n:
        m = match(text, at)
        if m is None:
            raise Broken(f"character {text[at]!r}")
        g, start, at = m.lastgroup, m.start(), m.end()
        if g == "s" or g == "c":
            space = True
            continue
        if g == "l":
            if bodies and "\n" in m[0]:
                at = start + m[0].index("\n") + 1
                for tag in bodies:
                    e = re.compile(rf"(?m)^[ \t]*{tag}$").search(text, at)
                    if e is None:
                        raise Broken("here-document not closed")
                    at = e.end()
                bodies = []
            header = False
            if last not in _RUBY_SKIPS_LINE and not re.compile(r"\s*(?:#[^\n]*\s*)*(?:&?\.(?!\.))").match(text, at):
                out.append("N")
                last = "N"
            space = True
            continue
        if g == "w":
            word = m[0]
            if last == ".":
                k = "i"
            elif last == "d":
                k = "i"
                if text.startswith("=", at) and re.compile(r"=\s*\(|=[ \t]*[a-z_]").match(text, at) and not text.startswith("==", at) and text[at + 1 : at + 2] == "(":
                    at += 1
            elif at < n and text[at] == ":" and not text.startswith("::", at) and last != "?" and (at + 1 == n or text[at + 1] in " \t\n\"'[({,):}"):
                k, at = "j", at + 1
            else:
                k = words.get(word, "i")
                if last in "CM" and k == "i" and (word[0].islower() or word[0] == "_") and not text.startswith("::", at):
                    raise Broken("name of a class or module")
                if k == "W" or k == "O":
                    header = last in "N" or last in "=(" or k == "O"
                elif k == "o" and header:
                    k, header = "D", False
        elif g == "n":
            k = "n"
            if at < n and (text[at].isalpha() or text[at] == "_"):
                raise Broken("name after number")
        elif g == "y":
            k = "n"
            if last in _RUBY_OPERAND and not space:
                raise Broken("symbol")
        elif g == "h":
            if last in _RUBY_OPERAND and (not space or text[at : at + 1] == " " and not m[0].startswith(("<<~", "<<-"))):
                k, at = "b", start + 2
            else:
                bodies.append(re.escape(m["ht"]))
                k = "n"
        elif g == "t":
            at, k = _ruby_quoted(text, at, m[0][-1]), "n"
            if at < n and text[at] == ":" and not text.startswith("::", at) and last in "{(,|N":
                k, at = "j", at + 1
        elif g == "p":
            if last in _RUBY_OPERAND and not (space and text[at : at + 1] not in " \t"):
                k, at = "b", start + 1
            else:
                close = _CLOSING.get(m[0][-1], m[0][-1])
                end = text.find(close, at)
                if end < 0:
                    raise Broken("literal not closed")
                at, k = end + 1, "n"
        else:
            o = m[0]
            if o == "/" and (last not in _RUBY_OPERAND or last == "i" and space and text[at : at + 1] not in " \t="):
                r = re.compile(r"(?:[^/\\\n]|\\.)*/[imxounse]*").match(text, at)
                if r is None:
                    raise Broken("pattern not closed")
                at, k = r.end(), "n"
            elif last == "d" or last == "." and o in "+-*/%<>!~^[==":
                k = "i"
                if o == "[" and text.startswith("]", at):
                    at += 1 + text.startswith("]=", at)
            else:
                k = ops.get(o, o)
        out.append(k)
        last, space = k, False
    if bodies:
        raise Broken("here-document not closed")
    return "".join(out)


# ---------------------------------------------------------------- grammars

_DSL = re.compile(r"\s+|<(\w+)>|'([^']+)'|(\[(?:\\.|[^\]\\])+\]|\\Z)|([!&~]?\()|([*+?])|(.)")


def _body(text: str) -> str:
    out = []
    for ref, literal, chars, group, times, other in _DSL.findall(text):
        if ref:
            out.append(f"(?&{ref})")
        elif literal:
            out.append(re.escape(literal))
        elif group:
            out.append({"(": "(?>", "!(": "(?!", "&(": "(?=", "~(": "(?<!"}[group])
        elif times:
            out.append(times + "+")
        elif chars or other:
            out.append(chars or other)
    return "".join(out)


def grammar(rules: str, start: str) -> regex.Pattern:
    """A pattern of ``start`` from ``name = body`` lines: ``<name>`` refers to a rule, quoted text and letters are kinds,
    ``!(``, ``&(`` and ``~(`` say what must not follow, must follow and must not stand before, alternatives are ordered and repetition never gives back."""
    defined = "".join(f"(?P<{n}>{_body(b)})" for n, b in re.findall(r"(?m)^ *(\w+) = (.*(?:\n {8,}.*)*)$", rules))
    return regex.compile(rf"(?(DEFINE){defined})(?:{_body(start)})")


_JS_RULES = r"""
    file = <st>*
    unit = N* (X d?)? (<func> | V <id> '=' (<func> | <arrow>) <end> | <post> '=' (<func> | <arrow>) <end> | <method>) [N;]*
    end = ';' | N | &('}') | \Z
    id = [ifmtyY]
    word = [FCRYJVILWDOfgTKPScdBXMmetyin]
    st = [;NZz] | <block> | V <decl> (',' <decl>)* <end> | <func> | <class> | I '(' <expr> ')' <st> (N* L <st>)? | O J? '(' (<over> | <steps>) ')' <st>
        | R <expr>? <end> | W '(' <expr> ')' <st> | D <st> N* W '(' <expr> ')' ';'? | B <id>? <end> | T <block> N* (K ('(' <pat> ')')? <block> N*)? (P <block>)?
        | S '(' <expr> ')' '{' N* ((c <expr> | d) ':' <st>*)* '}' | X (d (<func> | <class> | <asg> <end>) | '*' (m i)? m s <end> | <names> (m s)? <end> | <func> | <class> | V <decl> (',' <decl>)* <end>)
        | M !('(' | '.') (s | (<id> ',')? (<id> | <names> | '*' m <id>) m s) <end> | <id> ':' <st> | !([FC]) <expr> <end>
    names = '{' (<word> (m <word>)? (',' <word> (m <word>)?)* ','?)? '}'
    over = (V <pat> | <post>) [fg] <expr>
    steps = (V <decl> (',' <decl>)* | <expr>)? ';' <expr>? ';' <expr>?
    block = '{' <st>* '}'
    decl = <pat> ('=' <asg>)?
    pat = <id> | A | <object> | <array>
    func = Y? F '*'? <id>? <params> <block>
    params = '(' (<param> (',' <param>)* ','?)? ')'
    param = E? <pat> ('=' <asg>)?
    class = C <id>? (e <post>)? '{' <member>* '}'
    key = <word> | s | '[' <asg> ']'
    mods = (t !([(=;N}]))? (Y !([(=;N}]))? '*'? ([t] !([(=;N}]))?
    method = <mods> <key> <params> <block>
    member = [;NZ#] | t <block> | <method> | <mods> <key> ('=' <asg>)? <end>
    expr = <asg> (',' <asg>)*
    arrow = Y? (<id> | <params>) '>' (<block> | <asg>)
    asg = &(Y? (<id> '>' | '(')) <arrow> | y '*'? <asg>? | <bin> ('?' <asg> ':' <asg>)? (~([nsk]) [=a] <asg>)?
    bin = <un> ([b+*g] <un>)*
    un = [J!+\^]* <post>
    post = <prim> ('(' (<arg> (',' <arg>)* ','?)? ')' | '.' (<word> | '(' (<arg> (',' <arg>)*)? ')' | '[' <expr> ']') | '[' <expr> ']' | k)* '^'?
    arg = E? <asg>
    prim = [nskrA] | <func> | <id> | '(' <expr> ')' | <array> | <object> | <class> | M &([(.]) | J '.' i
    array = '[' ','* (<arg> (','+ <arg>)* ','*)? ']'
    object = '{' (<prop> (',' <prop>)* ','?)? '}'
    prop = E <asg> | <method> | <key> ':' <asg> | <id> ('=' <asg>)?
"""
_JAVA_RULES = r"""
    file = (<ann>* p <q> ';')? (Q M? <q> ('.' '*')? ';' | ';')* <typedecl>*
    unit = <mods> <tparams>? (<type> i <mparams> <dims> <throws>? (<block> | ';') | i <mparams> <throws>? <block>) ';'*
    q = [ir] ('.' [ir])*
    type = (t | [ir] <targs>? ('.' [ir] <targs>?)*) <dims>
    dims = (<ann>* '[' ']')*
    targs = '<' (<targ> (',' <targ>)*)? '>'
    targ = <ann>* ('?' ([ei] <type>)? | <type>)
    ann = '@' <q> ('(' (<annarg> (',' <annarg>)*)? ')')?
    annarg = (i '=')? (<init> | <ann>)
    mods = (<ann> | [Md])*
    typedecl = [;k] | <mods> <types>
    types = C i <tparams>? (e <type> (',' <type>)*)* <cbody> | '@' C i <cbody> | i i <tparams>? <mparams> (e <type> (',' <type>)*)? <cbody>
    tparams = '<' <tparam> (',' <tparam>)* '>'
    tparam = <ann>* i (e <type> ('&' <type>)*)?
    cbody = '{' (<member>* '}' | <consts> (';' <member>*)? '}')
    consts = <const> (',' <const>)* ','?
    const = <ann>* [ir] <args>? <cbody>?
    member = [;Zk#] | <mods> (<block> | <types> | <tparams>? (i <mparams> <throws>? <block> | <type> i (<mparams> <dims> <throws>? (<block> | (d <init>)? ';') | <vars> ';')))
    throws = h <type> (',' <type>)*
    mparams = '(' (<mparam> (',' <mparam>)*)? ')'
    mparam = <mods> <type> E? i <dims>
    vars = <dims> ('=' <init>)? (',' i <dims> ('=' <init>)?)*
    init = '{' (<init> (',' <init>)*)? ','? '}' | <expr>
    block = '{' <st>* '}'
    st = [;Zz] | <block> | <mods> (C i <tparams>? (e <type> (',' <type>)*)* <cbody> | <type> i <vars> ';') | I '(' <expr> ')' <st> (L <st>)? | W '(' <expr> ')' <st>
        | O '(' (<mods> <type> i ':' <expr> | (<mods> <type> i <vars> | <list>)? ';' <expr>? ';' <list>?) ')' <st> | R <expr>? ';' | D <st> W '(' <expr> ')' ';' | B i? ';'
        | T ('(' <res> (';' <res>)* ';'? ')')? <block> (K '(' <mods> <type> ('|' <type>)* i ')' <block>)* (P <block>)? | <switch> | A <expr> (':' <expr>)? ';' | M '(' <expr> ')' <block> | i ':' <st> | <expr> ';'
    res = <mods> <type> i '=' <expr> | <expr>
    switch = S '(' <expr> ')' '{' ((c <pattern> (',' <pattern>)* | d) (l (<block> | R <expr> ';' | <expr> ';') | ':' <st>*))* '}'
    pattern = <type> i | <bin>
    list = <expr> (',' <expr>)*
    expr = &(i l | '(') <lambda> | <bin> ('?' <expr> ':' <expr>)? (~(n) [=a] <expr>)?
    lambda = (i | '(' (i (',' i)*)? ')' | <mparams>) l (<block> | <expr>)
    bin = <un> ((b | '+' | '*' | '<'  | '>' '>'? '>'? | '&' | '|') <un> | q M? <type> i?)*
    un = ([!+\^] | '(' t <dims> ')' | '(' <type> ('&' <type>)* ')' &([inr(!wtS]))* <post>
    post = (&([it]) <type> u [iw] | <prim>) ('.' (i <args>? | <targs> i <args> | w <creator>) | '[' <expr> ']' | u [iw])* '^'?
    args = '(' <list>? ')'
    prim = n | [ir] <args>? | '(' <expr> ')' | w <creator> | t <dims> '.' i | <type> '.' i | <switch>
    creator = <ann>* (t | i <targs>? ('.' i <targs>?)*) (<args> <cbody>? | ('[' <expr>? ']')+ (<init>)?)
"""
_GO_RULES = r"""
    file = p i ';' (Q (<imp> | '(' (<imp> (';' <imp>)* ';'?)? ')') ';')* ((<func> | <decl>) ';' | '#')*
    unit = <func> ';'
    imp = (i | '.')? n
    decl = t (<tspec> | '(' (<tspec> (';' <tspec>)* ';'?)? ')') | V (<vspec> | '(' (<vspec> (';' <vspec>)* ';'?)? ')')
    tspec = i ('[' i <type> (',' i <type>)* ']')? '='? <type>
    vspec = <ids> ('=' <list> | <type> ('=' <list>)?)?
    ids = i (',' i)*
    func = F (<params> i | i ('[' <par> (',' <par>)* ']')?) <sig> <block>?
    sig = <params> (<params> | <type>)?
    params = '(' (<par> (',' <par>)* ','?)? ')'
    par = i E? <type> | E? <type>
    type = i ('.' i)? ('[' <type> (',' <type>)* ']')? | '*' <type> | '[' (E | <expr>)? ']' <type> | m '[' <type> ']' <type> | l? h l? <type> | F <sig>
        | s '{' (<field> (';' <field>)* ';'?)? '}' | j '{' (<elem> (';' <elem>)* ';'?)? '}' | '(' <type> ')'
    field = (<ids> <type> | '*'? i ('.' i)?) n?
    elem = i <sig> | r <type>? | '!'? <type> (b '!'? <type>)*
    block = '{' <sts> '}'
    sts = z* <st>? (';' z* <st>?)*
    st = <decl> | R <list>? | B i? | g i | G <expr> | <block> | <if> | O (<range> | <simplen>? ';' <simplen>? ';' <simplen>? | <simplen>)? <block>
        | S (<simplen>? ';')? <simplen>? '{' ((c <list> | d) ':' <sts>)* '}' | y '{' ((c <simple> | d) ':' <sts>)* '}' | i ':' ';'? <st>? | <simple>
    if = I (<simplen>? ';')? <simplen> <block> (L (<if> | <block>))?
    range = (<listn> [D=])? x <exprn>
    simple = <list> ([D=a] (x <expr> | <list>) | '^' | l <expr>)?
    simplen = <listn> ([D=a] (x <exprn> | <listn>) | '^' | l <exprn>)?
    list = <expr> (',' <expr>)*
    listn = <exprn> (',' <exprn>)*
    expr = <un> ([b+*&] <un>)*
    un = [!+*&l]* <prim> (<suffix> | '{' (<pair> (',' <pair>)* ','?)? '}')*
    exprn = <unn> ([b+*&] <unn>)*
    unn = [!+*&l]* <primn> <suffix>*
    suffix = '.' (i | '(' (<type> | t) ')') | '[' (<expr>? (':' <expr>?)* | <type> (',' <type>)*) ']' | '(' (<arg> (',' <arg>)* E? ','?)? ')'
    arg = <expr> | <type>
    pair = <item> (':' <item>)?
    item = '{' (<pair> (',' <pair>)* ','?)? '}' | <expr>
    prim = <primn> | &(s) <type>
    primn = [nir] | '(' (<expr> | <type>) ')' | F <sig> <block> | &('[' | m) <type> '{' (<pair> (',' <pair>)* ','?)? '}' | &('[' | m | h | j) <type> &('(' | ')' | ',')
"""
_PHP_RULES = r"""
    file = <st>*
    unit = ';'* M* <fn> (<block> | ';') ';'*
    type = '?'? [iMC] ([|&] !([vE&]) [iM])*
    params = '(' (<param> (',' <param>)* ','?)? ')'
    param = M* <type>? '&'? E? v ('=' <expr>)?
    fn = F '&'? <name> <params> (':' <type>)?
    name = [iFCnyMkNURBILeWDOfATKPScdgGbx]
    closure = M? F '&'? <params> ((U '(' ('&'? v (',' '&'? v)* ','?)? ')')? (':' <type>)? <block> | (':' <type>)? '>' <expr>)
    block = '{' <st>* '}'
    cls = M* C i (':' <type>)? (x i (',' i)*)* <cbody>
    cbody = '{' <member>* '}'
    member = [#m] | U i (',' i)* (';' | '{' (<name> (q <name>)? (A | g) M? (i (',' i)*)? ';')* '}') | M* (<fn> (<block> | ';') | k <type>? &(<name> '=') <const> (',' <const>)* ';' | k <const> (',' <const>)* ';' | <type>? <var> (',' <var>)* ';') | c i ('=' <expr>)? ';'
    const = <name> '=' <expr>
    var = v ('=' <expr>)?
    st = [;z#] | <block> | I '(' <expr> ')' (':' <st>* ((I '(' <expr> ')' | L) ':' <st>*)* e ';' | <st> (L <st>)?) | f '(' <expr> A (<expr> '>')? '&'? <expr> ')' <body> | R (<expr> (',' <expr>)*)? ';'
        | W '(' <expr> ')' <body> | D <st> W '(' <expr> ')' ';' | O '(' <list>? ';' <list>? ';' <list>? ')' <body> | S '(' <expr> ')' ('{' <cases> '}' | ':' <cases> e ';') | B 0? ';'
        | T <block> (K '(' i ('|' i)* v? ')' <block>)* (P <block>)? | G v (',' v)* ';' | M <var> (',' <var>)* ';' | N (i ';' | i? <block>)
        | U [Fk]? <use> (',' <use>)* ';' | k <const> (',' <const>)* ';' | <fn> <block> | <cls> | <expr> ';'
    use = i (A i)? ('{' [Fk]? i (A i)? (',' [Fk]? i (A i)?)* ','? '}')?
    body = ':' <st>* e ';' | <st>
    cases = ((c <expr> | d) [:;] <st>*)*
    list = <expr> (',' <expr>)*
    expr = y (<expr> ('>' <expr>)?)? | <bin> ('?' <expr>? ':' <bin>)* (~(0) [=a] '&'? <expr>)?
    bin = <un> ([b+*&|] <un> | g <un>)*
    un = ([!+\^&n] | '(' i ')' &([v0ir(\[!+n]))* <post>
    post = <prim> (p (<name> | v | '{' <expr> '}') | q (<name> | v | '{' <expr> '}') | '[' <expr>? ']' | '(' (<arg> (',' <arg>)* ','? | E)? ')' | '{' <arms> '}')* '^'?
    arms = ((<list> | d) '>' <expr>) (',' (<list> | d) '>' <expr>)* ','?
    arg = (<name> ':')? E? '&'? <expr>
    prim = [v0ir] | '(' <expr> ')' | '[' (<elem>? (',' <elem>?)*) ']' | <closure> | M &(q) | C ('(' (<arg> (',' <arg>)*)? ')')? (x i (',' i)*)* <cbody> | '$' ('{' <expr> '}' | v)
    elem = E? '&'? <expr> ('>' '&'? <expr>)?
"""
_RUBY_RULES = r"""
    file = <sts>
    unit = N* (i? <def>) N*
    sts = [Nz]* (<st> (N [Nz]* <st>?)*)?
    st = (a <sym> <sym>? | <simple>) ([IWv] <simple>)*
    sym = [in]
    simple = <nots> (k <nots>)*
    nots = (q | '!')* (R (<args>)? | <mlhs> '=' <args> | <asg>)
    mlhs = <lhs> (',' <lhs>)+
    lhs = '*'? i ('.' i | u i | '[' [^\]]* ']')* | '*' | '(' <lhs> (',' <lhs>)* ')'
    asg = <tern> (~(n) ('=' | A) N* <value>)?
    value = (<asg> | R) (',' <arg> (',' <arg>)*)? (v <asg>)?
    tern = <bin> ('?' N* <tern> N* (':' N* <tern>))?
    bin = <un> ((b | '+' | '*' | '<' | '>' !(.) | '&' | '|' | '!' | S) N* <un>)* (b &([)\]N]))?
    un = ([!+&*qS])* <post> (v <post>)?
    post = <prim> (('.' | u) [iCMIWOcwBoELlvtRynqkgad] '!'? | '.' <paren> | u i | <paren> | '[' N* <args>? N* ']' | <block>)* (&([irnj(\[f{cIBydu!]) !('{' | '(' | '[' | I N) <args> <block>?)?
    paren = '(' N* (<args> ','?)? N* ')'
    args = <arg> (',' N* <arg>)*
    arg = j N* <tern>? <block>? | [*&S] <un> | [*&S] | <asg> ('>' N* <asg>)?
    block = o <bars>? <body> E | '{' <bars>? <sts> '}'
    bars = '|' N* (<plist>)? N* '|' | b &(N | .)
    plist = <par> (',' N* <par>)* ','?
    par = [*&S] i? | j N* <tern>? | i ('=' <un>)? | '(' <plist> ')'
    body = <sts> (v (<args>)? ('>' <post>)? (t | N)? <sts>)* (L <sts>)? (e <sts>)?
    def = d i (('.' | u) i)? '='? ('(' N* (<plist> N*)? ')' ('=' N* <st> | <body> E) | '=' <st> | <plist>? N <body> E)
    prim = <def> | [ir] | n+ | y | '(' <sts> ')' | '[' N* (<args> ','? N*)? ']' | '{' N* (<pair> (N* ',' N* <pair>)* N* ','? N*)? '}' | C (b <asg> | u? i (u i)* ('<' <post>)?) N <body> E | M i (u i)* N <sts> E
        | I <simple> (t | N t?) <sts> (l <simple> (t | N t?) <sts>)* (L <sts>)? E | W <simple> (D | N) <sts> E | O <plist> g <simple> (D | N) <sts> E | c <simple>? N* ([wg] <args> (t | N t?) <sts>)+ (L <sts>)? E
        | B <body> E | f (<paren2> | <plist>)? <block> | u i | R
    paren2 = '(' <plist>? ')'
    pair = j N* (<asg> ('>' N* <asg>)?)? | S <un> | <asg> N* '>' N* <asg>
"""


# ---------------------------------------------------------------- folding
#
# Most of a file is plain statements over plain operands.  Before the grammar runs, these are folded from the inside out:
# a call, member access or parenthesised operation becomes the operand r, a finished plain statement becomes z, a plain
# declaration Z, and control statements over folded blocks become z in turn.  Folding only replaces what the grammar would
# accept at that place, so the verdict is the same and the recursive pattern sees a few characters instead of thousands.


def _folds(text: str, **sets: str) -> list[tuple[re.Pattern, str]]:
    """Pairs of a pattern and what it becomes, one on a line as ``what <- pattern``; ``@name`` stands for a set."""
    out = []
    for line in text.strip().splitlines():
        to, pattern = (x.strip() for x in line.split("<- ", 1))
        for name, value in sets.items():
            pattern = pattern.replace("@" + name, value)
        out.append((re.compile(pattern), to))
    return out


_FOLDS = {
    "javascript": _folds(
        r"""
         <- (?<=[\[{(])(?:(?:[is]:)?\+?[ns],)+(?=(?:[is]:)?\+?[ns][,\]})])
        r <- [irsk]\.i
        r <- (?<!\.)[ir]\((?:@x(?:,@x)*)?\)(?![{>])
        r <- (?<=[b+*=a(,:?>!R\[])\(@x(?:[b+*]@x)*\)(?![>{])
        r <- @x(?:[b+*]@x)+
        A <- (?<=[=(,:?\[R])\[(?:@x(?:,@x)*)?\]
        A <- (?<=[=(,?\[R])\{(?:(?:[is]:@x|i)(?:,(?:[is]:@x|i))*)?\}
        z <- (?<=[{}NZz])(?:(?:Vi=@x|[ir]a@x|r|r=@x|R@x?);)+
        Z <- (?<=[{}NZz])i=@x;
        z <- (?<=[{}NZz])I\(@x\)\{[Zz]*\}(?:L\{[Zz]*\})?(?!L)
        z <- (?<=[{}NZz])O\(Vi[fg]@x\)\{[Zz]*\}
        z <- (?<=[{}NZz])W\(@x\)\{[Zz]*\}
        z <- zz+
        """,
        x="[inskrA]",
    ),
    "java": _folds(
        r"""
         <- (?<=[{(])(?:\+?n,)+(?=\+?n[,})])
        r <- [ir]\.i(?=[(.;,)b+*=a])
        r <- (?<![itw>\].@M])[ir]\((?:@x(?:,@x)*)?\)(?![{hl])
        r <- (?<=[b+*<>=a(,:?!R\[])\((?:r|@x(?:[b+*]@x)+)\)(?![l{inr(!])
        r <- @x(?:[b+]@x)+
        Z <- (?<=[{}Zz])(?:[it]i(?:=@x)?;)+
        z <- (?<=[{}Zz])(?:(?:[ir][a=]@x|r|R@x?);)+
        z <- (?<=[{}Zz])I\(@x(?:[<>*]@x)?\)\{[Zz]*\}(?:L\{[Zz]*\})?(?!L)
        z <- (?<=[{}Zz])O\([it]i:@x\)\{[Zz]*\}
        z <- (?<=[{}Zz])W\(@x(?:[<>*]@x)?\)\{[Zz]*\}
        z <- zz+
        """,
        x="[inr]",
    ),
    "go": _folds(
        r"""
         <- (?<=[{(])(?:(?:n:)?\+?n,)+(?=(?:n:)?\+?n[,})])
        r <- (?<![F).])i\.i(?=[(.;,)b+*=aD{])
        r <- r\.i
        r <- (?<![F).])[ir]\((?:@x(?:,@x)*)?\)
        r <- (?<=[b+*=aD!RIx])\(@x(?:[b+*&]@x)*\)
        r <- (?<=[(,;])\((?:r|@x(?:[b+]@x)+)\)(?![{it*\[mhsjF(])
        r <- @x(?:[b+]@x)+
        z <- (?<=[{}z;])(?:(?:i[Da=]@x|r|r[a=]@x|R@x?);)+
        z <- (?<=[{}z;])I@x\{z*\}(?:L\{z*\})?;
        z <- (?<=[{}z;])Oi(?:,i)?Dx@x\{z*\};
        z <- zz+
        """,
        x="[inr]",
    ),
    "php": _folds(
        r"""
         <- (?<=[\[(])(?:(?:0>)?\+?0,)+(?=(?:0>)?\+?0[,\])])
        r <- [vr]p[iv]
        r <- (?<![F&q])[ir]\((?:@x(?:,@x)*)?\)(?![{:])
        r <- (?<=[b+=a(,:?!R\[>])\(@x(?:[b+]@x)*\)(?![{:])
        r <- @x(?:[b+]@x)+
        z <- (?<=[{};z])(?:(?:[vr][a=]@x|r|R@x?);)+
        z <- (?<=[{};z])I\(@x\)\{z*\}(?:L\{z*\})?(?!L)
        z <- (?<=[{};z])f\(@xA(?:@x>)?v\)\{z*\}
        z <- (?<=[{};z])W\(@x\)\{z*\}
        z <- zz+
        """,
        x="[v0ir]",
    ),
    "ruby": _folds(
        r"""
         <- (?<=[\[{(])(?:(?:n>|j)?\+?n,)+(?=(?:n>|j)?\+?n[,\]})])
        r <- (?<![d.])[ir]\.i(?=[(.N,)b+*=Ao])
        r <- (?<![d.])[ir]\((?:@x(?:,@x)*)?\)
        r <- (?<=[b+*<=A(,?!R\[N])\(@x(?:[b+*]@x)*\)
        r <- @x(?:[b+]@x)+(?![ins({\[])
        z <- (?<=[Nz])(?:(?:i[=A]@x|r|r[=A]@x|R@x?)N)+
        z <- (?<=[Nz])I@x(?:[<*]@x)?Nz*(?:LN?z*)?EN
        z <- (?<=[Nz])@xo(?:\|i(?:,i)*\|)?Nz*EN
        z <- zz+
        """,
        x="[inr]",
    ),
}


#: In whole files, declarations over folded bodies fold too: # is a member, k a type, and what is also a statement is z.
_FILE_FOLDS = {
    "javascript": _folds(
        r"""
         <- (?<=[zZ#])N+
        z <- (?<=[{}NZz;])X?Y?Fi\((?:i(?:,i)*)?\)\{[Zz]*\}
        z <- (?<=[{}NZz;])Vi=(?:Y?(?:i|\((?:i(?:,i)*)?\))>|Y?Fi?\((?:i(?:,i)*)?\))\{[Zz]*\};
        z <- (?<=[{}NZz;])Vi=\{[is]:[ns]\};
        # <- (?<=[{}N#])t?Y?i\((?:i(?:,i)*)?\)\{[Zz]*\}
        z <- (?<=[{}NZz;])X?Ci(?:ei)?\{[#N]*\}
        """
    ),
    "java": _folds(
        r"""
         <- (?<=;)Q[ir](?:\.[ir])*;
        # <- (?<=[{};#])(?:@i|M)*@T\i\((?:@Ti(?:,@Ti)*)?\)\{[Zz]*\}
        # <- (?<=[{};#])(?:@i|M)+@Ti(?:=@x)?;
        k <- (?<=[;}#k])M*Ci\{[#Zk]*\}
        """.replace("\\i", "i"),
        T="[ti](?:<i(?:,i)*>)?(?:\\[\\])?",
        x="[inr]",
    ),
    "go": _folds(
        r"""
        # <- (?<=[;#])F(?:\(i\*?i\))?i\((?:i@T(?:,i@T)*)?\)@T?\{z*\};
        # <- (?<=[;#])tis\{(?:ii;)*\};
        """,
        T=r"\*?(?:\[\])?i",
    ),
    "php": _folds(
        r"""
        # <- (?<=[{};z#m])Fi\((?:v(?:,v)*)?\)\{z*\}
        m <- (?<=[{};#m])M+Fi\((?:v(?:,v)*)?\)\{z*\}
        z <- (?<=[{};z#])Ni;
        # <- (?<=[{};z#m])(?:Ui|ki=\[0>0\]);
        z <- (?<=[{};z#])Ci\{[#m]*\}
        """
    ),
    "ruby": _folds(
        r"""
        z <- (?<=[Nz])di(?:\.i)?(?:\((?:i(?:,i)*)?\))?Nz*EN
        z <- (?<=[Nz])Ci(?:<i)?N+z*EN
        z <- (?<=[Nz])(?:ii|in|i=\{n>n\}(?:\.i)?)N
         <- (?<=z)N+
        """
    ),
}
_LEADS = {"javascript": "N", "php": ";", "ruby": "N"}


def folded(kinds: str, language: str, unit: bool) -> str:
    folds = _FOLDS[language] if unit else _FOLDS[language] + _FILE_FOLDS[language]
    kinds = _LEADS.get(language, "") + kinds + ("N" if language == "ruby" else "")
    while True:
        before = len(kinds)
        for pattern, to in folds:
            kinds = pattern.sub(to, kinds)
        if len(kinds) == before:
            return kinds


#: Seconds after which a text nested beyond all measure is left undecided.
PATIENCE = 30


_RULES = {"javascript": _JS_RULES, "java": _JAVA_RULES, "go": _GO_RULES, "php": _PHP_RULES, "ruby": _RUBY_RULES}
#: What a file begins with, and what it goes on with again and again.
_FILE = {
    "javascript": ("", "<st>"),
    "java": ("(<ann>* p <q> ';')? (Q M? <q> ('.' '*')? ';' | ';')*", "<typedecl>"),
    "go": ("p i ';' (Q (<imp> | '(' (<imp> (';' <imp>)* ';'?)? ')') ';')*", "(<func> | <decl>) ';' | '#'"),
    "php": ("", "<st>"),
    "ruby": ("", "[Nz]+ | <st> (N | \\Z)"),
}


@lru_cache(None)
def _grammar(language: str, part: str) -> regex.Pattern:
    return grammar(_RULES[language], part)


def _matches(kinds: str, language: str, unit: bool) -> bool:
    """A file is matched one top-level statement after the other, so that what the matcher keeps is bounded by a statement."""
    if unit:
        return _grammar(language, "<unit> \\Z").match(kinds, timeout=PATIENCE) is not None
    head, item = _FILE[language]
    m = _grammar(language, head).match(kinds, timeout=PATIENCE) if head else None
    if head and m is None:
        return False
    at, match = m.end() if m else 0, _grammar(language, item).match
    while at < len(kinds):
        m = match(kinds, at, timeout=PATIENCE)
        if m is None or m.end() == at:
            return False
        at = m.end()
    return True


_KINDS = {"javascript": kinds_javascript, "java": kinds_java, "go": kinds_go, "ruby": kinds_ruby}


def plain_lines(text: str) -> str:
    """The text with line feeds only and without a byte order mark."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.removeprefix("﻿").rstrip()


def _parses_python(text: str, unit: bool) -> bool | None:
    if unit and text.lstrip("\n")[:1] in (" ", "\t"):
        text = "if 1:\n" + text
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return False
    except (RecursionError, MemoryError):
        return None  # nested beyond this parser's stack, which is no fault of the text
    if unit and len(body) == 1 and isinstance(body[0], ast.If) and text.startswith("if 1:\n"):
        body = body[0].body
    return not unit or len(body) == 1 and isinstance(body[0], (ast.FunctionDef, ast.AsyncFunctionDef))


def parses(text: str, language: str, unit: bool) -> bool | None:
    """Whether the text is valid syntax; ``unit``: as one declaration of a function or method, else as a file.  None where that cannot
    be told, as the text is nested beyond the matcher's memory or its time."""
    text = plain_lines(text)
    if language == "python":
        return _parses_python(text, unit)
    try:
        kinds = kinds_php(text, unit) if language == "php" else _KINDS[language](text)
    except Broken:
        return False
    try:
        return _matches(folded(kinds, language, unit), language, unit)
    except (TimeoutError, MemoryError):
        return None
