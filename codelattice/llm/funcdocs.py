"""Functions paired with their documentation.

Method: island grammars.  In a file only documentation, annotations, signatures and balanced bodies are recognised; text
between them is water and is skipped.  Strings are blanked first, so that code inside them never counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, picked, with_code
from .grammars import language_of, parses, plain_lines

_BLOCK = r"/\*(?s:.*?)\*/"
_QUOTED = r'"(?:[^"\\\n]|\\(?s:.))*"'
_SINGLE = r"'(?:[^'\\\n]|\\(?s:.))*'"
#: Comments (c) and strings (s) of each language.
_OPAQUE = {
    "python": re.compile(r'(?P<c>\#[^\n]*)|(?P<s>[rRuUbBfF]{0,2}(?:"""(?s:[^\\]|\\.)*?"""|\'\'\'(?s:[^\\]|\\.)*?\'\'\'|' + rf"{_QUOTED}|{_SINGLE}))"),
    "javascript": re.compile(
        rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>{_QUOTED}|{_SINGLE}|`(?:[^`\\]|\\.)*`|(?:(?<=[=(,:;!&|?{{}}>])|(?<=\breturn)|(?<=\btypeof)|(?<=\bcase)|(?<=^)|(?<=\n))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/|(?<=\))[ \t]*/(?![*/= ])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/(?=[a-z]*\.[a-z]))"
    ),
    "java": re.compile(rf'(?P<c>//[^\n]*|{_BLOCK})|(?P<s>"""(?s:[^\\]|\\.)*?"""|{_QUOTED}|{_SINGLE})'),
    "go": re.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|(?P<s>{_QUOTED}|{_SINGLE}|`[^`]*`)"),
    "php": re.compile(rf"(?P<c>//[^\n]*|\#(?!\[)[^\n]*|{_BLOCK})|(?P<s>\"(?s:[^\"\\]|\\.)*\"|'(?s:[^'\\]|\\.)*'|<<<[ \t]*[\"']?(?P<t>\w+)[\"']?\n(?s:.*?)\n[ \t]*(?P=t)\b)"),
    "ruby": re.compile(rf"(?P<c>\#[^\n]*|(?:^|(?<=\n))=begin\b(?s:.*?)\n=end\b[^\n]*)|(?P<s>\"(?:[^\"\\]|\\.)*\"|{_SINGLE}|<<[~-]?['\"]?(?P<t>[A-Z]\w*)['\"]?(?s:.*?)\n[ \t]*(?P=t)\b)"),
}
_NOT_LINE_END = re.compile(r"[^\n]")


class Source:
    """A file with its comments by the line they end on, and its text with comments and strings blanked."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.strings: dict[int, str] = {}
        self.comments: list[tuple[int, int]] = []
        parts, at = [], 0
        for m in _OPAQUE[language].finditer(text):
            a, b = m.span()
            parts.append(text[at:a])
            if m.lastgroup == "c" or m["c"] is not None:
                self.comments.append((a, b))
                parts.append(_NOT_LINE_END.sub(" ", m[0]))
            else:
                self.strings[a] = m[0]
                parts.append('"' + "X" * (b - a - 1))
            at = b
        parts.append(text[at:])
        self.code = "".join(parts)
        self._by_end: dict[int, tuple[int, int]] | None = None

    def line_start(self, at: int) -> int:
        return self.text.rfind("\n", 0, at) + 1

    def comment_before(self, at: int) -> str | None:
        """The comment that ends on the line directly before the line of ``at``; annotations in between are passed over."""
        if self._by_end is None:
            self._by_end = {}
            for a, b in self.comments:
                start = self.line_start(a)
                if not self.text[start:a].strip(" \t") and not self.text[b : (self.text.find("\n", b) + 1 or len(self.text) + 1) - 1].strip():
                    self._by_end[self.line_start(b - 1 if self.text[b - 1] != "\n" else b)] = (start, b)
        line = self.line_start(at)
        while line:
            before = self.line_start(line - 1)
            if before in self._by_end:
                start, end = self._by_end[before]
                single = self.text[start:end].lstrip()[:2] in ("//", "# ", "#", "#\n") or self.text[start:end].lstrip()[:1] == "#"
                while single and start and (up := self.line_start(start - 1)) in self._by_end and self._by_end[up][0] == up and self.text[up:start].lstrip()[:1] in "/#" and self.text[up:start].lstrip()[:2] != "/*":
                    start = up
                return self.text[start:end]
            stripped = self.code[before:line].strip()
            if stripped.startswith("@") and self.language in ("java", "javascript") or stripped.startswith("#[") and self.language == "php":
                line = before
                continue
            return None
        return None


    def cut(self, start: int, end: int) -> str:
        return self.text[start:end].strip("\n").rstrip()

    def with_annotations(self, at: int) -> int:
        """The start of the annotations on the line of ``at`` and directly above it, else ``at``."""
        marks = {"java": "@", "javascript": "@", "php": "#"}.get(self.language)
        line = self.line_start(at)
        if not marks:
            return at
        lead = self.code[line:at].strip()
        first = at if not lead.startswith(marks) else line + len(self.code[line:at]) - len(self.code[line:at].lstrip())
        while line:
            up = self.line_start(line - 1)
            before = self.code[up:line]
            if not before.strip().startswith(marks):
                break
            line, first = up, up + len(before) - len(before.lstrip())
        return first


def _after_brackets(code: str, at: int) -> int:
    """The place after the bracket group that opens at ``at``; -1 where it never closes."""
    depth = 0
    for m in _BRACKETS.finditer(code, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return -1


_BRACKETS = re.compile(r"[()\[\]{}]")
_PY_HEAD = re.compile(r"(?m)^([ \t]*)(?:(?:async[ \t]+)?(def)|(class))[ \t]+(\w+)")
_PY_COLON = re.compile(r"[()\[\]{}:]")
_PY_LINE = re.compile(r"(?m)^[ \t]*(?=[^\s#])")


def _docstring(source: Source, at: int) -> str | None:
    depth = 0
    for m in _PY_COLON.finditer(source.code, at):
        c = m[0]
        if c == ":" and not depth:
            body = re.compile(r"[\s\\]*").match(source.code, m.end()).end()
            text = source.strings.get(body)
            if text is None or "b" in (prefix := text[: min(text.index(q) for q in "\"'" if q in text)].lower()) or "f" in prefix:
                return None
            if not re.compile(r"[ \t]*(?:;|\n|$|\r)").match(source.code, body + len(text)):
                return None
            text = text[len(prefix) :]
            return text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
        depth += (c in "([{") - (c in ")]}")
    return None


_PY_DECORATOR = re.compile(r"(?m)^[ \t]*@")
_PY_STEP = re.compile(r"[()\[\]{}]|\n[ \t]*(?=[^\s#])")
_JS_STEP = re.compile(r"[()\[\]{};]|\n\s*(?=[^\s.?:+\-*/%&|=,<>)\]}])")


def _python_span(code: str, head: int, at: int, indent: int) -> tuple[int, int]:
    """(start, end) of a function with its decorators: ``head`` is the start of its first line, ``at`` the place after its name."""
    start = head
    for m in reversed(list(_PY_DECORATOR.finditer(code, 0, head))):
        depth, broken = 0, False
        for c in _PY_STEP.finditer(code, m.end(), start):
            if c[0][0] == "\n":
                broken = broken or not depth and c.end() < start
            else:
                depth += 1 if c[0] in "([{" else -1
        if broken or depth:
            break
        start = m.start()
    depth = 0
    for c in _PY_STEP.finditer(code, at):
        if c[0][0] != "\n":
            depth += 1 if c[0] in "([{" else -1
        elif not depth and len(c[0][1:].expandtabs(8)) <= indent and code[c.start() - 1] != "\\":
            return start, c.start()
    return start, len(code)


def _expression_end(code: str, at: int) -> int:
    """The end of the expression at ``at`` that is a JavaScript function's body."""
    depth = 0
    for c in _JS_STEP.finditer(code, at):
        if c[0] in "([{":
            depth += 1
        elif c[0] in ")]}":
            depth -= 1
            if depth < 0:
                return c.start()
        elif not depth:
            return c.end() if c[0] == ";" else c.start()
    return len(code)


#: Name, raw documentation, and the function's code (annotations, signature and body) when asked for.
_Function = tuple[str, "str | None", Callable[[], str]]


def _python(source: Source) -> Iterator[_Function]:
    code, stack = source.code, []
    heads = list(_PY_HEAD.finditer(code))
    for m in heads:
        indent = len(m[1].expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        if m[3]:
            stack.append((indent, "class", m[4]))
            continue
        if not any(kind == "def" for _, kind, _ in stack):
            yield (f"{stack[-1][2]}.{m[4]}" if stack else m[4]), _docstring(source, m.end()), lambda m=m, indent=indent: source.cut(*_python_span(code, m.start(), m.end(), indent))
        stack.append((indent, "def", m[4]))


_JS = re.compile(
    r"(?P<open>\{)|(?P<close>\})|\bclass\s+(?P<cls>[\w$]+)(?:\s+extends\s+[\w$.]+)?\s*\{|(?P<fn>(?:\bexport\s+(?:default\s+)?)?(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<fname>[\w$]+)\s*)(?=\()"
    r"|(?P<var>(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<vname>[\w$]+)\s*=\s*(?:async\s+)?(?:function\b\s*\*?\s*[\w$]*\s*(?=\()|(?=\([^()]*(?:\([^()]*\)[^()]*)*\)\s*=>)|(?=[\w$]+\s*=>)))"
    r"|(?<![\w$.])(?P<met>(?:(?:static|async|get|set)\s+)*\*?\s*(?P<mname>\#?[A-Za-z_$][\w$]*)\s*)(?=\()"
)
_JAVA = re.compile(
    r"(?P<open>\{)|(?P<close>\})|(?<!\.)\b(?:class|interface|enum|record)\s+(?P<cls>\w+)[^{;()]*(?:\([^)]*\)[^{;]*)?\{|(?P<met>(?:(?<=[{};\s)])|^)(?:[\w<>\[\],.?&]+\s+)*(?P<mname>[A-Za-z_]\w*)\s*)(?=\()"
)
_GO = re.compile(r"(?P<open>\{)|(?P<close>\})|(?P<fn>^func\s*(?:\(\s*\w*\s*\*?\s*(?P<recv>\w+)(?:\[[^\]]*\])?\s*\)\s*)?(?P<fname>\w+)\s*(?:\[[^\]]*\])?)(?=\()", re.M)
_PHP = re.compile(
    r"(?P<open>\{)|(?P<close>\})|(?<![\w$>:])(?:class|trait|interface|enum)\s+(?P<cls>\w+)[^{;]*\{|(?P<fn>(?:\b(?:public|private|protected|static|final|abstract)\s+)*\bfunction\s+&?\s*(?P<fname>\w+)\s*)(?=\()", re.I
)
_NOT_NAMES = set("if for while switch catch return function with super new synchronized else do try await typeof throw".split())


def _braced(source: Source) -> Iterator[_Function]:
    code, language = source.code, source.language
    scan = {"javascript": _JS, "java": _JAVA, "go": _GO, "php": _PHP}[language]
    stack: list[tuple[str, str]] = []
    at, n = 0, len(code)
    while at < n and (m := scan.search(code, at)):
        at = m.end()
        g = m.groupdict()
        if g["open"]:
            stack.append(("block", ""))
        elif g["close"]:
            if stack:
                stack.pop()
        elif g.get("cls"):
            stack.append(("class", g["cls"]))
        else:
            name = g.get("fname") or g.get("vname") or g.get("mname")
            kind = stack[-1][0] if stack else "file"
            if g.get("mname"):
                if kind != "class" or name in _NOT_NAMES:
                    continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            params = _after_brackets(code, at) if code[at : at + 1] == "(" else at
            if params < 0:  # it seems not to close, so this is no function; what follows is scanned on
                continue
            tail = re.compile(r"[^{};=]*(?:=>\s*)?").match(code, params)
            body = tail.end()
            if g.get("mname") and language == "javascript" and code[body : body + 1] != "{":
                continue
            if language == "java" and (code[body : body + 1] not in "{;" or "=" in tail[0] or m["met"].strip() == name and code[body : body + 1] != "{"):
                continue
            lead = code[source.line_start(start) : start].strip()
            doc = source.comment_before(start) if not lead or lead[0] in "@#" else None
            owner = g.get("recv") or (stack[-1][1] if kind == "class" else "")
            braced = code[body : body + 1] == "{"
            end = _after_brackets(code, body) if braced else _expression_end(code, body) if language == "javascript" else body + 1
            if kind in ("file", "class"):
                yield (f"{owner}.{name}" if owner else name), doc, lambda start=start, end=end if end >= 0 else n: source.cut(source.with_annotations(start), end)
            if braced:  # the balanced body is water: functions inside functions don't count
                at = end if end >= 0 else body + 1  # seems never to close: what is inside is scanned as if it stood outside


_RUBY_ISLAND = re.compile(
    r"(?m)^[ \t]*(?:(?:private|public|protected|module_function)[ \t]+)?(?:(?P<def>def)[ \t]+(?:(?:self|[A-Z]\w*)\.)?(?P<name>[\w?!=+\-*/<>\[\]%~]+)|(?P<cls>class|module)[ \t]+(?:<<[ \t]*)?(?P<cname>[\w:]+)|(?P<open>if|unless|while|until|case|for|begin)\b)"
    r"|(?P<eq>=[ \t]*(?:if|unless|case|begin)\b)|(?P<do>\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|(?P<end>(?:^|(?<=[\s;]))end\b(?![?!:]))"
)


def _ruby(source: Source) -> Iterator[_Function]:
    stack: list[tuple[str, str]] = []
    held: tuple[str, str | None, int] | None = None  # the function not yet ended
    looped = -1
    for m in _RUBY_ISLAND.finditer(source.code):
        if m["end"]:
            if stack:
                stack.pop()
            if held and all(kind == "class" for kind, _ in stack):
                name, doc, start = held
                yield name, doc, lambda start=start, end=m.end(): source.cut(start, end)
                held = None
        elif m["def"]:
            if all(kind == "class" for kind, _ in stack):
                held = (f"{stack[-1][1]}.{m['name']}" if stack else m["name"]), source.comment_before(m.end()), m.start()
            stack.append(("def", ""))
        elif m["cls"]:
            stack.append(("class", m["cname"].rsplit("::", 1)[-1]))
        elif m["do"]:
            line = source.line_start(m.start())
            if line != looped:
                stack.append(("block", ""))
        else:
            if m["open"] in ("while", "until", "for"):
                looped = source.line_start(m.start("open"))
            stack.append(("block", ""))
    if held:
        name, doc, start = held
        yield name, doc, lambda: source.cut(start, len(source.text))


_LEAD = re.compile(r"(?:\s|<\?php\b|@[\w.]+(?:\([^()\n]*\))?|#\[[^\]\n]*\])*")


def functions(text: str, language: str, func_name: str | None) -> Iterator[_Function]:
    """Names, raw documentation and code of the functions in the text; with ``func_name`` the text is that one function."""
    source = Source(text, language)
    if func_name is None:
        yield from _python(source) if language == "python" else _ruby(source) if language == "ruby" else _braced(source)
    elif language == "python":
        m = _PY_HEAD.search(source.code)
        if m and m[2]:
            yield func_name, _docstring(source, m.end()), lambda: source.cut(0, len(text))
    else:
        start = _LEAD.match(source.code).end()
        if language in ("java", "php"):  # annotations on the declaration's own line or above it
            first = re.compile(r"\s*(?:<\?php\b\s*)?").match(source.code).end()
            start = start if source.code[first : first + 1] not in "@#" else first
        first = re.compile(r"\s*(?:<\?php\b\s*)?").match(source.code).end()
        yield func_name, source.comment_before(start), lambda: source.cut(first, len(text))


# ---------------------------------------------------------------- what documentation says

_MARKS = re.compile(r"(?m)^=(?:begin|end)\b.*$|^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//+!?|\#+)[ \t]?|\*+/[ \t]*$")
_TAG = re.compile(r"^\s*[@:\\](?:param|parameter|arg|argument|type|rtype|returns?|result|raises?|throws?|exception|yields?|yieldparam|yieldreturn|option|keyword|var|since|see|author)\b", re.I)
_SECTION = re.compile(r"^\s*(?:args?|arguments?|params?|parameters?|keyword args?|returns?|yields?|raises?|throws?|results?|attributes)\s*:?\s*$", re.I)
_INLINE_SECTION = re.compile(r"^\s*(?:returns?|yields?|raises?)\s*:\s", re.I)
_RULE = re.compile(r"^\s*-{3,}\s*$|^\s*={3,}\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")
_SENTENCE = re.compile(r"(?<=[.!?;\]])\s+|\n\s*\n|\n(?=\s*(?:TODO|FIXME|TBD|XXX)\b)")
#: Sentences that only announce documentation or ask for it.
_ANNOUNCES = re.compile(
    r"^\W*(?:to-?do|fix-?me|tbd|xxx|hack|wip)\b|^\W*(?:undocumented|inheritdoc|n/?a|none|docs?|placeholder|stub)\W*$|^\W*see above\W*$"
    r"|\b(?:documentation|docs?|docstring|description|summary|comment|explanation)s?\b[^.]*\b(?:to be (?:written|added|done|provided|filled|completed)|goes here|go here|comes? here|will follow|follows later|is (?:missing|pending)|missing|pending|needed|coming soon|later)\b"
    r"|\b(?:insert|add|write|put|provide|fill in|enter|type|need|needs|requires?)\b[^.]*\b(?:documentation|docs|docstring|description|summary|comment|explanation)\b"
    r"|\b(?:please|must|should|someone|somebody|to|will|shall)\b[^.]*\b(?:document|describe|explain)\b|\bdocument (?:this|me|it)\b|\bdescribe (?:the behaviou?r|what|this|me|here)\b|\bauto-?generated\b[^.]*\bstub\b|\bnot (?:yet )?documented\b|\bto be documented\b",
    re.I,
)


def told(doc: str) -> str:
    """The documentation without comment marks and without the entries for parameters and results."""
    lines = _MARKS.sub("", plain_lines(doc)).split("\n")
    out: list[str] = []
    i, section, tag = 0, None, False
    while i < len(lines):
        line = lines[i]
        indent = len(line) - len(line.lstrip())
        following = lines[i + 1] if i + 1 < len(lines) else ""
        if not line.strip():
            tag = False
            if section is not None and section[1] and not (following.strip() and (len(following) - len(following.lstrip())) > section[0]):
                section = None
            out.append("")
        elif _RULE.match(line):
            pass
        elif _TAG.match(line):
            tag, section = True, None
        elif _SECTION.match(line) and (line.rstrip().endswith(":") or _RULE.match(following)):
            section = (indent, line.rstrip().endswith(":"))
            tag = False
        elif section is not None:
            if section[1] and indent <= section[0]:
                section = None
                continue
            if not section[1] and i + 1 < len(lines) and _RULE.match(following):
                section = None
                continue
        elif tag and indent > 0 and out[-1:] != [""]:
            pass
        elif _INLINE_SECTION.match(line):
            tag = True
        else:
            tag = False
            out.append(line)
        i += 1
    return "\n".join(out).strip()


def is_real(doc: str | None, name: str) -> bool:
    """Whether the documentation says something: at least four words besides the name's own, not only a promise."""
    if not doc:
        return False
    text = told(doc)
    own = name.rsplit(".", 1)[-1]
    pieces = {p.lower() for p in _PIECES.findall(own)} | {own.lower()}
    count, says = 0, False
    for sentence in _SENTENCE.split(text):
        left = sum(1 for w in _WORD.findall(re.sub(r"\b" + re.escape(own) + r"\b", " ", sentence)) if w.lower() not in pieces)
        count += left
        says = says or left > 0 and not _ANNOUNCES.search(sentence)
    return says and count >= 4


_OUT = pa.schema([("doc_id", pa.string()), ("func_name", pa.string()), ("language", pa.string()), ("documentation", pa.string()), ("code", pa.string())])
_FOUND = pa.schema([("doc_id", pa.string()), ("func_name", pa.string())])


def documented_code(code: str, language: str, func_name: str | None, wanted: bool = True) -> list[tuple[str, str, str]]:
    """(name, documentation, code) of the functions with real documentation; none if the code is not valid.  The code of a function is
    its annotations, signature and body; it is left empty unless ``wanted``."""
    text = plain_lines(code)
    found = [(name, told(doc), own() if wanted else "") for name, doc, own in functions(text, language, func_name) if is_real(doc, name)]
    return found if found and parses(text, language, func_name is not None) is not False else []


def documented(code: str, language: str, func_name: str | None) -> list[tuple[str, str]]:
    """(name, documentation) of the functions with real documentation; none if the code is not valid."""
    return [(name, doc) for name, doc, _ in documented_code(code, language, func_name, False)]


def _pairs(schema: pa.Schema) -> Callable[[dict[str, list]], dict[str, list]]:
    def run(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        for doc, path, func, code, language in zip(*(rows[n] for n in ("doc_id", "path", "func_name", "code", "language"))):
            lang = language_of(language, path)
            for name, text, own in documented_code(code, lang, func, "code" in out) if lang else ():
                for column, value in zip(schema.names, (doc, name, lang, text, own)):
                    out[column].append(value)
        return out

    return run


def _rows(docs: DataFrame, schema: pa.Schema) -> DataFrame:
    rows = with_code(picked(docs, "doc_id", "path", "func_name", "code", "language"))
    return rows.mapInArrow(batches(_pairs(schema), schema), ", ".join(f"{n} string" for n in schema.names)).distinct()


def function_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, func_name, language, documentation, code), one row per function or method with real documentation; code is its
    annotations, signature and body.

    Null or empty code, and code that does not parse, gives nothing; so does a row of unknown language.  Two functions of
    one name in one file with the same documentation and code are one row.  Redelivered rows count once.
    """
    return _rows(docs, _OUT)


def found(docs: DataFrame) -> DataFrame:
    return _rows(docs, _FOUND)
