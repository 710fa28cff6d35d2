"""Generated, minified or vendored source files.

Method: one multi-pattern automaton finds generation and copy notices in file headers; path rules know vendored and
generated folders, lockfiles and minified suffixes; the look of the code (line lengths, share of literals) tells shrunk
files and data saved as code.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, picked, with_code
from .funcdocs import _OPAQUE
from .grammars import language_of, plain_lines

# Folders and file names that tell vendored, generated and shrunk files.
VENDORED = set(
    """vendor _vendor vendored third_party thirdparty third-party 3rdparty 3rd_party extern external externals node_modules bower_components jspm_components
    jspm_packages web_modules site-packages dist-packages godeps deps bundled pods carthage submodules""".split()
)
GENERATED = set("generated generated-sources generated_sources generated-src __generated__ _generated autogen auto-generated gen src-gen gen-src".split())
SHRUNK = re.compile(r"[.-]min\.[a-z]+$|\.(?:bundle|pack|packed|chunk|umd|esm)\.[a-z]+$|\.min\.", re.I)
MADE = re.compile(r"(?:_pb2(?:_grpc)?|\.pb|\.g|\.designer|\.generated|_generated|\.gen|_autogen|\.pb\.gw|_pb|\.freezed|_grpc_pb)\.[a-z]+$|^zz_generated", re.I)
LOCKED = set("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock cargo.lock gemfile.lock composer.lock go.sum".split())

# What notices say, in lower case.  The first group of each kind counts anywhere in a header, the second only where a
# comment line begins with it, as prose may hold it too.
NOTICES = {
    "generated": (
        """do not edit|don't edit|do not modify|do not change this file|not edit by hand|not edit manually|@generated|autogenerated|automatically generated|auto-generated file|auto generated file|code generated|file was generated
        |file is generated|machine written|machine-written|machine generated|machine-generated|manual edits|manual changes|changes will be lost|edits will be lost|edits are overwritten|changes are overwritten|automatisch erzeugt
        |automatisch generiert|nicht von hand|généré automatiquement|ne pas modifier|generado automáticamente|no editar|no modificar""",
        "generated by|generated from|generated with|generated using|generated code|produced by the|généré par|generado por|this code was generated|this file is produced|this file was produced",
    ),
    "copied": (
        "bundled copy|taken verbatim|verbatim copy|copied verbatim|vendored from|vendored copy|last synced|send changes upstream|upstream at|do not patch here|embedded because|copy of the upstream",
        "copied from|taken from|forked from|imported from|adapted from|local copy|embedded copy|mirrored from|borrowed from|bundled from|synced from|see upstream|this is a copy|third-party|third party",
    ),
}
#: How far into a comment line its beginning reaches.
BEGINNING = 16


@lru_cache(None)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, groups in NOTICES.items():
        for anywhere, phrases in zip((True, False), groups):
            for phrase in re.split(r"\s*\|", phrases):
                found.add_word(phrase.strip(), (kind, anywhere, len(phrase.strip())))
    found.make_automaton()
    return found


_LEADING = re.compile(r"(?:\s|<\?php\b|#[^\n]*|//[^\n]*|/\*(?s:.*?)\*/|<!--(?s:.*?)-->)*")
_DOCSTRING = re.compile(r'[rR]?(?:"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\')')
_OWNER = re.compile(r"(?:copyright|\(c\)|©)\s+(?:\(c\)\s+|©\s+)?(?:\d{4}(?:\s*-\s*\d{4})?,?\s+)?(?:by\s+)?the\s+([\w.-]+)\s+(?:authors|developers|contributors|project|team|maintainers)", re.I)
_PART = re.compile(r"(?m)^[\s*#/;!-]*(?:this (?:module|file|code|package) (?:is|belongs)\s+)?(?:part of|belongs to)\s+(?:the\s+)?([\w.-]+(?:/[\w.-]+)?)", re.I)
_MARKS = re.compile(r"^[\s*#/;!<\"'-]+")


def header(text: str, language: str | None) -> str:
    """The comments (in Python also a docstring) before the first line of code."""
    end = _LEADING.match(text).end()
    if language == "python" and (m := _DOCSTRING.match(text, end)):
        end = m.end()
    return text[:end]


def footer(text: str, found: list[re.Match]) -> str:
    """The comments after the last line of code; ``found`` are the comments and strings of the text."""
    start, end = len(text), len(text)
    for m in reversed(found):
        if m["c"] is None or text[m.end() : end].strip(" \t\r\n"):
            break
        start = end = m.start()
    own_line = text.rfind("\n", 0, start) + 1
    return text[start:] if not text[own_line:start].strip() else text[start:].partition("\n")[2]


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def notice(text: str, repo: str | None, language: str | None, found: list[re.Match]) -> tuple[str | None, str | None]:
    """``generated`` or ``copied`` if the header, or the comments at the end of the file, say so.  Second, where nothing but a notice of
    the authors and name of one other repository tells that it is copied: that repository, as ``owner/name``."""
    head = header(text, language) + "\n" + footer(text, found)
    kinds = set()
    for line in head.lower().split("\n"):
        line = _MARKS.sub("", line)
        kinds.update(kind for end, (kind, anywhere, length) in _automaton().iter(line) if anywhere or end + 1 - length <= BEGINNING)
    own = {_plain(repo), _plain(repo.rsplit("/", 1)[-1])} if repo else set()
    foreign = {x for m in [*_OWNER.finditer(head), *_PART.finditer(head)] if own and _plain(x := m[1].rstrip(".,")) not in own}
    if foreign and not kinds:
        origin = next((x for x in sorted(foreign) if "/" in x), None)
        alone = origin and all(_plain(x) in (_plain(origin), _plain(origin.rsplit("/", 1)[-1])) for x in foreign)
        return "copied", origin if alone else None
    return "generated" if "generated" in kinds else "copied" if kinds or foreign else None, None


def place(path: str | None) -> str | None:
    if not path:
        return None
    folders = [x.lower() for x in path.split("/")]
    base = folders.pop()
    if base in LOCKED or MADE.search(base) or any(x in GENERATED for x in folders):
        return "generated"
    if SHRUNK.search(base):
        return "minified"
    return "vendored" if any(x in VENDORED for x in folders) else None


_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)[,\s:]*")
_STATEMENT = re.compile(r"[{};]")
_MAP = re.compile(r"(?m)^\s*(?://|/\*)[#@]\s*sourceMappingURL=")
#: Shrunk code has lines at least this long that hold at least so many ends of statements and blocks.
LONG_LINE, LINE_STATEMENTS = 300, 8
#: Literals make a file mainly data from this share of its text, if they are as many characters as the second figure.
DATA_SHARE, DATA_CHARS = 0.6, 1000


def opaque(text: str, language: str | None) -> list[re.Match]:
    """The comments and strings of the text."""
    return list(_OPAQUE.get(language or "", _OPAQUE["javascript"]).finditer(text))


def look(text: str, found: list[re.Match]) -> str | None:
    """``minified`` or ``data`` if the code looks so."""
    literal, comment, rest, at = 0, 0, [], 0
    for m in found:
        rest.append(text[at : m.start()])
        at = m.end()
        if m["c"] is not None:
            comment += len(m[0])
        else:
            rest.append('""')
            literal += len(m[0]) if len(m[0]) > 1 and not (m[0][:3] in ('"""', "'''") and " " in m[0]) else 0
    rest.append(text[at:])
    code = "".join(rest)
    numbers = sum(len(x) for x in _NUMBER.findall(code))
    body = len(text) - comment
    if literal + numbers >= DATA_CHARS and literal + numbers + 2 * code.count('""') >= DATA_SHARE * body:
        return "data"
    if _MAP.search(text):
        return "minified"
    crowded = sum(len(x) for x in code.split("\n") if len(x) >= LONG_LINE and len(_STATEMENT.findall(x)) >= LINE_STATEMENTS)
    return "minified" if crowded and 2 * crowded >= len(code) else None


_OUT = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("evidence", pa.string()), ("origin", pa.string())])


def _kinds(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _OUT.names}
    for doc, repo, path, func, code, language in zip(*(rows[n] for n in ("doc_id", "repo", "path", "func_name", "code", "language"))):
        lang, text = language_of(language, path), plain_lines(code)
        # what stands before a single function is its documentation, not a file's header
        islands = opaque(text, lang)
        said, origin = (None, None) if func is not None else notice(text, repo, lang, islands)
        told = [(kind, evidence) for evidence, kind in (("path", place(path)), ("header", said), ("look", look(text, islands))) if kind]
        if told:
            for column, value in zip(_OUT.names, (doc, *told[0], origin if told == [("copied", "header")] else None)):
                out[column].append(value)
    return out


def not_handwritten(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, evidence) of the rows not written by hand for their repo; all other rows are hand-written.

    kind is generated, minified, vendored, copied, moved or data, evidence the first of path, header and look that shows it.  moved are
    files that show nothing but their own authors' notice, of another repo that is in docs as well: hand-written source of this
    collection in a second place, which is for the search for near-duplicates to settle.
    Null or empty code gives nothing; a null path or repo only takes that evidence away.  Redelivered rows count once.
    """
    rows = picked(docs, "doc_id", "repo", "path", "func_name", "code", "language")
    told = with_code(rows).mapInArrow(batches(_kinds, _OUT), "doc_id string, kind string, evidence string, origin string")
    repos = rows.where(F.col("repo").isNotNull()).select(F.lower("repo").alias("place")).distinct().withColumn("known", F.lit(True))
    placed = told.withColumn("place", F.lower("origin")).join(repos, "place", "left")
    return placed.select("doc_id", F.when(F.col("known"), "moved").otherwise(F.col("kind")).alias("kind"), "evidence").distinct()


def found(docs: DataFrame) -> DataFrame:
    """(doc_id) of the rows to leave out so that only hand-written source remains: all kinds but moved."""
    return not_handwritten(docs).where("kind <> 'moved'").select("doc_id").distinct()
