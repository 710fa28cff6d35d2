"""Source files that do not parse.

Method: every file is tried against the supported grammars, its own language first and then the others in the order of a
token-based ranking.  A file that fails its own grammar and passes another one has a wrong extension or language label; a
file that fails all of them is corrupt.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, picked, with_code
from .grammars import LANGUAGES, language_of, parses, plain_lines

#: Words and marks that tell a language, with how strongly they do.
MARKS = {
    "python": {"def": 2, "self": 2, "elif": 3, "None": 2, "import": 1, "from": 1, "in": 1, "lambda": 2, '"""': 3, "True": 1, "False": 1, "not": 1, "pass": 2},
    "javascript": {"function": 2, "let": 3, "const": 2, "=>": 2, "===": 3, "var": 1, "require": 2, "undefined": 2, "async": 1, "export": 1, "of": 1, "this": 1},
    "java": {"public": 2, "private": 2, "protected": 1, "static": 1, "void": 2, "class": 1, "package": 1, "new": 1, "String": 2, "int": 1, "boolean": 2, "final": 1, "@Override": 3},
    "go": {"func": 3, ":=": 3, "package": 2, "range": 2, "struct": 2, "error": 1, "nil": 2, "chan": 3, "defer": 3, "import": 1},
    "php": {"<?php": 5, "$": 2, "->": 1, "foreach": 3, "echo": 2, "function": 1, "namespace": 2, "use": 1, "public": 1},
    "ruby": {"end": 3, "def": 1, "do": 2, "elsif": 3, "unless": 2, "require": 1, "module": 2, "nil": 1, "puts": 2, "|": 1},
}
_TOKEN = re.compile(r'<\?php|"""|=>|===|:=|->|[$|]|@?[A-Za-z_]\w*')


def ranked(text: str) -> list[str]:
    """The languages by how well the text's tokens fit, best first; ties in the order of LANGUAGES."""
    counts = Counter(_TOKEN.findall(text))
    scores = {lang: sum(w * counts[t] for t, w in marks.items()) for lang, marks in MARKS.items()}
    return sorted(LANGUAGES, key=lambda lang: (-scores[lang], LANGUAGES.index(lang)))


def verdict(code: str, language: str, unit: bool) -> tuple[bool | None, str | None]:
    """Whether the code is valid in its language (None: cannot be told); if not, the best-ranked language it is valid in."""
    own = parses(code, language, unit)
    if own is not False:
        return own, None
    code = plain_lines(code)
    if not re.search(r"\w", code):
        return False, None
    return False, next((lang for lang in ranked(code) if lang != language and parses(code, lang, unit)), None)


_OUT = pa.schema([("doc_id", pa.string()), ("repo", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("parses_as", pa.string()), ("cause", pa.string())])


def _verdicts(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {n: [] for n in _OUT.names}
    for doc, repo, path, func, code, language in zip(*(rows[n] for n in ("doc_id", "repo", "path", "func_name", "code", "language"))):
        lang = language_of(language, path)
        if lang is None:
            valid, other, cause = None, None, "unknown language"
        else:
            valid, other = verdict(code, lang, func is not None)
            cause = None if valid else "undecided" if valid is None else "wrong language" if other else "corrupt"
        for name, value in zip(_OUT.names, (doc, repo, lang, valid, other, cause)):
            out[name].append(value)
    return out


def check_syntax(docs: DataFrame) -> DataFrame:
    """(doc_id, repo, language, valid, parses_as, cause), one row per doc_id.

    Judged as TESTDATA says: rows with func_name as one declaration, others as a file.  Null or empty code gives no row; a
    row whose language is neither named nor told by its path has valid null and cause ``unknown language``, one that is nested beyond
    the parser's memory or time has valid null and cause ``undecided``.  A doc_id delivered more than once counts once; a null doc_id is kept as it is.  Other columns are not read.
    """
    rows = with_code(picked(docs, "doc_id", "repo", "path", "func_name", "code", "language"))
    found = rows.mapInArrow(batches(_verdicts, _OUT), "doc_id string, repo string, language string, valid boolean, parses_as string, cause string")
    return found.distinct()


def invalid(docs: DataFrame) -> DataFrame:
    return check_syntax(docs).where(~F.col("valid")).select("doc_id")


def invalid_rates(docs: DataFrame) -> DataFrame:
    """(repo, language, files, invalid_files, wrong_language_files, undecided_files, invalid_share) per repo and language; files that are
    undecided count in no share."""
    return (
        check_syntax(docs).where(F.col("language").isNotNull()).groupBy("repo", "language")
        .agg(
            F.count("valid").alias("files"), F.count_if(~F.col("valid")).alias("invalid_files"), F.count_if(F.col("cause") == "wrong language").alias("wrong_language_files"),
            F.count_if(F.col("cause") == "undecided").alias("undecided_files"),
        )
        .withColumn("invalid_share", F.when(F.col("files") > 0, F.round(F.col("invalid_files") / F.col("files"), 6)))
    )
