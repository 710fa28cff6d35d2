"""Text functions: cleaning, similarity, chunking, budgets and extraction."""

from __future__ import annotations

import ast
import difflib
import json
import re
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = r"^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _BLANK, "")


# ---------------------------------------------------------------- comparison


def exact_match(a: Column, b: Column) -> Column:
    return stripped(a) == stripped(b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of the stripped texts: both empty 1, one empty 0, null if either is."""
    x, y = stripped(a), stripped(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(longer == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / longer))


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; it depends on the order of its arguments."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def parses_as_python(code: pd.Series) -> pd.Series:
    def fine(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    return code.map(fine)


# ---------------------------------------------------------------- tokens and budgets


def bm25_tokens(c: Column) -> Column:
    """Lower-case words after deleting ASCII punctuation."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"\p{Punct}", "")), r"\s+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    """Tokens by the offline rule: runs of word characters and single other marks."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), 1))


def _tokens(text: str) -> list[re.Match]:
    return list(re.finditer(r"\w+|[^\w\s]", text))


def truncated(text: str, most: int) -> str:
    """The longest start of the text that has at most so many tokens."""
    tokens = _tokens(text)
    return text if len(tokens) <= most else text[: tokens[most - 1].end()] if most > 0 else ""


def truncate_tokens(c: Column, most: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else truncated(t, most)), "string")(c)


def fits_context(code: Column, prompts: list[str], most: int, reserve: int = 3000) -> Column:
    """Whether the longest prompt with the code, and the reserve for an answer, stay within so many tokens."""
    longest = max((len(_tokens(p)) for p in prompts), default=0)
    return token_count(code) + longest + reserve <= most


# ---------------------------------------------------------------- chunking


def line_chunks(c: Column, size: int = 10) -> Column:
    """array<struct(chunk, start_line, end_line, total_lines, text)> of so many lines each, stripped, empty ones dropped."""
    lines = F.split(c, "\n")
    total = F.size(lines)
    numbers = F.sequence(F.lit(0), F.floor((total - 1) / size).cast("int"))
    made = F.transform(
        numbers,
        lambda i: F.struct(
            i.alias("chunk"), (i * size + 1).alias("start_line"), F.least((i + 1) * size, total).alias("end_line"), total.alias("total_lines"),
            stripped(F.array_join(F.slice(lines, i * size + 1, F.lit(size)), "\n")).alias("text"),
        ),
    )
    return F.filter(made, lambda x: x["text"] != "")


TEXT_SEPARATORS = ("\n\n", "\n", " ", "")
PYTHON_SEPARATORS = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")


def recursive_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = TEXT_SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the first separator that occurs, finer ones inside parts still too long;
    neighbouring parts are merged again while they fit, and up to ``overlap`` characters of whole parts are repeated."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        cut = re.split(f"(?={re.escape(separator)})", text)
        parts = [p for p in cut if p]
    else:
        parts = list(text)
    out: list[str] = []
    window: deque[str] = deque()

    def close() -> None:
        if whole := "".join(window).strip():
            out.append(whole)

    held = 0
    for part in parts:
        if len(part) > size:
            close()
            window.clear()
            held = 0
            out.extend(recursive_split(part, size, overlap, finer) if finer else [part[i : i + size] for i in range(0, len(part), size)])
            continue
        if window and held + len(part) > size:
            close()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.popleft())
        window.append(part)
        held += len(part)
    close()
    return out


def split_text(c: Column, size: int, overlap: int, python: bool = False) -> Column:
    """array<string> of pieces; null for null."""
    separators = PYTHON_SEPARATORS if python else TEXT_SEPARATORS
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else recursive_split(t, size, overlap, separators)), "array<string>")(c)


def halves(text: str, most: int, by_lines: bool = False, prefix: str = "") -> list[str]:
    """The text halved again and again, by characters or by lines, until each part with its prefix has at most ``most`` tokens."""
    if len(_tokens(prefix + text)) <= most:
        return [prefix + text]
    units = text.split("\n") if by_lines else list(text)
    if len(units) < 2:
        return [prefix + text]
    mid, glue = len(units) // 2, "\n" if by_lines else ""
    return halves(glue.join(units[:mid]), most, by_lines, prefix) + halves(glue.join(units[mid:]), most, by_lines, prefix)


def split_by_tokens(c: Column, most: int, by_lines: bool = False, prefix: Column | None = None) -> Column:
    run = F.pandas_udf(lambda s, p: pd.Series([None if t is None else halves(t, most, by_lines, q or "") for t, q in zip(s, p)]), "array<string>")
    return run(c, prefix if prefix is not None else F.lit(""))


def item_text(name: Column, signature: Column, code: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Name: "), F.coalesce(name, F.lit(""))), F.concat(F.lit("Signature: "), F.coalesce(signature, F.lit(""))), F.concat(F.lit("Code: "), F.coalesce(code, F.lit(""))))


# ---------------------------------------------------------------- descriptions


def numbered(descriptions: Column) -> Column:
    """``**i. text`` for each description, blank lines between them."""
    return F.array_join(F.transform(descriptions, lambda d, i: F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(". "), d)), "\n\n")


def packed(descriptions: list[str], most: int) -> list[list[str]]:
    """Descriptions in order in groups of at most ``most`` tokens; one that is too long alone is cut at sentence ends."""
    groups: list[list[str]] = []
    used = 0
    for d in descriptions:
        for part in [d] if len(_tokens(d)) <= most else _sentences(d, most):
            n = len(_tokens(part))
            if not groups or used + n > most:
                groups.append([])
                used = 0
            groups[-1].append(part)
            used += n
    return groups


def _sentences(text: str, most: int) -> list[str]:
    out, held = [], ""
    for s in text.split(". "):
        longer = f"{held}. {s}" if held else s
        if held and len(_tokens(longer)) > most:
            out.append(held)
            held = s
        else:
            held = longer
    return [*out, held] if held else out


def pack_descriptions(descriptions: Column, most: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda d: None if d is None else packed([x for x in d if x is not None], most)), "array<array<string>>")(descriptions)


def answer_lines(response: Column, include_name: Column | None = None) -> Column:
    """The lines of a response that say something, each as ``name - line``."""
    name = F.coalesce(include_name, F.lit("")) if include_name is not None else F.lit("")
    lines = F.filter(F.transform(F.split(response, "\n"), stripped), lambda x: (x != "") & ~x.contains("---None---"))
    return F.transform(lines, lambda x: F.concat(name, F.lit(" - "), x))


def purpose(description: Column) -> Column:
    """The text of the ``**Purpose**`` part; without one, the first paragraph."""
    part = F.regexp_extract(description, r"(?s)\*\*Purpose\*\*:?\s*(.*?)(?=\n\s*\*\*|\n\s*\n|\z)", 1)
    first = stripped(F.element_at(F.split(stripped(description), r"\n\s*\n"), 1))
    return F.when(stripped(part) != "", stripped(part)).otherwise(first)


def purpose_line(description: Column) -> Column:
    """The text after the colon in the first line that names a purpose; empty if no line does."""
    line = F.get(F.filter(F.split(description, "\n"), lambda x: x.contains("Purpose")), F.lit(0))
    return F.coalesce(stripped(F.regexp_replace(line, r"^[^:]*:", "")), F.lit(""))


# ---------------------------------------------------------------- extraction


def first_json(text: str | None) -> str | None:
    """The text from its first brace to the one that balances it, braces being counted wherever they stand; nothing where it is not
    JSON or never balances."""
    depth, start = 0, -1
    for m in re.finditer(r"[{}]", text or ""):
        if start < 0 and m[0] == "}":
            continue
        start = m.start() if start < 0 else start
        depth += 1 if m[0] == "{" else -1
        if not depth:
            whole = text[start : m.end()]
            try:
                json.loads(whole)
            except ValueError:
                return None
            return whole
    return None


extract_json = F.pandas_udf(lambda s: s.map(first_json), T.StringType())


def extract_query(response: Column) -> Column:
    """A graph query in a response: a fenced block, else from the first MATCH through its RETURN, else all of it."""
    fenced = F.regexp_extract(response, r"(?s)```(?:\w+)?\s*\n(.*?)```", 1)
    plain = F.regexp_extract(response, r"(?is)(\bMATCH\b.*?\bRETURN\b[^\n]*)", 1)
    return F.when(fenced != "", stripped(fenced)).when(plain != "", stripped(plain)).otherwise(stripped(response))


_FROM = r"(?m)^\s*from\s+([.\w]+)\s+import"
_IMPORT = r"(?m)^\s*import\s+(\w[\w.]*(?:\s+as\s+\w+)?(?:\s*,\s*\w[\w.]*(?:\s+as\s+\w+)?)*)"


def imported_modules(code: Column) -> Column:
    """The modules that lines of Python import, by ``from m import x`` and by ``import a.b as c, d``."""
    plain = F.flatten(F.transform(F.regexp_extract_all(code, F.lit(_IMPORT), 1), lambda names: F.transform(F.split(names, r"\s*,\s*"), lambda n: F.regexp_extract(n, r"^[\w.]+", 0))))
    return F.array_distinct(F.concat(F.regexp_extract_all(code, F.lit(_FROM), 1), plain))


_FROM_NAMES = r"(?m)^[ \t]*from\s+([.\w]+)\s+import\s+(?:\(([^)]*)\)|([^\n(#]*))"


def imported_names(code: Column) -> Column:
    """array<struct(module, name, alias)> of ``from m import a as b`` lines, with or without parentheses; ``*`` names nothing."""
    at = lambda i: F.regexp_extract_all(code, F.lit(_FROM_NAMES), i)
    lines = F.arrays_zip(at(1).alias("m"), at(2).alias("p"), at(3).alias("q"))
    names = lambda x: F.split(F.regexp_replace(F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["q"], F.lit(""))), r"#[^\n]*|\\\\\n", ""), ",")
    part = lambda n, i: F.regexp_extract(n, r"^\s*([A-Za-z_]\w*)(?:\s+as\s+([A-Za-z_]\w*))?\s*$", i)
    made = F.transform(lines, lambda x: F.transform(names(x), lambda n: F.struct(x["m"].alias("module"), part(n, 1).alias("name"), F.nullif(part(n, 2), F.lit("")).alias("alias"))))
    return F.filter(F.flatten(made), lambda x: x["name"] != "")


def identifiers(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_]\w*)"), 1))


def safe_name(c: Column) -> Column:
    """A name that can be a file name."""
    return F.translate(c, "/\\ :", "____")


def shortened_query(text: str, most: int) -> str:
    """A completion query within so many tokens: its lines that hold ``import``, three dots, and of the other lines as many as fit from the
    end, fewer tokens than are left."""
    if len(_tokens(text)) <= most:
        return text
    lines = text.split("\n")
    kept = [x for x in lines if "import" in x]
    room, tail = most - sum(len(_tokens(x)) for x in kept), []
    for line in reversed([x for x in lines if "import" not in x]):
        room -= len(_tokens(line))
        if room <= 0:
            break
        tail.append(line)
    return "\n".join([*kept, "...", *reversed(tail)])


def shorten_query(c: Column, most: int = 3000) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else shortened_query(t, most)), "string")(c)


#: Lines before the definition a prompt's end stands in; lines kept where there is none; lines and imports that are always kept.
BUFFER, FALLBACK, LEAST_LINES, LEAST_IMPORTS = 5, 50, 10, 3


def shortened_prompt(text: str, most: int) -> str:
    """A prompt within so many tokens: its imports, and what follows from a few lines before the last definition on, or its last lines where
    nothing is defined.  What is still too long loses lines from the beginning, then imports, down to the least numbers of both."""
    if len(_tokens(text)) <= most:
        return text
    lines = text.split("\n")
    imports = [x for x in lines if "import " in x or "from " in x]
    others = [x for x in lines if not ("import " in x or "from " in x)]
    at = next((i for i in range(len(others) - 1, -1, -1) if re.match(r"\s*(?:async\s+def|def|class)\s", others[i])), None)
    body = others[-FALLBACK:] if at is None else others[max(0, at - BUFFER) :]
    sizes = [[len(_tokens(x)) for x in part] for part in (imports, body)]
    total, cut = sum(map(sum, sizes)), [0, 0]
    for part, least in ((1, LEAST_LINES), (0, LEAST_IMPORTS)):
        while total > most and len(sizes[part]) - cut[part] > least:
            total -= sizes[part][cut[part]]
            cut[part] += 1
    return "\n".join(imports[cut[0] :] + body[cut[1] :])


def shorten_prompt(c: Column, most: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else shortened_prompt(t, most)), "string")(c)


def completed_line(prompt: str, generated: str) -> str:
    """The first line of the shortest start of the generation, line by line, with which the prompt parses."""
    lines = generated.split("\n")
    for i in range(1, len(lines) + 1):
        part = "\n".join(lines[:i])
        if not part.strip():
            continue
        try:
            ast.parse(prompt + part)
            break
        except (SyntaxError, ValueError):
            continue
    else:
        part = generated
    return next((x.strip() for x in part.split("\n") if x.strip()), "")


@F.pandas_udf(T.StringType())
def complete(prompt: pd.Series, generated: pd.Series) -> pd.Series:
    return pd.Series([None if p is None or g is None else completed_line(p, g) for p, g in zip(prompt, generated)])


def per_row(function: Callable, kind: str | T.DataType) -> Callable[..., Column]:
    """A vectorised function from one on plain values; null in any argument gives null."""

    def run(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in it:
            yield pd.Series([None if any(v is None for v in row) else function(*row) for row in zip(*columns)])

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)
