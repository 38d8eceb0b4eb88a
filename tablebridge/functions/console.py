"""Risk of a SQL statement: words outside quotes and comments, statements, and what they do."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values.
TRANSACTION = {"BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE"}
READ = {"SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN"}
WRITE = {"INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE"}
LIMIT = 1 << 20

# One alternative for each kind of text; an opening that is matched by no closed form is an error.
_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|\#[^\n]*|/\*.*?\*/)|(?P<open_comment>/\*)
    |(?P<quoted>'(?:\\.|''|[^'\\])*'|"(?:""|[^"])*"|`(?:``|[^`])*`)|(?P<open_quote>['"`])
    |(?P<dollar>(?P<tag>\$\w*\$).*?(?P=tag))|(?P<open_dollar>\$\w*\$)
    |(?P<word>[^\W\d][\w$]*)|(?P<left>\()|(?P<right>\))|(?P<end>;)|(?P<other>.)""",
    re.S | re.X,
)


_BRACKETED = re.compile(r"'(?:''|[^'])*'|\[[^\]]*\]")


@dataclass(frozen=True)
class Risk:
    statement: str
    level: str  # readonly, write or dangerous
    returns_rows: bool


def scan(sql: str) -> tuple[list[str], int]:
    """Upper-case words at every depth, and the number of statements; ValueError for what is not closed."""
    words, statements, content, depth = [], 0, False, 0
    for m in _LEX.finditer(sql):
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        if kind.startswith("open_"):
            raise ValueError(f"{kind[5:]} is not closed")
        if kind in ("space", "comment"):
            continue
        if kind == "end" and depth == 0:
            statements, content = statements + content, False
            continue
        depth = depth + 1 if kind == "left" else max(0, depth - 1) if kind == "right" else depth
        content = True
        if kind == "word":
            words.append(m.group().upper())
    if depth:
        raise ValueError("parenthesis is not closed")
    return words, statements + content


def outer_words(sql: str) -> Iterator[tuple[str, int]]:
    """Upper-case words outside of parentheses, quotes, [names] and comments, and where each begins."""
    depth = 0
    for m in _LEX.finditer(_BRACKETED.sub(lambda t: "." * len(t[0]), sql)):
        depth += {"left": 1, "right": -1}.get(m.lastgroup, 0)
        if m.lastgroup == "word" and depth <= 0:
            yield m.group().upper(), m.start()


def analyse(sql: str) -> Risk:
    """Exactly one statement of at most 1 MiB, no transaction control and no DELIMITER; else ValueError."""
    sql = sql.strip()
    if not sql:
        raise ValueError("empty")
    if len(sql.encode()) > LIMIT:
        raise ValueError("longer than 1 MiB")
    if sql[:9].upper() == "DELIMITER":
        raise ValueError("DELIMITER is not supported")
    words, statements = scan(sql)
    if statements != 1:
        raise ValueError("not one statement")
    if not words:
        raise ValueError("empty")
    first = words[0] if words[0] != "WITH" else next((w for w in words[1:] if w in WRITE), "SELECT")
    if first in TRANSACTION:
        raise ValueError("transaction control is not supported")
    if first in READ:
        to_file = any(a == "INTO" and b in ("OUTFILE", "DUMPFILE") for a, b in zip(words, words[1:]))
        return Risk(first.lower(), "dangerous" if to_file else "readonly", True)
    return Risk(first.lower(), "write", "RETURNING" in words) if first in WRITE else Risk(first.lower(), "dangerous", False)


def is_production(env: str) -> bool:
    env = env.strip().lower()
    return "prod" in env or "生产" in env


def confirmation(risk: Risk, env: str) -> str:
    """none, click, or type the connection's name."""
    if risk.level == "readonly":
        return "none"
    return "name" if risk.level == "dangerous" and is_production(env) else "click"


def cut_bytes(text: str, most: int = 4000) -> str:
    """At most so many bytes of UTF-8, without half a character."""
    return text.encode()[:most].decode(errors="ignore")


def compact(text: str, most: int = 240) -> str:
    """White space collapsed, at most so many characters and then an ellipsis."""
    text = " ".join(text.split())
    return text if len(text) <= most else text[:most] + "…"
