"""Column defaults as catalogs store them, cleaned to the logical value."""

from __future__ import annotations


def _balanced(text: str) -> bool:
    depth = 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if depth < 0:
            return False
    return depth == 0


def _quoted(text: str, marks: str = "'") -> bool:
    return len(text) >= 2 * len(marks) and text.startswith(marks) and text.endswith(marks)


def _unquote(text: str) -> str:
    return text[1:-1].replace("''", "'") if _quoted(text) else text


def _unwrap(text: str, times: int) -> str:
    """Peel layers of parentheses that enclose the whole text."""
    while times and text.startswith("(") and text.endswith(")") and len(text) > 1 and _balanced(text[1:-1]):
        text, times = text[1:-1].strip(), times - 1
    return text


def clean_default(src: str, raw: str) -> str:
    """Unknown databases: the text as it is."""
    text = raw.strip()
    if src == "postgres":
        return _unquote(text.split("::", 1)[0].strip())
    if src in ("oracle", "dameng"):
        if _quoted(text, "''") and "'" not in text[2:-2]:
            return text[2:-2].strip()
        return text[2:-2] if _quoted(text, "'''") else _unquote(text)
    if src == "sqlserver":
        text = _unwrap(text, len(text))
        return text[1:] if text.startswith("N'") and text.endswith("'") else text
    return _unquote(_unwrap(text, 1)) if src == "mysql" else raw
