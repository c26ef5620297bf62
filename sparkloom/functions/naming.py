"""Naming strategies: how a field name becomes a header."""

from __future__ import annotations

from collections.abc import Callable

Naming = Callable[[str], str]

def pieces(name: str) -> list[str]:
    """The name cut before every capital that begins a word: one behind a small letter or digit, or the last of a run before a small letter."""
    out, start = [], 0
    for i in range(1, len(name)):
        behind_capital = name[i - 1].isupper() and name[i + 1 : i + 2].islower()
        if name[i].isupper() and (behind_capital or name[i - 1].islower() or name[i - 1].isdigit()):
            out.append(name[start:i])
            start = i
    return [*out, name[start:]]


def parts(name: str) -> list[str]:
    """The words of a camel-case or snake-case name, in lower case."""
    return [p for piece in pieces(name) for p in piece.lower().split("_") if p]


def literal(name: str) -> str:
    return name


def capitalize(name: str) -> str:
    return name[:1].upper() + name[1:]


def snake_case(name: str) -> str:
    return "_".join(parts(name))


def screaming_snake_case(name: str) -> str:
    return snake_case(name).upper()


def kebab_case(name: str) -> str:
    return "-".join(parts(name))


def with_spaces_lower_case(name: str) -> str:
    return " ".join(parts(name))


def with_spaces(name: str) -> str:
    return " ".join(" ".join(pieces(name)).replace("_", " ").split())


def with_spaces_capitalize(name: str) -> str:
    return " ".join(capitalize(p) for p in parts(name))
