"""Text that is nested by brackets: blocks of balanced braces, and object literals as JSON."""

from __future__ import annotations

import json
import re

import pandas as pd

from .similarity import lazy

BRACES = re.compile(r"\\.|%[^\n]*|[{}]")


def blocks_of(text: str) -> list[str]:
    """The contents of the outermost braces, in order; escaped braces are text, `%` comments go to the end of their line. A block that is not closed is none."""
    out, depth, start, kept, at = [], 0, 0, [], 0
    for m in BRACES.finditer(text):
        if m[0].startswith("%"):
            kept.append(text[at : m.start()])
            at = m.end()
        elif m[0] == "{":
            depth += 1
            if depth == 1:
                kept, at = [], m.end()
        elif m[0] == "}" and depth:
            depth -= 1
            if not depth:
                out.append("".join([*kept, text[at : m.start()]]))
    return out


@lazy("array<string>")
def balanced_blocks(c: pd.Series) -> pd.Series:
    """blocks_of each text; null stays null."""
    return c.map(lambda x: None if x is None else blocks_of(x))


#: The tokens of an object literal: strings, numbers, names, marks; what is skipped.
TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<mark>[{}\[\](),:])|(?P<other>.)""", re.S)
NAMES = {"true": True, "false": False, "null": None, "undefined": None}


class Literal:
    """Reads one literal: objects with bare or quoted keys, lists, trailing commas; a value of any other kind, as a call or a function, is opaque and read as null."""

    def __init__(self, text: str):
        self.tokens = [(m.lastgroup, m[0]) for m in TOKEN.finditer(text) if m.lastgroup]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("ends within a value")
        self.at += 1
        return self.tokens[self.at - 1]

    def skip(self):
        """Up to the comma or bracket that ends an opaque value."""
        depth = 0
        while self.at < len(self.tokens) and (depth or self.peek() not in (",", "}", "]")):
            depth += {"(": 1, "{": 1, "[": 1, ")": -1, "}": -1, "]": -1}.get(self.take()[1], 0)

    def value(self):
        kind, text = self.take()
        if kind == "string":
            out = json.loads('"' + re.sub(r"\\'|(?<!\\)\"", lambda m: "'" if m[0] == "\\'" else '\\"', text[1:-1]) + '"') if text[0] == "'" else json.loads(text)
        elif kind == "number":
            out = json.loads(text)
        elif text == "{":
            out = {}
            while self.peek() != "}":
                key_kind, key = self.take()
                if key_kind not in ("string", "name", "number") or self.take()[1] != ":":
                    raise ValueError(f"no key: {key}")
                out[key[1:-1] if key_kind == "string" else key] = self.value()
                if self.peek() == ",":
                    self.take()
            self.take()
        elif text == "[":
            out = []
            while self.peek() != "]":
                out.append(self.value())
                if self.peek() == ",":
                    self.take()
            self.take()
        elif kind == "mark" and text != "(":
            raise ValueError(f"no value: {text}")
        else:
            out = NAMES.get(text)
            self.at -= text == "("
        if self.at < len(self.tokens) and self.peek() not in (",", "}", "]"):
            self.skip()
            out = None
        return out


def literal_json(text: str) -> str | None:
    """A literal as compact JSON with sorted keys; null where the text is none."""
    try:
        reader = Literal(text)
        out = reader.value()
        return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if reader.at == len(reader.tokens) else None
    except (ValueError, RecursionError):
        return None


@lazy("string")
def object_literal(c: pd.Series) -> pd.Series:
    """literal_json of each text; null stays null."""
    return c.map(lambda x: None if x is None else literal_json(x))
