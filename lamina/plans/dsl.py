"""The prescription language: directives that say how a Parquet file should be written, one a line.

    set file compression zstd(3)
    set column a.list.element encoding byte_stream_split

A # starts a comment, blank lines count for nothing, words are separated by white space, names are case-sensitive. Order matters: of two
directives with one key the later holds, and directives for a column hold over those for the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

# Fixed values of the language.
LEVELS = {"zstd": (1, 22), "gzip": (0, 9), "brotli": (0, 11)}
PLAIN_CODECS = ("uncompressed", "snappy", "lz4_raw")
ENCODINGS = ("plain", "delta_binary_packed", "delta_length_byte_array", "delta_byte_array", "byte_stream_split")
STATISTICS = ("none", "chunk", "page")
FILE_PROPERTIES = ("compression", "max_row_group_size", "data_page_size_limit", "statistics_truncate_length")
COLUMN_PROPERTIES = ("compression", "encoding", "dictionary", "dictionary_page_size_limit", "statistics", "bloom_filter", "bloom_filter_ndv", "bloom_filter_fpp")


class PrescriptionError(ValueError):
    """What is wrong with a text, by its line from 1, or which directives contradict each other."""


@dataclass(frozen=True)
class Codec:
    """A codec and its level, where it has one."""

    name: str
    level: int | None = None

    @classmethod
    def parse(cls, text: str) -> Codec:
        if text in PLAIN_CODECS:
            return cls(text)
        if (m := re.fullmatch(r"(zstd|gzip|brotli)\((\d{1,9})\)", text)) and LEVELS[m[1]][0] <= int(m[2]) <= LEVELS[m[1]][1]:
            return cls(m[1], int(m[2]))
        raise ValueError(f"invalid codec '{text}'")

    def __str__(self) -> str:
        return self.name if self.level is None else f"{self.name}({self.level})"


def _number(text: str) -> int:
    if not re.fullmatch(r"\+?\d+", text) or int(text) >= 1 << 64:
        raise ValueError(f"invalid number '{text}'")
    return int(text)


def _flag(text: str) -> bool:
    if text not in ("true", "false"):
        raise ValueError(f"invalid bool '{text}'")
    return text == "true"


def _real(text: str) -> float:
    try:
        if "_" in text:
            raise ValueError
        return float(text)
    except ValueError:
        raise ValueError(f"invalid number '{text}'") from None


def _of(names: tuple[str, ...], kind: str):
    def parse(text: str) -> str:
        if text not in names:
            raise ValueError(f"invalid {kind} '{text}'")
        return text

    return parse


_PARSERS = {
    "compression": Codec.parse, "max_row_group_size": _number, "data_page_size_limit": _number, "statistics_truncate_length": lambda x: None if x == "none" else _number(x), "encoding": _of(ENCODINGS, "encoding"),
    "dictionary": _flag, "dictionary_page_size_limit": _number, "statistics": _of(STATISTICS, "statistics"), "bloom_filter": _flag, "bloom_filter_ndv": _number, "bloom_filter_fpp": _real,
}


def _shown(value) -> str:
    if value is None:
        return "none"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return str(value)


@dataclass(frozen=True)
class Directive:
    """One setting: of the file (path is None) or of a leaf column."""

    property: str
    value: object
    path: str | None = None

    @property
    def key(self) -> str:
        """What the directive sets; two with one key contradict each other unless their values are shown alike."""
        return f"file {self.property}" if self.path is None else f"column {self.path} {self.property}"

    @property
    def shown(self) -> str:
        """The value as text."""
        return _shown(self.value)

    def __str__(self) -> str:
        return f"set {self.key} {self.shown}"

    @classmethod
    def parse(cls, text: str) -> Directive:
        words = text.split()
        if not words or words[0] != "set" or len(words) < 2 or words[1] not in ("file", "column"):
            raise ValueError(f"invalid directive '{text}'")
        if len(words) != (4 if words[1] == "file" else 5):
            raise ValueError(f"wrong number of words in '{text}'")
        path = None if words[1] == "file" else words[2]
        if path is not None and not all(path.split(".")):
            raise ValueError(f"invalid column path '{path}'")
        name, value = words[-2:]
        if name not in (FILE_PROPERTIES if path is None else COLUMN_PROPERTIES):
            raise ValueError(f"unknown {words[1]} property '{name}'")
        return cls(name, _PARSERS[name](value), path)


@dataclass(frozen=True)
class Conflict:
    """Two directives of one key: the first one with it, and a later one of another value."""

    key: str
    first: Directive
    second: Directive

    def __str__(self) -> str:
        return f"conflicting directives for {self.key}: '{self.first.shown}' and '{self.second.shown}'"


class Prescription:
    """Directives in order."""

    def __init__(self, directives: Iterable[Directive] = ()):
        self.directives = list(directives)

    @classmethod
    def parse(cls, text: str) -> Prescription:
        out = []
        for n, line in enumerate(text.split("\n"), 1):
            if line := line.split("#", 1)[0].strip():
                try:
                    out.append(Directive.parse(line))
                except ValueError as e:
                    raise PrescriptionError(f"line {n}: {e}") from None
        return cls(out)

    def __iter__(self) -> Iterator[Directive]:
        return iter(self.directives)

    def __len__(self) -> int:
        return len(self.directives)

    def __eq__(self, other) -> bool:
        return isinstance(other, Prescription) and self.directives == other.directives

    def __add__(self, other: Prescription) -> Prescription:
        return Prescription([*self.directives, *other.directives])

    def __str__(self) -> str:
        return "\n".join(map(str, self.directives))

    def conflict(self) -> Conflict | None:
        """The first contradiction, or None."""
        first: dict[str, Directive] = {}
        for d in self.directives:
            if first.setdefault(d.key, d).shown != d.shown:
                return Conflict(d.key, first[d.key], d)
        return None

    def validate(self) -> Prescription:
        """Itself, or an error where directives contradict each other."""
        if c := self.conflict():
            raise PrescriptionError(str(c))
        return self

    def settled(self) -> dict[tuple[str | None, str], Directive]:
        """The directive that holds for each (path, property): the last one."""
        return {(d.path, d.property): d for d in self.directives}
