"""Splitting texts into chunks by separators of falling priority."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import chunk_id
from tessera.functions.text import slices as slices_of


def _keywords(text: str, tail: str = "") -> tuple[str, ...]:
    """One separator a bar: what starts a line there."""
    return tuple("\n" + w for w in text.split("|")) + ("\n\n", "\n", " ", "")


_SENTENCES = (". ", "! ", "? ")
_BRANCHES = "if |for |while |switch |case "
_BINDINGS = "export const |export let |const |let |var "
_TYPES = "void |int |float |double |char |unsigned |long "
SEPARATORS: dict[str, tuple[str, ...]] = {
    "default": ("\n\n", "\n", " ", ""),
    "en": ("\n" * 3, "\n" * 2, "\n", *_SENTENCES, "; ", ", ", " ", ""),
    "zh": ("\n" * 3, "\n" * 2, "\n", *"。！？；，、", ""),
    "ja": ("\n" * 3, "\n" * 2, "\n", *"。！？；、", ""),
    "ko": ("\n" * 2, "\n", *_SENTENCES, *"。！？", "; ", ": ", ", ", " ", ""),
    "py": ("\nclass ", "\nasync def ", "\ndef ", "\n    def ", "\n\tdef ", "\n\n", "\n", " ", ""),
    "ts": _keywords("enum |interface |namespace |type |export default class |export abstract class |export class |class |export async function |export function |async function |function |" + _BINDINGS + "|" + _BRANCHES + "|default "),
    "js": _keywords("export default class |export class |class |export async function |export function |async function |function |" + _BINDINGS + "|" + _BRANCHES + "|default "),
    "java": _keywords("class |interface |enum |record |@interface |public |protected |private |static |abstract |" + _BRANCHES),
    "c": _keywords("struct |typedef |union |enum |" + _TYPES + "|static |extern |" + _BRANCHES),
    "cpp": _keywords("template |namespace |class |struct |union |enum |typedef |public:|protected:|private:|" + _TYPES + "|auto |static |extern |" + _BRANCHES),
    "go": _keywords("func |var |const |type |if |for |switch |case "),
    "php": _keywords("function |class |if |foreach |while |do |switch |case "),
    "r": _keywords("function |setClass(|setMethod(|setGeneric(|if |else |for |while |repeat |library(|require("),
    "rs": _keywords("struct |enum |trait |impl |mod |pub async fn |pub fn |async fn |fn |pub const |const |let |use |if |while |for |loop |match "),
    "mdx": (*("\n" + "#" * n + " " for n in (1, 2, 3, 4)), "\n```", "\n\n", "\n", *_SENTENCES, "; ", ", ", " ", ""),
    "csv": ("\nRow ", "\n", " | ", ", ", " ", ""),
    "json": ("\n\n", "\n", "},", "],", ", ", ": ", " ", ""),
    "xml": ("\n\n", "\n", ">", *_SENTENCES, ", ", " ", ""),
    "html": (*("<" + t for t in "body div p br li h1 h2 h3 h4 h5 h6 span table tr td th ul ol header footer nav head style script meta title".split()), "\n\n", "\n", " ", ""),
}


@dataclass(frozen=True)
class Splitter:
    """size and overlap in codepoints; `lead`: separators go before the next piece, else after the last one."""

    size: int = 1000
    overlap: int = 200
    separators: tuple[str, ...] = SEPARATORS["en"]
    lead: bool = False
    keep: bool = True
    newline_heading: bool = False

    def __post_init__(self):
        if self.size <= 0 or self.overlap < 0 or self.overlap >= self.size:
            raise ValueError("need 0 <= overlap < size")
        if not self.separators:
            raise ValueError("separators must not be empty")

    def split(self, text: str | None) -> list[str]:
        if not text or not text.strip():
            return []
        if self.newline_heading and text.startswith("#"):
            text = "\n" + text
        return self._level(text, self.separators)

    def _level(self, text: str, separators: tuple[str, ...]) -> list[str]:
        found = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
        chosen = separators[found]
        # nothing is left below the empty separator, nor where none of them occurs
        below = separators[found + 1 :] if chosen and chosen in text else ()
        out: list[str] = []
        small: list[str] = []
        for piece in self._pieces(text, chosen):
            if len(piece) <= self.size:
                small.append(piece)
                continue
            out += self._packed(small, chosen)
            small = []
            out += self._level(piece, below) if below else [piece[i : i + self.size] for i in range(0, len(piece), self.size)]
        return out + self._packed(small, chosen)

    def _pieces(self, text: str, separator: str) -> list[str]:
        if not separator:
            return list(text)
        parts = text.split(separator)
        if not self.keep or len(parts) == 1:
            return parts
        if self.lead:
            return parts[:1] * bool(parts[0]) + [separator + p for p in parts[1:]]
        out: list[str] = []
        for p in parts[:-1]:
            if p or not out:
                out.append(p + separator)
            else:
                out[-1] += separator
        return out + parts[-1:] * bool(parts[-1])

    def _packed(self, pieces: list[str], separator: str) -> list[str]:
        """Greedy runs of at most `size`; each starts with the last whole pieces of the run before, up to `overlap`."""
        glue = "" if self.keep else separator
        width = lambda run: sum(map(len, run)) + len(glue) * max(0, len(run) - 1)
        out: list[str] = []
        run: list[str] = []
        total = first = 0
        for p in pieces:
            add = len(p) + (len(glue) if first < len(run) else 0)
            if total + add > self.size and first < len(run):
                out.append(glue.join(run[first:]))
                while first < len(run) and (total > self.overlap or total + add > self.size):
                    total -= len(run[first]) + (len(glue) if first + 1 < len(run) else 0)
                    first += 1
                if first == len(run):
                    total = 0
            total += len(p) + (len(glue) if first < len(run) else 0)
            run.append(p)
        out.append(glue.join(run[first:]))
        return [c for c in out if c]


def _code(size: int, overlap: int, name: str) -> Splitter:
    return Splitter(size, overlap, SEPARATORS[name], lead=True)


CHUNKERS: dict[str, Splitter] = {
    "recursive": Splitter(4000, 200, SEPARATORS["default"]),
    "base": Splitter(),
    "text": Splitter(1500, 150),
    "docx": Splitter(2500, 250),
    "mdx": replace(_code(3000, 300, "mdx"), newline_heading=True),
    "csv": _code(1200, 100, "csv"),
    "json": Splitter(2000, 200, SEPARATORS["json"]),
    "xml": Splitter(2500, 250, SEPARATORS["xml"]),
    "py": _code(1500, 150, "py"),
    "ts": _code(1500, 150, "ts"),
    "js": _code(1200, 100, "js"),
    "java": _code(2000, 200, "java"),
    "c": _code(1000, 100, "c"),
    "cpp": _code(1500, 150, "cpp"),
    "go": _code(1000, 100, "go"),
    "php": _code(1200, 100, "php"),
    "r": _code(1000, 100, "r"),
    "rs": _code(1500, 150, "rs"),
    "html": _code(1500, 200, "html"),
}
#: File types with a chunker of their own in the ingestion path; the others get "text".
DISPATCH = {"docx": "docx", "doc": "docx"}


def splitter_udf(splitter: Splitter):
    """text -> array<string>, a slice of an Arrow batch at a time. A filter on the chunks doesn't make them once more."""

    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for a, b in slices_of(texts):
                yield pa.array([splitter.split(t) for t in texts.slice(a, b - a).to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(split, ArrayType(StringType())).asNondeterministic()


def slices(text: Column, size: int) -> Column:
    """Fixed slices without overlap."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)


def chunks(docs: DataFrame, splitter: Splitter) -> DataFrame:
    """docs (source_id, text, ...) as one row a chunk: source_id, chunk_index, total_chunks, id, text."""
    cut = docs.select("source_id", splitter_udf(splitter)(F.col("text")).alias("chunks"))
    each = cut.select("source_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "text"))
    return each.select("source_id", "chunk_index", "total_chunks", chunk_id(F.col("source_id"), F.col("chunk_index")).alias("id"), "text")
