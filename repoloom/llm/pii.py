"""Find personal information in free text and replace it with typed placeholders (problem 9).

A character-level bidirectional LSTM with CRF transitions, trained by :mod:`repoloom.llm.pii_train`, tags whole texts
in overlapping windows wherever a gate, trained with it, lets a stretch through; the spans of the windows are reconciled
over the text. What the tagger says stands: afterwards only the edges of its spans are moved to those of the form that
stands there, and a span that cannot be of its kind is dropped.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from repoloom.llm import tagger
from repoloom.llm.pii_train import _LOW as LOW
from repoloom.llm.pii_train import _UP as UP
from repoloom.llm.pii_train import ADDRESS, EMAIL, ID, PHONE, SURNAME
from repoloom.session import spread

#: The weights that :mod:`repoloom.llm.pii_train` made.
WEIGHTS = str(Path(__file__).with_name("pii_weights.npz"))
#: Characters of the texts that a worker tags at once, about.
GROUP_CHARS = 8_000_000

#: A word of a name, an initial, or what joins them.
_PART = rf"(?:{SURNAME}|[{UP}][{LOW}]{{1,3}}|[{UP}]{{2,4}}(?= )|[{UP}]\.|van|von|de|da|del|di|der|den|VAN|VON|DE|O['’](?=[{UP}]))"
_NAME = re.compile(rf"{_PART}(?:[ ,-]+{_PART})*")
_TITLE = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Herr|Frau|Sr|Sra|Mme|Señor|Señora)\.? +|von +)+")


@lru_cache(maxsize=2)
def _weights(source: str | bytes) -> dict:
    """Weights from a path, or from the bytes of the file, which travel with the task (under 200 KB)."""
    return tagger.load(io.BytesIO(source) if isinstance(source, bytes) else source)


def _near(pattern: re.Pattern, text: str, a: int, b: int, reach: int) -> re.Match | None:
    """The match of ``pattern`` that overlaps ``a..b`` most, looked for from ``reach`` characters before."""
    best, size = None, 0
    for m in pattern.finditer(text, max(0, a - reach), min(len(text), b + reach)):
        over = min(b, m.end()) - max(a, m.start())
        if over > size:
            best, size = m, over
    return best


def _words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span with the words that its edges cut."""
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
        b += 1
    return a, b


def edges(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact edges of a tagged span, moved to those of the form that stands there.

    A span stays where no known form stands. None is returned only for what cannot be of its kind: an email without a
    sign or word for *at*, a phone number of fewer than seven digits or inside a longer number, an identity number of fewer than five letters and
    digits or none of them a digit, an address without a digit or a capital, a name of fewer than two words.
    """
    form, reach = {"email": (EMAIL, 40), "phone": (PHONE, 14), "id_number": (ID, 60), "address": (ADDRESS, 40)}.get(kind, (None, 0))
    if form and (m := _near(form, text, a, b, reach)):
        start, end = m.span("id") if kind == "id_number" else m.span()
        if start < b and a < end:
            return start, max(b, end) if kind == "address" else end
    a, b = _words(text, a, b)
    part = text[a:b]
    a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip(" .,;:"))
    part = text[a:b]
    if kind == "email":
        return (a, b) if re.search(r"@|\bat\b", part, re.I) else None
    if kind == "phone":
        return (a, b) if sum(c.isdigit() for c in part) >= 7 and not re.match(r"[.,]?\d", text[b : b + 2]) else None
    if kind == "id_number":
        return (a, b) if sum(c.isalnum() for c in part) >= 5 and re.search(r"\d", part) else None
    if kind == "address":
        return (a, b) if re.search(r"\d", part) and re.search(rf"[{UP}]", part) else None
    return _name_edges(text, a, b)


def _name_edges(text: str, a: int, b: int) -> tuple[int, int] | None:
    if m := _TITLE.match(text, a, b):
        a = m.end()
    if " " not in text[a:b]:  # the first name was not tagged
        if m := re.search(rf"(?<![\w.])(?:[{UP}][{UP}{LOW}]{{2,}} (?:[{UP}]\. )?|[{UP}]\. )$", text[max(0, a - 24) : a]):
            a -= len(m[0])
    if "," not in text[a:b] and " " not in text[a:b]:  # "surname, first name" of which the surname was tagged
        if m := re.match(rf", [{UP}][\wÀ-ÿ]+(?: [A-Z]\.)?(?!\w)", text[b : b + 24]):
            b += m.end()
    m = _NAME.search(text, a, b)
    if not m:
        return None
    part = re.sub(r"['’]s?$", "", m[0])  # a quotation mark or genitive behind a name stays
    return (m.start(), m.start() + len(part)) if len(re.findall(rf"[{UP}][\w.]", part)) >= 2 else None


def find(texts: list[str], weights: str | bytes = WEIGHTS) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the personal information of each text, in order and without overlap."""
    out = []
    for text, spans in zip(texts, tagger.tag_texts(_weights(weights), texts), strict=True):
        exact: list[tuple[int, int, str]] = []
        for a, b, k in spans:
            kind = tagger.KINDS[k]
            if kind == "name" and (m := _near(EMAIL, text, a, b, 40)) and m.start() <= a and b <= m.end():
                kind = "email"  # a name inside an email is a part of it
            case = edges(text, a, b, kind)
            if case and (not exact or case[0] >= exact[-1][1]):
                exact.append((*case, kind))
        out.append(exact)
    return out


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Indices of texts with content, in groups of bounded total length."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            group.append(i)
            size += len(t)
            if size > GROUP_CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


def found(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``doc_id, kind, start_char`` of each case; null, empty and blank texts hold none.

    Whole texts are tagged, however long. Rows repeated under one id give each case once.
    """

    model = Path(weights).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for group in _groups(texts):
                for i, spans in zip(group, find([texts[i] for i in group], model), strict=True):
                    rows += [(ids[i], kind, a) for a, _, kind in spans]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["doc_id", "kind", "start_char"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, kind string, start_char int").distinct()


def masked(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """``doc_id, text`` of every row, each case replaced by ``[EMAIL]``, ``[PHONE]`` and so on; a null stays null."""

    model = Path(weights).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for group in _groups(texts):
                for i, spans in zip(group, find([texts[i] for i in group], model), strict=True):
                    text = texts[i]
                    for a, b, kind in reversed(spans):
                        text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
                    texts[i] = text
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return spread(documents.select("doc_id", "text"), "doc_id").mapInArrow(run, "doc_id bigint, text string")
