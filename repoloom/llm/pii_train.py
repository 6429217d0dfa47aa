"""Train the tagger of personal information: ``python -m repoloom.llm.pii_train DOCUMENTS.parquet``.

Labelled spans come from a bounded sample of documents (``SAMPLE`` rows). Labelling functions mark what has an
unmistakable form or context; first names are learned from the contexts that only a person can stand in. Every marked
document is used again with its names, numbers and addresses replaced by invented ones, so that the tagger learns forms
and contexts and no list. The weights are written next to this module; nothing else of the sample is kept.
"""

from __future__ import annotations

import os
import random
import re
import sys
import time
from collections import Counter
from functools import lru_cache

import numpy as np

from repoloom.llm import tagger

SAMPLE = 10_000
EPOCHS, BATCH, RATE, SEED = 14, 256, 8e-3, 7
#: Passes over the sample that fit the gate; the part of the cases kept apart that it may miss, and how much wider it opens.
GATE_PASSES, GATE_MISS, GATE_MARGIN = 8, 0.0005, 2.0

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
SURNAME = rf"(?:[{_UP}][{_LOW}’']{{3,}}|[{_UP}]{{5,}})"
SURNAMES = rf"(?:(?:van|von|de|da|del|di|der|den|VAN|VON|DE) )?{SURNAME}(?:-{SURNAME})?"
NAME_CONTEXT = re.compile(
    rf"(?:Reported-by: |Author: |# author: |Reviewed by |approved-by=|TODO\(|\bping |Pairing with |According to |\"owner\": \"|User\(name=\"|Laut |Según |D'après |contact |Dr\. )(?P<first>[{_UP}][{_LOW}]+|[{_UP}]{{3,}}) (?:[{_UP}]\. )?{SURNAMES}"
)
_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\s+AT\s+|\s+at\s+(?=[\w-]+\s+dot\s))"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+DOT\s+|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*{_AT}(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,}}\b(?!:\w)", re.A)
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{2,8}){1,5}|\(\d{2,5}\) ?\d{3}[ -]?\d{3,5}|\d{3}([.-])\d{3}\1\d{4}|0\d(?: \d{2}){4}|0\d{2,5}[ /-]\d{5,9}|0\d{3,4} \d{3} \d{3,4})(?: (?:ext\.?|x|Durchwahl|poste) ?\d{1,5})?(?![\w-]|\.\d)"
)
_NOT_PHONE = re.compile(r"(?i)(?:error|entry|order number|version|revision|digest|address|build|ticket|port|commit|issue)\s+$")
ID_LABEL = r"(?i:passport(?: no\.?| number| n°)?|ssn:?|social security (?:number|no\.?)|tax id|driving licen[cs]e(?: no\.?)?|id card(?: no\.?)?|national insurance number|ausweisnummer|ausweis-nr\.?|personalausweis(?:nummer)?|reisepass-?nr\.?|steuer-id|steuernummer|sozialversicherungsnummer|passeport n°|num[ée]ro de s[ée]curit[ée] sociale|carte d['’]identit[ée](?: n°)?|dni|nie|pasaporte(?: n\.?º)?|n[úu]mero de (?:la )?seguridad social)"
ID = re.compile(rf"\b{ID_LABEL}[ :]+(?P<id>(?=[A-Z -]*\d)(?=(?:[ -]?[A-Z\d]){{6}})[A-Z\d]{{1,14}}(?:[ -][A-Z\d]{{1,12}}(?![{_LOW}\w]))*)(?![\w])")
_PLACE = rf"[{_UP}][\w’'-]+(?: [{_UP}][\w’'-]+)?"
_TAIL = rf"(?:, (?:Apt|Suite|Flat|Unit) \d+)?(?:, {_PLACE})?(?:, [A-Z]{{2}} \d{{5}})?"
ADDRESS = re.compile(
    rf"(?<![\w-])(?:\d{{1,5}}[a-z]? (?:[{_UP}][\w’'-]+ ){{1,3}}(?:Street|St\.|Lane|Road|Rd\.|Avenue|Ave\.?|Drive|Crescent|Blvd\.?|Boulevard|Court|Way|Close|Terrace|Square|Place){_TAIL}"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|impasse|boulevard|place|quai|chemin|allée) (?:de la |de l['’]|des |du |de )?{_PLACE}(?: {_PLACE})?(?:, \d{{5}} {_PLACE})?"
    rf"|[{_UP}][{_LOW}]+(?:straße|strasse|str\.|weg|gasse|platz|allee|ufer|damm|ring|steig|stieg|hof|winkel|graben|markt) \d{{1,4}}[a-z]?(?:, \d{{5}} {_PLACE})?"
    rf"|(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo|Camino|Ronda) ?(?:de la |de las |de los |del |de )?{_PLACE} \d{{1,4}}(?:, \d+º ?[A-Z]?)?(?:, \d{{5}} {_PLACE})?)"
)


def first_names(texts: list[str]) -> set[str]:
    """First names that stand at least twice where only a person can."""
    seen = Counter(m["first"].title() for t in texts for m in NAME_CONTEXT.finditer(t))
    return {n for n, k in seen.items() if k >= 2 and n not in ("The", "Project", "Stage")}


@lru_cache(maxsize=4)
def _name_forms(firsts: frozenset[str]) -> re.Pattern:
    first = "|".join(sorted([*firsts, *(n.upper() for n in firsts)])) or "(?!)"
    return re.compile(rf"(?<![\w.])(?:(?:{first}) (?:[{_UP}]\. )?{SURNAMES}|[{_UP}]\. {SURNAMES}|(?:van |VAN )?{SURNAME}(?:-{SURNAME})?, (?:{first})(?: [{_UP}]\.)?)(?![\w])")


def label(text: str, firsts: set[str]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the spans that the labelling functions mark; the earlier kind wins where two overlap."""
    spans: list[tuple[int, int, int]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in spans):
            spans.append((a, b, tagger.KINDS.index(kind)))

    for m in EMAIL.finditer(text):
        add(m.start(), m.end(), "email")
    for m in ID.finditer(text):
        add(m.start("id"), m.end("id"), "id_number")
    for m in ADDRESS.finditer(text):
        add(m.start(), m.end(), "address")
    for m in PHONE.finditer(text):
        if not _NOT_PHONE.search(text[max(0, m.start() - 16) : m.start()]):
            add(m.start(), m.end(), "phone")
    for m in _name_forms(frozenset(firsts)).finditer(text):
        add(m.start(), m.end(), "name")
    return sorted(spans)


_SYLLABLES = [a + b for a in "b d f g k l m n p r s t v br kr st tr th sk w h j z".split() for b in ("a", "e", "i", "o", "u", "an", "er", "in", "or", "ai", "el", "ar")]
_ENDS = "son berg ton ini escu ovic ska ez eau mann ford wood ley er sen strand ano ucci wicz enko ova ides ard et in ulis quist holm".split()


def invented(kind: str, old: str, rng: random.Random) -> str:
    """Another value of the same form: letters and digits are replaced, punctuation and case stay."""
    if kind == "name":

        def word(m: re.Match) -> str:
            w = m[0]
            if len(w) <= 3:
                return w
            new = (rng.choice(_SYLLABLES) + (rng.choice(_SYLLABLES) if rng.random() < 0.7 else "") + (rng.choice(_ENDS) if rng.random() < 0.6 else rng.choice("aeinosy"))).capitalize()
            return new.upper() if w.isupper() else new

        return re.sub(rf"[{_UP}{_LOW}’']+", word, old)
    if kind in ("phone", "id_number"):
        return re.sub(r"\d", lambda m: str(rng.randrange(10)) if rng.random() < 0.8 else m[0], re.sub(r"(?<=\d)[A-Z](?=\d)", lambda m: rng.choice("ABCDEFGHJKLMNPRSTVWXYZ"), old))
    if kind == "email":
        at = re.match(r"[\w.+%-]+", old)
        return re.sub(r"[a-z]{3,}", lambda m: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in m[0]), at[0]) + old[at.end() :]
    return re.sub(r"\d", lambda m: str(rng.randrange(1, 10)), old)


def augmented(text: str, spans: list[tuple[int, int, int]], rng: random.Random, capitals: float = 0.0) -> tuple[str, list[tuple[int, int, int]]]:
    out, at, new, size = [], 0, [], 0
    for a, b, kind in spans:
        out.append(text[at:a])
        size += a - at
        value = invented(tagger.KINDS[kind], text[a:b], rng)
        if kind == 4 and rng.random() < capitals:
            value = value.upper()
        new.append((size, size + len(value), kind))
        out.append(value)
        size += len(value)
        at = b
    out.append(text[at:])
    return "".join(out), new


def windows_of(text: str, spans: list[tuple[int, int, int]], rng: random.Random, plain: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training windows: all that hold a span, and a share ``plain`` of the rest."""
    ids = tagger.encode(text)
    tags = np.zeros(len(ids), np.uint8)
    for a, b, kind in spans:
        tags[a] = 1 + 2 * kind
        tags[a + 1 : b] = 2 + 2 * kind
    out = []
    for s in range(0, max(1, len(ids) - 20), tagger.TRAINING_WINDOW - 16):
        part, goal = ids[s : s + tagger.TRAINING_WINDOW], tags[s : s + tagger.TRAINING_WINDOW].copy()
        if goal.any() or rng.random() < plain:
            if len(goal) and goal[0] and goal[0] % 2 == 0:
                goal[0] -= 1  # a window may begin inside a span
            pad = tagger.TRAINING_WINDOW - len(part)
            out.append((np.pad(part, (0, pad)), np.pad(goal, (0, pad))))
    return out


def fit_gate(texts: list[str], labels: list[list[tuple[int, int, int]]], seed: int = SEED, report=print) -> np.ndarray:
    """Weights of the gate's features and, at the end, its bias: logistic regression over blocks, Adagrad by groups of texts."""
    rng = np.random.default_rng(seed)
    weights = np.zeros(2 * tagger.BUCKETS + 1)
    square = np.full_like(weights, 1e-2)
    order = rng.permutation(len(texts))
    groups = []
    for at in range(0, len(order), 64):
        part = order[at : at + 64]
        codes = tagger.Codes([texts[k] for k in part])
        goal = np.zeros(len(codes.all), bool)
        cases = []
        for i, k in enumerate(part):
            for a, b, _ in labels[k]:
                goal[codes.first[i] + a : codes.first[i] + b] = True
                cases.append((codes.first[i] + a, codes.first[i] + b))
        text, low, high = tagger.blocks_of(codes)
        want = np.array([goal[a:b].any() for a, b in zip(low, high, strict=True)], bool)
        reach = np.maximum(low - tagger.SEEN, codes.first[text]), np.minimum(high + tagger.SEEN, codes.last[text])
        groups.append((codes, tagger.gate_features(codes.all), want, reach, cases, low))
    kept = max(1, len(groups) // 10)  # not fitted: they tell where the gate opens
    for _ in range(GATE_PASSES):
        for k in rng.permutation(len(groups) - kept) + kept:
            codes, features, want, (begin, stop), _, _ = groups[k]
            score = tagger.gate_scores(weights, codes, features)
            g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - want) * np.where(want, 4.0, 1.0)
            push = np.zeros(len(codes.all) + 1)
            np.add.at(push, begin, g)
            np.add.at(push, stop, -g)
            push = np.cumsum(push)[:-1]
            step = np.bincount(features.ravel(), np.tile(push, 2), len(weights))
            step[-1] += g.sum()
            square += step * step
            weights -= 0.15 * step / np.sqrt(square)
    best = []
    for codes, features, _, _, cases, low in groups[:kept]:
        score = tagger.gate_scores(weights, codes, features)
        best += [score[np.searchsorted(low, a, "right") - 1 : np.searchsorted(low, b - 1, "right")].max() for a, b in cases]
    if best:
        weights[-1] -= np.quantile(best, GATE_MISS) - GATE_MARGIN
    if report:
        opened = np.concatenate([tagger.gate_scores(weights, g[0], g[1]) > 0 for g in groups[:kept]])
        report(f"gate: lets {opened.mean():.3f} of the blocks through")
    return weights.astype(np.float32)


def fit(texts: list[str], epochs: int = EPOCHS, seed: int = SEED, report=print, workers: int = 1) -> dict[str, np.ndarray]:
    """The weights of a tagger and its gate for a bounded list of texts."""
    rng = random.Random(seed)
    firsts = first_names(texts)
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    seen: list[tuple[str, list[tuple[int, int, int]]]] = []
    for t in texts:
        spans = label(t, firsts)
        seen.append((t, spans))
        rows += windows_of(t, spans, rng, 1.0)
        if spans:
            for capitals in (0.0, 0.3):
                seen.append(augmented(t, spans, rng, capitals))
                rows += windows_of(*seen[-1], rng, 0.0)
    gate = fit_gate([t for t, _ in seen], [x for _, x in seen], seed, report)
    windows, tags = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    began = time.time()
    if report:
        report(f"{len(texts)} texts, {len(firsts)} first names, {len(windows)} windows")
    p = tagger.train(tagger.initial(seed), windows, tags, epochs, BATCH, RATE, seed, (lambda e, x, p: report(f"epoch {e}: {x:.5f}, {time.time() - began:.0f} s")) if report else None, workers)
    return p | {"gate": gate}


def score(p: dict, texts: list[str], firsts: set[str]) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and count by kind on held-out texts, by start and kind."""
    got = tagger.tag_texts(p, texts)
    out = {}
    for k, kind in enumerate(tagger.KINDS):
        want = {(i, a) for i, t in enumerate(texts) for a, _, x in label(t, firsts) if x == k}
        have = {(i, a) for i, spans in enumerate(got) for a, _, x in spans if x == k}
        both = len(want & have)
        out[kind] = (both / max(1, len(have)), both / max(1, len(want)), len(want))
    return out


def main(path: str, target: str) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t]
    random.Random(SEED).shuffle(texts)
    texts = texts[:SAMPLE]
    train, held = texts[: int(0.9 * len(texts))], texts[int(0.9 * len(texts)) :]
    p = fit(train, workers=os.cpu_count() or 1)
    tagger.save(p, target)
    print(score(tagger.load(target), held, first_names(train)))


if __name__ == "__main__":
    from pathlib import Path

    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else str(Path(__file__).with_name("pii_weights.npz")))
