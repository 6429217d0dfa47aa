"""Fit the language model of problem 3: ``python -m repoloom.llm.pairs_train DOCUMENTS.parquet``.

The n-grams of the sentences in :mod:`repoloom.llm.pairs` are joined by those of documents whose label for the language
is one that the sentences alone agree with, at most ``SAMPLE`` documents of each language, drawn by the hash of their
id. What is written are counts of hashed n-grams; nothing else of the sample is kept.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np

from repoloom.llm import pairs

#: Documents of one language that are read at most.
SAMPLE = 2_000
#: The part of a language's counts that the sentences keep beside the documents.
SENTENCES_PART = 0.5


def fit(documents: list[tuple[int, str, str]], sample: int = SAMPLE) -> np.ndarray:
    """Shares (buckets, languages) from ``doc_id, lang, text``; languages without documents have their sentences only."""
    model = pairs.LanguageModel(pairs.sentence_counts())
    counts = np.zeros_like(model.counts)
    taken = dict.fromkeys(model.languages, 0)
    for _, lang, text in sorted(documents, key=lambda d: zlib.crc32(str(d[0]).encode())):
        short = (lang or "").lower()[:2]
        if short not in taken or taken[short] >= sample or not text:
            continue
        found = pairs.natural_words(text)
        k = model.languages.index(short)
        if len(found) < 8 or model.posteriors([found])[0, k] < 0.9:
            continue
        taken[short] += 1
        for word in found:
            np.add.at(counts[:, k], model.grams(word), 1.0)
    own = model.counts / model.counts.sum(0)
    total = counts.sum(0)
    return np.where(total > 0, SENTENCES_PART * own + (1 - SENTENCES_PART) * counts / np.maximum(total, 1), own)


def main(path: str, target: str) -> None:
    import pyarrow.parquet as pq

    rows = pq.read_table(path, columns=["doc_id", "lang", "text"])
    shares = fit(list(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True)))
    scaled = np.round(shares * 2e6).astype(np.uint32)
    at = np.flatnonzero(scaled)
    np.savez_compressed(target, at=at.astype(np.uint32), n=scaled.ravel()[at])
    print(len(at), "counts")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else pairs.COUNTS)
