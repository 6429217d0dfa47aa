"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, scoring and window decoding."""

from __future__ import annotations

import contextlib
import ctypes
import multiprocessing
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tag 0 is outside; 1 + 2 k begins and 2 + 2 k continues kind k.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 384, 288
#: Characters that are tagged on either side of a stretch that the gate lets through.
CONTEXT = 64
#: Length of a training window.
TRAINING_WINDOW = 192
HIDDEN, EMBEDDING = 40, 24
_PAD, _LOWER, _UPPER, _OTHER, _NEWLINE, _TAB = 0, 96, 97, 98, 99, 100
VOCABULARY = 101


def _table() -> np.ndarray:
    ids = np.full(0x250, _OTHER, np.uint8)
    for code in range(0x250):
        c = chr(code)
        if 32 <= code < 127:
            ids[code] = code - 31
        elif c in "\n\r":
            ids[code] = _NEWLINE
        elif c.isspace():
            ids[code] = _TAB
        elif c.isalpha():
            ids[code] = _UPPER if c.isupper() else _LOWER
    return ids


_IDS = _table()


def encode(text: str) -> np.ndarray:
    """Class of each code point: ASCII as it is, other Latin letters by case, the rest together."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 0x250, _IDS[np.minimum(codes, 0x24F)], _OTHER).astype(np.uint8)


def allowed() -> np.ndarray:
    """Which tag may follow which: a continuation only its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    H, E = HIDDEN, EMBEDDING
    p = {"emb": rng.normal(0, 0.3, (VOCABULARY, E))}
    for d in "fb":
        p[f"wx{d}"] = rng.normal(0, E**-0.5, (E, 4 * H))
        p[f"wh{d}"] = rng.normal(0, H**-0.5, (H, 4 * H))
        p[f"b{d}"] = np.concatenate([np.zeros(H), np.ones(H), np.zeros(2 * H)])
    p["wo"], p["bo"] = rng.normal(0, (2 * H) ** -0.5, (2 * H, TAGS)), np.zeros(TAGS)
    p["trans"], p["start"] = rng.normal(0, 0.1, (TAGS, TAGS)), np.zeros(TAGS)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(p: dict, ids: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) of one direction. Gates: input, forget, output, candidate."""
    H = HIDDEN
    steps, batch = ids.shape
    table = p["emb"] @ p[f"wx{d}"] + p[f"b{d}"]
    wh = p[f"wh{d}"].copy()
    table[:, 3 * H :] *= 2  # tanh(x) = 2 sigmoid(2 x) - 1
    wh[:, 3 * H :] *= 2
    h = np.zeros((batch, H), np.float32)
    c = np.zeros((batch, H), np.float32)
    out = np.empty((steps, batch, H), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = h @ wh
        z += table[ids[t]]
        s = _sigmoid(z)
        g = s[:, 3 * H :] * 2 - 1
        before = c
        c = s[:, H : 2 * H] * c + s[:, :H] * g
        tc = _sigmoid(c * 2) * 2 - 1
        if keep is not None:
            keep.append((t, s, g, before, tc, h))
        h = s[:, 2 * H : 3 * H] * tc
        out[t] = h
    return out


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keep the matrix library of this process to one thread: a task has one core, and small products gain nothing."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def _fast(p: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For both directions the input table, recurrent and output weights, arranged for states of (hidden, batch).

    A sigmoid is half a hyperbolic tangent of half its argument, so that one call serves all gates.
    """
    H, out = HIDDEN, []
    for d, rows in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
        half = np.repeat([0.5, 1.0], [3 * H, H]).astype(np.float32)
        table = (p["emb"] @ p[f"wx{d}"] + p[f"b{d}"]) * half
        out.append((np.ascontiguousarray(table.T), np.ascontiguousarray((p[f"wh{d}"] * half).T), np.ascontiguousarray(p["wo"][rows].T)))
    return out


def emissions(p: dict, ids: np.ndarray) -> np.ndarray:
    """Tag scores (time, tags, batch) of windows ``ids`` (time, batch)."""
    H = HIDDEN
    steps, batch = ids.shape
    scores = np.empty((steps, TAGS, batch), np.float32)
    scores[:] = p["bo"][None, :, None]
    for (table, wh, wo), order in zip(_fast(p), (range(steps), range(steps - 1, -1, -1)), strict=True):
        h, c = np.zeros((H, batch), np.float32), np.zeros((H, batch), np.float32)
        z, cell = np.empty((4 * H, batch), np.float32), np.empty((H, batch), np.float32)
        for t in order:
            np.matmul(wh, h, out=z)
            z += table[:, ids[t]]
            np.tanh(z, out=z)
            gates = z[: 3 * H]
            gates *= 0.5
            gates += 0.5
            c *= z[H : 2 * H]
            np.multiply(z[:H], z[3 * H :], out=cell)
            c += cell
            np.tanh(c, out=h)
            h *= z[2 * H : 3 * H]
            scores[t] += wo @ h
    return scores


def viterbi(p: dict, scores: np.ndarray) -> np.ndarray:
    """The best tag sequences (time, batch) of scores (time, tags, batch).

    A window in which the outside tag leads everywhere by more than any transitions can make good has no other tag, so
    that only the others are decoded.
    """
    steps, n, batch = scores.shape
    ok = allowed()
    trans = np.where(ok, p["trans"], -1e4).astype(np.float32)
    begin = (p["start"] + np.where(ok[0], 0, -1e4)).astype(np.float32)
    gain = max(float((p["trans"][ok] - p["trans"][0, 0]).max()), float((p["start"] - p["start"][0]).max()), 0.0)
    lead = (scores[:, 0] - scores[:, 1:].max(1)).min(0)
    out = np.zeros((steps, batch), np.int8)
    todo = np.flatnonzero(lead <= 2 * gain)
    if not len(todo):
        return out
    part = np.ascontiguousarray(scores[:, :, todo])
    best = part[0] + begin[:, None]
    back = np.empty((steps, n, len(todo)), np.int8)
    inner = [2 + 2 * k for k in range(len(KINDS))]
    outer = [0] + [1 + 2 * k for k in range(len(KINDS))]
    arrive = trans[:, outer]
    columns = np.arange(len(todo))
    for t in range(1, steps):
        new = part[t].copy()
        for at, j in enumerate(outer):
            step = best + arrive[:, at, None]
            arg = step.argmax(0)
            back[t, j] = arg
            new[j] += step[arg, columns]
        for j in inner:  # a continuation follows only its own kind
            first, more = best[j - 1] + trans[j - 1, j], best[j] + trans[j, j]
            longer = more > first
            back[t, j] = np.where(longer, j, j - 1)
            new[j] += np.where(longer, more, first)
        best = new
    path = np.empty((steps, len(todo)), np.int8)
    path[-1] = best.argmax(0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t, path[t], columns]
    out[:, todo] = path
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(p: dict, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Negative log likelihood per character of the CRF and its gradients, by forward-backward and back-propagation."""
    H = HIDDEN
    steps, batch = ids.shape
    kept: dict[str, list] = {"f": [], "b": []}
    hf, hb = _run(p, ids, "f", kept["f"]), _run(p, ids, "b", kept["b"])
    scores = hf @ p["wo"][:H] + hb @ p["wo"][H:] + p["bo"]
    trans = p["trans"]
    alpha = np.empty_like(scores)
    beta = np.zeros_like(scores)
    alpha[0] = scores[0] + p["start"]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, :, None] + trans[None], 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _log_sum(alpha[-1], 1)
    rows = np.arange(batch)
    gold = scores[0][rows, tags[0]] + p["start"][tags[0]]
    for t in range(1, steps):
        gold = gold + scores[t][rows, tags[t]] + trans[tags[t - 1], tags[t]]
    scale = 1.0 / (steps * batch)
    ds = np.exp(alpha + beta - z[None, :, None])
    g = {"start": (ds[0].sum(0) - np.bincount(tags[0], minlength=TAGS)) * scale}
    dtrans = np.zeros((TAGS, TAGS))
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + trans[None] + (scores[t] + beta[t])[:, None, :] - z[:, None, None]
        dtrans += np.exp(pair).sum(0)
        np.subtract.at(dtrans, (tags[t - 1], tags[t]), 1)
    g["trans"] = dtrans * scale
    for t in range(steps):
        ds[t][rows, tags[t]] -= 1
    ds *= scale
    both = np.concatenate([hf, hb], 2).reshape(-1, 2 * H)
    flat = ds.reshape(-1, TAGS)
    g["wo"], g["bo"] = both.T @ flat, flat.sum(0)
    dh_all = (flat @ p["wo"].T).reshape(steps, batch, 2 * H)
    demb_in = np.zeros((VOCABULARY, EMBEDDING), np.float32)
    for d, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
        wh = p[f"wh{d}"]
        dwh = np.zeros_like(wh)
        dtable = np.zeros((VOCABULARY, 4 * H), np.float32)
        dh_next = np.zeros((batch, H), np.float32)
        dc_next = np.zeros((batch, H), np.float32)
        for t, s, cand, before, tc, h_before in reversed(kept[d]):
            i, f, o = s[:, :H], s[:, H : 2 * H], s[:, 2 * H : 3 * H]
            dh = dh_all[t][:, part] + dh_next
            dc = dc_next + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
            dwh += h_before.T @ dz
            one = np.zeros((batch, VOCABULARY), np.float32)
            one[rows, ids[t]] = 1
            dtable += one.T @ dz
            dh_next = dz @ wh.T
            dc_next = dc * f
        g[f"wh{d}"], g[f"wx{d}"], g[f"b{d}"] = dwh, p["emb"].T @ dtable, dtable.sum(0)
        demb_in += dtable @ p[f"wx{d}"].T
    g["emb"] = demb_in
    return float((z - gold).sum() * scale), {k: np.asarray(v, np.float32) for k, v in g.items()}


def _share(args: tuple) -> tuple[float, dict]:
    return loss_and_gradients(*args)


def train(p: dict, windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int, rate: float, seed: int, report=None, workers: int = 1) -> dict:
    """Adam with a cosine schedule over windows (count, time); gradients are clipped by norm, a batch is shared by workers."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v2 = {k: np.zeros_like(v) for k, v in p.items()}
    total, step = epochs * (len(windows) // batch), 0
    with multiprocessing.get_context("fork").Pool(workers) if workers > 1 else contextlib.nullcontext() as pool:
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            losses = []
            for at in range(0, len(order) - batch + 1, batch):
                parts = [(p, np.ascontiguousarray(windows[x].T), tags[x].T.astype(np.int64)) for x in np.array_split(order[at : at + batch], workers)]
                results = pool.map(_share, parts, 1) if pool else [_share(parts[0])]
                losses.append(float(np.mean([r[0] for r in results])))
                g = {k: np.mean([r[1][k] for r in results], axis=0) for k in p}
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                shrink = min(1.0, 0.25 / (norm + 1e-9))
                step += 1
                lr = rate * (0.5 + 0.5 * np.cos(np.pi * step / total)) + 1e-5
                for k in p:
                    gk = g[k] * shrink
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                    p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            if report:
                report(epoch, float(np.mean(losses)), p)
    return p


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover a stretch of ``n`` characters; the last one ends with the stretch."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


#: Characters of a block that the gate judges, those of its neighbours that it sees, and hash buckets of its features.
BLOCK, SEEN, BUCKETS = 32, 16, 1 << 15


def _classes() -> np.ndarray:
    """The class of each code for the gate: lower letters and marks as they are, capitals together, digits together."""
    out = np.arange(VOCABULARY, dtype=np.int64)
    for code in range(32, 127):
        c = chr(code)
        if c.isupper():
            out[code - 31] = ord("A") - 31
        elif c.isdigit():
            out[code - 31] = ord("0") - 31
    out[_UPPER] = ord("A") - 31
    return out


_CLASS = _classes()
_SHAPE = np.array([ord("a") - 31 if _CLASS[c] == c and (ord("a") - 31 <= c <= ord("z") - 31 or c == _LOWER) else _CLASS[c] for c in range(VOCABULARY)])


#: Stands before each text, so that no feature reaches into the text before.
_APART = np.array([_PAD, _TAB, _PAD, _TAB, _PAD, _TAB], np.uint8)


class Codes:
    """The codes of several texts in one array; text ``k`` lies at ``first[k]`` up to ``last[k]``."""

    def __init__(self, texts: list[str]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        gaps = len(_APART) * np.arange(1, len(texts) + 1)
        self.last = np.cumsum(sizes) + gaps
        self.first = self.last - sizes
        self.all = np.tile(_APART, len(texts) + int(sizes.sum()) // len(_APART) + 1)[: int(sizes.sum()) + len(_APART) * len(texts)]
        for k, first in enumerate(self.first.tolist()):
            self.all[first - len(_APART) : first] = _APART
        self.all[np.arange(int(sizes.sum())) + np.repeat(gaps, sizes)] = encode("".join(texts))


def gate_features(codes: np.ndarray) -> np.ndarray:
    """Two hashed features of each position: the four classes up to it, and the last six runs of one shape up to it."""
    n = len(codes)
    if not n:
        return np.zeros((2, 0), np.int64)

    def mix(x: np.ndarray, seed: int) -> np.ndarray:
        x *= np.int64(0x2545F4914F6CDD1D)
        x += seed
        x >>= 40
        x &= BUCKETS - 1
        return x

    a = np.concatenate([np.zeros(3, np.int64), _CLASS[codes]])
    grams = a[:n] * 101
    for k in (1, 2):
        grams += a[k : n + k]
        grams *= 101
    grams += a[3:]
    shape = _SHAPE[codes]
    changes = np.diff(shape, prepend=-1) != 0
    runs = np.concatenate([np.zeros(5, np.int64), shape[changes]])
    m = len(runs) - 5
    key = runs[:m].copy()
    for k in range(1, 6):
        key *= 101
        key += runs[k : m + k]
    return np.stack([mix(grams, 17), BUCKETS + mix(key, 71)[np.cumsum(changes) - 1]])


def blocks_of(codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of the texts: number of the text, start and end in ``codes.all``."""
    counts = -(-(codes.last - codes.first) // BLOCK)
    text = np.repeat(np.arange(len(counts)), counts)
    low = codes.first[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    return text, low, np.minimum(low + BLOCK, codes.last[text])


def gate_scores(weights: np.ndarray, codes: Codes, features: np.ndarray | None = None) -> np.ndarray:
    """The log odds of each block that it holds a part of a case."""
    if features is None:
        features = gate_features(codes.all)
    total = np.concatenate([[0.0], np.cumsum(weights[features[0]] + weights[features[1]], dtype=np.float64)])
    text, low, high = blocks_of(codes)
    return total[np.minimum(high + SEEN, codes.last[text])] - total[np.maximum(low - SEEN, codes.first[text])] + weights[-1]


#: Characters that the gate looks at together at most, and those before a part of a longer text that it sees as well.
PART, LEAD = 1 << 18, 1 << 12


def _open_blocks(gate: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """The blocks that the gate lets through, in order, as text, start and end; parts of long texts are looked at in turn."""
    group: list[tuple[int, int, str]] = []  # text, start of the part with its lead, part

    def judged() -> Iterator[tuple[int, int, int]]:
        codes = Codes([part for _, _, part in group])
        which = np.flatnonzero(gate_scores(gate, codes) > 0)
        text, low, high = (x[which] for x in blocks_of(codes))
        for k, a, b in zip(text.tolist(), (low - codes.first[text]).tolist(), (high - codes.first[text]).tolist(), strict=True):
            no, start, _ = group[k]
            if start == 0 or a >= LEAD:
                yield no, start + a, start + b

    size = 0
    for no, text in enumerate(texts):
        for at in range(0, len(text), PART):
            start = max(0, at - LEAD)
            group.append((no, start, text[start : at + PART]))
            size += len(group[-1][2])
            if size >= PART:
                yield from judged()
                group, size = [], 0
    if group:
        yield from judged()


def stretches(p: dict, texts: list[str]) -> list[tuple[int, int, int]]:
    """The stretches that are tagged, as text, start and end: blocks that the gate lets through, with their context."""
    if "gate" not in p:
        return [(k, 0, len(t)) for k, t in enumerate(texts) if t]
    out: list[tuple[int, int, int]] = []
    for k, low, high in _open_blocks(p["gate"], texts):
        a, b = max(0, low - CONTEXT), min(len(texts[k]), high + CONTEXT)
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1] = (k, out[-1][1], b)
        else:
            out.append((k, a, b))
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the tagged spans of one sequence."""
    hits = np.flatnonzero(tags)
    out: list[tuple[int, int, int]] = []
    for at in hits.tolist():
        tag = int(tags[at])
        kind = (tag - 1) // 2
        if out and tag % 2 == 0 and out[-1][1] == at and out[-1][2] == kind:
            out[-1] = (out[-1][0], at + 1, kind)
        else:
            out.append((at, at + 1, kind))
    return out


def reconcile(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """One set of spans for a text from those of its windows: (start, end, kind, distance to the nearer window edge).

    Spans of two windows that overlap are one case: the one that lies deeper inside its window is kept; a span that a
    window edge cuts is the least deep of all.
    """
    out: list[tuple[int, int, int]] = []
    group: list[tuple[int, int, int, int]] = []
    reach = -1

    def settle() -> None:
        kept: list[tuple[int, int, int, int]] = []
        for span in sorted(group, key=lambda s: (-s[3], s[0])):
            if all(span[1] <= o[0] or o[1] <= span[0] for o in kept):
                kept.append(span)
        out.extend((a, b, k) for a, b, k, _ in kept)

    for span in sorted(found):
        if span[0] >= reach:  # nothing before reaches it
            settle()
            group, reach = [], -1
        group.append(span)
        reach = max(reach, span[1])
    settle()
    return sorted(out)


def tag_texts(p: dict, texts: list[str], batch: int = 512) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of the spans of each text; what the gate lets through is tagged in overlapping windows."""
    one_thread()
    places: list[tuple[int, int, int, bool, bool]] = []  # size, text, start, whether the window cuts the text there
    for k, a, b in stretches(p, texts):
        for s in window_starts(b - a):
            size = min(WINDOW, b - a)
            places.append((size, k, a + s, a + s > 0, a + s + size < len(texts[k])))
    places.sort()
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for at in range(0, len(places), batch):
        part = places[at : at + batch]
        width = part[-1][0]
        ids = np.zeros((len(part), width), np.uint8)
        codes = encode("".join(texts[k][s : s + size] for size, k, s, _, _ in part))
        at_code = 0
        for row, (size, *_) in enumerate(part):
            ids[row, :size] = codes[at_code : at_code + size]
            at_code += size
        best = viterbi(p, emissions(p, np.ascontiguousarray(ids.T))).T
        for row in np.flatnonzero(best.any(1)).tolist():
            size, k, s, open_left, open_right = part[row]
            for a, b, kind in spans(best[row]):
                if a < size:
                    b = min(b, size)
                    found[k].append((s + a, s + b, kind, min(a if open_left else WINDOW, size - b if open_right else WINDOW)))
    return [reconcile(f) for f in found]


def save(p: dict, path: str) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


def load(path) -> dict[str, np.ndarray]:  # noqa: ANN001 - a path or an open file
    with np.load(path) as data:
        return {k: data[k].astype(np.float32) for k in data.files}
