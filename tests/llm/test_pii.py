import re

import numpy as np
import pytest

from repoloom.llm import pii, tagger

TEXT = "Reported-by: Bodil Askangor <bodil.ask@example.org>\nCall +44 7700 900705 if the job fails at night.\nMy passport no. HZ9671002, phone 01632 960217, in case the form asks.\nShip the kit to 397 Heron Lane, Ostford, ZZ 00123.\nWrite to soren.noradour [at] uni [dot] example [dot] org for access.\n"


def cases(text):
    return [(kind, text[a:b]) for a, b, kind in pii.find([text])[0]]


def test_kinds():
    assert cases(TEXT) == [("name", "Bodil Askangor"), ("email", "bodil.ask@example.org"), ("phone", "+44 7700 900705"), ("id_number", "HZ9671002"), ("phone", "01632 960217"), ("address", "397 Heron Lane, Ostford, ZZ 00123"), ("email", "soren.noradour [at] uni [dot] example [dot] org")]


@pytest.mark.parametrize("text", ["", " ", "Clone it from git@git.example:query/quota.git and run the setup target.", "The Gustav worker drops error 800-861-0039 since 2024-02-12.", "Graph Builder and Session Cache share the same route queue.", "Rename save_invoice to keep it in line with the other helpers.", "Order number 468-68 is only a sample value. The port is 8087, the address 10.0.87.87."])
def test_no_cases(text):
    assert cases(text) == []


def test_marks_around_names_stay():
    text = "INSERT INTO node_users VALUES (7, 'Bodil Askangor', '397 Heron Lane, Ostford, ZZ 00123');\nBodil Askangor's branch still fails.\n"
    out = text
    for a, b, kind in reversed(pii.find([text])[0]):
        out = f"{out[:a]}[{kind.upper()}]{out[b:]}"
    assert out == "INSERT INTO node_users VALUES (7, '[NAME]', '[ADDRESS]');\n[NAME]'s branch still fails.\n"


def test_long_texts_are_read_to_the_end():
    filler = "The parser skips a chunk larger than 683 KB and writes a warning. " * 400
    found = pii.find([filler + TEXT + filler])[0]
    assert len(found) == 7 and found[0][0] == len(filler) + 13


def test_table(spark):
    df = spark.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (3, ""), (4, "nothing here")], "doc_id bigint, text string").selectExpr("*", "'clash' as kind")
    rows = pii.found(df).collect()
    assert len(rows) == 7 and {r.doc_id for r in rows} == {1}
    out = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert out[2] is None and out[3] == "" and out[4] == "nothing here" and out[1].startswith("Reported-by: [NAME] <[EMAIL]>\nCall [PHONE] if")
    assert pii.found(df.limit(0)).count() == 0


def test_gradients_are_exact():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tagger.initial(1).items()}
    ids, tags = rng.integers(0, 100, (7, 3)), rng.integers(0, tagger.TAGS, (7, 3))
    _, g = tagger.loss_and_gradients(p, ids, tags)
    for key in ("emb", "wxf", "whb", "bf", "wo", "trans", "start"):
        at = tuple(rng.integers(0, n) for n in p[key].shape) if key != "emb" else (int(ids[0, 0]), 3)
        step = 1e-3
        q = {k: v.copy() for k, v in p.items()}
        q[key][at] += step
        up, _ = tagger.loss_and_gradients(q, ids, tags)
        q[key][at] -= 2 * step
        down, _ = tagger.loss_and_gradients(q, ids, tags)
        assert g[key][at] == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    p = tagger.initial(2)
    scores = rng.normal(0, 2, (3, tagger.TAGS, 1)).astype(np.float32)
    ok = tagger.allowed()
    best = max((s for s in itertools.product(range(tagger.TAGS), repeat=3) if ok[0, s[0]] and all(ok[a, b] for a, b in zip(s, s[1:], strict=False))), key=lambda s: p["start"][s[0]] + sum(scores[t, x, 0] for t, x in enumerate(s)) + sum(p["trans"][a, b] for a, b in zip(s, s[1:], strict=False)))
    assert tuple(tagger.viterbi(p, scores)[:, 0]) == best


def test_reconciliation_prefers_the_deeper_window():
    assert tagger.reconcile([(10, 20, 4, 0), (8, 20, 4, 30), (50, 60, 0, 5)]) == [(8, 20, 4), (50, 60, 0)]
    assert tagger.window_starts(100) == [0] and tagger.window_starts(500)[-1] == 500 - tagger.WINDOW


def test_windows_without_a_case_are_told_without_decoding():
    rng = np.random.default_rng(5)
    p = tagger.initial(2)
    scores = rng.normal(0, 1, (6, tagger.TAGS, 40)).astype(np.float32)
    scores[:, 0, ::2] += 50
    whole = tagger.viterbi(p, scores)
    assert not whole[:, ::2].any() and whole[:, 1::2].any()
    assert (whole[:, 1:2] == tagger.viterbi(p, scores[:, :, 1:2])).all()


def test_states_by_column_are_those_of_training():
    p = tagger.initial(4)
    ids = np.random.default_rng(1).integers(0, tagger.VOCABULARY, (30, 5)).astype(np.uint8)
    H = tagger.HIDDEN
    want = tagger._run(p, ids, "f") @ p["wo"][:H] + tagger._run(p, ids, "b") @ p["wo"][H:] + p["bo"]
    assert np.allclose(tagger.emissions(p, ids).transpose(0, 2, 1), want, atol=1e-4)


def test_spans_do_not_depend_on_the_texts_beside():
    other = ["", "x", TEXT[::-1], "a" * 1000]
    p = pii._weights(pii.WEIGHTS)
    assert tagger.tag_texts(p, [*other, TEXT])[-1] == tagger.tag_texts(p, [TEXT])[0]
    a, b = tagger.Codes([*other, TEXT]), tagger.Codes([TEXT])
    assert np.allclose(tagger.gate_scores(p["gate"], a)[-len(TEXT) // tagger.BLOCK :], tagger.gate_scores(p["gate"], b)[-len(TEXT) // tagger.BLOCK :], atol=1e-6)


#: Sentences labelled by hand, of no table: ``{kind:text}`` is a case.
BY_HAND = """
Please forward the invoice to {email:martha.klein@firma.example.de} before Friday.
My new number is {phone:+49 30 901820}, the old one no longer works.
Reviewed by {name:Thomas Berger}, merged on Monday.
The courier only delivers to {address:12 Station Road, Ashford} in the morning.
Her passport no. {id_number:K8842917} expires next year.
Ask {name:Ingrid Solberg} or write to {email:i.solberg@mail.example.org}.
Call {phone:(030) 123-4567} and ask for the night shift.
According to {name:Paul Okafor} the index is rebuilt twice.
Write to {email:ops-team [at] example [dot] org} if the build breaks.
Contact: {name:Maria Lopez}, {phone:+34 612 345 678}.
SSN: {id_number:512-44-8731} was found in the log.
Laut {name:Sabine Krüger} ist der Cache leer.
Die Lieferung geht an {address:Lindenstraße 14, 50674 Köln}.
Ausweisnummer {id_number:L01X00T47} steht im Formular.
D'après {name:Claire Fontaine}, le test est ancien.
Envoyez le colis au {address:18 rue des Lilas, 75020 Paris}.
Escriba a {email:soporte@empresa.example.es} antes del lunes.
Según {name:Javier Moreno}, la prueba falla.
El paquete va a {address:Calle Mayor 22, 28013 Madrid}.
Fixed by {name:K. Lindqvist} in the last release.
Clone it from git@example.com:core/tools.git and run make.
The value 3.14159265 is close enough, error 404 is not.
OrderService calls PaymentGateway and returns a Receipt.
Version 2.10.3 drops the flag --email from the parser.
The function load_user(name) reads the address table.
Release Blue Harbor ships with Graph Builder 7.
The Index Manager writes 1024 rows to port 8080.
Commit 9f8a7c6d5e4b3a2918 breaks the digest check.
"""


def by_hand():
    for line in BY_HAND.strip().splitlines():
        text, want = "", set()
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            if m := re.fullmatch(r"\{(\w+):([^}]*)\}", part):
                want.add((len(text), m[1]))
                part = m[2]
            text += part
        yield text, want


def test_parts_of_a_long_text(monkeypatch):
    filler = "The parser skips a chunk larger than 683 KB and writes a warning. " * 200
    text = filler + TEXT + filler + TEXT
    whole = pii.find([text])[0]
    monkeypatch.setattr(tagger, "PART", 8192)
    assert pii.find([text])[0] == whole and len(whole) == 14


def test_cases_labelled_by_hand():
    p = pii._weights(pii.WEIGHTS)
    figures = {}
    for stage, found in (("raw", lambda t: {(a, tagger.KINDS[k]) for a, _, k in tagger.tag_texts(p, [t])[0]}), ("final", lambda t: {(a, k) for a, _, k in pii.find([t])[0]})):
        rows = [(found(text), want) for text, want in by_hand()]
        both, got, all_ = sum(len(g & w) for g, w in rows), sum(len(g) for g, _ in rows), sum(len(w) for _, w in rows)
        figures[stage] = (both / got, both / all_)
    print(figures)
    assert min(figures["final"]) >= 0.8 and 2 * figures["raw"][0] * figures["raw"][1] / sum(figures["raw"]) > 0.7
