import pytest

from repoloom.llm import pairs as p

GOOD = [
    ("Who calls save?", "save is called by load in a/b.py."), ("Is it safe to call twice?", "Yes."), ("Is it safe to call twice?", "Yes"), ("How many?", "40"), ("Where is x_y defined?", "core/x.py"),
    ("Who calls it?", "I can not see other callers in the indexed project."), ("Who calls it?", "not found in the codebase"), ("Wo ist es definiert?", "Es ist in a/b.py definiert und wird dort geprüft."),
    ("What does it do?", "A worker is not allowed to open the file twice, so it refuses the second request. Readers can't help but wait."), ("Who calls save?", "Who calls save? It is called by load."), (None, "Something is returned."),
]
BAD = [
    ("q?", None, "empty_answer"), ("q?", " \n\u200b", "empty_answer"), ("q?", "<empty>", "empty_answer"), ("q?", "N/A", "empty_answer"), ("q?", "...", "empty_answer"),
    ("Who calls save?", "**who calls  SAVE???**", "copied_question"), ("Who calls save?", "Question: Who calls save?\nAnswer:", "copied_question"),
    ("Who calls save?", "I'm sorry, but I can't help with that request.", "refusal"), ("Wer ruft es auf?", "Dabei kann ich leider nicht helfen.", "refusal"), ("Qui ?", "Je suis désolé, je ne peux pas répondre à cette question.", "refusal"), ("q", "My guidelines do not permit me to comment on this.", "refusal"),
    ("Who calls save?", "Funkcja znajduje się w pliku i jest wywoływana przez inną.", "other_language"), ("Wer ruft es auf?", "It is called by the other function in the same file.", "other_language"), ("Who?", "この関数は別の関数から呼び出されます。", "other_language"),
    ("q", "See:\n```python\ndef f():", "truncated_answer"), ("q", "The helpers (load, save", "truncated_answer"), ("q", "It takes three parameters:", "truncated_answer"), ("Who calls emit_route?", "It is called by load, as is emit_ro", "truncated_answer"), ("Where is Thing?", "Thing ist in a/b.py definiert.", "other_language"),
]


@pytest.mark.parametrize(("q", "a"), GOOD)
def test_good(q, a):
    assert p.judge([q], [a])[0][0] is None


@pytest.mark.parametrize(("q", "a", "want"), BAD)
def test_bad(q, a, want):
    assert p.judge([q], [a])[0][0] == want


def test_end_likelihood_and_delivery(spark):
    whole = "The file is read once and the result is kept in the cache."
    runs = [(f"r{i}", "What happens?", whole, None) for i in range(20)] + [("cut", "What happens?", whole[: whole.index(" the result")], None), ("word", "What happens?", whole[:-4], None), ("stop", "What happens?", whole[:-1], None), ("cut", "What happens?", whole[: whole.index(" the result")], None), (None, None, None, None)]
    r = spark.createDataFrame(runs, "run_id string, question string, answer string, defect string")
    g = spark.createDataFrame([("g1", "q?", "", "x"), ("g2", "q?", whole * 300, "x")], "id string, question string, expected_answer string, pair_id string")
    got = sorted((x.pair_table, str(x.pair_id), x.defect) for x in p.found(r, g).collect())
    assert got == [("golden_items", "g1", "empty_answer"), ("question_runs", "None", "empty_answer"), ("question_runs", "cut", "truncated_answer"), ("question_runs", "word", "truncated_answer")]
    assert p.found(r.limit(0), g.limit(0)).count() == 0


def test_held_out_language_accuracy():
    held = {
        "en": "Every record is stored before the next one arrives.", "de": "Jeder Datensatz wird gespeichert, bevor der nächste eintrifft.", "fr": "Chaque enregistrement est stocké avant que le suivant arrive.", "es": "Cada registro se guarda antes de que llegue el siguiente.",
        "it": "Ogni registro viene salvato prima che arrivi il prossimo.", "pl": "Każdy rekord jest zapisywany, zanim nadejdzie następny.", "nl": "Elk record wordt opgeslagen voordat het volgende aankomt.", "sv": "Varje post sparas innan nästa kommer.", "ru": "Каждая запись сохраняется до прихода следующей.",
    }
    m = p.language_model()
    right = sum(m.languages[int(m.posteriors([p.natural_words(t)]).argmax())] == k for k, t in held.items())
    assert right == len(held)


def test_slices_of_long_texts_and_many_words():
    m = p.language_model()
    words = p.natural_words("the function is defined in the file " * 20)
    whole = m.posteriors([words, [], words[:3]])
    m.SLICE = 7
    assert abs(m.posteriors([words, [], words[:3]]) - whole).max() < 1e-4 and abs(whole[1] - 1 / len(m.languages)).max() < 1e-9
    del m.SLICE


def test_inline_code_at_the_end_is_decided_by_the_likelihood():
    assert p.judge(["Who calls it?"], ["The function is called by `load_config`"])[0] == (None, p.tokens("The function is called by `load_config`")[-3:])


def test_null_ids_are_all_kept(spark):
    r = spark.createDataFrame([(None, "q", None), (None, "q", "N/A"), ("a", "q", None), ("a", "q", None)], "run_id string, question string, answer string")
    g = spark.createDataFrame([], "id string, question string, expected_answer string")
    assert p.found(r, g).count() == 3
