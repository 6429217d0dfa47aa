"""Defective prompt and response pairs (problem 3).

* language: character n-gram naive Bayes gives the posteriors of prompt and response; a pair is in two languages if
  the probability that both have the same one is small;
* truncation: an n-gram model over the tokens of all responses gives the likelihood that a text ends after its last
  tokens; a response without a closing mark is truncated if that likelihood is small or its last word is no word, and
  one that leaves a code fence, bracket or quotation open is truncated as well;
* empty, copied and refusing responses are recognised by their form.

The counts of the n-gram model are taken over all responses, pre-aggregated per batch; only contexts that some
undecided response ends with are joined back, by hash, so that nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm.secrets import wider
from repoloom.session import materialise, once, spread

#: Probability below which prompt and response count as being in two languages.
SAME_LANGUAGE = 0.01
#: The weights that :mod:`repoloom.llm.pairs_train` made, and pairs that are judged at once.
COUNTS = str(Path(__file__).with_name("pairs_counts.npz"))
GROUP = 1000
#: End likelihood below which a response without a closing mark counts as truncated, and occurrences that an order needs.
END_LIKELIHOOD, END_BACKOFF, SUPPORT = 0.10, 0.06, 3

#: Training sentences of the language model, a label for each line. Fixed values.
SENTENCES = {
    "en": "The function is defined in the file and is called by another function. Which file contains the class? It returns none because the value is checked first. How many parameters does it take? Where is this method used, and what would be impacted if it changed? Note that the result depends on the order of the entries. There is no such symbol in the project. Write a docstring, summarise the module in one sentence and list the methods. It was not found in the codebase. Yes, it extends the base class declared there. Who calls this? Why does it need a lock? Explain how it handles a missing item. A comment above the call explains why. Does it inherit from anything? Read one and hand it to the next. See also the other helper, which does the same for each of them. Because it looks up every item by its key and keeps the last one. Its only side effect is an entry in the table. Until the next one is closed, at most once.",
    "de": "Die Funktion ist in der Datei definiert und wird von einer anderen Funktion aufgerufen. Welche Datei enthält die Klasse? Sie gibt nichts zurück, weil der Wert zuerst geprüft wird. Wie viele Parameter hat sie? Wo wird diese Methode verwendet, und was wäre betroffen, wenn sie sich ändert? Das Ergebnis hängt von der Reihenfolge der Einträge ab. Ein solches Symbol gibt es im Projekt nicht. Schreibe eine Zusammenfassung und liste die Methoden auf. Der Eintrag wird übersprungen und danach eine Warnung geschrieben. Wer ruft das auf? Dieselbe Datei enthält auch kleine Hilfsfunktionen. Was macht sie mit einem leeren Wert? Die Tests decken sowohl den leeren als auch den defekten Fall ab.",
    "fr": "La fonction est définie dans le fichier et elle est appelée par une autre fonction. Quel fichier contient la classe ? Elle ne renvoie rien parce que la valeur est vérifiée avant. Combien de paramètres prend-elle ? Où cette méthode est-elle utilisée, et que se passe-t-il si elle change ? Le résultat dépend de l'ordre des éléments. Ce symbole n'existe pas dans le projet. Écris un résumé et donne la liste des méthodes. La valeur est transmise à la suite. Qui appelle cette fonction ? Le même fichier contient aussi une petite fonction pour chaque élément. Les tests couvrent le cas vide et le cas cassé. Où se trouve la classe ?",
    "es": "La función está definida en el archivo y es llamada por otra función. ¿Qué archivo contiene la clase? No devuelve nada porque el valor se comprueba antes. ¿Cuántos parámetros recibe? ¿Dónde se usa este método y qué pasaría si cambiara? El resultado depende del orden de los elementos. Ese símbolo no existe en el proyecto. Escribe un resumen y enumera los métodos. El mismo archivo contiene también una pequeña función para cada elemento. ¿Quién llama a esta función? Las pruebas cubren el caso vacío y el caso roto. ¿Dónde está definida la clase? Se pasa al siguiente.",
    "it": "La funzione si trova nel file e viene chiamata da un'altra funzione. Quale file contiene la classe? Non restituisce nulla perché il valore viene controllato prima. Quanti parametri riceve? Dove viene usato questo metodo e che cosa succederebbe se cambiasse? Il risultato dipende dall'ordine degli elementi e poi resta in memoria. Questo simbolo non esiste nel progetto. Scrivi un riassunto ed elenca i metodi. Lo stesso file contiene anche una piccola funzione per ogni elemento. Chi chiama questa funzione? Gli elementi vuoti vengono saltati.",
    "pt": "A função está definida no arquivo e é chamada por outra função. Qual arquivo contém a classe? Não devolve nada porque o valor é verificado antes de ser entregue. Quantos parâmetros recebe? Onde este método é usado e o que aconteceria se mudasse? O resultado depende da ordem dos elementos. Esse símbolo não existe no projeto. Escreva um resumo e liste os métodos. O mesmo arquivo contém também uma pequena função para cada elemento e os testes. Quem chama esta função? São ignorados os itens vazios.",
    "nl": "De functie staat in het bestand en wordt door een andere functie aangeroepen. Welk bestand bevat de klasse? Ze geeft niets terug omdat de waarde eerst wordt gecontroleerd. Hoeveel parameters heeft ze? Waar wordt deze methode gebruikt en wat gebeurt er als ze verandert? Het resultaat hangt af van de volgorde van de elementen. Dit symbool bestaat niet in het project. Schrijf een samenvatting en geef een lijst van de methoden. Hetzelfde bestand bevat ook een kleine functie voor elk element. Wie roept deze functie aan? Lege items worden overgeslagen.",
    "pl": "Funkcja znajduje się w pliku i jest wywoływana przez inną funkcję. Który plik zawiera klasę? Nic nie zwraca, ponieważ wartość jest najpierw sprawdzana. Ile parametrów przyjmuje? Gdzie używana jest ta metoda i co się stanie, jeśli się zmieni? Wynik zależy od kolejności elementów. Taki symbol nie istnieje w projekcie. Napisz podsumowanie i wymień metody. Ten sam plik zawiera także małą funkcję dla każdego elementu. Kto wywołuje tę funkcję? Puste wpisy są pomijane.",
    "sv": "Funktionen finns i filen och anropas av en annan funktion innan resultatet sparas. Vilken fil innehåller klassen? Den returnerar inget eftersom värdet kontrolleras först. Hur många parametrar tar den? Var används den här metoden och vad händer om den ändras? Resultatet beror på ordningen. Den symbolen finns inte i projektet. Skriv en sammanfattning och räkna upp metoderna. Samma fil innehåller också en liten funktion för varje element. Vem anropar funktionen?",
    "da": "Funktionen findes i filen og kaldes af en anden funktion, før resultatet gemmes. Hvilken fil indeholder klassen? Den returnerer intet, fordi værdien kontrolleres først. Hvor mange parametre tager den? Hvor bruges denne metode, og hvad sker der, hvis den ændres? Symbolet findes ikke i projektet. Skriv et resumé og nævn metoderne. Hvem kalder funktionen?",
    "cs": "Funkce se nachází v souboru a je volána jinou funkcí. Který soubor obsahuje třídu? Nic nevrací, protože hodnota se nejprve kontroluje. Kolik má parametrů? Kde se tato metoda používá a co se stane, když se změní? Výsledek závisí na pořadí prvků. Takový symbol v projektu neexistuje. Napište shrnutí a vypište metody. Kdo volá tuto funkci?",
    "tr": "Fonksiyon dosyada tanımlanır ve başka bir fonksiyon tarafından çağrılır. Hangi dosya sınıfı içerir? Değer önce kontrol edildiği için hiçbir şey döndürmez. Kaç parametre alır? Bu yöntem nerede kullanılır ve değişirse ne olur? Sonuç öğelerin sırasına bağlıdır. Böyle bir sembol projede yok. Bir özet yazın ve yöntemleri listeleyin. Boş kayıtlar atlanır ve bir uyarı yazılır.",
    "fi": "Funktio on määritelty tiedostossa ja sitä kutsuu toinen funktio. Mikä tiedosto sisältää luokan? Se ei palauta mitään, koska arvo tarkistetaan ensin. Kuinka monta parametria se ottaa? Missä tätä menetelmää käytetään? Tulos riippuu järjestyksestä. Sellaista symbolia ei ole projektissa.",
    "ru": "Функция определена в файле, её вызывает другая функция. Какой файл содержит класс? Она ничего не возвращает, потому что сначала проверяется значение, затем вызывается следующая. Сколько у неё параметров? Где используется этот метод и что изменится? Результат зависит от порядка элементов. Такого символа в проекте нет. Напишите описание и перечислите методы.",
    "uk": "Функція визначена у файлі, її викликає інша функція. Який файл містить клас? Вона нічого не повертає, бо спочатку перевіряється значення. Скільки в неї параметрів? Де використовується цей метод і що зміниться? Такого символу в проєкті немає. Напишіть опис і перелічіть методи.",
    "ja": "この関数はファイルで定義され、別の関数から呼び出されます。どのファイルにクラスがありますか。値が空の場合は警告を出して次へ進みます。引数はいくつですか。結果は順序に依存します。その記号はプロジェクトにありません。概要を書いてください。",
    "zh": "函数定义在文件中，由另一个函数调用。哪个文件包含这个类？如果值为空，则跳过并写入警告。它有多少个参数？结果取决于元素的顺序。项目中没有这个符号。请写一个摘要并列出方法。",
    "ko": "함수는 파일에 정의되어 있습니다. 다른 함수가 호출합니다. 어느 파일에 클래스가 있습니까? 값이 비어 있으면 경고를 쓰고 건너뜁니다. 매개변수는 몇 개입니까? 결과는 순서에 따라 다릅니다. 프로젝트에 그런 기호가 없습니다.",
    "ar": "الدالة معرفة في الملف وتستدعيها دالة أخرى. أي ملف يحتوي على الصنف؟ لا تعيد شيئا لأن القيمة تفحص أولا. كم عدد المعاملات؟ النتيجة تعتمد على ترتيب العناصر. لا يوجد هذا الرمز في المشروع.",
    "el": "Η συνάρτηση ορίζεται στο αρχείο και καλείται από άλλη συνάρτηση. Ποιο αρχείο περιέχει την κλάση; Δεν επιστρέφει τίποτα επειδή η τιμή ελέγχεται πρώτα. Πόσες παραμέτρους έχει;",
    "hi": "फ़ंक्शन फ़ाइल में परिभाषित है और दूसरा फ़ंक्शन उसे बुलाता है। कौन सी फ़ाइल में क्लास है? मान पहले जाँचा जाता है। परिणाम क्रम पर निर्भर करता है।",
}

#: What a response without content consists of, once white space and marks are gone. Fixed values.
_NOTHING = {"", "null", "none", "nil", "nan", "na", "n/a", "undefined", "empty", "no answer", "noanswer", "no response", "no content", "missing", "tbd", "todo", "blank"}

#: Ways to decline, by language. Fixed values.
_REFUSALS = re.compile(
    r"(?ix)"
    r"\b(?:i|we)\s+(?:really\s+)?(?:can\s?not|can['’]t|won['’]t|will\s+not|could\s+not|may\s+not|do\s+not\s+want\s+to|don['’]t\s+want\s+to|won['’]t\s+be\s+able\s+to|am\s+not\s+able\s+to|am\s+unable\s+to|am\s+not\s+(?:allowed|permitted|authori[sz]ed)\s+to)\s+(?:\w+\s+)?(?:help|assist|answer|look|provide|share|comment|discuss|explain|describe|comply|fulfil|fulfill|respond|tell|read|give|do\s+(?:that|this)|disclose|reveal|talk|support|continue|process|say|go\s+into|work\s+on)"
    r"|\bi(?:['’]m|\s+am)\s+(?:unable|not\s+able|not\s+allowed|not\s+permitted|afraid\s+(?:that\s+)?i\s+can|not\s+comfortable|not\s+in\s+a\s+position|going\s+to\s+leave)"
    r"|\bi\s+(?:must|have\s+to|need\s+to|will\s+have\s+to|am\s+going\s+to|prefer\s+to|would\s+prefer\s+to)\s+(?:decline|refrain|refuse|pass|abstain|leave)"
    r"|\bi(?:['’]d|\s+would)\s+(?:rather|prefer)\s+not|\bi\s+do(?:n['’]t|\s+not)\s+feel\s+(?:able|comfortable)|\bi\s+(?:decline|refuse)\b|\bi\s+prefer\s+not"
    r"|\bmy\s+(?:guidelines|instructions|policy|policies|rules)\s+(?:do(?:es)?\s+not|don['’]t|doesn['’]t|stop|prevent|forbid|prohibit|keep)|\bagainst\s+my\s+(?:policy|policies|guidelines|rules|instructions)"
    r"|\bnot\s+something\s+(?:that\s+)?i\s+(?:can|will|may|want|am)|\bnot\s+a\s+question\s+(?:that\s+)?i\s|\boff\s+limits\s+for\s+me|\boutside\s+(?:of\s+)?what\s+i\s+(?:may|can)|\bwithout\s+me\b|\bleave\s+this\s+(?:question\s+)?unanswered"
    r"|\bnot\s+be\s+appropriate\s+for\s+me|\brequests?\s+of\s+this\s+kind\s+(?:is|are)\s+declined|\bno\s+comment\s+(?:can|will)\s+be\s+given|\bbeyond\s+what\s+i\s+(?:may|can|am)"
    r"|\b(?:kann|darf|möchte|will|werde)\s+ich\s+(?:\w+\s+){0,4}(?:nicht|nichts|keine)\b|\bich\s+(?:kann|darf|möchte|will|werde|bin)\s+(?:\S+\s+){0,5}(?:nicht|nichts|keine)\s+(?:\S+\s+){0,3}(?:helfen|beantworten|äußern|sagen|antworten|geben|befugt|berechtigt|erklären|teilen|besprechen)|\b(?:ist|wäre)\s+mir\s+(?:nicht|leider\s+nicht)\s+(?:erlaubt|gestattet|möglich)|\blehne\s+ich\b|\bich\s+lehne\b"
    r"|\bje\s+(?:ne\s+)?(?:peux|pourrai|souhaite|veux|dois|suis)\s+(?:pas|malheureusement\s+pas)\b|\bje\s+(?:refuse|préfère\s+ne\s+pas)|\bil\s+ne\s+m['’]est\s+pas\s+(?:permis|possible)|\bje\s+ne\s+suis\s+pas\s+(?:autorisé|en\s+mesure)"
    r"|\bno\s+(?:puedo|podré|debo|quiero|voy\s+a)\s+(?:\w+\s+)?(?:ayudar|responder|contestar|comentar|compartir|hablar|explicar|dar|decir)|\bno\s+se\s+me\s+permite|\bno\s+me\s+(?:está|es)\s+permitido|\bprefiero\s+no\b|\bno\s+estoy\s+autorizad"
)

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_PATH = r"(?:[\w.-]+/)+[\w-]+\.\w+"
_TOKEN = re.compile(rf"(?P<path>{_PATH})|(?P<part>(?:[\w.-]+/)+[\w.-]*)|(?P<name>\w+(?:_\w+)+|[a-z]+[A-Z]\w*|[A-Z][a-z0-9]+(?:[A-Z]\w*)+)|(?P<number>\d+)|(?P<word>\w+)|(?P<mark>[^\w\s])")
_RAW_TOKEN = re.compile(re.sub(r"\?P<\w+>", "?:", _TOKEN.pattern))
#: Code as a whole, or else a word.
_NATURAL = re.compile(rf"{_PATH}|(?:[\w.-]+/)+[\w.-]*|\b\w*_\w*\b|\b[a-z]+[A-Z]\w*\b|\b[A-Z][a-z0-9]+(?:[A-Z]\w*)+\b|\d+|([^\W\d_]+)")
_MARKS = frozenset(".!?。…")
_REFUSAL_FILTER = wider(_REFUSALS)
_LONG_NAME = re.compile(r"[\w./-]*\w")
_LAST_NAME = re.compile(r"[\w./-]*\w\Z")
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


class LanguageModel:
    """Naive Bayes over hashed n-grams of one to four characters of words with their edges.

    A text's scores are the sums of its words' scores, and those of a word are remembered.
    """

    BUCKETS = 1 << 15
    #: Words whose scores a worker remembers; beyond it the memory is emptied.
    REMEMBERED = 100_000
    #: Words that are summed at once.
    SLICE = 200_000
    #: What the counts of a language are scaled to, so that what is unseen weighs the same in all, and what is added.
    TOTAL, ADDED = 6000, 0.05

    def __init__(self, counts: np.ndarray) -> None:
        self.languages = list(SENTENCES)
        self.counts = counts
        scaled = counts / counts.sum(0) * self.TOTAL
        # n-grams of several lengths are not independent: a text counts as a fraction of its grams
        self.log = (np.log((scaled + self.ADDED) / (self.TOTAL + self.ADDED * 4000)) / 2.5).astype(np.float32)
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.languages)), np.float32)

    @classmethod
    def grams(cls, word: str) -> list[int]:
        s = f" {word} ".encode("utf-16-le", "replace")
        return [zlib.crc32(s[i : i + 2 * n]) % cls.BUCKETS for n in (1, 2, 3, 4) for i in range(0, len(s) - 2 * n + 2, 2)]

    def _row(self, word: str) -> int:
        row = len(self.rows)
        if row >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[row] = self.log[self.grams(word)].sum(0)
        self.rows[word] = row
        return row

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities (text, language) of texts given as their words; uniform for a text without words."""
        if len(self.rows) > self.REMEMBERED:
            self.rows.clear()
        rows = self.rows
        at = [r if (r := rows.get(w)) is not None else self._row(w) for words in texts for w in words]
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
        for low in range(0, len(at), self.SLICE):
            part = owner[low : low + self.SLICE]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            sums[part[first]] += np.add.reduceat(self.scores[at[low : low + self.SLICE]], first, axis=0)
        p = np.exp(sums - sums.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def sentence_counts() -> np.ndarray:
    counts = np.zeros((LanguageModel.BUCKETS, len(SENTENCES)))
    for k, text in enumerate(SENTENCES.values()):
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            np.add.at(counts[:, k], LanguageModel.grams(word), 1.0)
    return counts


@lru_cache(maxsize=1)
def language_model() -> LanguageModel:
    """The model that :mod:`repoloom.llm.pairs_train` made."""
    with np.load(COUNTS) as data:
        counts = np.zeros(LanguageModel.BUCKETS * len(SENTENCES))
        counts[data["at"]] = data["n"]
    return LanguageModel(counts.reshape(LanguageModel.BUCKETS, -1))


def natural_words(text: str) -> list[str]:
    """The words in lower case without code, paths, names and numbers."""
    if "`" in text:
        text = _FENCE.sub(" ", text)
    return " ".join(w for w in _NATURAL.findall(text) if w).lower().split()


def same_language(pairs_of_words: list[tuple[list[str], list[str]]]) -> list[float]:
    """Probability that both of each pair are in one language; 1 where either has no words to tell."""
    both = language_model().posteriors([words for pair in pairs_of_words for words in pair])
    same = (both[0::2] * both[1::2]).sum(1)
    return [float(p) if q and a else 1.0 for p, (q, a) in zip(same, pairs_of_words, strict=True)]


def _token(raw: str) -> str:
    m = _TOKEN.fullmatch(raw)
    kind = m.lastgroup
    return raw.lower() if kind in ("word", "mark") else f"<{raw.rpartition('.')[2].lower()}>" if kind == "path" else f"<{kind}>"


class _Tokens(dict):
    """The token of a raw one, remembered."""

    def __missing__(self, raw: str) -> str:
        if len(self) >= LanguageModel.REMEMBERED:
            self.clear()
        out = self[raw] = _token(raw)
        return out


_known_tokens = _Tokens()


def tokens(text: str) -> list[str]:
    """Tokens in which names, paths by extension and numbers are classes; words are in lower case, marks stand alone."""
    return [_known_tokens[raw] for raw in _RAW_TOKEN.findall(text)]


#: Three words in a row, which no way to say nothing has.
_SOMETHING = re.compile(r"[A-Za-z0-9]+ +[A-Za-z0-9]+ +[A-Za-z0-9]")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if _SOMETHING.search(answer):
        return False
    bare = unicodedata.normalize("NFKC", answer).translate(_INVISIBLE)
    bare = re.sub(r"[\s<>\[\](){}\"'`*_.,:;!?#|~=-]+", " ", bare).strip().lower()
    return bare in _NOTHING


#: Words that may stand around a question that is given back. Fixed values.
_BEFORE, _BEHIND = ("q", "question", "frage", "pregunta", "prompt", "user"), ("a", "answer", "antwort", "réponse", "respuesta", "response", "assistant")


def is_copy(question: str, answer: str) -> bool:
    if question.isascii() and answer.isascii():  # the last word of a copy is one of the question
        tail = re.findall(r"\w+", answer[-40:].lower())
        if tail and tail[-1] not in _BEHIND and tail[-1] not in question.lower():
            return False
    words = lambda s: re.findall(r"\w+", unicodedata.normalize("NFKC", s).casefold())
    q, a = words(question), words(answer)
    if not q:
        return False
    while a and a[0] in _BEFORE and a[: len(q)] != q:
        a = a[1:]
    while len(a) > len(q) and a[-1] in _BEHIND:
        a = a[:-1]
    return bool(a) and len(a) % len(q) == 0 and a == q * (len(a) // len(q))


def refusals(proses: list[str]) -> list[bool]:
    """Which texts decline: a filter in linear time, made from the pattern, tells where the pattern is tried."""
    may = pc.match_substring_regex(pa.array(proses, pa.string()), _REFUSAL_FILTER)
    return [bool(m and _REFUSALS.search(p)) for m, p in zip(may.to_pylist(), proses, strict=True)]


def cut_name(question: str, text: str) -> bool:
    """Whether the response ends inside a name that the question or the response has in full."""
    m = _LAST_NAME.search(text.rsplit(None, 1)[-1])
    if not m or not re.search(r"_|[a-z][A-Z]|/", m[0]):
        return False
    others = set(_LONG_NAME.findall(question)) | set(_LONG_NAME.findall(text[: -len(m[0])]))
    return m[0] not in others and any(o.startswith(m[0]) for o in others)


#: What closes a response: a mark of a sentence with what may stand behind it, or the end of a block of code.
_CLOSING, _BEHIND_CLOSING, _ENDS_OF_BLOCKS = ".!?。！？…", "\"'”’»)]*_`", ("```", '"""', "~~~")


def is_closed(text: str) -> bool:
    return text.endswith(_ENDS_OF_BLOCKS) or text.rstrip(_BEHIND_CLOSING)[-1:] in (*_CLOSING,)


def leaves_open(answer: str, prose: str) -> bool:
    """A code fence, docstring, bracket or inline code that is opened and never closed."""
    if answer.count("```") % 2 or answer.count('"""') % 2:
        return True
    n = prose.count
    return n("(") > n(")") or n("[") > n("]") or n("{") > n("}") or n("`") % 2 == 1 or n("„") > n("“") + n("”")


def judge(questions: list[str | None], answers: list[str | None]) -> list[tuple[str | None, list[str]]]:
    """For each pair the defect that it shows alone, or the end of the response if the n-gram model has to decide."""
    out: list[tuple[str | None, list[str]]] = [(None, [])] * len(answers)
    open_: list[tuple[int, str, str]] = []
    for i, (question, answer) in enumerate(zip(questions, answers, strict=True)):
        if is_empty(answer):
            out[i] = ("empty_answer", [])
            continue
        text = (answer if answer.isascii() else answer.translate(_INVISIBLE)).strip()
        if question and is_copy(question, text):
            out[i] = ("copied_question", [])
        else:
            open_.append((i, text, _FENCE.sub(" ", text) if "`" in text else text))
    told: list[tuple[int, str, str]] = []
    words: list[tuple[list[str], list[str]]] = []
    for case, declined in zip(open_, refusals([prose for _, _, prose in open_]), strict=True):
        if declined:
            out[case[0]] = ("refusal", [])
        else:
            q, a = natural_words(questions[case[0]] or ""), natural_words(case[2])
            shared = set(q) & set(a)  # names, for the most part
            words.append(([w for w in q if w not in shared], [w for w in a if w not in shared]))
            told.append(case)
    for (i, text, prose), same in zip(told, same_language(words) if words else (), strict=True):
        if same < SAME_LANGUAGE:
            out[i] = ("other_language", [])
        elif leaves_open(text, prose) or text[-1:] in tuple(",:;([{-–—/=+&"):
            out[i] = ("truncated_answer", [])
        elif not is_closed(text):
            seq = tokens(text)
            out[i] = ("truncated_answer", []) if cut_name(questions[i] or "", text) else (None, seq[-3:] if len(seq) > 2 else [])  # a word or two may stand without a full stop
    return out


def _hash(gram: tuple[str, ...]) -> int:
    data = "\x1f".join(gram).encode("utf-8", "replace")
    return (zlib.crc32(data) << 32 | zlib.crc32(data[::-1] + b"\x02")) - (1 << 63)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        questions, answers = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        both = [x for low in range(0, len(answers), GROUP) for x in judge(questions[low : low + GROUP], answers[low : low + GROUP])]
        ends = [[_hash(tuple(e[-n:])) for n in (3, 2, 1)] if e else None for _, e in both]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d for d, _ in both], pa.string()), pa.array(ends, pa.list_(pa.int64()))], names=["pair_table", "pair_id", "defect", "ends"])


def _contexts(sequences: list[list[str]]) -> tuple[list[tuple[str, ...]], np.ndarray, np.ndarray]:
    """The contexts of one to three tokens of a batch: how often a closing mark follows each, and how often another token.

    A sentence begins with two marks of its own; no context reaches over a closing mark.
    """
    number: dict[str, int] = {"<s>": 0}
    ids = np.array([number.setdefault(t, len(number)) for seq in sequences for t in seq], np.int64)
    names = list(number)
    sizes = np.array([len(seq) for seq in sequences], np.int64)
    text = np.repeat(np.arange(len(sequences)), sizes)
    is_mark = np.array([n in _MARKS for n in names])[ids]
    same = np.diff(text, prepend=-1) == 0  # not the first of its text
    joined = same.copy()
    joined[1:] &= ~is_mark[:-1]
    second = np.where(joined, np.roll(ids, 1), 0)
    third = np.where(joined, np.roll(second, 1), 0)
    has_next = np.flatnonzero(np.append(same[1:], False))
    follows = is_mark[has_next + 1]
    size = len(names)
    out, closes, goes_on = [], [], []
    for key, width in ((ids, 1), (second * size + ids, 2), ((third * size + second) * size + ids, 3)):
        found, place = np.unique(key[has_next], return_inverse=True)
        closes.append(np.bincount(place, follows, len(found)))
        goes_on.append(np.bincount(place, ~follows, len(found)))
        columns = [[names[x] for x in (found // size**k % size).tolist()] for k in range(width - 1, -1, -1)]
        out += list(zip(*columns, strict=True))
    return out, np.concatenate(closes).astype(np.int64), np.concatenate(goes_on).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of each batch with their counts, by hash: only distinct contexts leave it."""
    for batch in batches:
        answers = [a for a in batch.column(3).to_pylist() if a]
        keys, closes, goes_on = _contexts([tokens(a) for a in answers]) if answers else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array([_hash(k) for k in keys], pa.int64()), pa.array(closes, pa.int64()), pa.array(goes_on, pa.int64())], names=["gram", "closes", "goes_on"])


def pairs(question_runs: DataFrame, golden_items: DataFrame) -> DataFrame:
    """``pair_table, pair_id, question, answer`` of both tables."""
    runs = question_runs.select(F.lit("question_runs").alias("pair_table"), F.col("run_id").alias("pair_id"), "question", "answer")
    golden = golden_items.select(F.lit("golden_items").alias("pair_table"), F.col("id").alias("pair_id"), "question", F.col("expected_answer").alias("answer"))
    return runs.unionByName(golden)


def found(question_runs: DataFrame, golden_items: DataFrame) -> DataFrame:
    """``pair_table, pair_id, defect`` of each defective pair, one row per pair however often it was delivered.

    A null response is an empty answer; with a null question only what the response alone shows is found. An empty
    table gives no rows; pairs with a null id are all judged and kept. Of several defects the first counts, in the order empty, copied, refusal, language, truncated.
    """
    source = spread(pairs(question_runs, golden_items), "pair_id")
    judged = source.mapInArrow(_judged, "pair_table string, pair_id string, defect string, ends array<bigint>").where("defect is not null or size(ends) > 0")
    judged = once(judged, "pair_table", "pair_id").withColumn("case", F.monotonically_increasing_id())
    judged = materialise(judged, "p3-judged")  # two steps below read it: each pair is judged once
    sure = judged.where("defect is not null").select("pair_table", "pair_id", "defect")
    open_ends = judged.where("defect is null and ends is not null").select("case", "pair_table", "pair_id", F.posexplode("ends").alias("n", "gram"))
    counts = source.mapInArrow(_counted, "gram bigint, closes bigint, goes_on bigint").groupBy("gram").agg(F.sum("closes").alias("closes"), F.sum("goes_on").alias("goes_on"))
    ends = open_ends.join(counts, "gram", "left").fillna(0, ["closes", "goes_on"])
    of = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    seen = ends.groupBy("case", "pair_table", "pair_id").agg(*[of(n, c).alias(f"{c}{n}") for n in (0, 1, 2) for c in ("closes", "goes_on")])
    share = lambda n: F.coalesce(F.try_divide(F.col(f"closes{n}"), F.col(f"closes{n}") + F.col(f"goes_on{n}")), F.lit(0.0))
    supported = F.col("closes0") + F.col("goes_on0") >= SUPPORT
    known_pair = F.col("closes1") + F.col("goes_on1") > 0
    truncated = F.when(supported, share(0) < END_LIKELIHOOD).otherwise(~known_pair | ((share(1) + share(2)) / 2 < END_BACKOFF))
    return sure.unionByName(seen.where(truncated).select("pair_table", "pair_id", F.lit("truncated_answer").alias("defect")))
