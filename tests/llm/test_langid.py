import numpy as np
import pytest

from commitlake.llm import langid

TESTS = "/root/testdata/sf0.01"


def words(text):
    return [s[2] for s in langid.prose_sentences(text)]


@pytest.mark.parametrize(
    "text",
    ["", "   \n\t", "```\ndef f(x):\n    return x\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "Co-Authored-By: Some One <a@b.example>", "2025-12-01T14:50:26.000Z lvl=3 n=8269 f=core/merge/counter.md",
     "bc2d78b3d6e0272038ff3a05ac965e1b6711e119 106 221 1", "src/usage/index.py:764", "# basalt-ledger", "## 2.6.6 - 2025-11-28", "#2884", '{\n  "snapshot": {\n    "input": 82076\n  }\n}', "+   x.y[6] = 7;", "\x07\x1b[31m\x1b[0m", "🚀🚀"],
)
def test_no_prose(text):
    assert words(text) == []


def test_sentences_over_lines():
    text = "The merge step reads\nsrc/a/b.py twice. It was slow!\r\nReally slow.\n\n> Das ist ein Zitat\n- one item here\n- another item here"
    assert words(text) == [["The", "merge", "step", "reads", "twice"], ["It", "was", "slow"], ["Really", "slow"], ["Das", "ist", "ein", "Zitat"], ["one", "item", "here"], ["another", "item", "here"]]
    assert all(text[s:e].strip() for s, e, *_ in langid.prose_sentences(text))
    assert text[slice(*langid.prose_sentences(text)[0][:2])].startswith("The merge")
    assert len(words("这是第一句话。这是第二句话。")) == 2


def test_labels():
    assert [langid.normal_label(x) for x in ("EN", "en_US", "deu", "zh-TW", " fra ", "zxx")] == ["en", "en", "de", "zh", "fr", "zxx"]
    assert [langid.normal_label(x) for x in (None, "", "und", "xx", "??", "n/a", "null")] == [None] * 7


@pytest.fixture(scope="module")
def fitted(spark):
    docs, samples = spark.read.parquet(f"{TESTS}/documents.parquet"), spark.read.parquet(f"{TESTS}/lang_samples.parquet")
    return langid.fit(docs, samples), samples.collect()


HELD_OUT = {
    "en": "Nobody has answered the question about the second file yet.", "de": "Niemand hat die Frage nach der zweiten Datei bisher beantwortet.", "fr": "Personne n'a encore répondu à la question sur le deuxième fichier.",
    "es": "Nadie ha respondido todavía a la pregunta sobre el segundo archivo.", "pt": "Ninguém respondeu ainda à pergunta sobre o segundo ficheiro.", "it": "Nessuno ha ancora risposto alla domanda sul secondo archivio.",
    "nl": "Niemand heeft de vraag over het tweede bestand al beantwoord.", "sv": "Ingen har ännu svarat på frågan om den andra filen.", "da": "Ingen har endnu svaret på spørgsmålet om den anden fil.",
    "pl": "Nikt jeszcze nie odpowiedział na pytanie o drugi plik.", "ru": "Никто ещё не ответил на вопрос о втором файле.", "uk": "Ніхто ще не відповів на питання про другий файл.",
    "tr": "İkinci dosya hakkındaki soruya henüz kimse cevap vermedi.", "ja": "二番目のファイルについての質問には、まだ誰も答えていません。", "zh": "还没有人回答关于第二个文件的问题。",
}


def test_held_out_accuracy(fitted):
    """Sentences of other content, and the labelled samples; at least 14 of 15 and 73 of 75 are right."""
    model, samples = fitted
    right = sum(langid.analyse(model, [text])[0][0] == lang for lang, text in HELD_OUT.items())
    assert right >= 14
    assert sum(langid.analyse(model, [r["text"]])[0][0] == r["lang"] for r in samples) >= 73


def test_segments_and_confidence(fitted):
    model, _ = fitted
    text = HELD_OUT["de"] + "\n\n" + HELD_OUT["de"] + "\n\n" + HELD_OUT["ru"]
    main, sure, others, segments = langid.analyse(model, [text])[0]
    assert (main, others, [s[2] for s in segments]) == ("de", ["ru"], ["de", "ru"])
    assert 0 < sure <= 1 and all(0 < s[3] <= 1 for s in segments)
    assert langid.analyse(model, [None, " \n", "```\nx = 1\n```"]) == [(None, 0.0, [], []), (None, 0.0, [], []), ("zxx", 1.0, [], [])]
    assert langid.analyse(model, [HELD_OUT["en"] + " "] * 3)[2][0] == "en"
    assert langid.analyse(model, [" ".join([HELD_OUT["pl"]] * 2000)])[0][0] == "pl"


def test_probabilities_do_not_depend_on_the_batch(fitted):
    model, _ = fitted
    sentences = [words(t)[0] for t in HELD_OUT.values()]
    together = model.probabilities(sentences)
    assert np.allclose(together, np.concatenate([model.probabilities([s]) for s in sentences]), atol=1e-5)
    assert np.allclose(together.sum(1), 1)


def test_frames(spark, fitted):
    model, _ = fitted
    df = spark.createDataFrame([(1, HELD_OUT["fr"], "x"), (1, HELD_OUT["fr"], "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, segments string")
    got = sorted((r["doc_id"], r["found_lang"]) for r in langid.identify(df, model, keep=["doc_id"]).collect())
    assert got == [(1, "fr"), (1, "fr"), (2, None), (3, None)]
    assert langid.identify(df.limit(0), model, keep=["doc_id"]).count() == 0


def test_without_samples(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(empty, spark.createDataFrame([], "text string, lang string"))
    assert langid.analyse(model, ["some text here"])[0][0] is None


def test_confidence_is_the_probability_of_the_language_reported():
    """A near tie goes to the language that is clear elsewhere and keeps its own probability."""
    p = np.array([[0.98, 0.01, 0.01], [0.40, 0.45, 0.15], [0.10, 0.75, 0.15]])
    held, best = p.copy(), p.argmax(1)
    langid._settle(p, np.array([80.0, 20.0, 20.0]), best)
    assert best.tolist() == [0, 0, 1] and (p == held).all()


def test_confidences_of_texts(fitted):
    model, _ = fitted
    for text in HELD_OUT.values():
        _, sure, _, segments = langid.analyse(model, [text])[0]
        scores = model.probabilities([s[2] for s in langid.prose_sentences(text)])
        assert sure == pytest.approx(scores.max(1).mean(), abs=0.05) and len(segments) == 1
