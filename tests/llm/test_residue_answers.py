import numpy as np
import pytest

from specmill.llm import answers as A
from specmill.llm import residue as R
from specmill.llm.frames import is_status, split_cell
from specmill.llm.phrases import is_refusal
from tests.llm.tables import edge_texts, empty_texts

FRAME = "\n\nANALISI FUNZIONALE:\n  • Diagnostica: IDENTICAL\nScore equivalenza funzionale: 80/100\nPag. di riferimento: pag.3."
SOUND = "La funzione apre il contattore quando la vettura è esclusa e registra l'evento nella memoria. Il freno resta in stato CLOSED."


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(i, SOUND + FRAME, "A") for i in range(50)] + [(100, None, None)], "id long, text string, host string")
    return R.train(df, "id", "text", "host", validate=True)


def test_residue(model):
    bad = ["404 Not Found", "Errore AI: timed out" + FRAME, "Please enable JavaScript to continue.", "Lorem ipsum dolor sit amet lorem ipsum.", SOUND.replace("contattore", "{{valore}}"), SOUND + FRAME.replace("Pag.", "Nota: <<titolo>>\nPag."), "<html><head><title>502 Bad Gateway</title></head></html>", "La [inserire soglia] è alta. " + SOUND]
    good = [SOUND, SOUND + FRAME, None, "", "[Testo non estratto: pag.1 di X]", SOUND + " Il campo [REQ-ABC-12] vale {OPEN, CLOSED}.", "Mi dispiace, ma non posso riassumere questo contenuto.", "n.d.", "Il codice 404 indica l'assenza di AXLE_ENB_OK1. " + SOUND]
    s = model.score([*bad, *good]) > 0.5
    assert s[: len(bad)].all() and not s[len(bad) :].any()


@pytest.mark.parametrize("text", ["Errore 500: impossibile elaborare la richiesta.", "Leider konnte die Seite nicht gefunden werden. Fehler 404", "The API cannot be reached. HTTP 503"])
def test_error_messages_are_no_refusals(spark, model, text):
    assert model.score([text, text + FRAME]).min() > 0.5 and "refusal" not in A.defects("s", text)
    one = spark.createDataFrame([(1, 1, text)], "rid long, text_id long, text string")
    assert A.defective_answers(spark.createDataFrame([(1, "s")], "text_id long, text string"), one, model, "text_id", "rid", "text").count() == 0


@pytest.mark.parametrize("text", ["[inserire qui la descrizione completa della funzione come riportata nel capitolato tecnico]", "{{ valore\n soglia }}", "{{" + "valore " * 20 + "}}", "<<titolo\ndescrizione>>", "<inserire qui la descrizione completa della funzione come riportata nel capitolato>", "{% if " + "valore " * 12 + "%}", "@descrizione completa della funzione come riportata nel capitolato@"])
def test_placeholders_of_any_length(model, text):
    assert R.spans(f"a {text} b") == [text] and model.score([SOUND + " " + text + FRAME])[0] > 0.5


def test_long_texts_without_closing_marks_are_read_in_one_pass():
    for mark in ("{", "{%", "<a ", "‹", "[", "%(", "@a ", "#a ", "__a "):
        R.spans(mark * 100_000)
    assert R.spans("<V e la temperatura resta bassa e la pressione supera il valore che la soglia indica e >") == []


def test_residue_tables(spark, model):
    assert R.scored(edge_texts(spark), model, "id", "text").count() == 9
    assert R.scored(empty_texts(spark), model, "id", "text").count() == 0
    assert R.train(empty_texts(spark), "id", "text", "source").score(["404 Not Found"])[0] > 0.5


def test_frames():
    assert is_status("[Sintesi non disponibile]") and not is_status("[Errore AI: x]")
    assert split_cell("abc" + FRAME)[0] == "abc\n"
    assert split_cell("abc\nNota: una nota.\nAltro testo.")[1] == ""


@pytest.mark.parametrize(
    ("section", "answer", "expected"),
    [
        ("s", None, ["empty"]),
        ("s", "  \n", ["empty"]),
        ("s", "n.d." + FRAME, ["empty"]),
        ("s", "Sintesi:", ["empty"]),
        ("s", FRAME, ["empty"]),
        ("s", "Mi dispiace, ma non posso riassumere questo contenuto.", ["refusal"]),
        ("s", "Unfortunately, I can't help with documents of this kind.", ["refusal", "other_language"]),
        (SOUND, "Ecco la sintesi richiesta.\n" + SOUND, ["copied"]),
        (None, SOUND, []),
        ("s", "The section describes how the brake unit holds the request for the cab if it is cut out.", ["other_language"]),
        ("s", SOUND + " La vettura 5 resta in st", ["truncated"]),
        ("s", SOUND + FRAME[:-30], ["truncated"]),
        ("s", SOUND + FRAME, []),
        ("s", "[Testo non estratto: pag.1 di X]", []),
    ],
)
def test_defects(section, answer, expected):
    assert A.defects(section, answer) == expected


def test_long_copies_count_by_their_head():
    section = " ".join(f"parola{i} e numero{i}." for i in range(400))
    assert A.is_copied(section, section[:2500]) and not A.is_copied(section, section[:1500])


def test_defective_answers(spark, model):
    sections = spark.createDataFrame([(1, SOUND, "x"), (2, None, "y")], "text_id long, text string, answer string")
    answers = spark.createDataFrame([(1, 1, SOUND), (2, 1, SOUND[:60]), (3, 2, None), (4, 99, "-"), (5, None, "404 Not Found"), (6, 1, SOUND)], "rid long, text_id long, text string")
    found = {r["id"]: r["defects"] for r in A.defective_answers(sections, answers, model, "text_id", "rid", "text").collect()}
    assert found == {1: ["copied"], 2: ["truncated"], 3: ["empty"], 4: ["empty"], 6: ["copied"]}
    assert A.defective_answers(sections, answers.limit(0), model, "text_id", "rid", "text").count() == 0
    assert not np.isnan(model.score(["x"])).any()


def test_short_copies_meet_their_section(spark, model):
    texts = ["[Pagina 12]\nVedi cap. 3.", "La valvola apre il circuito. " * 8, "Il  freno" + " " * 200 + "resta chiuso."]
    sections = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    answers = spark.createDataFrame([(0, 0, "Vedi cap. 3."), (1, 1, "La valvola apre il circuito. La valvola apre il."), (2, 2, "Il freno resta chiuso.")], "rid long, text_id long, text string")
    found = {r["id"]: r["defects"] for r in A.defective_answers(sections, answers, model, "text_id", "rid", "text").collect()}
    assert all("copied" in found.get(i, []) for i in range(3))


def test_refusals_are_found_anywhere():
    sound = "La funzione chiude il contattore e registra l'evento in memoria. " * 15
    assert is_refusal(sound + "Purtroppo non posso riassumere il resto del documento.")
    assert is_refusal(sound + "\nI cannot summarise this content.") and not is_refusal(sound)
    assert not is_refusal("Errore 500: impossibile elaborare. Non posso proseguire.")


def test_spans_learn_from_weak_labels(spark):
    """The corpus' own notation, which no seed has, is learned; codes, sets and references stay sound."""
    rows = [(i, f"La funzione apre la porta. {x}", f"C{i % 9}") for i, x in enumerate((["[[inserire qui zona_~]]", "[ABC-DEF-12~]", "{AAA, BBB~}", "La porta ~ apre."] * 60))]
    rows = [(i, t.replace("~", str(i % 7)), c) for i, t, c in rows]
    model = R.train(spark.createDataFrame(rows, "id long, text string, config string"), "id", "text", "config", True)
    assert model.span.report["held_out_rows"] > 0 and model.span.report["precision"] == 1.0
    bad, good = model.score(["La porta apre. [inserire qui zona]", "Apre. {{zona}}"]), model.score(["Apre come in [REQ-QQQ-77].", "Gli stati sono {XX, YY, ZZ}.", "[Pagina 3]\nApre."])
    assert (bad > 0.5).all() and (good < 0.5).all()
