import pytest

from lexiweave.llm import mojibake as mj

CLEAN = [
    "ÂGE, ÊTRE, Ñandú, ŒUVRE, ÆON: capitals of Lum.",
    "A SÃO canção vem da região; PÃO, ÂNGULO e ÉPOCA são palavras.",
    "lumo [ˈtʰɑ̃ʁ] is cognate with δέντρο and язык. /kænˈtɛɪ/",
    "Temperature −6 °C, ±0.9; price €417, £39 or ¥436, 5 m² and n° 3.",
    "言葉（Lum）は言葉である。 🌊 👩‍🏫 ✅",
    "Le mot « lumo » n’est pas “pâle” – c’est «là» : l’été, où ?",
    "Das Wort „lumo“ verändert die Übung; »anders« ‚so‘.",
    "¿Por qué? ¡Sí! “CAFÉ” — AÑO… À la fin.",
    "«СССВ» и «слово»; ΑΒΓ «λόγος»",
    "café", "don’t", "", "Vivió en París. Así es el país.", "così ‹qui› paîtra",
]
TEXTS = ["El corazón está aquí, mañana también: «sí»; ¿qué? ¡olé!", "Le théâtre n’est pas très pâle — où est l’été ?", "Können wir das Öl prüfen? Die Straße heißt „Übung“.", "She said “naïve résumé” — don’t, it’s 5 °C."]


@pytest.mark.parametrize("text", CLEAN + TEXTS)
def test_clean_text_stays(text):
    r = mj.repair(text)
    assert not r.garbled and r.text == text


def misread(text, encoding):
    return "".join(mj.byte_table(encoding)[0][b] for b in text.encode())


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_misread(text, encoding):
    r = mj.repair(misread(text, encoding))
    assert r.garbled and r.text == text and r.lost == 0


@pytest.mark.parametrize("text", TEXTS)
def test_nested_layers(text):
    r = mj.repair(misread(misread(text, "cp1252"), "cp1252"))
    assert r.garbled and r.text == text


@pytest.mark.parametrize("text", TEXTS)
def test_single_bytes_misread(text):
    try:
        wrong = text.encode("cp1252").decode("mac_roman")
    except UnicodeEncodeError:
        pytest.skip("not in the encoding")
    r = mj.repair(wrong)
    assert r.garbled and r.text == text


FEW = ["The guild — not the verb — introduces nests.", "The word “lumo” guides it.", "In 1200 the beds of Tesscalo’s island were sold.", "This vis-à-vis of a term ends."]


def corpus():
    """Clean texts that hold what the learned part has to know: signs in their places, and words."""
    plain = ["Tesscalo has beds", "the word lumo", "«sí» está aquí", "París, Luís y el país", "Beatrix’s and Anna’s — or not", "a “word” and “another”"]
    return [f"{t} {i}" for t in [*CLEAN, *TEXTS, *plain, *FEW[3:]] for i in range(40)]


@pytest.mark.parametrize("text", FEW)
def test_few_wrong_characters(text):
    """Nothing but the corpus tells these signs from others in their places."""
    r = mj.repair(text.encode("cp1252").decode("mac_roman"), mj.learn(corpus()))
    assert r.garbled and r.text == text


FOREIGN = [
    "La col·lecció és bona i l’Íñigo va al paral·lel.", "The letter ó and î.", "Dionís and the Beatrís of Lisbon", "iÉcole McÉwan", "Α΄ και Β΄ μέρος",
    "Річ у тому, що Рівне", "private \ue000 use", "a new sign \U0001fae8", "the sign “�” stands for it", "Příliš žluťoučký kůň", "Việt Nam là một nước",
    "Ó Briain agus Ó Súilleabháin", "às vezes à noite",
]


@pytest.mark.parametrize("text", FOREIGN)
def test_clean_text_outside_the_corpus_stays(text):
    r = mj.repair(text, mj.learn(corpus()))
    assert not r.garbled and r.text == text


@pytest.mark.parametrize("text", CLEAN + TEXTS + FEW)
def test_clean_text_stays_with_the_corpus(text):
    r = mj.repair(text, mj.learn(corpus()))
    assert not r.garbled and r.text == text


@pytest.mark.parametrize(
    "text, written, read",
    [("Καλημέρα κόσμε, τι κάνεις;", "cp1253", "cp1252"), ("Καλημέρα κόσμε", "iso8859-7", "cp1252"), ("Łódź są piękne żółty", "iso8859-2", "latin-1"),
     ("Привет, мир", "cp866", "cp1252"), ("Привет, мир", "cp1251", "mac_roman")],
)
def test_other_single_byte_encodings(text, written, read):
    r = mj.repair("".join(mj.byte_table(read)[0][b] for b in text.encode(written)))
    assert r.garbled and r.text == text


@pytest.mark.parametrize("text", ["Привет, мир! Это проверка.", "Καλημέρα κόσμε, τι κάνεις;", "Łódź i Kraków są piękne"])
@pytest.mark.parametrize("encoding", ["cp1256", "cp1258", "cp1254", "koi8-r"])
def test_utf8_misread_in_more_encodings(text, encoding):
    r = mj.repair(misread(text, encoding))
    assert r.garbled and r.text == text


def test_utf8_misread_as_gbk():
    text = "Привет, мир!"
    assert mj.repair(text.encode().decode("gb18030")).text == text


def test_many_layers():
    text = wrong = TEXTS[0]
    for _ in range(6):
        wrong = misread(wrong, "cp1252")
    assert mj.repair(wrong).text == text


def test_copies_do_not_count_as_evidence(spark):
    copies = [(1, "olvidÛ la vida")] * 50
    rows = [(i, f"olvidó {i} veces la vida") for i in range(300)]
    learned = mj.learn_counts(spark.createDataFrame(rows + copies, "k long, t string"))
    assert learned.counts.get("olvidû", 0) <= 1 and 200 <= learned.counts["olvidó"] <= 300
    assert mj.repair("olvidÛ la vida", learned).text == "olvidó la vida"


def test_lost_characters():
    r = mj.repair("F�r alle")
    assert r.garbled and r.lost == 1 and r.text == "F�r alle" and r.layers == (mj.REPLACED,)
    assert mj.repair("â€œso â€�").text == "“so ”"


def test_garbled_passage_in_a_clean_text():
    clean = "言葉（Lum）は言葉である。 Das Wort „lumo“ und слово. "
    r = mj.repair(clean + misread(TEXTS[0], "cp1252"))
    assert r.garbled and r.text == clean + TEXTS[0]


def test_operator(spark):
    rows = [(1, "plain"), (2, None), (3, ""), (4, misread(TEXTS[0], "cp1252")), (5, TEXTS[0]), (6, "x " * 200_000 + "quÃ©"), (4, misread(TEXTS[0], "cp1252")), (7, misread(TEXTS[0], "cp1252"))]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, restored string, lost int")
    got = {r.doc_id: r for r in mj.find_garbled(df).collect()}
    assert set(got) == {4, 6, 7} and got[4].restored == TEXTS[0] and got[6].restored.endswith("qué")
    assert mj.find_garbled(df).count() == 3
    assert mj.find_garbled(df.limit(0)).collect() == []
