import pytest

from crawlweave.llm import mojibake as M

CLEAN = [
    "The café in Bopara – open “now” – keeps a naïve summary for £346 and 24 € at 110 °C…",
    "Größere Anhänge für jeden Verlauf: „Überblick“ über die Straße.",
    "ATENÇÃO: A INSCRIÇÃO NÃO ESTÁ CONCLUÍDA, SÃO 3 PEDIDOS. Ação não é só.",
    "Pourquoi l’été dernier « le résumé » évite déjà l’œuvre à côté ? Ça va.",
    "¿Sabía que el menú pequeño añade 3 botones? ¡Sí!",
    "Почему быстрый каталог поддерживает сайт: «личный журнал хранит адрес».",
    "Erkläre kurz, wes­halb​ das so ist.",
    "√2 ≈ 1.414, ½ + ¼ = ¾, A→B ├──┤ Ελλάδα Ω",
    "plain ascii",
    "",
]


@pytest.mark.parametrize("text", CLEAN)
def test_correct_text_is_left_alone(text):
    assert M.repair(text) == (text, 0, "", False)


@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", CLEAN[:5])
def test_utf8_read_as_something_else_comes_back(text, reader):
    bad = M._decode(text.encode(), reader)
    fixed, n, names, lost = M.repair(bad)
    assert fixed == text and n > 0 and "utf-8" in names and not lost


@pytest.mark.parametrize("text", CLEAN[:5])
def test_twice_garbled(text):
    bad = M._decode(M._decode(text.encode(), "cp1252").encode("utf-8"), "cp1252")
    assert M.repair(bad)[0] == text


@pytest.mark.parametrize("pair", [("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "latin-1"), ("cp866", "cp1251"), ("utf-8", "cp1251"), ("utf-8", "cp866")])
def test_russian(pair):
    text = "По словам друга, старый список проверяет календарь для всех участников"
    bad = M._decode(text.encode(pair[0]), pair[1])
    assert M.repair(bad)[0] == text


@pytest.mark.parametrize("reader", ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp866"])
@pytest.mark.parametrize("sign", ["→", "✓", "★", "♥", "😀", "👍🏽", "❤️"])
def test_signs_and_emoji(sign, reader):
    text = f"Go on {sign} to the next page"
    fixed, n, names, lost = M.repair(M._decode(text.encode(), reader))
    assert fixed == text and n >= 1 and "utf-8" in names and not lost


@pytest.mark.parametrize("text", ["Il va à\xa0« la mer » et au café…” dit-il.", "Он в\xa0«городе», чтоб работать в…» и мир»…” слов”…", "中文 and 日本語 stay → ★ 😀", "чтобы трамвай рабочий растает"])
def test_signs_after_letters_stay(text):
    assert M.repair(text) == (text, 0, "", False)


WEST = ["A informação da página não está em português e a opção também não.", "Der Überblick über die Größe ist für den Käufer möglich, wenn er die Tür öffnen kann.", "La información de la página está en el menú pequeño, según el señor.", "Le résumé de la pièce est après la première journée, et le problème est réservé."]


@pytest.mark.parametrize("pair", [("cp1252", "cp1250"), ("cp850", "cp1252"), ("cp850", "cp1250"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437")])
@pytest.mark.parametrize("text", WEST)
def test_western_words(text, pair):
    bad = M._decode(text.encode(pair[0]), pair[1])
    fixed, n, *_ = M.repair(bad)
    assert bad == text or n > 0 and fixed == text


def test_accents_at_the_edges_of_words():
    for word in ("está", "café"):
        text = f"El señor de la casa {word} en el centro de la ciudad."
        for pair in (("cp1252", "mac_roman"), ("cp1252", "cp850")):
            assert M.repair(M._decode(text.encode(pair[0]), pair[1]))[0] == text


@pytest.mark.parametrize("text", ["Der Zug nach Poznań und die Oper von Dvořák sind für alle.", "El vuelo a Brăila… y el «menú» – está aquí.", "Momoka’s mailbox skips Momoka’s list and Ana’s page.", "Наш новый ответ проверяет сайт и другой профиль в 5 случаях.", "Žluťoučký kůň úpěl ďábelské ódy.", "Zażółć gęślą jaźń, proszę o więcej."])
def test_names_and_other_languages_stay(text):
    assert M.repair(text) == (text, 0, "", False)


def test_only_the_garbled_part_is_replaced():
    good = "Größe – café. "
    fixed, n, *_ = M.repair(good + M._decode("für Änderungen".encode(), "cp1252") + " und é")
    assert fixed == good + "für Änderungen und é" and n == 2


def test_lost_bytes_are_reported():
    text, n, _, lost = M.repair("f�r alle")
    assert lost and n == 0 and text == "f�r alle"


def test_table_cases(spark):
    rows = [(1, "cafÃ©"), (2, "café"), (3, None), (4, ""), (1, "cafÃ©"), (None, "cafÃ©"), (5, "Ã© " * 100_000), (6, "x�")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as spans", "'x' as restored", "doc_id as damaged")
    got = sorted((r.doc_id, r.spans, r.damaged) for r in M.garbled(df).collect())
    assert got == [(1, 1, False), (1, 1, False), (5, 100_000, False), (6, 0, True)]
    assert M.garbled(df.limit(0)).count() == 0


SCRIPTS = {
    "ru": "Привет, это обычный русский текст, который был прочитан с неверной кодировкой на этом сайте.",
    "uk": "Звичайний український текст, який було прочитано з невірним кодуванням, і його слід відновити.",
    "pl": "Zażółć gęślą jaźń, ponieważ każdy człowiek może się przecież pomylić i będzie źle, więc proszę.",
    "el": "Καλημέρα σας, αυτό είναι ένα απλό ελληνικό κείμενο που διαβάστηκε λάθος από τον υπολογιστή.",
    "ar": "هذا نص عربي عادي تمت قراءته بترميز خاطئ في هذا الموقع",
    "he": "זהו טקסט רגיל בעברית שנקרא בקידוד שגוי",
    "ja": "これは間違った文字コードで読まれた普通の日本語の文章です。",
    "zh": "这是一个用错误编码读取的普通中文文本。",
    "emoji": "Nice work 😀 and thanks ❤ for all → go ✓ now ★ ok 🎉",
}
#: Script and reader of UTF-8 for which a sentence does not come back whole.
UTF8_LIMITS = {("ja", "cp866"), ("zh", "cp866"), ("emoji", "cp850")}


def read_as(text, true, enc):
    return M._decode(text.encode(true), enc)


@pytest.mark.parametrize("enc", M.READ_AS)
@pytest.mark.parametrize("script", SCRIPTS)
def test_utf8_round_trips(script, enc):
    garbled = read_as(SCRIPTS[script], "utf-8", enc)
    if garbled is None:
        return
    fixed, n, _, _ = M.repair(garbled)
    assert n and (fixed == SCRIPTS[script] or (script, enc) in UTF8_LIMITS)


@pytest.mark.parametrize("true,enc", [(t, e) for t in ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5") for e in ("cp1252", "latin-1", "cp1250", "koi8-r", "cp866", "mac_roman", "cp437", "cp850") if t != e])
def test_russian_pairs_round_trip(true, enc):
    fixed, n, _, _ = M.repair(read_as(SCRIPTS["ru"], true, enc))
    assert n and fixed == SCRIPTS["ru"]


@pytest.mark.parametrize("true", ["cp1253", "iso8859-7"])
@pytest.mark.parametrize("enc", ["cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "mac_cyrillic"])
def test_greek_pairs_round_trip(true, enc):
    assert M.repair(read_as(SCRIPTS["el"], true, enc))[0] == SCRIPTS["el"]


@pytest.mark.parametrize("script,true,enc", [("uk", "cp1251", "cp1252"), ("uk", "cp1251", "latin-1"), ("uk", "iso8859-5", "cp1252"), ("pl", "cp1250", "cp1251"), ("pl", "cp1250", "koi8-r"), ("pl", "iso8859-2", "cp1250")])
def test_other_alphabets_round_trip(script, true, enc):
    assert M.repair(read_as(SCRIPTS[script], true, enc))[0] == SCRIPTS[script]


@pytest.mark.parametrize("script", SCRIPTS)
def test_correct_text_of_any_script_stays(script):
    assert M.repair(SCRIPTS[script]) == (SCRIPTS[script], 0, "", False)
    assert M.repair(SCRIPTS[script].upper())[1] == 0


@pytest.mark.parametrize("true,enc", [("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("cp1251", "koi8-r")])
def test_correct_words_beside_garbled_ones_stay(true, enc):
    before, middle, after = "Он сказал, что ", "этот текст был прочитан неверно", " и ушёл домой."
    fixed, n, _, _ = M.repair(before + read_as(middle, true, enc) + after)
    assert n and fixed == before + middle + after


def test_a_lone_word():
    assert M.repair(read_as("Привет", "cp1251", "cp1252"))[0] == "Привет"
    assert M.repair("He said " + read_as("Привет", "cp1251", "cp1252") + " to all")[0] == "He said Привет to all"


def test_bytes_of_an_unknown_reading_are_reported_not_changed():
    text = "これは日本語です".encode("shift-jis").decode("latin-1")
    fixed, n, _, damaged = M.repair(text)
    assert damaged and fixed.encode("latin-1", "ignore").decode("shift-jis", "ignore")[:3] == "これは"
