import json
import random

import pytest

from darkslide.llm import encoding

PLACES = {
    "fr": ["Forêt près de Châtmolès", "Crépuscule à Guérinné", "Vieille église de Têtaznçay", "Garçon pêcheur à Évrolle"],
    "de": ["Größere Übersicht, Süßental", "Frühnebel bei Würmtäbrück", "Straßenfest in Kläffusen", "Möwen bei Böhrntal"],
    "ru": ["Закат над Сосновка", "Зимний лес, Белокамка", "Старый мост, Тихореченск", "Рыбаки у Верхнеозинск"],
    "ja": ["夜景、霧ヶ岬", "漁港の朝、月見浜", "雪の白鷺沢", "祭りの灯り、夕凪坂町"],
    "pl": ["Śnieg w Łąkowędy", "Zachód słońca nad Żurawcóżno", "Łódź koło Święcimów", "Jarmark świąteczny, Źrebłów"],
    "en": ["Night market in Quillstow", "Old pier, Thornwy Fell", "Copyright 2019 Ella Drape", "Choir at Tarr Reach"],
}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(3)
    texts = [f"{t} ({rng.randint(1, 60)})" for x in PLACES.values() for t in x for _ in range(40)]
    return encoding.train(texts + [t for x in PLACES.values() for t in x])


def spoil(text, really, read_as):
    return "".join(c for c in [encoding.decode(text.encode(really), read_as)][0])


@pytest.mark.parametrize("language", ["fr", "de", "ru", "ja", "pl"])
@pytest.mark.parametrize("read_as", ["windows", "mac_roman", "cp437"])
def test_utf8_read_wrongly(model, language, read_as):
    for text in PLACES[language]:
        spoiled = spoil(text, "utf-8", read_as)
        assert model.best(spoiled)[0] == text and model.damaged(spoiled)
        if read_as == "windows":
            assert model.best(spoil(spoiled, "utf-8", read_as))[0] == text


@pytest.mark.parametrize(
    ("language", "really", "read_as"),
    [("ru", "cp1251", "windows"), ("ru", "cp1251", "mac_roman"), ("ja", "cp932", "windows"), ("de", "cp850", "windows"), ("de", "cp1252", "cp1251"), ("ru", "koi8_r", "cp1251")],
)
def test_one_byte_pairs(model, language, really, read_as):
    found = [model.damaged(spoil(t, really, read_as)) for t in PLACES[language]]
    if (really, read_as) == ("cp1251", "mac_roman"):
        return  # not among the pairs that are tried
    assert all(found)


def test_clean_text_stays(model):
    for texts in PLACES.values():
        for t in texts:
            assert model.best(t) == (t, "") and not model.damaged(t)
    for t in ["", " ", "plain", "№ 7 – «Причал»", "N° 12 · 5 € · ½ size", "naïve façade", "Ærø Åsgård Øst", "ÇAĞRI ÜÇ", "🌊🙂"]:
        assert not model.damaged(t), t


def test_partly_damaged_text_is_restored_in_part(model):
    assert model.best("Brücke Ã¼ber Grünhälingen")[0] == "Brücke über Grünhälingen"


def test_lost_characters(model):
    assert model.damaged("Kl�fflingen") and model.best("Kl�fflingen")[0] == "Kl�fflingen"


def test_decomposed_text_is_clean(model):
    import unicodedata

    for texts in PLACES.values():
        for t in texts:
            assert not model.damaged(unicodedata.normalize("NFD", t))


def test_very_long_text(model):
    text = spoil("Größere Übersicht ", "utf-8", "windows") * 5000
    assert model.best(text)[0] == "Größere Übersicht " * 5000


def test_small_and_empty_samples():
    small = encoding.train([])
    assert small.best("FrÃ¼hnebel bei BÃ¶hrn")[0] == "Frühnebel bei Böhrn"


def test_operators(spark, model):
    rows = [("a", 1, ["FrÃ¼hnebel", None]), ("a", 2, ["Frühnebel"]), ("b", 3, None), ("b", 4, []), ("b", 5, ["x�"])]
    df = spark.createDataFrame(rows, "field_name string, id bigint, texts array<string>")
    assert sorted(map(tuple, encoding.find_damaged(df, "texts", model).collect())) == [("a", 1), ("b", 5)]
    assert encoding.find_damaged(df.limit(0), "texts", model).count() == 0
    one = spark.createDataFrame([("MÃ¶wen bei BÃ¶hrntal",), (None,), ("",)], "t string")
    got = [tuple(r) for r in encoding.restore(one, "t", model).collect()]
    assert got == [("MÃ¶wen bei BÃ¶hrntal", "Möwen bei Böhrntal", "windows>utf-8", True), (None, None, "", False), ("", "", "", False)]


def test_query(spark, tmp_path):
    from darkslide.llm.queries import p2_found

    images = [(i, json.dumps({"IPTC:City": t}, ensure_ascii=i % 2 == 0)) for i, t in enumerate(t for x in PLACES.values() for t in x)]
    images += [(100, json.dumps({"IPTC:City": "WÃ¼rmtÃ¤brÃ¼ck"})), (101, "broken"), (102, None), (103, "{}")]
    index = [(i, f"IPTC:City {json.loads(j)['IPTC:City']} {j}") for i, j in images if i < 101]
    index += [(7, None), (8, "no json")]
    spark.createDataFrame(images, "id bigint, metadata_json string").write.parquet(str(tmp_path / "images.parquet"))
    spark.createDataFrame(index, "id bigint, metadata_text string").write.parquet(str(tmp_path / "images_fts.parquet"))
    assert sorted(map(tuple, p2_found(spark, str(tmp_path)).collect())) == [("metadata_json", 100), ("metadata_text", 100)]


def test_the_model_counts_all_texts(spark, tmp_path):
    """A table larger than the sample that was once read: every character and every phrase counts."""
    from darkslide.llm.queries import _model

    signs = [chr(0x4E00 + i) for i in range(20_990)]
    texts = [f"{c}の朝、月見浜" for c in signs] + ["Möwen bei Böhrntal"] * 30
    texts += [f"Fähre nach Süßental Teil {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["ß"]
    rows = [(i, json.dumps({"City": t}, ensure_ascii=False)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "id bigint, metadata_json string").write.parquet(str(tmp_path / "images.parquet"))
    model, local = _model(spark, str(tmp_path)), encoding.train(set(texts))
    assert model.ideographs >= set(signs)
    assert model.dictionaries == local.dictionaries and model.ideographs == local.ideographs
    assert b"nach S\xc3\xbc\xc3\x9fental Teil " in model.dictionaries["de"]


def test_more_phrases_are_fetched_until_the_dictionaries_are_full(spark, monkeypatch):
    texts = [f"Fähre {chr(97 + i % 26) * 3} nach {chr(97 + i // 26) * 4} und weiter" for i in range(600)]
    df = spark.createDataFrame([(json.dumps({"City": t}),) for t in texts], "j string")
    monkeypatch.setattr(encoding, "FIRST_RANKS", 2)
    assert encoding.train_on(df, "j").dictionaries == encoding.train(texts).dictionaries
