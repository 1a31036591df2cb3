import pytest
from pyspark.sql import functions as F

from kindred.functions import names as N


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(column).collect()]


CASES = {
    "Михайлов Сергей": "михаи лов сергеи", "Йосиф Ёлкин": "и осиф е лкин", "Ömer Şahin": "o mer s ahin", "İlham": "i lham", "Kəmalə ı": "kəmalə ı", "ҳамза ӯктам": "ҳамза у ктам", "Қазақ Ұлы": "қазақ ұлы",
    "և ու": "եւ ու", "ՍՊԸ": "սպը", "ООО «Ромашка» №5": "ооо ромашка no", "foo_bar 2²": "foo_bar", " A.B.": "a b", None: "", "": "", "   ": "",
}


def test_normalize_text(spark):
    assert values(spark, CASES, N.normalize_text("s")) == list(CASES.values())
    assert values(spark, ["Михайлов", "Ömer 7"], N.normalize_text("s", mode="clean")) == ["михаилов", "omer"]
    assert values(spark, ["Flat 7-B"], N.normalize_text("s", keep_digits=True)) == ["flat 7 b"]


def test_latin(spark):
    said = {"ромашка": "romashka", "щука юля": "shuka yulya", "Щука": "щuka", "սպը": "spy", "kəmalə": "kemale", "o’neil `x'": "oneil x", None: ""}
    assert values(spark, said, N.transliterate("s")) == list(said.values())


def test_legal_forms(spark):
    assert values(spark, ["ооо ромашка llc", "spy co", None, "company company x"], N.remove_legal_forms("s")) == ["ромашка", "", "", "x"]


@pytest.mark.parametrize(("text", "script"), [("Иван", "cyrillic"), ("Ivan", "latin"), ("Անի", "armenian"), ("ანა", "georgian"), ("Ivan Иван", "mixed"), ("123", "unknown"), (None, "unknown")])
def test_script(spark, text, script):
    assert values(spark, [text], N.detect_script("s")) == [script]


def test_garbage(spark):
    rows = {None: 1, "": 1, "  ": 1, "UNKNOWN person": 1, "Замените  на имя": 1, "согласно списку": 1, "Неизвестно": 1, "Иванов": 0, "anhayt": 1}
    assert values(spark, rows, N.is_garbage("s")) == list(rows.values())


def test_signs(spark):
    assert values(spark, ["«a» ’b’ \"c\""], N.normalize_quotes("s")) == ["'a' 'b' 'c'"]
    assert values(spark, ["a–b—c−d"], N.normalize_dashes("s")) == ["a-b-c-d"]
    assert values(spark, ["a|/b\\_c"], N.normalize_separators("s")) == ["a b c"]
    assert values(spark, ["a.(b)"], N.normalize_punctuation_soft("s")) == ["a  b "]


def test_dates(spark):
    rows = [("2024-03-01", "arm"), ("1700000000", "tjk"), ("1700000000", "arm"), ("junk", "tjk"), (None, "tjk")]
    got = [str(r[0]) for r in spark.createDataFrame(rows, "d string, country string").select(N.parse_snapshot("d")).collect()]
    assert got == ["2024-03-01 00:00:00", "2023-11-14 22:13:20", "None", "None", "None"]
    days = spark.sql("SELECT timestamp'2024-01-01 12:00:00' a, timestamp'2024-01-03 11:00:00' b").select(N.days_between(F.col("a"), F.col("b"))).first()[0]
    assert days == 1
