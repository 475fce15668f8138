import random

import pyarrow as pa
import pytest

from quantloom.llm import textstats
from quantloom.llm.textstats import COMMON, not_prose, text_statistics


def measure(*texts):
    return textstats.measure(pa.array(texts, pa.string())).to_pylist()



PROSE = "The committee judged that activity had continued to expand, and that prices were likely to rise. "
SHAPES = {
    "prose": [
        PROSE * 4,
        PROSE.upper() * 4,
        (PROSE * 4).lower().replace(",", "").replace(".", ""),
        "\n".join((PROSE * 4)[i : i + 40] for i in range(0, len(PROSE) * 4, 40)),
        "> " + "\n> ".join((PROSE * 3)[i : i + 45] for i in range(0, len(PROSE) * 3, 45)),
        "- " + "\n- ".join([PROSE.strip()] * 5),
        "Der Rat beschloss, die Geldpolitik nicht zu ändern, und die Inflation stieg leicht. " * 4,
        "Le conseil a décidé de ne pas modifier sa politique, et la production a ralenti. " * 4,
        "El consejo decidió no cambiar la política, mientras que el consumo bajó un poco. " * 4,
        PROSE * 4 + "\n\n- rates 4.1\n- prices 5.2\n",
        (PROSE * 4).replace(" ", "\u00a0"),
        "Question: " + PROSE * 2 + "\nAnswer: " + PROSE * 2,
    ],
    "list": [
        "\n".join(f"- term premium {x}" for x in "abcdefgh"),
        "\n".join(f"{i}. policy rate (Dublin)" for i in range(1, 12)),
        "\n".join(f"0{i}:30 bank lending, main hall" for i in range(1, 9)),
        "\n".join(f"[ ] el tipo de cambio / Lugar{x}" for x in "abcdefgh"),
        "\n\n".join(f"Le crédit aux ménages – Paris – see Lyon{x}" for x in "abcdefgh"),
        ", ".join(f"Place{x} energy costs" for x in "abcdefghijkl"),
        "\n".join(f"Place{x} savings ratio" for x in "abcdefghijkl"),
        PROSE + "\n" + "\n".join(f"({x}) Rome, Oslo, Bern, Paris, Vienna, Madrid" for x in "abcdefgh"),
    ],
    "table": [
        "Item\t2019\t2020\t2021\n" + "\n".join(f"row {x}\t1.5\tn.a.\t33" for x in "abcdef"),
        "| Item | 2019 | 2020 |\n" + "\n".join(f"| der Zins {x} | 1.5 | 2.5 |" for x in "abcdef"),
        "Item        Q1 2019     Q2 2020\n" + "\n".join(f"rent growth {x}      1.5        2.25" for x in "abcdef"),
        "Item Chg 2019 Q1 2020 Q2 2021\n" + "\n".join(f"real wages{x} 1.5 2.5 133" for x in "abcdef"),
        '"Item";"Q1 2019";"Q2 2020"\n' + "\n".join(f'"2008-10-0{i}";"1.5";"2.5"' for i in range(1, 9)),
        "Item,Q1 2019,Q2 2020,Q3\n" + "\n".join(f"wage{x},1.5,2.5,n.a." for x in "abcdef"),
    ],
    "junk": [
        "Qk9PVEg3aGVyZSBpcyBhIGxvbmcgbGluZSBvZiBjb2RlIHRoYXQgbm9ib2R5IGNhbiByZWFk\n" * 5,
        "0x036ba97c 0x51fc68ed 0x8981b74c 0x9507236c " * 8,
        "free best cheap online rates chart top buy yield forecast 2024 " * 8,
        "energy costs Paris " * 40,
        "dtarw gfzrexkxe agvegdltrvzqk mgh xwchmcwqjjldg vhzgltdkc " * 6,
        "+!^\\{_ #@/<|]< ^ [}!^%}} %{%^^ $[#{^$}$ %\\_ *]! @ {^~$~ " * 6,
        " ".join("For every town the rate fell by two per cent and prices rose."),
        "IÃ±Â â€“hÃ©Â ï¿½ummÃ©r,Â rÃ©câ€™rdï¿½Â â€™fÂ â€“hÃ© " * 6,
        "<div class='c1' id='x'>{{v1}}</div>;var x=[1,2];\n" * 6,
        "   \n\t ",
        "",
    ],
}


LANGUAGES = {
    "pl": "Rada postanowiła pozostawić stopy procentowe bez zmian. Inflacja obniżyła się w ostatnim kwartale, ale ceny usług nadal rosną. Członkowie komitetu uznali, że ryzyko pozostaje wysokie. ",
    "tr": "Merkez bankası faiz oranını değiştirmedi. Enflasyon son çeyrekte düştü ancak hizmet fiyatları artmaya devam ediyor. Kurul üyeleri risklerin yüksek kaldığını belirtti. ",
    "ru": "Совет директоров сохранил ключевую ставку без изменений. Инфляция снизилась в последнем квартале, но цены на услуги растут. Члены комитета отметили, что риски остаются высокими. ",
    "zh": "委员会决定维持利率不变。上个季度通货膨胀率有所下降，但服务价格继续上涨。成员们认为风险仍然很高。",
    "ja": "理事会は政策金利を据え置くことを決定した。前四半期にインフレ率は低下したが、サービス価格は上昇し続けている。委員はリスクが依然として高いと判断した。",
    "nl": "De raad heeft besloten de rente niet te wijzigen. De inflatie daalde in het laatste kwartaal, maar de prijzen van diensten blijven stijgen. Leden van het comité vonden dat het risico hoog blijft. ",
    "ar": "قرر المجلس الإبقاء على أسعار الفائدة دون تغيير. انخفض التضخم في الربع الأخير لكن أسعار الخدمات ما زالت ترتفع. ",
    "hi": "समिति ने ब्याज दर में कोई बदलाव नहीं किया। पिछली तिमाही में महंगाई घटी लेकिन सेवाओं की कीमतें बढ़ती रहीं। ",
    "ko": "위원회는 금리를 동결하기로 결정했다. 지난 분기에 물가 상승률은 낮아졌지만 서비스 가격은 계속 오르고 있다. ",
}


@pytest.mark.parametrize("shape, text", [(k, t) for k, texts in SHAPES.items() for t in texts])
def test_shapes(shape, text):
    got = measure(text)[0]
    assert got["shape"] == shape, got
    assert (got["shape"] != "prose") == ("running sentences" in got["failed"])


@pytest.mark.parametrize("text", [t * k for t in LANGUAGES.values() for k in (1, 3)])
def test_prose_of_any_language(text):
    assert measure(text)[0]["shape"] == "prose", measure(text)


def test_statistics_and_reasons():
    got = measure("one two\n\n- three.")[0]
    assert (got["n_words"], got["n_lines"]) == (4, 2) and got["mean_word_length"] == len("onetwo-three.") / 4
    got = measure("\n".join(["- item a ..."] * 10))[0]
    assert {"too few words", "bullet lines", "ellipsis lines", "symbols per word", "running sentences"} <= set(got["failed"])
    assert got["run_rule"] == "bullets"
    assert measure(PROSE * 4)[0]["failed"] == [] and measure(PROSE * 4)[0]["run_rule"] is None


def test_very_long_text():
    assert measure(PROSE * 20_000)[0]["n_words"] == 16 * 20_000
    assert measure("x" * 2_000_000)[0]["shape"] == "junk"


def test_a_text_has_the_same_statistics_alone_and_among_others():
    draw = random.Random(4)
    pool = [x for texts in SHAPES.values() for x in texts] + list(LANGUAGES.values())
    marks = ["\n", "\n\n", "\r\n", " ", "\t", "> ", "… ", " – ", "{", "<b>", "[ ] ", "#", "1,234.5 ", "é", "\u200b", ",", ";", "\x0b"]
    texts = []
    for _ in range(150):
        pieces = []
        for _ in range(draw.randrange(6)):
            x = draw.choice(pool)
            at = draw.randrange(len(x) + 1)
            pieces += [x[at : at + draw.randrange(120)], draw.choice(marks)]
        texts.append("".join(pieces))
    assert measure(*texts) == [measure(x)[0] for x in texts]
    for x, got in zip(texts, measure(*texts)):
        assert 0 <= sum(got[f"{k}_share"] for k in ("prose", "list", "table", "junk")) <= 1 + 1e-9
        if x.isascii() and ">" not in x:
            words = x.split()
            assert got["n_words"] == len(words), repr(x)
            assert abs(got["mean_word_length"] * len(words) - sum(map(len, words))) < 1e-6
            letters = "".join(c if c.isalpha() else " " for c in x.lower()).split()
            assert abs(got["common_words"] - sum(w in COMMON for w in letters) / max(1, len(letters))) < 1e-9


def test_tables(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, PROSE * 5, ""), (3, PROSE * 5, ""), (None, PROSE * 5, "")], "doc_id long, text string, shape string")
    got = text_statistics(df)
    assert got.count() == 4 and [tuple(r) for r in not_prose(df).collect()] == [(2, "junk")]
    assert text_statistics(df.limit(0)).count() == 0


def test_a_block_that_repeats_one_sentence_counts_among_varied_prose():
    varied = (
        "The old harbour was closed after a storm had broken its northern wall. Fishermen from three villages then sold "
        "their catch at the railway bridge, where buyers from town waited every morning. Nobody could say when repairs "
        "would begin, for money had run out and winter is near."
    )
    text = varied + "\n\n" + "We have seen that it was what they would have said then. " * 8
    got = measure(text)[0]
    assert got["shape"] == "junk" and got["junk_share"] > got["prose_share"] > 0
    assert "running sentences" in got["failed"] and got["run_rule"] == "repeated words"
