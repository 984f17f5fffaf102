import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadloom.llm import tokens
from quadloom.llm.packing import Places, pack, solve
from quadloom.llm.text_quality import Words, describe, text_statistics
from quadloom.llm.tokens import count_tokens, encode_texts, encoder

ODD = ["a", "é", "'", "s", "'s", "'ll", " ", "  ", "\n", " ", "　", "1", "½", "日", "本", "!", "»", "—", "\t", "_", "\x1c", " ", "re", "\r\n", "Ω", "😀", "̈", "<|endoftext|>"]
LONG = [" " * 60_001 + "x", "a" * 70_000, "\n" * 60_000, "ab " * 40_000 + " " * 55_000 + "\n y", "\x1c" * 60_000 + " \x1c!", "日" * 30_000]


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=30).map("".join), max_size=12), st.sampled_from([1 << 20, 16]))
def test_parts_are_encoded_as_the_whole(name, texts, span):
    enc, tokens.SLICE_BYTES = encoder(name, tokens.TOKENIZERS), span
    ids, counts = enc.encode(pa.array(texts, pa.string()))
    tokens.SLICE_BYTES = 1 << 20
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == enc._encoding.encode_ordinary(t)


def test_long_texts_as_another_library_encodes_them():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    ids, counts = encoder("byte_bpe_50k", tokens.TOKENIZERS).encode(pa.array(LONG))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(LONG):
        assert ids[ends[i] : ends[i + 1]].tolist() == other.encode(t, add_special_tokens=False).ids


def test_encode_table(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "Hello world"), (None, " "), (5, "naïve <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = encoder("byte_bpe_50k", tokens.TOKENIZERS)._encoding
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert got == {k: enc.encode_ordinary(t or "") for k, t in rows}
    assert {r.doc_id: r.tokens for r in count_tokens(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=25), st.sampled_from([64, 1000]), st.sampled_from([1024, 16]))
def test_plan_fits_and_places_every_item(counts, capacity, grid):
    plan = solve(counts, capacity, grid=grid)
    places = Places(plan, counts)
    lengths = np.concatenate([np.full(n, k) for k, n in counts.items()])
    ranks = np.concatenate([np.arange(n) for n in counts.values()])
    fill = np.zeros(plan.containers, np.int64)
    np.add.at(fill, places.container(lengths, ranks), lengths)
    assert fill.min() > 0 and fill.max() <= capacity


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = {}
    for _ in range(5000):
        n = min(2048, int(rng.lognormvariate(6, 0.8)) + 1)
        counts[n] = counts.get(n, 0) + 1
    bound = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert solve(counts, 2048).containers <= 1.01 * bound


@pytest.mark.parametrize(
    ("counts", "capacity"),
    [({1: 50_000}, 8192), ({9: 30_000, 700: 900, 1500: 400}, 8192), ({8191: 5, 1: 5, 4095: 6, 4097: 6}, 8192), ({1: 3_000_000, 1000: 900, 1025: 900}, 1 << 20)],
)
def test_plan_over_the_grid_packs_exact_lengths(counts, capacity):
    bound = -(-sum(k * n for k, n in counts.items()) // capacity)
    assert solve(counts, capacity).containers == bound


def test_pack_table(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 400)) for i in range(700)] + [(10_000, None), (10_001, 0), (10_002, 5_000), (None, 7)] + [(20_000 + i, 33) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n long").repartition(5).withColumns({"bin": F.lit("clash"), "size": F.lit(1)})
    packed, plans = pack(df, "doc_id", "n", [("small", 100), ("large", 1000)])
    found = packed.collect()
    for b, capacity in (("small", 100), ("large", 1000)):
        own = [r for r in found if r.bin == b]
        fill, sizes = {}, {}
        for r in own:
            sizes.setdefault(r.doc_id, []).append((r.part, r.start, r.size))
            if r.size:
                fill[r.container] = fill.get(r.container, 0) + r.size
            else:
                assert r.container is None
        assert max(fill.values()) <= capacity and set(fill) == set(range(plans[b].containers))
        assert len(fill) <= 1.03 * -(-sum(fill.values()) // capacity) + 1
        for k, n in rows:
            parts = sorted(sizes[k])
            assert sum(p[2] for p in parts) == (n or 0) and [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
            assert all(p[2] == capacity for p in parts[:-1])
    assert pack(df.limit(0), "doc_id", "n", [("small", 100)])[0].count() == 0
    with pytest.raises(ValueError, match="capacities"):
        pack(df, "doc_id", "n", [("none", 0)])


COMMON = frozenset("the a is of and in that it we before if you can then was for as to with not der die das ist und le la les est et el los es y de".split())
PROSE = "The model of the river is not the same as that of the lake, and we measured it before the night.\nIf the water is high, you can plot the curve and then compare it with a map of the valley.\n"
WRAPPED = "the value of the station is wide and we wait for the\nnext reading of the sensor before the end of the day,\nas the plan of the team is to keep the station open in\nthe first week of the year.\n"
CODE = "import tools\nfor i in range(10):\n    x[i] = f(y, i) + 2\n    if x[i] > 3: print(x[i])\ndef g(a, b=2):\n    return a @ b.T\n# the mean of the values in the table\n"
TABLE = "| name | size |\n|---|---|\n| the lake is in the valley | 3 |\n| river | 4 |\n"
TSV = "name\tnote\nthe lake is in the valley\tthe sea is in the west\nriver\tthe river is in the north\n"
LIST = "- how to plot the curve\n- when not to filter the data\n* the end of the list is near\n1. first of the items in it\n"
HEAP = "the and in of that is river lake before if a was the of to\nwith as not then and the in a of lake is you can it\nof the the and station is in before that was map a\n"
NOUNS = "river lake station model curve table value sensor map\nmodel curve river station lake valley table plot\n"
DATA = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==\n" * 3


def stats(*texts):
    got = describe(pa.array(texts, pa.string()), Words(COMMON))
    return [{k: v[i] for k, v in got.items()} for i in range(len(texts))]


def test_prose_is_told_from_the_rest():
    prose = [PROSE, WRAPPED, PROSE.replace("\n", "\r\n"), "> " + PROSE.strip().replace("\n", "\n> "), PROSE * 500, PROSE + CODE[:30]]
    other = [CODE, TABLE, TSV, LIST, HEAP, NOUNS, DATA, CODE + TABLE + PROSE[:10], "x" * 200_000, "# A heading of the text\n## Another in the text\n"]
    got = stats(*prose, *other)
    assert [g["prose_share"] >= 0.5 for g in got] == [True] * len(prose) + [False] * len(other)
    assert [got[len(prose) + i]["kind"] for i in range(4)] == ["code", "table", "table", "list"]


def test_statistics_by_brute_force():
    for text, got in zip([PROSE, CODE, TABLE, "One, two!\n\n  three\n"], stats(PROSE, CODE, TABLE, "One, two!\n\n  three\n"), strict=True):
        lines = [x for x in text.split("\n") if x.strip()]
        words = text.split()
        assert got["lines"] == len(lines) and got["words"] == len(words)
        assert got["mean_word_length"] == pytest.approx(sum(map(len, words)) / len(words))
        assert got["symbol_ratio"] == pytest.approx(sum(not c.isalnum() for w in words for c in w) / sum(map(len, words)))
        assert got["punctuated_share"] == pytest.approx(sum(x.rstrip().rstrip("”\"'»’)*_").endswith((".", "!", "?", "…")) for x in lines) / len(lines))
        x = np.array([len(v) for v in lines], float) - np.mean([len(v) for v in lines])
        if len(lines) > 2:
            assert got["length_autocorrelation"] == pytest.approx((x[1:] * x[:-1]).sum() / (x * x).sum())


def test_long_words_are_described_exactly():
    rule, cell, name, chinese = "-" * 75, "<tr><td>1.2</td><td>" + "é" * 40 + "</td></tr>.", "x" * 65 + "!", "我们在夜里之前测量了河流的模型并且把它和山谷的地图进行了比较因为水位很高。"
    for text in (rule, cell, name, chinese, f"a {rule}\n{cell} b {name}\n" + "9" * 70):
        got = stats(text)[0]
        signs = "".join(text.split())
        assert got["letter_ratio"] == pytest.approx(sum(map(str.isalpha, signs)) / len(signs))
        assert got["symbol_ratio"] == pytest.approx(sum(not c.isalnum() for c in signs) / len(signs))
        assert got["mean_word_length"] == pytest.approx(len(signs) / len(text.split()))
    found = stats(chinese, f"{chinese}\n{chinese}\n", rule, name)
    assert [g["prose_share"] for g in found] == [1, 1, 0, 0] and [g["punctuated_share"] for g in found] == [1, 1, 0, 1]


NESTED = "the plants that grow in the garden of the house\n    a tree that is as old as the house\n    the roses that we had before the war\nthe animals that you can see in the valley\n    the fox that is in the wood at night\n    a bird of the lake and of the river\n"
TERMS = "".join(f"the {x} near a valley\n" + f"the {y} of the western valley that most visitors see before a dark night\n" for x, y in (("lake", "water"), ("river", "stream"), ("hill", "slope")))
PARAGRAPHS = "    The value of the station is wide and we wait for the\nnext reading of the sensor before the end of the day,\nas the plan of the team is to keep the station open in\nthe first week of the year.\n" * 3


def test_layout_alone_tells_lists():
    flat = "".join(x.strip() + "\n" for x in NESTED.splitlines())
    long_first = "".join(TERMS.splitlines(True)[i ^ 1] for i in range(6))
    found = stats(NESTED, NESTED.replace("    ", "\t"), NESTED.replace("    ", "  "), TERMS, flat, long_first, PARAGRAPHS, NESTED.replace("\n", ".\n"), TERMS.replace("\n", ".\n"), NESTED.replace("    ", "   "))
    assert [(g["kind"], g["prose_share"]) for g in found] == [("list", 0)] * 4 + [("prose", 1)] * 6
    assert [g["list_lines"] for g in found[:4]] == [6] * 4


SENTENCES = {
    "it": "Il fiume che scorre a sud del paese non era mai stato misurato prima di ieri.\nPer ora il lago e il ponte non si vedono, ma di sera si sente il vento.\n",
    "pt": "O rio que passa ao sul da vila nunca foi medido antes de ontem.\nPor ora, o lago e a ponte não se veem, mas à noite ouve-se o vento.\n",
    "pl": "Rzeka, która płynie na południe od wsi, nie była do tej pory mierzona.\nNa razie nie widać ani jeziora, ani mostu, ale w nocy słychać wiatr i las.\n",
    "ru": "Река к югу от села до сих пор не была никем измерена.\nПока не видно ни озера, ни моста, но по ночам в лесу слышен ветер.\n",
    "el": "Ο ποταμός που κυλά νότια του χωριού δεν είχε μετρηθεί ποτέ πριν από χθες.\nΓια την ώρα δεν φαίνεται ούτε η λίμνη ούτε η γέφυρα, αλλά τη νύχτα ακούγεται ο άνεμος.\n",
    "fi": "Kylän eteläpuolella virtaavaa jokea ei ollut koskaan aiemmin mitattu ennen eilistä.\nToistaiseksi järveä tai siltaa ei näy, mutta yöllä metsässä kuuluu tuulen humina.\n",
    "tr": "Köyün güneyinden akan nehir düne kadar hiç ölçülmemişti.\nŞimdilik ne göl ne de köprü görünüyor, ama geceleri ormanda rüzgârın sesi duyuluyor.\n",
    "ar": "لم يتم قياس النهر الذي يجري جنوب القرية من قبل.\nلا يمكن رؤية البحيرة أو الجسر في الوقت الحالي، ولكن في الليل تسمع الريح من الغابة.\n",
    "hi": "गाँव के दक्षिण में बहने वाली नदी को कल से पहले कभी नहीं मापा गया था।\nअभी न तो झील दिखाई देती है और न ही पुल, लेकिन रात में जंगल से हवा की आवाज़ आती है।\n",
    "zh": "我们在夜里之前测量了河流的模型并且把它和山谷的地图进行了比较因为水位很高，所以我们需要继续测量它的宽度和深度。\n" * 3,
    "ja": "村の南を流れる川は昨日まで一度も測られたことがなかった。今のところ湖も橋も見えないが、夜になると森から風の音が聞こえてくる。\n" * 2,
    "ko": "마을 남쪽을 흐르는 강은 어제까지 한 번도 측정된 적이 없었다.\n지금은 호수도 다리도 보이지 않지만 밤에는 숲에서 바람 소리가 들린다.\n",
}
HEAPS = [
    "lago ponte fiume e vento di sera il paese da valle nord sud\nvilla di lago il ponte da fiume e sera vento nord\n", NOUNS.replace("map", "map."), NOUNS.replace(" ", ". "), CODE,
    "река озеро мост село ветер лес модель кривая таблица\nдатчик карта значение река станция модель\n", "река. озеро мост. село ветер. лес модель. кривая таблица.\n",
    "that is before lake a if not. the for and river with was,\nstation in to of then map you is not. if can a the,\nwe it as the model of before.\nriver before to is lake as.\n",
]


def test_sentences_of_any_language_and_heaps():
    found = dict(zip(SENTENCES, stats(*SENTENCES.values()), strict=True))
    assert {k: g["prose_share"] for k, g in found.items()} == dict.fromkeys(SENTENCES, 1)
    assert [g["prose_share"] for g in stats(*HEAPS)] == [0] * len(HEAPS)


def test_sentences_without_stops_in_lower_case_and_after_numbers():
    lower = "if the lake is too small, then the model explains the station as well\nthe station of the river is wide and we wait for the next reading of it\n"
    german = "in dieser übung ist das signal zum 4. mal die übung der station\nwir prüfen das signal und die kurve der station vor der nacht\n"
    assert [g["prose_share"] for g in stats(lower, german, "> " + lower.strip().replace("\n", "\n> "), lower.replace("well", "well ;"))] == [1] * 4


def test_periodicity_follows_the_step_of_the_document():
    step = lambda *indents: stats("".join(" " * i + "x\n" for i in indents))[0]["indent_periodicity"]
    assert step(0, 4, 8, 4, 8, 12, 6) == pytest.approx(5 / 6) and step(0, 2, 4, 6, 3) == pytest.approx(3 / 4)


def test_texts_do_not_touch_each_other():
    texts = [PROSE, CODE, None, "", " \n\t", TABLE, "no break at the end", LIST, "\n" + HEAP, TSV.rstrip("\n"), "river\tx"]
    together = stats(*texts)
    for t, g in zip(texts, together, strict=True):
        np.testing.assert_equal(g, stats(t)[0])


def test_statistics_table(spark):
    rows = [(1, PROSE), (2, None), (3, ""), (4, " \n"), (5, CODE), (None, PROSE), (6, PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kind": F.lit("clash"), "lines": F.lit(1)})
    common = spark.createDataFrame([(w,) for w in sorted(COMMON)] + [(None,)], "word string")
    got = {r.doc_id: r for r in text_statistics(df, "doc_id", "text", common).collect()}
    assert {k: r.kind for k, r in got.items()} == {1: "prose", 2: "blank", 3: "blank", 4: "blank", 5: "code", None: "prose", 6: "prose"}
    assert got[2].words == 0 and got[2].prose_share is None and got[1].prose_lines == 2
    assert text_statistics(df.limit(0), "doc_id", "text", common).count() == 0
    with pytest.raises(ValueError, match="common words"):
        text_statistics(df, "doc_id", "text", common, max_words=3)
