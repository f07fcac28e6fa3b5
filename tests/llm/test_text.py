from __future__ import annotations

import unicodedata

import pandas as pd
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import langid, textforms
from tidewire.llm.textforms import ClusterTransducer, MappingConflict, same_form, transducer
from tidewire.llm.visible import visible_text, words


@pytest.mark.parametrize(
    "text, form",
    [
        ("Ｆｕｌｌ，　x", "Full, x"),
        ("ệ ệ ệ", "ệ ệ ệ"),
        ("о̛̣", "ợ"),
        ("a​b­c", "abc"),
        ("é​̣", "ẹ́"),
        ("A new  x ​ y ", "A new x y"),
        ("Ð Ɖ d̵", "Đ Đ đ"),
        ("ﬁ Ⅳ …", "fi IV ..."),
        ("Тhủ đô", "Thủ đô"),
        ("m² – « » β", "m² – « » β"),
        ("mid\u2011month \u2010 \u2014", "mid-month - \u2014"),
        ("a\u0302\u0301\u0332", "a\u0332\u0302\u0301"),
        ("\U0001f469‍\U0001f33e", "\U0001f469‍\U0001f33e"),
        ("\U0001f469\U0001f33e", "\U0001f469\U0001f33e"),
        ("sĩ‍ số", "sĩ số"),
        ("﻿", ""),
        ("", ""),
        (None, None),
    ],
)
def test_same_form(text, form):
    assert same_form(text) == form


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aệо̛̣​‍　Аａ  ")), max_size=12))
def test_form_is_a_fixed_point_and_composition_never_shows(text):
    form = same_form(text)
    assert same_form(form) == form
    assert same_form(unicodedata.normalize("NFD", text)) == same_form(unicodedata.normalize("NFC", text))


def test_conflicting_mappings_are_refused():
    with pytest.raises(MappingConflict):
        ClusterTransducer([("é", "è"), ("è", "e")], "́", "​", "  ", "☀")
    with pytest.raises(MappingConflict):
        ClusterTransducer([("a", "b")], "́", "​", "  ", "☀")
    with pytest.raises(MappingConflict):  # two spellings of one cluster
        ClusterTransducer([("é", "x"), ("e\u0301", "y")], "\u0301", "​", "  ", "☀")
    assert transducer().longest("e\u0323\u0302x", 0) == (3, "\u1ec7")


def test_lookalike_pairs(spark):
    rows = [("a", "Tin mới", "x"), ("b", "Tin mới", None), ("c", "Tin  mоi", "x"), ("d", "Tin mới", "x"), ("a", "Tin mới", "x"), ("e", None, None), (None, "Tin mới", "x"), ("f", "", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "article_id string, title string, description string, form string, field_name int")
    found = rows_of(textforms.lookalike_pairs(df)[0])
    alike = lambda s, t: s is not None and t is not None and s != t and same_form(s) == same_form(t)
    expected = {("title", *sorted((i, j))) for i, s, _ in rows for j, t, _ in rows if i and j and i != j and alike(s, t)}
    assert set(found) == expected and len(found) == len(expected)
    assert textforms.lookalike_pairs(df.limit(0))[0].isEmpty()
    assert textforms.canonical_fields(df).columns == df.columns


def test_a_form_held_by_a_third_makes_only_its_true_pairs(spark):
    rows = [(f"k{i}", "cùng một tin" if i % 3 == 0 else f"tin {i}", None) for i in range(900)] + [("z", unicodedata.normalize("NFD", "cùng một tin"), None)]
    found = rows_of(textforms.lookalike_pairs(spark.createDataFrame(rows, "article_id string, title string, description string"))[0])
    assert len(found) == 300 and all(r[2] == "z" for r in found)


def test_visible_text():
    assert visible_text("<p>a</p><b>b</b>c &amp; d<script>x</script>") == "a bc & d"
    assert words("A-b", None, "c_d 5") == ["a", "b", "c", "d", "5"]
    assert visible_text(None) == ""
    assert len(words("x" * 200_000 + " y")) == 2


SAMPLES = pd.DataFrame(
    [
        ("vi", "Hôm nay trời mưa rất to ở nhiều nơi trong thành phố."), ("vi", "Người dân được khuyên tạm tránh khu vực này."),
        ("en", "Today it rained heavily in many places across the city."), ("en", "Residents are advised to avoid the area for now."),
        ("zh", "今天城市的许多地方下了大雨。"), (None, "x"), (" ", "y"),
    ],
    columns=["lang", "sample_text"],
)


def test_sentences():
    found = [t for _, _, t in langid.sentences("Châu Khê 1539\nShare | Print | RSS\nhttps://a.example/b\n#tin #news\n1 - 2 | 3.4\nNgười dân đi học (“Green Harbour Week”). It is raining now. 今天下了很大的雨。")]
    assert found == ["người dân đi học", "it is raining now", "今天下了很大的雨"]
    text = "Người dân đi học. It is raining now."
    assert [text[a:b] for a, b, _ in langid.sentences(text)] == ["Người dân đi học.", "It is raining now."]
    assert not list(langid.sentences(None)) and not list(langid.sentences(" \n "))


@pytest.mark.parametrize("label, code", [("vi_VN", "vi"), ("VIE", "vi"), ("zh-CN", "zh"), (" ", None), ("und", None), (None, None), ("nl", "nl")])
def test_label_code(spark, label, code):
    assert langid.label_code(label) == code
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(langid.label_code_column("lang")).head()[0] == code


def test_documents(spark):
    model = langid.fit(SAMPLES)
    assert model.languages == ["en", "vi", "zh"]
    rows = [
        (1, "Người dân được khuyên tránh xa khu vực.", "vi"), (2, "Người dân được khuyên tránh xa khu vực. Residents should avoid the whole area.", "vi"),
        (3, "Nguoi dan duoc khuyen tam tranh khu vuc nay.", None), (4, "12 - 3 | 4", "en"), (5, None, None), (6, "", "x"), (7, "Residents are advised to stay away.", "de"),
        (8, "Residents are advised to stay away. " * 3000, "EN-gb"), (9, "今天城市下了大雨。", "und"),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, segment_no string")
    segments = langid.language_segments(df, model)
    assert rows_of(langid.relabelled(segments).select("doc_id", "lang")) == [(2, "en"), (2, "vi"), (3, "vi"), (7, "en"), (9, "zh")]
    parts = {(r["doc_id"], r["segment_no"]): r for r in segments.collect()}
    text = rows[1][1]
    assert text[parts[2, 2]["start"] : parts[2, 2]["start"] + parts[2, 2]["length"]] == "Residents should avoid the whole area."
    assert parts[8, 1]["sentences"] == 3000
    assert langid.language_segments(df.limit(0), model).isEmpty()


def test_held_out_accuracy(spark):
    samples = pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet")
    model = langid.fit(samples[samples["sample_no"] % 2 == 0])
    held = samples[samples["sample_no"] % 2 == 1]
    scored = [(lang, t) for lang, s in held[["lang", "sample_text"]].itertuples(index=False) for _, _, t in langid.sentences(s)]
    best = model.confidences([t for _, t in scored]).argmax(1)
    assert sum(model.languages[b] == lang for b, (lang, _) in zip(best, scored)) >= 0.99 * len(scored)
