import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import tokenize as N
from weftline.functions.dictionary import Terms, dictionary_of, read_dictionary, tokenize_with


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "s string").select(make(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [("WXYZ^", "WXYZ^"), ("`1{", ""), ("`a{", "`{"), ("　 佛 a\n", "佛"), ("<b>佛</b>¶言", "佛言"), ("", ""), (None, None), ("佛~BREAK~言", "佛言")])
def test_clean(spark, raw, want):
    assert one(spark, raw, lambda S: T.clean(S)) == want


def test_clean_options(spark):
    assert one(spark, "佛，言。", lambda S: T.clean(S, keep_punctuation=True)) == "佛，言。"
    assert one(spark, "佛\n\n言\n說", lambda S: T.clean(S, whitespace=False, keep_paragraphs=True)) == "佛\n言說"
    assert one(spark, "佛x言", lambda S: T.clean(S, other=("x言",))) == "佛"


def test_strip_query_keeps_ascii_colon_and_nbsp(spark):
    assert one(spark, "佛：。 言: ,", lambda S: T.strip_query(S)) == "佛言: ,"


def test_target_tokens(spark):
    assert one(spark, "བདག་ གིས་  ཐོས་", lambda S: T.target_tokens(S)) == ["བདག", "གིས", "ཐོས"]


@pytest.mark.parametrize("term,text,want", [("aa", "aaaa", [0, 1, 2]), ("b", "aaaa", None), ("a.", "aaxa.", [3]), ("x", "", None), ("\\E", "a\\E\\E", [1, 3]), ("a", "ab" * 700, list(range(0, 1400, 2))), ("aa", "a" * 600, list(range(599)))])
def test_find_all(spark, term, text, want):
    assert one(spark, text, lambda S: T.find_all(F.lit(term), S)) == want


def test_category_and_stars(spark):
    assert [one(spark, x, lambda S: T.category(S)) for x in ("三", "西北", "冬", "馬", "佛")] == ["number", "direction", "season", "animal", "other"]
    assert one(spark, "a b c d", lambda S: T.with_stars(F.split(S, " "), F.lit(1), F.lit(2))) == ["a", "***", "b", "c", "***", "d"]
    assert one(spark, "a b", lambda S: T.with_stars(F.split(S, " "), F.lit(1), F.lit(5))) == ["a", "***", "b", "***"]


def test_remove_repeatedly(spark):
    assert one(spark, "a--b", lambda S: T.remove_repeatedly(S, "-")) == "a  b"
    assert one(spark, "a  xxb", lambda S: T.remove_repeatedly(S, " x")) == "a  b"
    with pytest.raises(ValueError):
        T.remove_repeatedly(F.col("s"), " ")


def test_dictionary(spark):
    cut = N.dictionary(["如是", "如是我", "[佛]", "a.b", ""])
    assert one(spark, "如是我聞佛言a.bacb", lambda S: cut(S)) == ["如是我", "聞", "佛", "言", "a.b", "a", "c", "b"]
    assert one(spark, "", lambda S: cut(S)) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé佛", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abé佛x", max_size=14))
def test_terms_cut_as_the_longest_first(terms, text):
    want, at = [], 0
    while at < len(text):
        n = max([len(t) for t in terms if text.startswith(t, at)], default=1)
        want.append(text[at : at + n])
        at += n
    assert list(Terms(pa.array(sorted(set(terms)))).cut(text)) == want


def test_large_dictionary_does_not_pass_the_driver(spark, tmp_path):
    spark.range(60_000).selectExpr("concat('t', lpad(conv(id, 10, 36), 5, '0')) as value").write.text(str(tmp_path / "terms"))
    held = read_dictionary(spark, str(tmp_path / "terms"))
    df = spark.createDataFrame([("t00000t0000Zx[t00010",), ("",), (None,)], "s string")
    assert [r.tokens for r in tokenize_with(df, "s", held).collect()] == [["t00000", "t0000Z", "x", "[", "t00010"], [], None]
    assert held.count() == 60_000 and dictionary_of(held.where("false")).count() == 0
    assert tokenize_with(df, "s", dictionary_of(held.where("false"))).first().tokens == list("t00000t0000Zx[t00010")


def test_dictionary_agrees_with_pattern(spark):
    terms = ["如是", "如是我", "佛", "言佛"]
    df = spark.createDataFrame([("如是我聞佛言佛如",), ("",), (None,)], "s string")
    got = tokenize_with(df, "s", dictionary_of(spark.createDataFrame([(t,) for t in terms], "term string"))).select("tokens", N.dictionary(terms)(F.col("s")).alias("want")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_sentences_of_words(spark):
    assert one(spark, "如是。我，聞\n\n佛", lambda S: N.sentences_of_words(S, ["如是"])) == [["如是"], ["我", "聞"], ["佛"]]


def test_characters_are_code_points(spark):
    assert one(spark, "a\U00020000b", lambda S: N.characters(S)) == ["a", "\U00020000", "b"]


def test_segmenter_takes_what_follows_the_last_word(spark):
    pairs = lambda c: F.regexp_extract_all(c, F.lit("(?s)(..?)"), F.lit(1))
    make = lambda S: N.sentences_of_words(S, ["如是"], pairs)
    assert one(spark, "我聞如是佛言說，我", make) == [["我", "聞", "如是", "佛言", "說", "我"]]
    assert one(spark, "如是。我", lambda S: N.as_string(N.sentences_of_words(S, ["如是"]), " / ")) == "如是 / 我"


def test_reparsed_and_gloss(spark):
    assert one(spark, "a,bc,d", lambda S: N.reparsed(F.split(S, ","), ["ab", "cd"])) == ["ab", "cd"]
    both = lambda x, y: [one(spark, x, lambda S: T.gloss(S, F.lit(y), {"狗": "dog", "rta": "horse"})[k]) for k in (0, 1)]
    assert both("狗", "khyi") == ["狗dog", "khyidog"] and both("狗", "rta") == ["狗dog", "rtahorse"] and both("佛", "rta") == ["", ""]


def test_dictionaries_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([("如是我聞佛言佛如",)], "s string")
    want = N.with_words(df, "s", ["如是", "言佛"]).first()["tokens"]
    monkeypatch.setattr(N, "REGEX_TERMS", 1)
    assert N.with_words(df, "s", ["如是", "言佛"]).first()["tokens"] == want
