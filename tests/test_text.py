"""Scalar functions on handmade rows, held against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import chat as C
from quillspark.functions import codes as K
from quillspark.functions import text as T
from quillspark.operators import filters


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean(spark):
    assert column(spark, [None, "", "a  b\t\nc ", " x "], T.clean) == ["", "", "a b c", "x"]


def test_clean_message(spark):
    found = column(spark, ["a" * 2000, "a" * 2001, "a" * 1999 + " b", "x {| y", None], T.clean_message)
    assert found == ["a" * 2000, "a" * 2000, "a" * 1999, "", ""]


def test_clean_qa(spark):
    assert column(spark, ["a || b {{x}} c <ref n>y</ref> <b>d", "a | b", None], T.clean_qa) == ["a b c d", "a | b", ""]


def test_sentences(spark):
    assert column(spark, ["One. Two!  Three? four", "", "3.5 is one."], lambda c: T.sentences(T.clean(c))) == [["One.", "Two!", "Three?", "four"], [], ["3.5 is one."]]
    assert column(spark, ["One. Two.", "", None], T.first_sentence) == ["One.", "", ""]


def test_first_dot(spark):
    assert column(spark, [".x", "3.5 m", "none", "a. b", None, "a" * 230 + ".b"], T.first_dot) == ["", "3.", "none", "a.", "", "a" * 220]


def test_paragraphs(spark):
    assert column(spark, ["\n\n a \n b\n\n\n c\r\nd\n \ne", "", None, " \n "], T.paragraphs) == [["a b", "c d", "e"], [], [], []]


@pytest.mark.parametrize(
    ("text", "reason"),
    [("x {{y}} and some more words", "markup"), ("| a | b | c | and more words here", "pipe_eq"), ("a=b=c=d=e=f=g= and more words", "pipe_eq"), ("a" * 24, "short"), ("a" * 25, None), ("a" * 65 + "#" * 35, None), ("a" * 64 + "#" * 36, "symbol_ratio")],
)
def test_paragraph_reasons(spark, text, reason):
    assert column(spark, [text], filters.paragraph_reason) == [reason]


def test_answer_reasons(spark):
    rows = [("q", "####"), ("q", "abcd"), ("q", "abcde"), ("q", "a" * 220), ("q", "a" * 221), ("", "abcde"), ("q", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, a string")
    found = [r.x for r in df.select("i", filters.answer_reason(F.col("q"), F.col("a")).alias("x")).orderBy("i").collect()]
    assert found == ["symbol_ratio", "too_short", None, None, "too_long", "missing_fields", "missing_fields"]


def test_clean_target(spark):
    assert column(spark, ["|abcdef", "abc\n|def", "CLASS=abc", "abcd ", "abcde", None], filters.clean_target) == [False, True, False, False, True, False]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aZ9 \t.#é日_|"), max_size=12), min_size=1, max_size=6))
def test_symbol_ratio(spark, texts):
    def plain(t):
        chars = [c for c in t if not c.isspace()]
        return sum(not c.isalnum() for c in chars) / len(chars) if chars else 1.0

    assert column(spark, texts, T.symbol_ratio) == pytest.approx([plain(t) for t in texts])


def test_control_tokens(spark):
    assert column(spark, ["<c0_12> a", "c0_12 b", "c0=12", "abc0_1"], T.strip_control) == ["a", "b", "c0=12", "abc0_1"]


def test_roles(spark):
    roles = ["human", "GPT", "tool call", "", None, " system "]
    assert column(spark, roles, C.role_export) == ["User", "Assistant", "Tool call", "Unknown", "Unknown", " system "]
    assert column(spark, roles, C.role_pull) == ["user", "assistant", "tool call", "user", "user", "system"]
    assert column(spark, roles, C.role_instruct) == ["Human", "Gpt", "Tool call", "Unknown", "Unknown", "System"]
    assert column(spark, roles, lambda c: C.role_instruct(c, "User"))[3:5] == ["User", "User"]


def test_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    values = [[("user", " a "), ("gpt", "b")], [("user", ""), ("gpt", "b")], [("user", "x {| y")], []]
    assert column(spark, values, C.format_messages, kind) == ["User: a\nAssistant: b", "Assistant: b", "User: x {| y", ""]
    found = column(spark, values, C.normalize_messages, kind)
    assert [[(m.role, m.content) for m in x] if x else None for x in found] == [[("user", "a"), ("assistant", "b")], None, None, None]


def test_message_keys(spark):
    df = spark.createDataFrame([(("", "human", None, None, "v", "t"),)], "m struct<role:string,`from`:string,speaker:string,content:string,value:string,text:string>")
    assert tuple(df.select(C.message(F.col("m")).alias("x")).first().x) == ("human", "v")


def test_codes(spark):
    assert column(spark, [[5, 12], [1234, 0]], K.codes_to_text, "array<int>") == ["c0=5 c1=12", "c0=1234 c1=0"]
    assert column(spark, [[5, 12], [1234, 0]], lambda c: K.codes_to_special(c, 256), "array<int>") == ["<c0_005> <c1_012>", "<c0_1234> <c1_000>"]
    assert column(spark, [[5]], lambda c: K.codes_to_special(c, 1024), "array<int>") == ["<c0_0005>"]
    assert column(spark, ["c0=1 junk c1=x c2=3", "", None], K.parse_codes) == [[1, 3], [], []]
    assert K.code_tokens(spark, 2, 3).count() == 6
    with pytest.raises(ValueError):
        K.format_prompt(F.lit("x"), F.array(F.lit(1)), "other")


def test_split_is_crc(spark):
    import zlib

    keys = [str(i) for i in range(300)]
    for fraction in (0.0, 0.05, 0.5, 1.0):
        want = [fraction >= 1 or zlib.crc32(f"7|{k}".encode()) < int(fraction * 2**32) and fraction > 0 for k in keys]
        assert column(spark, keys, lambda c, f=fraction: K.is_val(c, f, 7)) == want


def test_first_id_and_pad(spark):
    df = spark.createDataFrame([(0, "", "x"), (5, "a", "x"), (None, None, "0")], "a int, b string, c string")
    assert [r.x for r in df.select(K.first_id(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == ["x", "5", "0"]
    assert column(spark, [["a", "b"], list("abcdefgh"), []], lambda c: K.pad_left(c), "array<string>") == [list("aaaaab"), list("cdefgh"), None]


def test_target_regex_matches_python():
    assert re.search(T.CONTROL_TARGET, "<c0_0001>") and not re.search(T.CONTROL_TARGET, "<c0_001")


def test_few_texts_are_searched_by_slow_patterns(spark):
    white = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000"
    texts = ["", "a", *white, *[f"{w}a b{w}" for w in white], *[f"a{w}" for w in white], "<REF x", "Align=", "a=b-c <x", "DATA-SORT-VALUE", "[[", "[ [", "é²Ⅷ_日!", "\xa0!\u2003é", "a-b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    old = [F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.coalesce("t", F.lit("")).rlike("(?i)" + "|".join(re.escape(m) for m in T.MARKUP))]
    seen, symbols = (F.length(F.regexp_replace(F.coalesce("t", F.lit("")), rf"(?U)[\s\x1c-\x1f{more}]", "")) for more in ("", r"\p{L}\p{N}"))
    old.append(F.when(seen == 0, 1.0).otherwise(symbols / seen))
    t = F.col("t")
    for r in df.select(F.array(*[F.to_json(F.struct(c)) for c in (x.alias("x") for x in old)]).alias("old"), F.array(*[F.to_json(F.struct(c)) for c in (x.alias("x") for x in (T.strip(t), T.has_markup(t), T.symbol_ratio(t)))]).alias("new"), "t").collect():
        assert r.old == r.new, repr(r.t)
    plan = df.select(T.symbol_ratio(t).alias("x"), T.has_markup(t).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?U)") == 2 and "Contains" in plan or "contains" in plan
