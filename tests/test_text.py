"""Text rules against small cases and a plain version of their definition."""

import random
import re
import zlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import timecode
from strandline.settings import Script, Settings


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}").select("k", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.k)]


def plain_error(text):
    compact = re.sub(r"\s+", "", text)
    runs = [len(m[0]) for m in re.finditer(r"(.)\1+", compact, re.S)]
    if not compact:
        return "empty"
    if max(runs, default=1) >= 12:
        return "single"
    if re.search("[A-Za-z]{4,}", compact):
        return "unexpected"
    raw = compact.encode()
    if len(compact) >= 40 and len(raw) / len(zlib.compress(raw)) > 2.8:
        return "highly"
    return "implausibly" if len(compact) > 120 else None


def test_quality_error_takes_the_first_rule(spark):
    pick = random.Random(4)
    kana = "あいうえおかきくけこさしすせそたちつてと字幕語"
    texts = ["", " 　\n", "普通の文です。", "あ" * 12, "あ" * 11, "これは test です", "a b c d です", "ab cd", "はい" * 30, "".join(pick.choices(kana, k=121)), "".join(pick.choices(kana, k=120)), "x" * 12 + "abcd"]
    texts += ["".join(pick.choices("ab 字い", k=pick.randrange(60))) for _ in range(100)]
    found = column(spark, texts, lambda c: X.quality_error(c))
    assert [f and f.split()[0] for f in found] == [plain_error(t) for t in texts]
    assert found[3] == "single character repeated 12 times" and found[5].endswith("'test'")


def test_white_space_as_python_knows_it(spark):
    spaces = [chr(k) for k in range(0x3001) if chr(k).isspace()]
    assert column(spark, [f"a{s}b" for s in spaces], X.squash) == ["ab"] * len(spaces)
    assert one(spark, " a \n　 b\t", X.collapse) == "a b" and one(spark, "　 a b\n", X.strip) == "a b"


def plain_root(text):
    c = re.sub(r"[^\w぀-ヿ一-鿿]", "", text).lower()
    return next((c[:w] for w in range(1, min(8, len(c)) + 1) if len(c) % w == 0 and c[:w] * (len(c) // w) == c), c)


def test_repetition_root(spark):
    pick = random.Random(9)
    texts = ["", "...", "はいはいはい", "はい、はい", "abcabcabc", "abcdefghi" * 2, "Aa", "aab"] + ["".join(pick.choices("ab", k=pick.randrange(1, 17))) for _ in range(200)]
    assert column(spark, texts, X.repetition_root) == [plain_root(t) for t in texts]


@pytest.mark.parametrize(
    "response,count,want",
    [
        ("[1] a\n[2] b", 2, ["a", "b"]),
        ("[1] a\n[2] b\n[2] c", 2, ["a", "c"]),
        ("[2] b\nmore\n[1] a [3]", 2, ["a [3]", "b\nmore"]),
        ("[1] a", 2, None),
        ("[1] a\n[3] c\n[2]\n", 2, None),
        ("  [1]   a  \n", 1, ["a"]),
        ("no marks", 1, None),
        ("[99999999999999999999] x\n[1] a", 1, ["a"]),
    ],
)
def test_numbered_answers(spark, response, count, want):
    from strandline.operators.models import parse_numbered

    assert one(spark, response, lambda c: X.parse_numbered(c, F.lit(count))) == want
    assert parse_numbered(response, count) == want


def test_review_reasons(spark):
    pairs = [
        ("それは", "那", ["context-sensitive fragment"]), ("これは長い文章のはずです", "短", ["unusually short", "context-sensitive fragment"]),
        ("普通の文章です", "普通的句子。", []), ("日本語", "日本語", ["unchanged source"]), ("こんにちは", "こんにちは", ["unchanged source", "Japanese script", "no Chinese script", "context-sensitive fragment"]),
        ("文章です", "（日语发音不清）", ["unclear fallback"]), ("漢字", "abc", ["no Chinese script"]), ("文文文文", "很" * 10, ["unusually long"]),
    ]
    d = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string")
    got = {r.k: r.r for r in d.select("k", X.review_reasons(F.col("a"), F.col("b")).alias("r")).collect()}
    assert [got[k] for k in range(len(pairs))] == [w for _, _, w in pairs]
    safe = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(X.replacement_is_safe(F.col("a"), F.col("b"))).first()[0]
    assert safe("日本", "日文") and not safe("日本", " 日本 ") and not safe("日本", "にほん") and not safe("日本", "abc") and not safe("x", " ")


def test_similarity_is_the_standard_librarys(spark):
    pick = random.Random(6)
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a" * 250 + "b", "b" + "a" * 250)] + [("".join(pick.choices("abc", k=20)), "".join(pick.choices("abc", k=20))) for _ in range(30)]
    d = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", X.similarity(F.col("a"), F.col("b")).alias("r"))
    got = {r.k: r.r for r in d.collect()}
    assert all(got[k] == SequenceMatcher(None, *p).ratio() for k, p in enumerate(pairs))


def test_names_and_slugs(spark):
    assert one(spark, "Ｆｏｏ ẞ.MKV", X.name_key) == "foo ss.mkv"
    assert column(spark, ["Stale Source!", "--", "a__b"], X.reason_slug) == ["stale-source", "rejected", "a-b"]


def plain_stamp(s):
    ms = max(0, round(s * 1000))
    return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"


def test_times_round_half_even_and_back(spark):
    values = [0.0, 0.0005, 0.0015, 0.0025, -3.0, 59.9995, 3599.9996, 360000.25, 1.0005] + [random.Random(k).uniform(0, 1e5) for k in range(50)]
    stamps = column(spark, values, timecode.timestamp, "double")
    assert stamps == [plain_stamp(v) for v in values]
    assert column(spark, stamps, timecode.parse_timestamp) == [max(0, round(v * 1000)) for v in values]
    assert column(spark, ["1:00:00,000", "00:75:00,000", "x", "00:00:00.000", " 00:00:01,000 ", ""], timecode.parse_timestamp) == [3600000, 4500000, None, None, 1000, None]


def test_numbers_with_defaults(spark):
    assert column(spark, ["-0.5", "x", None, ""], timecode.logprob) == [-0.5, -99.0, -99.0, -99.0]
    assert column(spark, ["0.2", None], timecode.no_speech_prob) == [0.2, 1.0]


@pytest.mark.parametrize("wrong", [{"window_overlap_seconds": 30}, {"source_chunk_overlap_seconds": 300.0}, {"foreground_confident_min_dbfs": -30.0}, {"rescue_conditional_agreement_threshold": 0.4}, {"translation_review_min_length_ratio": 0.0}, {"translation_review_enabled": 1}, {"chunk_seconds": 0}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        Settings(**wrong)


def test_settings_from_toml(tmp_path):
    from strandline.settings import load_settings

    assert load_settings(tmp_path / "none.toml") == Settings()
    f = tmp_path / "c.toml"
    f.write_text("[processing]\nchunk_seconds = 60\n[paths]\nmedia_dir = 'm'\n")
    assert load_settings(f).chunk_seconds == 60 and load_settings(f).media_dir.endswith("/m")
    f.write_text("[paths]\nmedia_dir = '../x'\n")
    with pytest.raises(ValueError):
        load_settings(f)
    assert Script(alien_run="[0-9]+") != Script()


def test_quoted_as_python_writes_it(spark):
    texts = ["plain", "it's", 'say "x"', """it's "x" """, "back\\slash", "a\nb\tc\rd", "\x00\x1f\x7f", "漢字 é", ""]
    assert column(spark, texts, X.quoted) == [repr(t) for t in texts]
