import hashlib
import html
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import fixed
from weftline.config import DEFAULT
from weftline.functions import language, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def without(t, began, ended, fits):
    """t with a space for each leftmost stretch from began to the next ended whose inside fits."""
    out, at = [], 0
    while at < len(t):
        stop = t.find(ended, at + len(began)) if t[at : at + len(began)].lower() == began else -1
        if stop >= 0 and fits(t[at + len(began) : stop]):
            out.append(" ")
            at = stop + len(ended)
        else:
            out.append(t[at])
            at += 1
    return "".join(out)


def without_addresses(t):
    """t with a space for each run that is not white space from the sign of an address on."""
    out, at = [], 0
    while at < len(t):
        sign = next((x for x in ("https://", "http://", "www.") if t.startswith(x, at)), None)
        if sign and t[at + len(sign) : at + len(sign) + 1].strip():
            out.append(" ")
            while at < len(t) and not t[at].isspace():
                at += 1
        else:
            out.append(t[at])
            at += 1
    return "".join(out)


def plain(t):
    """Cleaning as a scanner that reads character by character. Markup here is tags without comments and scripts."""
    tags = lambda x: without(x, "<", ">", bool)
    t = without_addresses(tags(unicodedata.normalize("NFKC", html.unescape(tags(t or "")))))
    note = lambda x: x.isdigit() or x.lower() == "cita requerida" or x.lower().startswith("nota ") and x[5:].isdigit()
    t = without(without(t, "[", "]", note), "(", ")", lambda x: len(x) <= 3)
    return " ".join("".join(c if c.isalnum() or c == "_" or c in ".,;:-+#/" else " " for c in t).split())


@pytest.mark.parametrize(
    "raw",
    [None, "", "<p>El <b>framework</b> Spring [1] — ver https://x.com</p>", "a &amp; b &lt;i&gt; c", "ﬁn ½ ①", "uno (1) dos (dos) [cita requerida] [NOTA 3]", "C# y C++; Node.js/React", "  mucho   espacio  "],
)
def test_clean_follows_the_rules(spark, raw):
    assert one(spark, raw, text.clean) == plain(raw)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZé1 ,.;-+#/()[]<>&\n\t½ﬁñ", max_size=40), min_size=20, max_size=40))
def test_clean_is_idempotent_and_closed(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(text.clean(F.col("t")).alias("a")).withColumn("b", text.clean(F.col("a")))
    for r in df.collect():
        assert not re.search(r"\s\s|^\s|\s$|<[^>]+>", r["a"])
        assert len(r["b"]) <= len(r["a"])


def test_hashes_and_ids(spark):
    assert one(spark, "  Hola\n MUNDO ", text.canonical_hash) == hashlib.sha256(b"hola mundo").hexdigest()
    assert one(spark, "x", text.short_id) == hashlib.sha1(b"x").hexdigest()[:16]
    assert one(spark, "x", lambda c: text.short_id(c, F.lit("own"))) == "own"


def test_shingles_and_jaccard(spark):
    assert one(spark, "A b c a B C a", text.shingles) == ["a b c", "b c a", "c a b"]
    assert one(spark, "solo dos", text.shingles) == ["solo dos"]
    assert one(spark, "", lambda c: text.jaccard(F.array(), F.array())) == 0.0
    assert one(spark, "", lambda c: text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)


def test_terms(spark):
    assert one(spark, "Usa c++ y C++ siempre", lambda c: text.without_term(c, F.lit("C++"))) == "Usa   y   siempre"
    assert one(spark, "spring boot", text.canonical_case) == "Spring Boot"
    assert one(spark, "otra", text.canonical_case) == "otra"
    assert one(spark, "a b c", lambda c: text.ngrams(F.split(c, " "), 1, 3)) == ["a", "b", "c", "a b", "b c", "a b c"]


@pytest.mark.parametrize(("t", "code"), [("Este es un texto de la casa y el perro", "es"), ("This is the house and it was big", "en"), ("de la que", "und"), (None, "und"), ("xx zz ww vv uu tt", "und")])
def test_language_rule(spark, t, code):
    assert one(spark, t, language.detect)["code"] == code


def test_language_ratio_must_exceed_the_limit(spark):
    assert one(spark, "de " + "zz " * 19, language.detect)["code"] == "und"
    assert one(spark, "de " + "zz " * 18, language.detect)["code"] == "es"


def test_dictionary_and_fingerprint():
    assert len(fixed.TECHNOLOGIES) == 157 and len(fixed.EXTRA_STOP_WORDS) == 34
    assert all(len(w) == 33 for w in fixed.LANGUAGE_WORDS.values())
    assert len(DEFAULT.fingerprint()) == 64
