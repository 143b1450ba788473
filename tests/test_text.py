import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("  a\r\n\tb  c ", "a\nb c"),
        ("a\xa0 b", "a b"),
        ("wait......", "wait..."),
        ("a\n------\nb", "a\n---\nb"),
        ("a\n- - - - - -\nb", "a\nb"),
        ("a\n=-=-=-\nb", "a\nb"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("  x \x1f", "x"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, T.normalize(F.col("t")), t=raw) == clean


def test_html(spark):
    assert one(spark, T.html_to_text(F.col("t")), t="<p>a&nbsp;&amp;lt;</p><script>x</script>  <b>b</b>") == "a < b"


def test_tokens_are_ascii(spark):
    assert one(spark, T.tokenize(F.col("t")), t="Naïve X_1, ok") == ["na", "ve", "x_1", "ok"]


def test_phrase_and_think(spark):
    assert one(spark, T.has_phrase(F.col("t"), F.col("q")), t="The End", q=" the e ")
    assert not one(spark, T.has_phrase(F.col("t"), F.col("q")), t="The End", q="  ")
    assert one(spark, T.strip_think(F.col("t")), t="a<|think|>b<|endofthink|>c<|think|>d") == "ac"


@pytest.mark.parametrize(
    ("answer", "verdict", "categories"),
    [("safe", "safe", []), ("\n <|x|>\nUnsafe\nS1, S9", "unsafe", ["S1", "S9"]), ("unsafe", "unsafe", []), ("", "unsafe", []), (None, "unsafe", []), ("maybe", "unsafe", [])],
)
def test_guard(spark, answer, verdict, categories):
    got = one(spark, T.guard_verdict(F.col("t")), t=answer)
    assert (got.verdict, got.categories) == (verdict, categories)


def test_estimates(spark):
    assert one(spark, T.estimate_tokens(F.col("t")), t="a b\xa0c d") == 5
    assert one(spark, T.estimate_tokens(F.col("t")), t=None) == 1
    assert one(spark, T.message_tokens(F.col("t")), t="abcdefgh") == 2


def test_first_text_and_paths(spark):
    assert one(spark, T.first_text(F.col("t"), F.col("u")), t="", u="x") == ""
    assert one(spark, T.first_text(F.col("t"), F.col("u"), F.col("v")), t=None, u=" ", v=" x ") == " x "
    assert one(spark, T.suffix(F.col("t")), t="a.b/c.D") == ".d"
    assert one(spark, T.stem(F.col("t")), t="a.b/c.d.e") == "c.d"
    assert one(spark, T.is_image(F.col("t")), t="x.PNG")


def test_template(spark):
    form = T.Template("{a} and {b}{a}")
    assert form.fields == ["a", "b", "a"]
    assert one(spark, form.render({"a": F.col("t"), "b": F.lit(2)}), t="x") == "x and 2x"
    with pytest.raises(KeyError):
        form.render({"a": F.lit(1)})
