from pyspark.sql import functions as F

from quillforge.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers(spark):
    for text, expected in [("001.2400px", "1.24px"), ("0.50", ".5"), ("0px", "0"), ("0s", "0s"), ("-0.5em", "-.5em"), ("abc", "abc"), ("10", "10")]:
        assert one(spark, S.trim_number(F.lit(text))) == expected


def test_urls_and_paths(spark):
    for text, expected in [("'hash(a\\B.png)'", "a/b.png"), ("hash://X/y", "x/y"), ("/A", "a")]:
        assert one(spark, S.normalize_url(F.lit(text))) == expected
    assert one(spark, S.change_extension(F.lit("a/b.scss"), "css")) == "a/b.css"
    assert one(spark, S.path_template("{locale}/{output}", {"locale": F.lit("EN")}, F.lit("x.css"))) == "en/x.css"


def test_parsing(spark):
    assert [one(spark, S.parse_bool(F.lit(x))) for x in ("false", "TRUE", "what", None)] == [False, True, True, True]
    assert [one(spark, S.parse_int(F.lit(x))) for x in (" 7 ", "x", None)] == [7, 0, 0]
    assert one(spark, S.split_list(F.lit("a; ;b "))) == ["a", "b"]
    assert [one(spark, S.dpi_name(F.lit(x))) for x in (1.5, 2.0)] == ["Resolution15X", "Resolution2X"]
    assert one(spark, S.vendor_prefix(F.lit("-moz-x"))) == "-moz-"


def test_tokens(spark):
    values = F.create_map(F.lit("a"), F.lit("%b%"), F.lit("b"), F.lit("1"))
    assert one(spark, S.expand_tokens(F.lit("%A% %c% %b:x%"), values)) == "%b% %c% 1"
    assert one(spark, S.expand_tokens_deep(F.lit("%a%"), values)) == "1"
