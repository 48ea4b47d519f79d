"""Build-side operators on small inputs of their own."""

import pytest
from pyspark.sql import functions as F

from quillforge.functions import grammar, scanner, script
from quillforge.functions import text as X
from quillforge.operators import lookups, rules
from quillforge.sources import assets


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


CSS = [
    ("h1 , .k > i{ padding : 0 2px ; top:1px ! important }", "h1,.k>i{padding:0 2px;top:1px!important}", []),
    ("@media tv and ( height : 9px ) { q { left : 0 } }", "@media tv and (height:9px){q{left:0}}", []),
    ("u{width:calc( 9px + 2px * 4 );m:f( 1 , 2 )}", "u{width:calc(9px + 2px*4);m:f(1,2)}", []),
    ("u{b}v{d:e}", "u{}v{d:e}", [(1, 3, "not a declaration")]),
    ("}\nu{b:c", "u{b:c}", [(1, 1, "brace without a block"), (2, 2, "block without an end")]),
    ("u[k ~= 'v'] + i{e:%tok%}", "u[k~='v']+i{e:%tok%}", []),
    ("@-wg-dpi 3;u{b:'x", "u{}", None),
    ("/* open", "", [(1, 1, "comment without an end")]),
]


@pytest.mark.parametrize("text,expected,errors", CSS)
def test_grammar(text, expected, errors):
    sheet = grammar.parse(text)
    assert grammar.printed(sheet.items) == expected
    if errors is not None:
        assert [(e.line, e.column, e.message) for e in sheet.errors] == errors
        assert grammar.printed(grammar.parse(expected).items) == expected


def test_visitors():
    sheet = grammar.parse("a,b{x:1;y:2}@media tv{b{x:1}}c{}")
    out = grammar.rewritten(sheet, grammar.WithoutSelectors(["b"]), grammar.WithoutText("y:"), grammar.WithoutEmpty())
    assert grammar.printed(out.items) == "a{x:1}"


JS = [
    ("function f ( left , right ) { var sum = left + right ; return sum }", "function f(n,t){var i=n+t;return i}"),
    ("a = b / c ; d = /x[/]y/g . test( e )", "a=b/c;d=/x[/]y/g.test(e)"),
    ("x = 'a' + + b - - c", "x='a'+ +b- -c"),
    ("if (a) {\n b()\n c() }", "if(a){b()\nc()}"),
    ("(function(x){ var o = { x : x } ; return function(y){ return y + x + o.x } })", "(function(n){var t={x:n};return function(i){return i+n+t.x}})"),
    ("function g(n1){ return eval('n1') }", "function g(n1){return eval('n1')}"),
    ("x = 6 * 7; y = 5 - 7; z = 010 + 1", "x=42;y=5-7;z=010+1"),
    ("for (;;) ;", "for(;;);"),
    ("\"abc", None),
    ("(]", None),
]


@pytest.mark.parametrize("text,expected", JS)
def test_scripts(text, expected):
    assert scanner.minified(text) == expected
    if expected is not None:
        assert scanner.minified(expected) == expected


def test_script_values(spark):
    long = '{"k":"' + "x y" * 20000 + '"}'
    assert one(spark, script.json_text(F.lit(long.replace(":", " : ", 1)))) == long
    assert one(spark, script.quoted(F.lit("a\x01\u2028'"))) == '"a\\x01\\u2028\'"'
    assert one(spark, script.fold("<", F.lit(1), F.lit(2))) is True


def test_text_functions(spark):
    assert one(spark, X.shortest_colour(F.lit("#FF0000"))) == "red" and one(spark, X.colour_of(F.lit("Teal"))) == "#008080"
    assert len(X.NAMED) == 147 and one(spark, X.decode_escapes(F.lit(r"\26 b\1F600"))) == "&b\U0001F600"
    assert one(spark, X.relative_to(F.lit("a/b/c.png"), F.lit("a/d/e/f.css"))) == "../../b/c.png"
    assert one(spark, X.full_path(F.lit("/R"), F.lit("../X/./y"))) == "/x/y"


DECLS = "sheet long, media string, rule long, selector string, decl long, property string, value string, important boolean"


def test_segments_do_not_cross_a_conflict(spark):
    rows = [(1, None, 1, "a", 1, "p", "1", False), (1, None, 2, "b", 1, "p", "2", False), (1, None, 3, "a", 1, "q", "3", False), (1, None, 4, "a", 1, "q", "4", False)]
    d = spark.createDataFrame(rows, DECLS)
    assert [r.may_collapse for r in rules.collapse_guard(d).orderBy("rule").collect()] == [False, True]
    got = sorted((r.rule, r.selector, r.property, r.value) for r in rules.merge_segments(d).collect())
    assert got == [(1, "a", "p", "1"), (2, "b", "p", "2"), (4, "a", "q", "4")]


def test_shared_declarations_move(spark):
    rows = [(1, None, r, s, i, *d, False) for r, s, ds in ((1, "a", [("p", "1"), ("q", "2"), ("r", "3")]), (2, "b", [("p", "1"), ("q", "2"), ("s", "4")]), (3, "c", [("z", "9")])) for i, d in enumerate(ds)]
    got = [(r.selector, r.property) for r in rules.share_declarations(spark.createDataFrame(rows, DECLS)).orderBy("rule", "decl").collect()]
    assert got == [("a", "r"), ("a,b", "p"), ("a,b", "q"), ("b", "s"), ("c", "z")]


def test_raising(spark):
    rows, log = spark.createDataFrame([("x", "1"), ("y", "2")], "s string, t string"), spark.createDataFrame([("x", "9")], "s string, t string")
    with pytest.raises(Exception, match="renamed elsewhere"):
        lookups.unlogged(rows, log, "s", "t").collect()
    assert [r.s for r in lookups.unlogged(rows, log, "s", "t", skip=True).collect()] == ["y"]
    with pytest.raises(Exception, match="nothing found"):
        lookups.lookup(rows.select("s"), log, "s", "t", must=True).collect()
    with pytest.raises(Exception, match="selector hack"):
        rules.check_hacks(rows, "s", ["y"]).collect()


def test_configurations_and_named_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text("<C><Settings><Minify>true</Minify><Dpi> 2 </Dpi></Settings><ConfigSource>sub/b.xml</ConfigSource></C>")
    (tmp_path / "sub" / "b.xml").write_text("<C><ConfigSource>../a.xml</ConfigSource></C>")
    got = sorted((r.name, r.value) for r in assets.read_settings(spark, str(tmp_path / "a.xml")).collect())
    assert got == [("Dpi", "2"), ("Minify", "true")]
    assert [f.rsplit("/", 1)[1] for f in assets.config_files(spark, f"file://{tmp_path}/a.xml", 5)][:2] == ["a.xml", "b.xml"]
    rows = spark.createDataFrame([("x.css", "a{}"), ("y.css", None)], "n string, c string")
    assert assets.write_named(rows, str(tmp_path / "out"), "n", "c") == 2
    assert assets.write_named(rows.unionByName(spark.createDataFrame([("z.css", "b")], "n string, c string")), str(tmp_path / "out"), "n", "c") == 1
