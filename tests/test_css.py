import pytest

from quillforge.functions import css

CASES = [
    (".a { color : #AABBCC ; }", ".a{color:#abc}"),
    ("p{padding:0.0em 00.0px 0.70% 0%}", "p{padding:0 0 .7% 0}"),
    ("p{transition:0s}", "p{transition:0s}"),
    ("p{color:#112234}", "p{color:#112234}"),
    ("p{color:rgb(255,204,119)}", "p{color:#fc7}"),
    ("p{color:rgb(100,200,300)}", "p{color:rgb(100,200,300)}"),
    ("p{color:hsla(0120,0.300,00.0,0.4)}", "p{color:hsla(120,.3,0,.4)}"),
    ("a > b , c{x:y ! important}", "a>b,c{x:y!important}"),
    ("@media screen , print { a { b : c } }", "@media screen,print{a{b:c}}"),
    ("a{b:c;b:d}", "a{b:d}"),
    ("a{b:c !important;b:d}", "a{b:c!important}"),
    ("a{display:-ms-grid;display:block}", "a{display:-ms-grid;display:block}"),
    ("a{}", ""),
    ("@import 'x';", "@import 'x';"),
    ("@-wg-dpi 2;", ""),
    ("a{b:url( x.png )}", "a{b:url( x.png )}"),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_minified(text, expected):
    assert css.minified(text) == expected
    assert css.minified(expected) == expected


def test_verbatim_without_optimiser():
    assert css.minified("p{a:.20%;b:+17px;c:#ddccaa}", optimise=False) == "p{a:.20%;b:+17px;c:#ddccaa}"
    assert css.minified("@media screen{}", optimise=False) == "@media screen{}"


def test_pretty():
    assert css.minified("a{b:c;d:e}", optimise=False, pretty=True) == "a\r\n{\r\n  b:c;\r\n  d:e\r\n}\r\n"


@pytest.mark.parametrize("text", ["a{b:c", "a}b", "{b:c}", "a{b}"])
def test_errors(text):
    assert css.minified(text) is None


def test_null():
    assert css.minified(None) is None
