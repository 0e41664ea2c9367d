import pytest

from specmill.formula.evaluate import evaluate, letters, resolve, resolve_hyperlinks
from specmill.formula.syntax import parse, references, split_top

CELLS = {(None, "A", 1): "Door#12", (None, "B", 1): "x", ("Other", "D", 3): "far"}


def value(formula, row=1):
    return evaluate(parse(formula), lambda s, c, r: CELLS.get((s, c, r), ""), row)


@pytest.mark.parametrize(
    ("formula", "expected"),
    [
        ('"a""b"', 'a"b'), ('"a" & "b"', "ab"), ("2.0", "2"), ("2.5", "2.5"), ("$A1", "Door#12"), ("$A", "Door#12"), ("Other!$D$3", "far"), ("Other!D3:D9", ""),
        ('MID($A1,FIND("#",$A1),3)', "#12"), ('STRINGA.ESTRAI("abcdef";0;2)', "ab"), ('MID("abc","x",1)', ""), ('MID("abc",1)', ""), ('FIND("z","abc")', ""),
        ('FIND("b","abcb",3)', "4"), ('LEFT("abc")', "a"), ('LEFT("abc",-1)', ""), ('RIGHT("abc",0)', ""), ('RIGHT("abc",2)', "bc"), ("LEN()", "0"), ('LEN("abc")', "3"),
        ('UPPER("a")', "A"), ('MINUSC("A")', "a"), ('TRIM("  a  b ")', "a  b"), ('SUBSTITUTE("aXbX","X","-",1)', "a-b-"), ('SUBSTITUTE("a","b")', "a"),
        ("ADDRESS(3,28,4)", "$AB$3"), ('IFERROR("a","b")', "a"), ('IF("c","x","y")', "c"), ('CONCATENATE("a",1,"b")', "a1b"), ('HYPERLINK("u","t")', "u"),
        ("MATCH(1,2)", ""), ("AND(1,1)", ""), ("NOSUCH(1)", ""), ('("a")', "a"), ("1+2", "1+2"), ("", ""), ('UPPER(LEFT("ab;c",3))', "AB;"),
    ],
)
def test_evaluate(formula, expected):
    assert value(formula) == expected


def test_splitting_and_references():
    assert split_top('a,"b,c",f(d,e),', ",;") == ["a", '"b,c"', "f(d,e)"]
    assert references(parse('A1&F($B,Other!C3)'), 7) == {(None, "A", 1), (None, "B", 7), ("Other", "C", 3)}
    assert [letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_resolve_order():
    cell = lambda *_: ""
    assert resolve("=1", "v", "http://x", cell, 1) == ("http://x", "v")
    assert resolve('=HYPERLINK("u","t")', "v", None, cell, 1) == ("u", "t")
    assert resolve('=UPPER("u")', "v", None, cell, 1) == ("U", "v")
    assert resolve(None, " t ", None, cell, 1) == (None, "t")
    assert resolve(None, None, None, cell, 1) == (None, None)


def test_tables(spark):
    schema = "sheet string, row int, col int, value string, formula string, hyperlink string"
    rows = [("S", 1, 1, "Door", None, None), ("S", 1, 2, None, '=HYPERLINK("h/"&$A&other!$A$2,"t")', None), ("Other", 2, 1, "x", None, None), ("Other", 3, 1, "y", "=A2", None), ("S", 2, 1, None, "=Other!A3", None)]
    got = {(r["sheet"], r["row"], r["col"]): (r["url"], r["title"]) for r in resolve_hyperlinks(spark.createDataFrame(rows, schema)).collect()}
    assert got[("S", 1, 2)] == ("h/Doorx", "t") and got[("S", 2, 1)] == (None, None) and got[("S", 1, 1)] == (None, "Door")
    assert resolve_hyperlinks(spark.createDataFrame([], schema)).count() == 0
