import pytest

from koengine.api import Session, bind
from koengine.functions.checks import Lit, Op, Prop, parse_check, violates
from koengine.lang import diagnostics as d, logical as lp
from koengine.lang.json_frontend import parse_json
from koengine.lang.parser import parse


def test_and_binds_tighter_than_or():
    p = parse('MATCH T WHERE a == 1 OR b == "x" AND c != null RETURN *')
    assert p.operators[1] == lp.Filter(lp.Either(lp.Compare("a", "==", 1.0), lp.Both(lp.Compare("b", "==", "x"), lp.Compare("c", "!=", None))))


def test_parentheses_comments_and_case():
    p = parse("match T // all of them\nwhere (a > 1 or b < 2) and c >= 3 return f, g")
    assert isinstance(p.operators[1].predicate, lp.Both) and isinstance(p.operators[1].predicate.left, lp.Either)
    assert p.operators[-1] == lp.Project(("f", "g"))


def test_search_and_traverse():
    p = parse('MATCH T SIMILAR TO "sun" SCORE BM25 USING EMBEDDING TRAVERSE knows DEPTH 2 RETURN *')
    kinds = [type(o).__name__ for o in p.operators]
    assert kinds == ["Scan", "VectorSearch", "TextSearch", "Fuse", "Traverse", "Project"]


def test_filters_come_before_searches():
    p = parse('MATCH T SIMILAR TO "sun" WHERE a == 1 RETURN *')
    assert [type(o).__name__ for o in p.operators] == ["Scan", "Filter", "TextSearch", "Project"]


@pytest.mark.parametrize(
    "source, error",
    [
        ("MATCH T WHERE a == 1", d.MissingReturn), ("MATCH T WHERE a = 1 RETURN *", d.UnexpectedToken), ('MATCH T WHERE a == "x RETURN *', d.UnterminatedString),
        ("MATCH T WHERE a == # RETURN *", d.UnexpectedCharacter), ("FIND T", d.UnexpectedToken), ("MATCH", d.UnexpectedEnd), ("MATCH T WHERE a == foo RETURN *", d.BadLiteral), ("INGEST x", d.UnsupportedStatement),
    ],
)
def test_errors(source, error):
    with pytest.raises(error):
        parse(source)


def test_error_place():
    with pytest.raises(d.UnexpectedToken) as e:
        parse("MATCH T\nWHERE a = 1 RETURN *")
    assert (e.value.line, e.value.column) == (2, 9)


def test_json():
    p = parse_json('{"scan": {"type": "T"}, "filter": {"a": 1, "b": "x"}, "search": {"text": "sun"}}')
    assert p.operators[2] == lp.TextSearch("sun", 5)
    with pytest.raises(d.UnexpectedToken):
        parse_json({"scan": "T", "order": 1})
    with pytest.raises(d.BadLiteral):
        parse_json({"scan": "T", "filter": {"a": [1]}})
    with pytest.raises(d.InvalidPlan):
        parse_json({"scan": "T", "fuse": {}})


def test_bind_never_breaks_out():
    assert bind("a == {{x}}", {"x": "y"}) == 'a == "y"'
    with pytest.raises(ValueError):
        bind("a == {{x}}", {"x": 'y" OR b == "z'})


def test_session(spark, data):
    s = Session(spark, data)
    s.register = s.registry.register
    s.registry.register("fact", spark.createDataFrame([("1", "fact", 1, 35, None), ("2", "fact", 1, 20, "x"), ("3", "fact", 1, 10, None)], "koid string, type_name string, version long, temp int, note string"))
    q = lambda w: sorted(r["koid"] for r in s.query(f"MATCH fact WHERE {w} RETURN *").collect())
    assert q("temp == 35") == ["1"] and q("temp > 20") == ["1"] and q("temp >= 20") == ["1", "2"] and q("temp < 20") == ["3"]
    assert q('note != "x"') == ["1", "3"] and q("note == null") == ["1", "3"] and q('nothing != "x"') == ["1", "2", "3"] and q('nothing == "x"') == []
    assert q('temp == "35"') == []
    assert s.query("MATCH fact RETURN explain").count() == 2
    with pytest.raises(d.UnknownType):
        s.query("MATCH Nowhere RETURN *")
    assert s.query("UPDATE fact SET temp = 1 WHERE temp > 30").where("version = 2 AND temp = 1").count() == 1
    assert s.query("DELETE fact WHERE temp == 20").count() == 2
    assert s.query('CREATE fact {temp: 7, note: "new"}').count() == 3
    s.deploy("warm", "MATCH fact WHERE temp > {{least}} RETURN temp")
    assert s.execute("warm", least=5).count() == 2


def test_filter_reaches_the_scan(spark, data, capsys):
    df = Session(spark, data).query('MATCH orders WHERE o_orderstatus == "F" RETURN o_orderkey')
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_checks(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (5, None), (None, None)], "a int, b int")
    got = lambda e: [r[0] for r in df.select(violates(e)).collect()]
    assert got(parse_check("a < 3 and b == 2")) == [False, True, True, True]
    # a false left side ends AND, a true one ends OR, even if the right side is missing
    assert got(Op("not", (Op("and", (Op("==", (Lit(1), Lit(2))), Op("==", (Prop("a"), Lit(1))))),))) == [False] * 4
    assert got(parse_check("1 == 1 or a == 1")) == [False] * 4
    assert got(Op(">", (Op("/", (Prop("b"), Lit(0))), Lit(1)))) == [True] * 4
    with pytest.raises(ValueError):
        parse_check("a == ")
