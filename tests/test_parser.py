import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facet.lang import ParseError, parse, parse_expression


def one(text):
    return parse(text)[0]


def test_precedence():
    e = parse_expression("1 + 2 * 3 = 7 AND NOT a ?? b OR c")
    assert e.kind == "coalesce" and e.right.op == "OR"
    assert e.left.op == "AND" and e.left.right.kind == "not"
    assert e.left.left.left.right.op == "*"


def test_comments_and_empty_statements():
    assert [s.kind for s in parse("; SELECT 1 /* a /* nested */ b */; // tail\n ; LET x = 2")] == ["select", "let"]


@pytest.mark.parametrize("text, value", [("'a\\'b'", "a'b"), ('"\\u00e9\\n"', "é\n"), ("0xCAFE", b"\xca\xfe"), ("b'SGk='", b"Hi"), ("-5", -5), ("2f", 2.0), ("true", True), ("null", None)])
def test_literals(text, value):
    assert parse_expression(text).value == value


def test_durations_datetimes_and_decimals():
    assert parse_expression("1h30m").nanos == 5_400_000_000_000
    assert parse_expression("d'2024-01-15'").value.isoformat() == "2024-01-15T00:00:00+00:00"
    assert str(parse_expression("12.50dec").value) == "12.50"
    assert parse_expression("30dec").kind == "literal"


def test_targets_and_keys():
    s = one('SELECT * FROM user:"a/b"').source
    assert (s.collection, s.key) == ("user", "a/b")
    assert one("SELECT * FROM `odd name`:k-1").source.key == "k-1"
    assert one("RELATE user:a->likes->post:b").source == ["user:a"]


def test_value_is_a_field_before_from():
    assert one("SELECT value FROM t").value is False
    assert one("SELECT VALUE x FROM t").value is True
    assert one("SELECT value AS v FROM t").items[0].alias == "v"


def test_traversal_shapes():
    t = one("SELECT ->a{2..}->b<-(c WHERE w > 1){1..3 ALL}->user.{n, m: x.y} FROM u").items[0].value
    assert [s.label for s in t.steps] == ["a", "b", "c", "user"]
    assert (t.steps[0].low, t.steps[0].high) == (2, None) and t.steps[2].everything
    assert t.steps[3].fields == [("n", ["n"]), ("m", ["x", "y"])]


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT * FROM", "SELECT 1 +", "SELECT a < b < c FROM t", "UPSERT t SET a = 1", "SELECT * FROM t LIMIT -1", "INSERT INTO t 5", "SELECT 'x", "LET x 1", "/* open"])
def test_rejected(text):
    with pytest.raises(ParseError):
        parse(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_parses_or_is_rejected(text):
    try:
        parse(text)
    except ParseError:
        pass


def test_statement_soup():
    rng = random.Random(0)
    words = "SELECT FROM WHERE GROUP ORDER LIMIT ( ) [ ] { } -> <- , . ; a b 1 'x' = + * $v :: COUNT IN NOT AND ?? .. <|3|> @@ IF THEN END".split()
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        try:
            parse(text)
        except ParseError:
            pass
