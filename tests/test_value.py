import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from recordloom import value as V
from recordloom.errors import FormatError

integers = st.sampled_from(sorted(V.INTEGERS)).flatmap(lambda t: st.tuples(st.just(t), st.integers(*V.INTEGERS[t])))
text = st.text(st.characters(exclude_categories=["Cs"]), max_size=8)
scalars = st.one_of(
    st.just(V.UNIT), st.tuples(st.just("b"), st.booleans()), integers, st.floats(width=32).map(V.from_f32), st.floats().map(V.from_f64),
    st.tuples(st.just("c"), st.characters(exclude_categories=["Cs"])), st.tuples(st.just("s"), text), st.tuples(st.just("y"), st.binary(max_size=6)),
)
values = st.recursive(scalars, lambda v: st.one_of(st.tuples(st.just("q"), st.lists(v, max_size=4)), st.tuples(st.just("m"), st.lists(st.tuples(v, v), max_size=4))), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(values)
def test_envelope_keeps_every_value(v):
    assert V.same(V.from_envelope(V.to_envelope(v)), v)


def test_seventeen_kinds():
    assert len(V.TAGS) == 17


@pytest.mark.parametrize("tag", sorted(V.INTEGERS))
def test_ranges(tag):
    lo, hi = V.INTEGERS[tag]
    for n in (lo, hi):
        assert V.from_envelope(V.to_envelope((tag, n))) == (tag, n)
    for n in (lo - 1, hi + 1):
        with pytest.raises(FormatError):
            V.to_envelope((tag, n))


def test_envelope_text_is_pinned():
    v = ("m", [(("s", "b"), ("y", b"\x01\xff")), (("s", "a"), ("q", [("f64", math.nan), ("f32", 0.10000000149011612), V.UNIT])), (("s", "a"), ("u64", 2**64 - 1))])
    assert V.to_envelope(v) == '["m",[[["s","b"],["y","Af8="]],[["s","a"],["q",[["f64","NaN"],["f32","0.1"],["n"]]]],[["s","a"],["u64","18446744073709551615"]]]]'


def test_display():
    v = ("m", [(("s", "k"), ("q", [V.UNIT, ("b", True), ("y", b"\x0a\xff"), ("f64", 1e16), ("f64", 1.0), ("f64", -0.5)])), (("u8", 1), ("s", "a b"))])
    assert V.display(v) == "{k: [(), true, 0aff, 10000000000000000, 1, -0.5], 1: a b}"


@pytest.mark.parametrize(("x", "text"), [(0.0, "0.0"), (-0.0, "-0.0"), (1.0, "1.0"), (2.5, "2.5"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (1.5e17, "1.5e17"), (1e-5, "0.00001"), (1.25e-6, "1.25e-6"), (123456.789, "123456.789")])
def test_number_text(x, text):
    assert V.number_text("f64", x) == text and float(text) == x


def test_columns(spark):
    kind = T.StructType.fromDDL("a int, b string, c array<float>, d map<string,long>, e binary, f double")
    v = ("m", [(("s", "b"), ("s", "x")), (("s", "a"), ("u64", 7)), (("s", "a"), ("u64", 8)), (("s", "c"), ("q", [("f32", 0.5)])), (("s", "d"), ("m", [(("s", "k"), ("i64", 1)), (("s", "k"), ("i64", 2))])), (("s", "e"), ("q", [("u64", 1), ("u64", 255)]))])
    assert V.to_column(v, kind) == (7, "x", [0.5], {"k": 1}, b"\x01\xff", None)
    with pytest.raises(FormatError):
        V.to_column(("m", [(("s", "a"), ("u64", 2**40))]), kind)


def test_the_short_way_of_envelopes_is_the_long_one():
    s = lambda x: ("s", x)
    values = [("m", [(s("a"), ("i64", 1)), (s("b"), s("é"))]), ("m", [(s("a"), ("f64", 0.5)), (s("a"), ("f32", 0.5))]), ("m", []), ("m", [(s("a"), V.UNIT)]), ("m", [(s("a"), ("m", [(s("b"), ("i8", 1))])), (s("c"), s("d"))])]
    values += [("m", [(s("a"), ("q", [("m", [(s("b"), ("u8", 1))])]))]), ("m", [(s("a\n"), s('"]],[["s","'))]), ("m", [(("i8", 1), s("x")), (s("b"), ("b", True))]), ("q", [s("x")])]
    for v in values:
        text = V.to_envelope(v)
        assert text == json.dumps(V.to_node(v), ensure_ascii=False, separators=(",", ":"))
        assert V.from_envelope(text) == v == V.from_node(json.loads(text))
    for bad in ('["m",[[["s","a"],["u8","256"]]]]', '["m",[[["s","a"],["i8","1"]]x[["s","b"],["i8","1"]]]]', '["m",[[["s","a"],["i8","x"]]]]'):
        with pytest.raises((FormatError, ValueError)):
            V.from_envelope(bad)
    found = V.PAIR(V.to_envelope(values[0]))
    assert found == [("a", "i64", "1"), ("b", "s", "é")]
