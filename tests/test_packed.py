import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.functions.packed import BROKEN_ARRAY, BROKEN_BRACKET, BROKEN_QUOTE, NO_NAME, SEPARATORS, split_packed
from trellis.operators.packed import packed_values


@pytest.mark.parametrize("text, items, errors", [
    (None, [], []), ("", [], []), (" \n　", [], []), ("one", ["one"], []), ("a, b;c|d\ne\tf，g；h", list("abcdefgh"), []),
    ("b/w / 9/16 / x", ["b/w", "9/16", "x"], []), ('"stems; cut", x', ["stems; cut", "x"], []), ('"say ""hi"""; y', ['say "hi"', "y"], []), ('"a\\"b", c', ['a"b', "c"], []),
    ("a (b, c); [d|e] f", ["a (b, c)", "[d|e] f"], []), (" ,, a ,, ", ["a"], []), ('"open, x', ['"open', "x"], [BROKEN_QUOTE]), ('"a" b, c', ['"a" b', "c"], [BROKEN_QUOTE]), ("x (y; z", ["x (y", "z"], [BROKEN_BRACKET]),
    ('[{"name": "Lee, Kim", "consent": true}, {"name": " B "}, {"x": 1}, null]', ["Lee, Kim", "B"], [NO_NAME]), ('["caf\\u00e9", 3, ""]', ["café", "3"], []), ('["press k', ['["press k'], [BROKEN_ARRAY, BROKEN_BRACKET]),
    ("“a, b”; c", ["a, b", "c"], []), ("can't, launch '25", ["can't", "launch '25"], []),
])
def test_split(text, items, errors):
    assert split_packed(text) == (items, errors)


ITEM = st.text(alphabet="ab c'é花-", min_size=1, max_size=6).map(str.strip).filter(bool)


@given(st.lists(ITEM, min_size=1, max_size=6), st.sampled_from([",", ";", "|", "\n", "\t", "，", "； "]))
@settings(max_examples=150, deadline=None)
def test_joined_values_come_back(items, sep):
    assert split_packed(sep.join(items)) == (items, [])
    assert split_packed(json.dumps(items)) == (items, [])


@given(st.lists(st.text(alphabet='ab,;|"/ ', min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_quoted_values_come_back(items):
    assert split_packed(", ".join('"' + i.replace('"', '""') + '"' for i in items))[0] == items


@given(st.text(alphabet=SEPARATORS + 'a"([{])}\\/ “”', max_size=40))
@settings(max_examples=200, deadline=None)
def test_any_text_is_read(text):
    items, errors = split_packed(text)
    assert all(i and i == i.strip() for i in items) and errors == sorted(set(errors))


def test_table(spark):
    rows = [(1, "a, b", None, "x"), (1, "a, b", None, "x"), (2, None, "", "x"), (3, "x" * 50_000, "p;q;r", "x"), (None, "c, d", None, "x")]
    df = spark.createDataFrame(rows, "entry_no long, people string, tags string, key string")
    got = sorted((r["key"], r["field"], r["pos"], r["item"][:3], r["values"]) for r in packed_values(df, "entry_no", ["people", "tags"]).collect())
    assert got == [(1, "people", 1, "a", 2), (1, "people", 2, "b", 2), (3, "people", 1, "xxx", 1), (3, "tags", 1, "p", 3), (3, "tags", 2, "q", 3), (3, "tags", 3, "r", 3)]
    assert packed_values(df.limit(0), "entry_no", ["people"]).count() == 0
