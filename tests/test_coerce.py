import pytest

from recordlake import FieldSpec
from recordlake.functions.coerce import coerce


@pytest.mark.parametrize(
    "kind, raw, want",
    [
        ("email", "Mail: Ann@Corp.ORG today", "ann@corp.org"),
        ("email", "no address", None),
        ("email", "test@firm.io", None),
        ("email", "a@example.com, real@firm.io", None),
        ("url", "see https://firm.io/x.", "https://firm.io/x"),
        ("url", "firm.io/about", "https://firm.io/about"),
        ("url", "www.firm.io", "https://www.firm.io"),
        ("url", "no link", None),
        ("url", "https://www.google.com/url?sa=D&q=http%3A%2F%2Fharbour.test%2Fa%2Bb&ust=1", "http://harbour.test/a+b"),
        ("number", "$2,750.25 net", 2750.25),
        ("number", "-4 below", -4.0),
        ("number", "none", None),
        ("integer", "about 52 people", 52),
        ("integer", "2.5", 2),
        ("integer", "3.5", 4),
        ("boolean", "YES", True),
        ("boolean", " inactive ", False),
        ("boolean", "maybe", None),
        ("date", "15 Mar 2022", "2022-03-15"),
        ("date", "15  mar 2022", "2022-03-15"),
        ("date", "Mar 5, 2022", "2022-03-05"),
        ("date", "March 5, 2022", "2022-03-05"),
        ("date", "3/4/2020", "2020-04-03"),
        ("date", "3/14/2020", "2020-03-14"),
        ("date", "2019", "2019-01-01"),
        ("date", "1-2-2003", "2003-02-01"),
        ("date", "15 March 2022", "2022"),
        ("date", "2022-02-31", "2022"),
        ("date", "3 Mar 22", None),
        ("array", "a, b; c | d", ["a", "b", "c", "d"]),
        ("array", '["x", " y ", ""]', ["x", "y", ""]),
        ("array", "[not json", ["[not json"]),
        ("array", " ,; ", None),
        ("string", " [Quay](https://q.io)\n  Works ", "Quay Works"),
        ("string", "  ", None),
        ("number", "", None),
    ],
)
def test_cells(value, kind, raw, want):
    assert value(coerce(FieldSpec("x", kind), "raw"), raw=raw) == want


def test_json_kinds(value):
    def typed(kind, raw, json_kind):
        return value(coerce(FieldSpec("x", kind), "raw", kind="kind", items="array(raw)"), raw=raw, kind=json_kind)

    assert typed("integer", "7.9", "float") == 7
    assert typed("integer", "True", "bool") == 1
    assert typed("number", "True", "bool") == 1.0
    assert typed("number", "1e3", "float") == 1000.0
    assert typed("integer", "7.5 kg", "text") == 8
    assert typed("array", " z ", "list") == ["z"]


def test_page_link_beats_bare_domain(value):
    sql = coerce(FieldSpec("x", "url"), "raw", page_link="link")
    assert value(sql, raw="harbour.test", link="https://real.test") == "https://real.test"
    assert value(sql, raw="https://a.test", link="https://real.test") == "https://a.test"
