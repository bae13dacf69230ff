import pytest

from logloom.plans.query import Aggregate, ParseError, Query, Selection, parse


def test_avg():
    assert parse("avg(weight) as avg_weight").aggregate == Aggregate("avg", "weight", "avg_weight", None)
    assert parse("avg(weight) as avg_weight by hello").aggregate == Aggregate("avg", "weight", "avg_weight", "hello")


@pytest.mark.parametrize("text", ['name.location="kumari kandam"', 'name.location = "kumari kandam"', 'name.location= "kumari kandam"', 'name.location ="kumari kandam"'])
def test_structured_spacing(text):
    assert parse(text).selection == Selection("kumari kandam", "name.location")


def test_message_and_aggregate():
    q = parse('message="succeed" | count(country) as num_of_country')
    assert q.selection == Selection("succeed") and q.aggregate == Aggregate("count", "country", "num_of_country")


def test_distinct_count_key_with_slash():
    assert parse("distinct_count(country.hello/world)").aggregate == Aggregate("distinct_count", "country.hello/world")


def test_defaults():
    assert parse("") == Query()
    q = parse("source=a_b,c")
    assert q.sources == ("a_b", "c") and q.limit == 10_000 and q.distance == 2
    assert parse("limit 100").limit == 100 and parse("distance 100").distance == 100
    assert parse("distance 0").distance == 2  # an exact match can't be asked for


def test_ordered_choice():
    with pytest.raises(ParseError):
        parse("source=kube-server")  # source matches kube; what follows is no separator
    assert parse('counter="x"').selection == Selection("x", "counter")
    assert parse('source="x"').selection == Selection("x", "source")
    assert parse('message="x"').selection.key is None


def test_escapes_stay_raw():
    assert parse(r'message="a\"bA"').selection.value == r"a\"bA"


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("avg(weight) as avg_weight | limit 10", "Limit is not supported with aggregation. At least for now"),
        ("count(a) as b | distinct(c)", "Only one aggregation is supported. At least for now"),
        ('message="a" | b="c"', "Only one selection statement exist"),
        ("limit 1 | limit 2", "You can only use one limit operator"),
        ("source=a | source=b", "You can mention source only once"),
        ("distance 1 | distance 2", "Only one distance limit is allowed"),
    ],
)
def test_repeats(text, said):
    with pytest.raises(ParseError, match=said):
        parse(text)


@pytest.mark.parametrize("text", [" limit 1", "limit 1 ", "limit 1|limit 2", "limit 99999999999999999999", "distance 4294967296", "nonsense", "source=_a", "count(a)", 'message="a'])
def test_errors(text):
    with pytest.raises(ParseError):
        parse(text)


def test_limit_zero_with_aggregate():
    assert parse("count(a) as b | limit 0").aggregate.alias == "b"
