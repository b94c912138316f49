from hypothesis import given, settings
from hypothesis import strategies as st

from urlshift.operators.phpwalk import Rewriter
from urlshift.operators.serialized import apply_plan_serialized, apply_plan_by_site_serialized, broken_serialized
from urlshift.operators.replace import Step

STEPS = [Step(1, 1, 1, "//old-site.com", "//new-site.local")]


def php(value):
    if value is None:
        return "N;"
    if isinstance(value, bool):
        return f"b:{int(value)};"
    if isinstance(value, int):
        return f"i:{value};"
    if isinstance(value, float):
        return f"d:{value};"
    if isinstance(value, str):
        return f's:{len(value.encode())}:"{value}";'
    if isinstance(value, tuple):  # an object: class name, properties
        name, members = value
        return f'O:{len(name)}:"{name}":{len(members)}:{{' + "".join(php(k) + php(v) for k, v in members.items()) + "}"
    return f"a:{len(value)}:{{" + "".join(php(k) + php(v) for k, v in value.items()) + "}"


def fold(text):
    return text.replace("//old-site.com", "//new-site.local")


def rewritten(value):
    if isinstance(value, str):
        return fold(value)
    if isinstance(value, dict):
        return {k: rewritten(v) for k, v in value.items()}
    if isinstance(value, tuple):
        return value[0], rewritten(value[1])
    return value


texts = st.text(max_size=8).flatmap(lambda t: st.sampled_from([t, t + "//old-site.com/" + t, '";' + t, "é//old-site.com\";"]))
leaves = st.one_of(st.none(), st.booleans(), st.integers(), texts)
keys = st.one_of(st.integers(), texts)
values = st.recursive(
    leaves,
    lambda inner: st.one_of(st.dictionaries(keys, inner, max_size=3), st.tuples(st.just("Cls"), st.dictionaries(texts, inner, max_size=2))),
    max_leaves=8,
)


@settings(max_examples=300, deadline=None)
@given(values)
def test_walk_equals_rewriting_before_serializing(value):
    assert Rewriter(fold)(php(value)) == php(rewritten(value))


@settings(max_examples=200, deadline=None)
@given(values.filter(lambda v: not isinstance(v, (int, type(None)))))
def test_truncated_values_are_refused(value):
    text = php(value)
    assert Rewriter(fold)(text[:-1]) is None
    assert Rewriter(fold)(text + "x") is None


def test_column(spark):
    url = 'a:2:{s:3:"url";s:20:"https://old-site.com";s:4:"name";s:8:"Old Site";}'
    done = 'a:2:{s:3:"url";s:22:"https://new-site.local";s:4:"name";s:8:"Old Site";}'
    cases = {
        url: done,
        php({"x": url}): php({"x": done}),
        php({"//old-site.com": "//old-site.com"}): php({"//old-site.com": "//new-site.local"}),
        url[:-3]: url[:-3],
        'about s:3:"abc" and //old-site.com': 'about s:3:"abc" and //new-site.local',
        "//old-site.com": "//new-site.local",
        php("//old-site.com/é"): php("//new-site.local/é"),
        php({"a": "no address"}): php({"a": "no address"}),
        None: None,
    }
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(cases)], "blog_id long, i int, t string")
    many = [*STEPS, *(Step(i, 1, 1, f"//h{i}", "//n") for i in range(2, 30))]
    for steps in (STEPS, many):
        assert [r.t for r in apply_plan_serialized(df, steps).orderBy("i").collect()] == list(cases.values())
    plan = spark.createDataFrame([(1, 1, 1, "//old-site.com", "//new-site.local")],
                                 "seq long, blog_id long, pass int, search string, replace string")
    assert [r.t for r in apply_plan_by_site_serialized(df, plan).orderBy("i").collect()] == list(cases.values())
    assert [r.text for r in broken_serialized(df, ["i"]).collect()] == [url[:-3]]


def test_deep_value_is_rewritten():
    deep = "a:1:{i:0;" * 5000 + "%s" + "}" * 5000
    assert Rewriter(fold)(deep % php("//old-site.com")) == deep % php("//new-site.local")
