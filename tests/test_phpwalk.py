"""The walk over serialized values: any depth, values only a class can read, cut values inside others."""

import random

from urlshift.operators import phpwalk


def php(value):
    """A value as PHP writes it; a tuple is an object that wrote itself."""
    if isinstance(value, str):
        return f's:{len(value.encode())}:"{value}";'
    if isinstance(value, int):
        return f"i:{value};"
    if isinstance(value, tuple):
        return f'C:{len(value[0])}:"{value[0]}":{len(value[1].encode())}:{{{value[1]}}}'
    return f"a:{len(value)}:{{" + "".join(f"{php(k)}{php(v)}" for k, v in value.items()) + "}"


def test_any_depth():
    walk = phpwalk.Rewriter(lambda text: text.replace("//old.com", "//longer.test"))
    value = wanted = "http://old.com"
    for _ in range(20_000):
        value = {"//old.com": value}
    text = "".join('a:1:{s:9:"//old.com";' for _ in range(20_000)) + php(wanted) + "}" * 20_000
    assert walk(text) == text.replace(php(wanted), php("http://longer.test"))
    text, wanted = "http://old.com", "http://longer.test"
    for _ in range(5_000):
        text, wanted = php(text), php(wanted)
    assert walk(text) == wanted and not walk.unread


def test_objects_that_wrote_themselves_and_cut_values_inside():
    walk = phpwalk.Rewriter(lambda text: text.replace("//old.com", "//longer.test"))
    own = ("Foo", "x;{//old.com")
    assert walk(php({"a": own, "b": "//old.com"})) == php({"a": own, "b": "//longer.test"})
    inner = php({"a": "//old.com"})
    for broken in (inner[:-1], inner[:-9], 's:99:"//old.com";', "a:1:{//old.com}", inner + "x", 'C:3:"Foo":9:{//old.com', php(own) + "}"):
        assert walk(php({"a": broken, "b": inner})) == php({"a": broken, "b": php({"a": "//longer.test"})})
        assert walk.unread == 1
        assert walk(php({"a": php({"c": broken, "d": "//old.com"})})) == php({"a": php({"c": broken, "d": "//longer.test"})})
    assert walk(php({"a": "i://old.com;", "b": "s:see //old.com"})) == php({"a": "i://longer.test;", "b": "s:see //longer.test"})


def test_random_values():
    some = random.Random(4)
    walk = phpwalk.Rewriter(lambda text: text.replace("//old.com", "//longer.test"))

    def made(depth, new):
        kind = some.random()
        if depth == 0 or kind < 0.3:
            return some.choice(["", "é", "http://old.com/é", 5, ("Foo", "s:1//old.com"), '";}'])
        if kind < 0.6:
            return php(made(depth - 1, new)) if not isinstance(x := made(depth - 1, new), str) else x
        return {some.choice(["k", 3, "//old.com"]): made(depth - 1, new) for _ in range(some.randint(0, 4))}

    def renewed(value):
        if isinstance(value, dict):
            return {k: renewed(v) for k, v in value.items()}
        if not isinstance(value, str):
            return value
        inner = walk(value) if value[:2] in ("a:", "s:", "C:") else None
        return inner if inner is not None else value.replace("//old.com", "//longer.test")

    for _ in range(500):
        value = {"x": made(5, False)}
        assert walk(php(value)) == php(renewed(value))
