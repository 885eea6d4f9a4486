import ast
import random
import textwrap

import pytest

from taskmine.functions import source_scan
from taskmine.functions.source_code import list_definitions, list_elements
from taskmine.operators import code_changes as cc, pull_requests as pr

SOURCE = textwrap.dedent("""
    class A:
        def f(self):
            def g():
                pass
        async def h(self):
            pass
    if 1:
        def hidden():
            pass
    async def z():
        pass
""")


def names(source, code_type):
    return sorted(e["name"] for e in list_elements(source) if e["code_type"] == code_type)


def test_text_too_deep_for_the_parser_is_scanned():
    deep = "x = " + "-" * 100_000 + "1\ndef f(): pass\nclass A:\n    y = " + "(" * 10_000 + "1" + ")" * 10_000 + "\n    def g(self):\n        return 1\n\n# end\n"
    assert list_definitions(deep) == ["A", "A.g", "f"]
    assert [tuple(e.values()) for e in list_elements(deep)] == [("class", "A", 2, 5), ("function", "f", 1, 2), ("method", "A.g", 4 - 0, 6)] or \
        [tuple(e.values()) for e in list_elements(deep)] == [("class", "A", 2, 6), ("function", "f", 1, 2), ("method", "A.g", 4, 6)]


def test_text_that_nothing_can_read_is_neither_empty_nor_equal():
    broken = "x = " + "-" * 100_000 + "(\ndef f(): pass\n"
    assert list_definitions(broken) is None and list_elements(broken) is None
    assert list_definitions("def (") == []


Q3, BACK = "'" * 3, "\\"
TRICKY = "\n".join([
    '"""class Not: def x(): pass"""', 's = "def a(): " ; t = f"{ {\'k\': f\'{1:>{2}}\'}[\'k\'] } {{ def b(): }}"', "h = f'{x:#x} {y!r:\\'>9}' f'{z}'",
    "def one(a: dict = {'x': (1,", "        2)}) -> 'def no(): pass':  # class C:", '    """doc', "def inside_text(): pass", '"""', "    try:", "        def tried(): return [",
    "            1]", "    except (A,", "            B):", "        def tried():", "            pass", "    finally:", "        class Last: x = 1; y = 2", "    if x: pass", "    else:",
    "        async def later(): await x", "    return lambda: {", "    }", "class K(Base,", "        metaclass=M):", "", "    @deco(" + Q3, "    def text(): pass", "    " + Q3 + ")",
    "    async def m(self):", "        for a in b: print(rb'" + BACK + "'', u'x')", "        while True:", "            class Deep:", "                def m(self): " + BACK,
    "                    return 1", "", "    match = 3", "    # comment", "", "match x:", "    case {'a': [1, *_]}:", "        def in_case(): ...", "    case _: pass",
    "with open(x) as f, " + BACK, "        y: z()", ""])


def test_the_scanner_agrees_with_the_parser():
    rng = random.Random(7)
    for source in [TRICKY, SOURCE, *(random_source(rng) for _ in range(300))]:
        ast.parse(source)
        assert source_scan.definitions(source) == list_definitions(source), source
        want = [(e["code_type"], e["name"], e["start"], e["end"]) for e in list_elements(source)]
        assert sorted(source_scan.elements(source)) == sorted(want), source


@pytest.mark.parametrize("bad", ["x = (", "x = ]", "\"open", "f'{x", "(}"])
def test_what_fits_no_file_is_broken(bad):
    with pytest.raises(source_scan.Broken):
        source_scan.outline(bad)


def test_the_two_extractors_differ_on_purpose():
    assert list_definitions(SOURCE) == ["A", "A.f", "A.f.g"]
    assert names(SOURCE, "class") == ["A"]
    assert names(SOURCE, "method") == ["A.f", "A.h"]
    assert names(SOURCE, "function") == ["hidden", "z"]


@pytest.mark.parametrize("bad", ["def (", "", None, "x = '\0'", "class A(:"])
def test_unreadable_source_has_no_elements(bad):
    assert list_definitions(bad) == [] and list_elements(bad) == []


def test_span_is_the_first_in_breadth_first_order_without_decorators():
    source = textwrap.dedent("""
        def outer():
            def f():
                return 'inner'
        @decorated
        def f():
            return 'top'
    """)
    (f,) = [e for e in list_elements(source) if e["name"] == "f"]
    assert source.split("\n")[f["start"]:f["end"]] == ["def f():", "    return 'top'"]


def test_every_block_statement_is_searched():
    source = textwrap.dedent("""
        try:
            def a(): pass
        except E:
            def b(): pass
        else:
            def c(): pass
        finally:
            def d(): pass
        with x:
            class K:
                def m(self): pass
        for i in y:
            def e(): pass
        while z:
            def g(): pass
        match q:
            case 1:
                def h(): pass
    """)
    assert names(source, "function") == list("abcdegh")
    assert names(source, "method") == ["K.m"]


def random_source(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 3)):
        kind, name = rng.choice(["def", "async def", "class", "if", "x"]), rng.choice("abc")
        pad = "    " * depth
        if kind == "x" or depth > 3:
            out.append(f"{pad}x = {rng.randint(0, 1)}")
            continue
        head = "if 1:" if kind == "if" else f"class {name}:" if kind == "class" else f"{kind} {name}():"
        out += [pad + head, random_source(rng, depth + 1)]
    return "\n".join(out)


def brute_elements(source):
    """Names per kind by asking, for each node of the tree, which classes contain it."""
    tree = ast.parse(source)
    nodes = list(ast.walk(tree))
    owners = {id(n): [c.name for c in nodes if isinstance(c, ast.ClassDef) and any(n is m for m in ast.walk(c))] for n in nodes}
    funcs = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    found = {("class", c.name) for c in classes}
    found |= {("function", f.name) for f in funcs if not owners[id(f)]}
    found |= {("method", f"{c.name}.{f.name}") for c in classes for f in funcs if any(f is b for b in c.body)}
    first = {}
    for kind, name in found:
        if kind == "class":
            node = next(c for c in classes if c.name == name)
        elif kind == "function":
            node = next(f for f in funcs if f.name == name and not owners[id(f)])
        else:
            owner, method = name.split(".")
            node = next(f for f in funcs if f.name == method and owner in owners[id(f)])
        first[kind, name] = (node.lineno - 1, node.end_lineno)
    return first


def test_elements_of_random_sources():
    rng = random.Random(3)
    for _ in range(300):
        source = random_source(rng)
        got = {(e["code_type"], e["name"]): (e["start"], e["end"]) for e in list_elements(source)}
        assert got == brute_elements(source), source


def changes(spark, before, after):
    frame = spark.createDataFrame([("i", "t.py", before, after)], "instance_id string, path string, before_src string, after_src string")
    return sorted((r["change_type"], r["code_type"], r["name"]) for r in cc.code_changes(frame).collect())


def test_indentation_and_decorators_are_no_change(spark):
    assert changes(spark, "def f():\n    return 1\n", "@x\ndef f():\n\n      return 1\n") == []


def test_change_kinds(spark):
    before = "class A:\n    def m(self):\n        return 1\ndef f(): pass\ndef g(): return 1\n"
    after = "class A:\n    def m(self):\n        return 2\ndef g(): return 2\ndef h(): pass\n"
    assert changes(spark, before, after) == [
        ("added", "function", "h"), ("deleted", "function", "f"), ("modified", "class", "A"),
        ("modified", "function", "g"), ("modified", "method", "A.m"),
    ]


def test_a_name_added_as_another_type_hides_its_modification(spark):
    before = "def x(): return 1\n"
    after = "def x(): return 2\nif 1:\n    class x: pass\n"
    assert changes(spark, before, after) == [("added", "class", "x")]


def test_a_modified_function_hides_a_modified_class_of_the_same_name(spark):
    before = "def x(): return 1\nif 1:\n    class x:\n        a = 1\n"
    after = "def x(): return 2\nif 1:\n    class x:\n        a = 2\n"
    assert changes(spark, before, after) == [("modified", "function", "x")]


def test_null_and_empty_sources(spark):
    assert changes(spark, None, "def test_a(): pass") == [("added", "function", "test_a")]
    assert changes(spark, None, None) == []


def test_selectors_and_filters(spark):
    rows = [("added", "function", "test_a"), ("deleted", "function", "test_b"), ("added", "class", "TestA"),
            ("modified", "method", "TestA.test_m"), ("modified", "method", "TestA.helper"), ("added", "method", "Other.test_m"),
            ("added", "function", "helper")]
    frame = spark.createDataFrame([("i", "t.py", *row) for row in rows], "instance_id string, path string, change_type string, code_type string, name string")
    tests = cc.changed_tests(frame)
    assert sorted(r["name"] for r in tests.collect()) == ["TestA.test_m", "test_a", "test_b"]
    assert sorted(r["selector"] for r in cc.test_selectors(tests).collect()) == ["t.py::TestA::test_m", "t.py::test_a"]


def test_definition_diff(spark):
    frame = spark.createDataFrame([(1, "def a(): pass", "def a(): return 1"), (2, "def a(): pass", "def b(): pass"), (3, None, "x = 1")], "k int, b string, a string")
    got = {r["k"]: (r["only_modified"], r["new_definitions"], r["deleted_definitions"]) for r in pr.definition_diff(frame, "b", "a").collect()}
    assert got == {1: (True, [], []), 2: (False, ["b"], ["a"]), 3: (True, [], [])}
