import pytest

from gleanery.plans import boolean, language
from gleanery.plans.language import And, Not, Or, QueryError, Word, lex, parse
from gleanery.plans.tree import TreeNode

A, B, C = Word("a"), Word("b"), Word("c")


@pytest.mark.parametrize(
    ("query", "kinds"),
    [
        ("", []), ("  ", []), ("a", ["word"]), ("a b", ["word", "word"]), ("a AND b", ["word", "AND", "word"]), ("and or Not", ["word"] * 3),
        ("ANDY NOTE", ["word", "word"]), ("(a)", ["(", "word", ")"]), ("NOT(a OR b)", ["NOT", "(", "word", "OR", "word", ")"]), ("éa 日本", ["word", "word"]),
    ],
)
def test_lexer(query, kinds):
    assert [k for k, _ in lex(query)] == kinds


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a", A), ("((a))", A), ("a b", Or((A, B))), ("a OR b c", Or((A, B, C))), ("a AND b AND c", And((A, B, C))), ("a b AND c", Or((A, And((B, C))))),
        ("a AND b c", Or((And((A, B)), C))), ("(a b) AND c", And((Or((A, B)), C))), ("NOT a", Not(A)), ("NOT NOT a", Not(Not(A))), ("NOT a b", Or((Not(A), B))),
        ("NOT a AND b", And((Not(A), B))), ("NOT (a OR b)", Not(Or((A, B)))), ("a NOT b", Or((A, Not(B)))), ("a (b)", Or((A, B))), ("a AND (b OR c)", And((A, Or((B, C))))),
    ],
)
def test_parser(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("", "should receive word or '('"), ("()", "should receive word or '('"), ("a AND", "should receive word or '('"), ("OR a", "should receive word or '('"),
        ("NOT", "should receive word or '('"), ("(a", "should receive ')'"), ("a)", "should consume all tokens"), ("a OR AND b", "should receive word or '('"),
    ],
)
def test_parse_errors(query, message):
    with pytest.raises(QueryError, match=".*") as e:
        parse(query)
    assert str(e.value) == message


KNOWN = set("abcde")


def shown(query):
    return str(boolean.explain(boolean.plan(parse(query)), KNOWN)).splitlines()


@pytest.mark.parametrize(
    ("query", "lines"),
    [
        ("a", ["Term (term = a)"]),
        ("x", ["Term (term = x, unknown_term = true)"]),
        ("a AND b", ["Intersection", "├── Term (term = a)", "└── Term (term = b)"]),
        ("a b", ["Union", "├── Term (term = a)", "└── Term (term = b)"]),
        ("a AND NOT b", ["Exclusion", "├── include = Term (term = a)", "└── exclude = Term (term = b)"]),
        ("a AND NOT b AND NOT c", ["Exclusion", "├── include = Term (term = a)", "└── exclude = Union", "    ├── Term (term = b)", "    └── Term (term = c)"]),
        ("A, AND b's", ["Intersection", "├── Term (term = a)", "└── Term (term = bs, unknown_term = true)"]),
    ],
)
def test_plans(query, lines):
    assert shown(query) == lines


def test_nested_plan():
    lines = shown("a AND ((b AND NOT c) OR d) AND NOT e")
    assert lines[0] == "Exclusion" and lines[1] == "├── include = Intersection" and lines[-1] == "└── exclude = Term (term = e)"
    assert "│       ├── Exclusion" in lines and "│       │   └── exclude = Term (term = c)" in lines


@pytest.mark.parametrize(
    ("tree", "message"),
    [
        ("NOT a", "NOT should only appear as direct operand of AND"), ("a AND NOT NOT b", "NOT should only appear as direct operand of AND"),
        ("NOT a AND NOT b", "AND should contain at least one including operand"), ("c AND (NOT a AND NOT b)", "AND should contain at least one including operand"),
        ("a OR NOT b", "NOT should not be a part of OR expression"), (And(()), "AND should contain at least one including operand"),
        (And((A,)), "AND should contain at least two operands"), (Or(()), "OR should contain at least two operands"), (Or((A,)), "OR should contain at least two operands"),
    ],
)
def test_plan_errors(tree, message):
    with pytest.raises(QueryError) as e:
        boolean.plan(language.parse(tree) if isinstance(tree, str) else tree)
    assert str(e.value) == message


def test_trees():
    six = TreeNode("List", {k: str(i) for i, k in enumerate("abcdef")}).child(TreeNode("Leaf"))
    assert str(six).splitlines() == ["List (", *(f"    {k} = {i}," for i, k in enumerate("abcde")), "    f = 5", ")", "└── Leaf"]
    mixed = TreeNode("R").child(TreeNode("A"), "one").child(TreeNode("B").child(TreeNode("C")))
    assert str(mixed) == "R\n├── one = A\n└── B\n    └── C\n"
    assert str(TreeNode("Empty")) == "Empty\n"
