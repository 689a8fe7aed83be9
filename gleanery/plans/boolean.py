"""From syntax trees to plans, and from plans to columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import normalize_word
from gleanery.plans.language import And, Not, Or, QueryError, Word
from gleanery.plans.tree import TreeNode


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Intersection:
    inputs: tuple


@dataclass(frozen=True)
class Union:
    inputs: tuple


@dataclass(frozen=True)
class Exclusion:
    include: object
    exclude: object


def plan(tree):
    """The plan of a syntax tree. NOT is only allowed as an operand of AND, beside one without it."""
    if isinstance(tree, Word):
        return Term(normalize_word(tree.text))
    if isinstance(tree, Not):
        raise QueryError("NOT should only appear as direct operand of AND")
    if isinstance(tree, Or):
        if len(tree.operands) < 2:
            raise QueryError("OR should contain at least two operands")
        inputs = []
        for operand in tree.operands:
            if isinstance(operand, Not):
                raise QueryError("NOT should not be a part of OR expression")
            inputs.append(plan(operand))
        return Union(tuple(inputs))
    assert isinstance(tree, And)
    sides: tuple[list, list] = ([], [])
    for operand in tree.operands:
        negated = isinstance(operand, Not)
        sides[negated].append(plan(operand.operand if negated else operand))
    wanted, unwanted = sides
    if not wanted:
        raise QueryError("AND should contain at least one including operand")
    if len(tree.operands) < 2:
        raise QueryError("AND should contain at least two operands")
    include = wanted[0] if len(wanted) == 1 else Intersection(tuple(wanted))
    if not unwanted:
        return include
    return Exclusion(include, unwanted[0] if len(unwanted) == 1 else Union(tuple(unwanted)))


def leaf_terms(node) -> list[str]:
    """The distinct terms of a plan, in order."""
    if isinstance(node, Term):
        return [node.term]
    parts = (node.include, node.exclude) if isinstance(node, Exclusion) else node.inputs
    return list(dict.fromkeys(t for p in parts for t in leaf_terms(p)))


def matched(node, has: dict[str, Column]) -> Column:
    """Whether a document matches; ``has`` says for each term whether the document holds it."""
    if isinstance(node, Term):
        return has[node.term]
    if isinstance(node, Exclusion):
        return matched(node.include, has) & ~matched(node.exclude, has)
    parts = [matched(p, has) for p in node.inputs]
    return reduce((lambda a, b: a & b) if isinstance(node, Intersection) else (lambda a, b: a | b), parts)


def score(node, has: dict[str, Column], scores: dict[str, Column]) -> Column:
    """The score of a matching document: sums over what matches, excluded parts never counted."""
    if isinstance(node, Term):
        return scores[node.term]
    if isinstance(node, Exclusion):
        return score(node.include, has, scores)
    parts = [score(p, has, scores) for p in node.inputs]
    if isinstance(node, Union):
        parts = [F.when(matched(p, has), s).otherwise(F.lit(0.0)) for p, s in zip(node.inputs, parts)]
    return reduce(lambda a, b: a + b, parts)


def explain(node, known: set[str] | None = None) -> TreeNode:
    """The plan as a tree; with ``known`` terms given, others are marked as unknown."""
    if isinstance(node, Term):
        leaf = TreeNode("Term").attr("term", node.term)
        return leaf if known is None or node.term in known else leaf.attr("unknown_term", "true")
    if isinstance(node, Exclusion):
        return TreeNode("Exclusion").child(explain(node.include, known), "include").child(explain(node.exclude, known), "exclude")
    out = TreeNode(type(node).__name__)
    for part in node.inputs:
        out.child(explain(part, known))
    return out
