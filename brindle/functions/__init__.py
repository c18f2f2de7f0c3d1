"""Functions of the engine for SQL users: register(spark) makes them known to the session.

    logql_canonical(text)             one writing for queries that mean the same
    logql_selections(text)            keys of what a query reads; null where it doesn't parse
    logfmt(text)                      map of a logfmt line's cells, the last of a repeated key; null for null
    re2_java(expression)              an RE2 expression for the JVM's engine (rlike, regexp_extract); null where it doesn't compile
    glob_re2(pattern)                 an RE2 expression for a glob
    language_witness(expression, f)   a text of the expression's language that the filter expression keeps; null where there is none
    infer_language(template, text)    aggregate: the language of a template's lines; null where they are too few
    drain(TABLE(...))                 table function over one partition: rows text -> text, template

Null arguments give null. Texts are read whole. All work in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from brindle.logql.syntax import canonical
from brindle.operators.mining import DrainConfig, TooFewSamples, infer_language, templates_of
from brindle.operators.querylog import selections
from brindle.operators.unparsed import logfmt_cells
from brindle.relang import automaton
from brindle.relang.syntax import SyntaxFault, java, quote


def _glob(pattern: str) -> str:
    parts = {"*": "(?s:.*)", "?": "(?s:.)"}
    return r"\A" + "".join(parts.get(c) or quote(c) for c in pattern) + r"\z"


def _or_null(f: Callable, *faults: type[Exception]) -> Callable:
    def run(*values):
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except faults:
            return None

    return run


def _cells(text: str) -> dict[str, str]:
    keys, values, _ = logfmt_cells(text)
    return dict(zip(keys, values, strict=True))


def _witness(expression: str, wanted: str) -> str | None:
    return automaton.witness([automaton.Term(automaton.compile(expression)), automaton.Term(automaton.compile(wanted))])


#: name -> (result type, function of texts).
SCALARS: dict[str, tuple[str, Callable]] = {
    "logql_canonical": ("string", _or_null(canonical)),
    "logql_selections": ("array<string>", _or_null(selections)),
    "logfmt": ("map<string,string>", _or_null(_cells)),
    "re2_java": ("string", _or_null(java, SyntaxFault)),
    "glob_re2": ("string", _or_null(_glob)),
    "language_witness": ("string", _or_null(_witness, SyntaxFault, automaton.Undecided)),
}


def _inferred(template: pd.Series, text: pd.Series) -> str:
    known = template.dropna()
    if known.empty:
        return None
    try:
        return infer_language(known.iloc[0], text.dropna().tolist())["regex"]
    except TooFewSamples:
        return None


class Drain:
    """Templates of the texts of one partition, in the order given."""

    def __init__(self) -> None:
        self.texts: list[str] = []

    def eval(self, row: Row):
        if row["text"] is not None:
            self.texts.append(row["text"])

    def terminate(self):
        yield from zip(self.texts, templates_of(self.texts, DrainConfig()), strict=True)


def register(spark: SparkSession) -> list[str]:
    """Register all functions with the session; their names."""
    for name, (kind, f) in SCALARS.items():
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
    spark.udf.register("infer_language", F.pandas_udf(_inferred, "string"))
    spark.udtf.register("drain", F.udtf(Drain, returnType="text string, template string"))
    return [*SCALARS, "infer_language", "drain"]
