"""Relevance models as column expressions.

Each takes the statistics of one term in one document: tf (occurrences), length (tokens of the field), df (documents
with the term), ttf (occurrences in the corpus), docs (documents with the field) and tokens (tokens of the field in the
corpus), all double, and the boost. The expressions are SQL text over those names, so that they fold into the scan's
generated code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document lengths below this are exact when coded as one byte; above, the excess keeps four significant bits.
FREE = 24


@dataclass(frozen=True)
class Similarity:
    """A model: its formula over tf, length, df, ttf, docs, tokens, avg and boost."""

    name: str
    formula: str

    def score(self, tf: Column, length: Column, df: Column, ttf: Column, docs: Column, tokens: Column, boost: float = 1.0) -> Column:
        avg = tokens / F.greatest(docs, F.lit(1.0))
        names = {"tf": tf, "length": length, "df": df, "ttf": ttf, "docs": docs, "tokens": tokens, "avg": avg, "boost": F.lit(float(boost))}
        return _parse(self.formula)({n: c.cast("double") for n, c in names.items()})


def _parse(formula: str) -> Callable[[dict[str, Column]], Column]:
    """A formula as a function of columns; formulas are Python expressions over the names and the functions below."""
    code = compile(formula, "<similarity>", "eval")
    tools = {"ln": F.log, "log2": F.log2, "sqrt": F.sqrt, "greatest": lambda *a: F.greatest(*[x if isinstance(x, Column) else F.lit(float(x)) for x in a]), "power": lambda a, b: F.pow(a, b), "case": lambda c, a, b: F.when(c, a).otherwise(b)}
    return lambda names: eval(code, {"__builtins__": {}}, tools | names)


def bm25(k1: float = 1.2, b: float = 0.75) -> Similarity:
    return Similarity("bm25", f"boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * length / avg))")


def classic() -> Similarity:
    return Similarity("classic", "boost * (ln((docs + 1) / (df + 1)) + 1) * sqrt(tf) * (1 / sqrt(length))")


def boolean() -> Similarity:
    return Similarity("boolean", "boost + 0 * tf")


def raw_tf() -> Similarity:
    return Similarity("raw_tf", "boost * tf")


def lm_dirichlet(mu: float = 2000.0) -> Similarity:
    return Similarity("lm_dirichlet", f"greatest(boost * (ln(1 + tf / ({mu} * ((ttf + 1) / (tokens + 1)))) + ln({mu} / (length + {mu}))), 0)")


def lm_jelinek_mercer(weight: float = 0.1) -> Similarity:
    return Similarity("lm_jelinek_mercer", f"boost * ln(1 + ((1 - {weight}) * tf / length) / ({weight} * ((ttf + 1) / (tokens + 1))))")


def indri_dirichlet(mu: float = 2000.0) -> Similarity:
    return Similarity("indri_dirichlet", f"boost * ln((tf + {mu} * ((ttf + 1) / (tokens + 1))) / (length + {mu}))")


#: The parts of divergence from randomness. A normalisation gives tfn, a model and an after effect use it.
NORMALIZATIONS = {
    "none": "tf",
    "h1": "tf * avg / length",
    "h2": "tf * log2(1 + avg / length)",
    "h3": "((tf + 800.0 * (ttf + 1) / (tokens + 1)) / (length + 800.0) * 800.0)",
    "z": "tf * power(avg / length, 0.3)",
}
AFTER_EFFECTS = {"b": "((ttf + 2) / (df + 1))", "l": "1"}
BASIC_MODELS = {
    "g": "((log2((1 + {lam}) / {lam}) - (log2((1 + {lam}) / {lam}) - log2({lam} + 1)) / (1 + {tfn})) * {ae})",
    "if": "(log2(1 + (docs + 1) / (ttf + 0.5)) * {ae} * (1 - 1 / (1 + {tfn})))",
    "in": "(log2((docs + 1) / (df + 0.5)) * {ae} * (1 - 1 / (1 + {tfn})))",
    "ine": "(log2((docs + 1) / (docs * (1 - power((docs - 1) / docs, ttf)) + 0.5)) * {ae} * (1 - 1 / (1 + {tfn})))",
}


def dfr(model: str = "in", after: str = "l", normalization: str = "h2") -> Similarity:
    tfn = f"({NORMALIZATIONS[normalization]})"
    text = BASIC_MODELS[model].format(tfn=tfn, ae=AFTER_EFFECTS[after], lam="(ttf / (docs + ttf))")
    return Similarity(f"dfr_{model}_{after}_{normalization}", f"boost * {text}")


DISTRIBUTIONS = {
    "ll": "(0 - ln({lam} / ({tfn} + {lam})))",
    "spl": "(0 - ln((power({lam}, 1 - 1 / ({tfn} + 1)) - {lam}) / (1 - {lam})))",
}
LAMBDAS = {"df": "((df + 1) / (docs + 1))", "ttf": "((ttf + 1) / (docs + 1))"}


def ib(distribution: str = "ll", lam: str = "df", normalization: str = "h2") -> Similarity:
    text = DISTRIBUTIONS[distribution].format(tfn=f"({NORMALIZATIONS[normalization]})", lam=LAMBDAS[lam])
    return Similarity(f"ib_{distribution}_{lam}_{normalization}", f"boost * {text}")


INDEPENDENCE = {"chi_squared": "(tf - {e}) * (tf - {e}) / {e}", "saturated": "(tf - {e}) / {e}", "standardized": "(tf - {e}) / sqrt({e})"}


def dfi(measure: str = "standardized") -> Similarity:
    e = "((ttf + 1) * length / (tokens + 1))"
    return Similarity(f"dfi_{measure}", f"case(tf > {e}, boost * log2({INDEPENDENCE[measure].format(e=e)} + 1), 0.0)")


def axiomatic(kind: str = "f2exp", s: float = 0.25, k: float = 0.35) -> Similarity:
    """The axiomatic family (Fang and Zhai 2005): F1, F2 with length in the tf part, EXP or LOG idf; F3 as F1 less gamma."""
    tf_part = {"f1": "(1 + ln(1 + ln(tf)))", "f2": f"(tf / (tf + {s} + {s} * length / avg))", "f3": "(1 + ln(1 + ln(tf)))"}[kind[:2]]
    length_part = f"(({s} + 1) / ({s} + length / avg))" if kind[:2] == "f1" else "1"
    idf = f"power((docs + 1) / df, {k})" if kind.endswith("exp") else "ln((docs + 1) / df)"
    gamma = f" - (length - 1) * {s} / avg" if kind[:2] == "f3" else ""
    return Similarity(f"axiomatic_{kind}", f"greatest(boost * ({tf_part} * {length_part} * {idf}{gamma}), 0)")


class MultiSimilarity:
    """The sum of several models."""

    def __init__(self, *parts: Similarity):
        self.parts, self.name = parts, "multi"

    def score(self, *args, **kw) -> Column:
        total = self.parts[0].score(*args, **kw)
        for p in self.parts[1:]:
            total = total + p.score(*args, **kw)
        return total


class PerField:
    """A model by field."""

    def __init__(self, default, **fields):
        self.default, self.fields, self.name = default, fields, "per_field"

    def of(self, field: str):
        return self.fields.get(field, self.default)


def coded_length(n: Column) -> Column:
    """The document length that is left after it was coded as one byte: exact below FREE + 16, then four significant bits of the excess."""
    excess = n - FREE
    shift = F.greatest(F.length(F.bin(F.greatest(excess, F.lit(1)))) - 4, F.lit(0))
    return F.when(excess < 16, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", excess.cast("int"), shift.cast("int")), shift.cast("int")) + FREE)
