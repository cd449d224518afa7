"""Scalar and array expressions. All stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def position_rank(rank: Column, size: Column) -> Column:
    """(rank - 1) / (size - 1) for ranks from 1, and 0.5 for a single row. Unlike percent_rank, ties are told apart."""
    return F.when(size > 1, (rank - 1) / (size - 1)).otherwise(F.lit(0.5))


def sigmoid(z: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def decision(score: Column, flagged: Column | None = None, resolved: float = 0.75, confirm: float = 0.40) -> Column:
    """resolved, needs_confirmation or not_found; a flagged answer can't be resolved."""
    sure = score >= resolved if flagged is None else (score >= resolved) & ~flagged
    return F.when(sure, "resolved").when(score >= confirm, "needs_confirmation").otherwise("not_found")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is 0."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def set_measures(gold: Column, pred: Column) -> dict[str, Column]:
    """Precision, recall, F1, Jaccard and exactness of two sets; empty denominators count 0."""
    both = F.size(F.array_intersect(gold, pred)).cast("double")
    either = F.size(F.array_union(gold, pred))
    n_gold, n_pred = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    precision, recall = ratio(both, n_pred), ratio(both, n_gold)
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "jaccard": ratio(both, either),
        "exact": (both == n_gold) & (both == n_pred) & (both > 0),
    }


def recall_at(gold: Column, ranked: Column, k: int) -> Column:
    """Share of gold found among the first k; null for an empty gold."""
    return F.size(F.array_intersect(gold, F.slice(ranked, 1, k))) / F.nullif(F.size(F.array_distinct(gold)), F.lit(0))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Closed intervals meet."""
    return (a_hi >= b_lo) & (a_lo <= b_hi)


def first_failure(gates: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first gate that isn't passed (null counts as not passed); null if all are."""
    out = F.lit(None).cast("string")
    for name, passed in reversed(gates):
        out = F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def number(text: Column) -> Column:
    """A double from text; null for blanks and what isn't a number."""
    return F.trim(text).try_cast("double")


def ordinal_suffix(name: Column) -> Column:
    """1..8 for a suffix _a.._h, or the number of a suffix of digits; null else."""
    letter = F.regexp_extract(name, r"_([a-h])$", 1)
    digits = F.regexp_extract(name, r"_(\d+)$", 1)
    return F.coalesce(F.when(letter != "", F.ascii(letter) - 96), digits.try_cast("int"))


def is_subset(inner: Column, outer: Column) -> Column:
    """Whether all members of a set are in another; an empty set is in any."""
    return F.size(F.array_except(inner, outer)) == 0


def _escaped(text: Column) -> Column:
    """A string as JSON in ASCII alone: quotes, backslashes and control characters escaped, all beyond ASCII as \\uXXXX, pairs beyond 16 bits."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def of(c: Column) -> Column:
        # The code point, from UTF-32.
        code = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        out = F.when(code >= 0x10000, F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00))).when((code < 32) | (code > 126), unit(code)).otherwise(c)
        for raw, seen in named.items():
            out = F.when(c == raw, seen).otherwise(out)
        return out

    plain = text.rlike(r'^[ !#-\[\]-~]*\z')
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(F.array_join(F.transform(letters, of), "")), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """A value of any nesting of structs, maps with string keys, arrays, strings, whole numbers, booleans and nulls as JSON with sorted keys, no blanks, ASCII alone.

    Fields that are null are written as null. Fractions are refused: engines don't agree on their digits, so hashes of them mean nothing.
    """
    if isinstance(kind, T.StructType):
        parts = []
        for k, f in enumerate(sorted(kind.fields, key=lambda f: f.name)):
            parts += [F.lit(("," if k else "") + json.dumps(f.name) + ":"), canonical_json(value[f.name], f.dataType)]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts, F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("keys must be strings")
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_escaped(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _escaped(value)
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = value.cast("string")
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))
