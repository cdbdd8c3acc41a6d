"""Attribute-value rows into wide tables.

The attribute list and the value types are discovered first; the rows are then
reduced to one per entity and attribute, duplicates being resolved explicitly, and
pivoted with one conditional aggregation per attribute.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quakeweave.operators.metrics import reattach
from quakeweave.runtime import cut_lineage

RESOLUTIONS = ("latest", "earliest", "max", "min", "mean")
#: More columns than these are made in blocks, as one aggregation of thousands is neither compiled nor small in memory.
BLOCK_COLUMNS = 400


@dataclass(frozen=True)
class Attribute:
    name: str
    rows: int
    types: tuple[str, ...]


def _kind(value: Column, declared: T.DataType) -> list[Column]:
    """Counts from which the type of a value column is told: present, numbers, whole numbers."""
    if not isinstance(declared, T.StringType):
        return []
    number = value.try_cast("double")
    whole = F.coalesce(F.trim(value).rlike(r"^[+-]?[0-9]{1,18}$"), F.lit(False))
    return [F.count(value), F.count(number), F.count_if(whole)]


def discover_attributes(df: DataFrame, attribute: str, values: list[str], max_attributes: int = 20_000) -> list[Attribute]:
    """Names, row counts and value types of all attributes, ordered by name.

    A text column whose present values are all whole numbers becomes ``bigint``, all
    numbers ``double``, else it stays ``string``; other columns keep their type. Rows
    without an attribute are left out. The result has one entry per attribute, so it is
    a list of column names; beyond ``max_attributes`` a wide table is no longer useful
    and ValueError is raised rather than a part being dropped. ``reduce_cells`` gives the
    same cells as rows, for any number of attributes.
    """
    fields = df.schema
    aggs, at = [F.count(F.lit(1)).alias("n")], {}
    for v in values:
        kinds = _kind(F.col(v), fields[v].dataType)
        at[v] = [f"{v}__{k}" for k in range(len(kinds))]
        aggs += [c.alias(a) for c, a in zip(kinds, at[v])]
    found = df.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("__a")).agg(*aggs).limit(max_attributes + 1).collect()
    if len(found) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes in {attribute}")
    out = []
    for r in sorted(found, key=lambda r: r["__a"]):
        types = []
        for v in values:
            if not at[v]:
                types.append(fields[v].dataType.simpleString())
                continue
            present, number, whole = (r[c] for c in at[v])
            types.append("bigint" if present and whole == present else "double" if present and number == present else "string")
        out.append(Attribute(r["__a"], r["n"], tuple(types)))
    return out


def column_token(name: str) -> str:
    """A column name of letters, digits and ``_``: ``PSA@2.00`` -> ``psa_2p00``."""
    return re.sub(r"\W+", "_", name.lower().replace(".", "p")).strip("_") or "unnamed"


_OWN = ("n_attributes", "n_rows", "conflicts")


def wide_names(attributes: list[Attribute], suffixes: list[str], reserved: list[str]) -> dict[str, list[str]]:
    """Column names of each attribute, one per suffix; attributes whose names would clash with others get a number."""
    taken = {c.lower() for c in reserved}
    out: dict[str, list[str]] = {}
    for a in attributes:
        base, k = column_token(a.name), 1
        while True:
            token = base if k == 1 else f"{base}_{k}"
            names = [f"{token}_{s}" if s else token for s in suffixes]
            if not taken & {n.lower() for n in names}:
                break
            k += 1
        taken |= {n.lower() for n in names}
        out[a.name] = names
    return out


def _pick(value: Column, order: Column, resolution: str) -> Column:
    if resolution in ("latest", "earliest"):
        pair = F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))
        return (F.max if resolution == "latest" else F.min)(pair)["v"]
    return {"max": F.max, "min": F.min, "mean": F.avg}[resolution](value)


def reduce_cells(
    df: DataFrame, entity: list[str], attribute: str, values: list[str], order: list[str], *, resolution: str = "latest", tolerance: float | None = None
) -> DataFrame:
    """One row per entity and attribute: the resolved values, ``__rows`` and ``__conflict``.

    With ``tolerance``, a cell conflicts if in one of the value columns at least two
    finite numbers above 0 occur, the largest being more than ``tolerance`` times the
    smallest; without, if at least two different values occur. The partial aggregation
    before the shuffle leaves at most one row per cell and task, so a hot entity or
    attribute is no hot task.
    """
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {RESOLUTIONS}")
    when = F.struct(*[F.col(c) for c in order])
    picked, conflicts = [], []
    for v in values:
        picked.append(_pick(F.col(v), when, resolution).alias(v))
        if tolerance is None:
            conflicts.append(F.min(v) < F.max(v))
        else:
            c = F.col(v)
            ok = F.when((c > 0) & (c < float("inf")) & ~F.isnan(c), c)
            conflicts.append((F.count(ok) >= 2) & (F.max(ok) > F.lit(tolerance) * F.min(ok)))
    conflict = F.lit(False)
    for c in conflicts:
        conflict = conflict | F.coalesce(c, F.lit(False))
    keyed = df.where(F.col(attribute).isNotNull())
    return keyed.groupBy(*entity, attribute).agg(*picked, F.count(F.lit(1)).alias("__rows"), conflict.alias("__conflict"))


def widen(
    df: DataFrame,
    entity: list[str],
    attribute: str,
    values: list[str],
    order: list[str],
    *,
    resolution: str = "latest",
    tolerance: float | None = None,
    suffixes: list[str] | None = None,
    attributes: list[Attribute] | None = None,
) -> DataFrame:
    """One row per entity with a typed column for each attribute and value column.

    Columns: the entity's, ``<attribute>_<suffix>`` (without suffix if there is one value
    column and none is given), ``n_attributes``, ``n_rows`` and ``conflicts``, the sorted
    names of the attributes whose rows disagree (see ``reduce_cells``).

    Defined results: rows without an attribute take no part; NULL entity columns form an
    entity of their own; NULL values never win over others, and a cell without any is
    NULL; among rows of one cell the ``resolution`` decides, ``latest`` by the greatest
    ``order`` columns and then the greatest value; a value that does not cast to the
    discovered type becomes NULL (none can, if the types come from the same rows);
    attributes whose column names would clash with others or the entity's are numbered; an empty input gives the
    entity columns and an empty table. Other columns of the input are ignored.
    """
    attributes = discover_attributes(df, attribute, values) if attributes is None else attributes
    suffixes = suffixes if suffixes is not None else ([""] if len(values) == 1 else list(values))
    names = wide_names(attributes, suffixes, [*entity, *_OWN])
    cells = reduce_cells(df, entity, attribute, values, order, resolution=resolution, tolerance=tolerance)
    if len(attributes) * len(values) > BLOCK_COLUMNS:
        return _in_blocks(cells, entity, attribute, values, attributes, names)
    aggs = []
    for a in attributes:
        here = F.col(attribute) == F.lit(a.name)
        for v, kind, name in zip(values, a.types, names[a.name]):
            value = F.max(F.when(here, F.col(v)))
            aggs.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    flags = [F.when(F.max(F.when(F.col(attribute) == F.lit(a.name), F.col("__conflict"))), F.lit(a.name)) for a in attributes]
    named = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
    return cells.groupBy(*entity).agg(*aggs, F.count(F.lit(1)).alias("n_attributes"), F.sum("__rows").alias("n_rows"), named.alias("conflicts"))


def _in_blocks(cells: DataFrame, entity: list[str], attribute: str, values: list[str], attributes: list[Attribute], names: dict[str, list[str]]) -> DataFrame:
    """The wide table in blocks of columns, each made from its own attributes' cells and joined by entity."""
    cells = cut_lineage(cells, "cells")
    conflicts = F.sort_array(F.collect_list(F.when(F.col("__conflict") & F.col(attribute).isin(*[a.name for a in attributes]), F.col(attribute))))
    out = cells.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_attributes"), F.sum("__rows").alias("n_rows"), conflicts.alias("conflicts"))
    size = max(1, BLOCK_COLUMNS // len(values))
    for k in range(0, len(attributes), size):
        block = attributes[k : k + size]
        aggs = []
        for a in block:
            here = F.col(attribute) == F.lit(a.name)
            for v, kind, name in zip(values, a.types, names[a.name]):
                value = F.max(F.when(here, F.col(v)))
                aggs.append((value if kind == "string" else value.try_cast(kind)).alias(name))
        own = cells.where(F.col(attribute).isin(*[a.name for a in block])).groupBy(*entity).agg(*aggs)
        out = reattach(out, cut_lineage(own, "block"), entity)
    ordered = [n for a in attributes for n in names[a.name]]
    return out.select(*entity, *[F.col(f"`{n}`") for n in ordered], *_OWN)
