"""XML documents as typed rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class XmlColumn:
    """One output column; ``path`` is relative to the row element and defaults to the name.

    A path may climb (``../../name``), name a child (``a/b``) or an attribute (``@id``).
    """

    name: str
    data_type: str = "string"
    path: str | None = None
    not_null: bool = False
    default: object = None
    ordinality: bool = False


def _place(column: XmlColumn, depth: int) -> tuple[int, list[str]]:
    """The level a path starts from and its field names there."""
    level, fields = depth, []
    for step in (column.path or column.name).split("/"):
        if step == "..":
            level -= 1
        elif step != ".":
            fields.append("_" + step[1:] if step.startswith("@") else step)
    if level < 0 or not fields:
        raise ValueError(f"path of {column.name} leaves the document or names nothing")
    return level, fields


def _add(tree: dict, fields: list[str]) -> None:
    for name in fields[:-1]:
        tree = tree.setdefault(name, {})
    tree.setdefault(fields[-1], None)


def _struct(tree: dict) -> T.StructType:
    return T.StructType(
        [T.StructField(n, T.StringType() if sub is None else _struct(sub)) for n, sub in tree.items()]
    )


def _schema(steps: list[str], trees: list[dict]) -> T.StructType:
    """Schema of the root element: each step of the row path is a list inside the one before."""
    inner = _struct(trees[-1])
    for step, tree in zip(reversed(steps[1:]), reversed(trees[:-1])):
        inner = T.StructType([*_struct(tree).fields, T.StructField(step, T.ArrayType(inner))])
    return inner


def xml_table(df: DataFrame, xml: str, row_path: str, columns: Sequence[XmlColumn]) -> DataFrame:
    """One row per element at ``row_path``, with the other columns of the document's row kept.

    The document is parsed once into nested lists holding only the named fields. Ancestors stay in
    reach while the lists are unfolded inside the row, so ordinality needs no window. A missing
    value takes its default; one in a NOT NULL column is an error.
    """
    steps = row_path.strip("/").split("/")
    depth = len(steps) - 1
    trees: list[dict] = [{} for _ in steps]
    places = {}
    for c in columns:
        if not c.ordinality:
            places[c.name] = _place(c, depth)
            _add(trees[places[c.name][0]], places[c.name][1])

    def value(c: XmlColumn, scope: list[Column]) -> Column:
        level, fields = places[c.name]
        out = scope[level]
        for f in fields:
            out = out[f]
        return out

    def unfold(level: int, scope: list[Column]) -> Column:
        if level == depth:
            return F.array(F.struct(*[value(c, scope).alias(c.name) for c in columns if not c.ordinality]))
        below = scope[-1][steps[level + 1]]
        rows = F.transform(below, lambda e: unfold(level + 1, [*scope, e]))
        return F.flatten(F.filter(rows, lambda r: r.isNotNull()))

    others = [c for c in df.columns if c != xml]
    parsed = df.select(*others, F.from_xml(xml, _schema(steps, trees).simpleString()).alias("_doc"))
    rows = parsed.select(*others, F.posexplode(unfold(0, [F.col("_doc")])).alias("_pos", "_row"))

    def output(c: XmlColumn) -> Column:
        if c.ordinality:
            return (F.col("_pos") + 1).cast("bigint").alias(c.name)
        out = F.col("_row")[c.name].cast(c.data_type)
        if c.default is not None:
            out = F.coalesce(out, F.lit(c.default).cast(c.data_type))
        if c.not_null:
            out = F.when(out.isNull(), F.raise_error(F.lit(f"null in column {c.name}"))).otherwise(out)
        return out.alias(c.name)

    return rows.select(*others, *[output(c) for c in columns])
