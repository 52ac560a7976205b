"""JSON text written field by field, in the two-space layout of the report documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.base import ColumnOrName, bind, col


def json_value(value: ColumnOrName) -> Column:
    """JSON text of one scalar, ``null`` included."""
    wrapped = F.to_json(F.struct(col(value).alias("v")), {"ignoreNullFields": "false"})
    # Cut as bytes, which needs no count of characters.
    return bind(wrapped.cast("binary"), lambda w: F.substring(w, F.lit(6), F.length(w) - 6).cast("string"))


def json_number(value: ColumnOrName) -> Column:
    """The same of a whole number or a truth value, whose text is its JSON form."""
    return F.coalesce(col(value).cast("string"), F.lit("null"))


def json_word(value: ColumnOrName) -> Column:
    """The same of text that holds nothing to escape, such as keys, instants and closed sets."""
    return F.coalesce(F.concat(F.lit('"'), col(value), F.lit('"')), F.lit("null"))


def pretty_list(elements: Column, render, indent: int) -> Column:
    """A JSON array with one rendered element per entry; ``[]`` when empty."""
    pad = "\n" + " " * (indent + 2)
    body = F.array_join(F.transform(elements, render), "," + pad)
    return F.when(F.size(elements) > 0, F.concat(F.lit("[" + pad), body, F.lit("\n" + " " * indent + "]"))).otherwise(
        F.lit("[]")
    )


def pretty_object(fields: list[tuple[str, Column]], indent: int) -> Column:
    """A JSON object of already rendered values, its closing brace at ``indent``."""
    pad = "\n" + " " * (indent + 2)
    parts = [F.lit("{")]
    for i, (name, text) in enumerate(fields):
        parts += [F.lit(("," if i else "") + pad + f'"{name}": '), text]
    parts.append(F.lit("\n" + " " * indent + "}"))
    return F.concat(*parts)


def list_layout(n: Column, indent: int) -> Column:
    """Characters ``pretty_list`` adds to the one-line JSON of a list of ``n``."""
    return F.when(n > 0, n * (indent + 3) + indent + 1).otherwise(0)


def object_layout(n_fields: int, indent: int) -> int:
    """Characters ``pretty_object`` adds to the one-line JSON of an object."""
    return n_fields * (indent + 4) + indent + 1


def pretty_details(details: ColumnOrName, indent: int) -> Column:
    """The flat JSON text of error details, laid out at ``indent``."""
    pad = "\n" + " " * (indent + 2)
    entries = F.from_json(col(details), "map<string,string>", {"primitivesAsString": "true"})
    # Values keep their JSON form: numbers and null bare, text quoted.
    raw = F.transform(
        F.map_keys(entries),
        lambda k: F.concat(
            json_value(k),
            F.lit(": "),
            F.when(entries[k].isNull(), F.lit("null"))
            .when(entries[k].rlike(r"^-?[0-9]+\z") & (k != "retry_after"), entries[k])
            .otherwise(json_value(entries[k])),
        ),
    )
    return F.when(
        F.size(raw) > 0,
        F.concat(F.lit("{" + pad), F.array_join(raw, "," + pad), F.lit("\n" + " " * indent + "}")),
    ).otherwise(F.lit("{}"))
