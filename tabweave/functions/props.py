"""Property lists (arrays of name, value, type in insertion order), as a Python dict would hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabweave.schema import PROPS

#: Names that give a node its title, in order of preference (fixed values).
TITLE_KEYS = ("name", "period", "key", "hostname", "title", "id")
#: Node ids that start so are not shown as titles (fixed values).
HIDDEN_IDS = ("entity_", "attr_", "metric_", "time_", "cat_", "node_")


def prop(k: Column | str, v: Column, t: str = "str") -> Column:
    return F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), v.cast("string").alias("v"), F.lit(t).alias("t"))


def props(*items: Column) -> Column:
    """An array of properties; without any, an empty one."""
    return F.array(*items).cast(PROPS) if items else F.array().cast(PROPS)


def last_wins(a: Column) -> Column:
    """Each name once, at its first place, with its last value."""
    keys = F.array_distinct(F.transform(a, lambda p: p["k"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(a, lambda p: p["k"] == k), -1))


def public(a: Column) -> Column:
    """Without names that begin with an underscore, and without label."""
    return F.filter(a, lambda p: ~F.startswith(p["k"], F.lit("_")) & (p["k"] != "label"))


def listed(a: Column, between: str, sep: str = ", ") -> Column:
    """'k<between>v' of each, joined."""
    return F.array_join(F.transform(a, lambda p: F.concat(p["k"], F.lit(between), p["v"])), sep)


def in_brackets(a: Column) -> Column:
    """' (k=v, ...)' or nothing."""
    shown = public(a)
    return F.when(F.size(shown) > 0, F.concat(F.lit(" ("), listed(shown, "="), F.lit(")"))).otherwise("")


def display(node_id: Column, label: Column, a: Column) -> Column:
    """Label, quoted title and the other properties of a node."""
    shown = public(a)
    named = lambda k: F.get(F.filter(shown, lambda p: (p["k"] == k) & (p["v"] != "")), F.lit(0))["v"]
    titles = [named(k) for k in TITLE_KEYS]
    first = F.get(shown, F.lit(0))
    hidden = F.lit(False)
    for start in HIDDEN_IDS:
        hidden = hidden | F.startswith(node_id, F.lit(start))
    title = F.coalesce(*titles, F.when(~hidden, node_id), F.concat(first["k"], F.lit(": "), first["v"]), F.lit(""))
    extra = F.filter(shown, lambda p: (p["v"] != title) & (p["v"] != ""))
    return F.concat(label, F.lit(" '"), F.when(title != "", title).otherwise(node_id), F.lit("'"), F.when(F.size(extra) > 0, F.concat(F.lit(" ("), listed(extra, "="), F.lit(")"))).otherwise(""))
