"""Slots of templates: what a slot's type and options draw, and which commodity a template names.

Pools (type, t, tr) and commodity units are rows; a slot picks from the rows of its type
by the hash of its draw and name.  An unknown type and a type without rows raise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws as R
from ..functions import similarity as S
from ..functions import text as X
from . import generation as G

# Ranges of deadlines, weighed commodities, spellings that templates also use.
DEADLINES = {"weeks": (2, 70), "months": (1, 12), "days": (2, 30), "years": (1, 5)}
WEIGHED = ("silver", "tin", "copper", "gold", "wool", "iron", "lapis_lazuli", "barley", "wheat")
SPELLINGS = {"GUSKIN": "gold", "KU.KI": "gold", "ANSE": "donkeys", "ANSE.HI.A": "donkeys"}
POOLED = ("name", "place", "month", "eponym", "occupation", "item", "festival")
SIMPLE_MOST = 30


def _both(c: Column) -> Column:
    return F.struct(c.alias("t"), c.alias("tr"))


def plain(template: Column) -> Column:
    """A template's source text without slots and marks, in capitals."""
    return F.upper(S.strip_marks(F.regexp_replace(template, r"(?U)\{\w+_TL\}", "")))


def signs(named: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(sign, commodity) of commodities (key, source text) and other spellings, the longest first."""
    bare = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).upper()
    return sorted([(bare(t), k) for k, t in named if t] + list(SPELLINGS.items()), key=lambda x: -len(x[0]))


def detected(text: Column, named: list[tuple[str, str]]) -> Column:
    """The commodity with the longest sign in a ``plain`` text, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(sign)), F.lit(k)) for sign, k in signs(named)])


def embedded(text: Column, commodity: Column, named: list[tuple[str, str]]) -> Column:
    """Whether a ``plain`` text has a sign of this commodity."""
    out = F.lit(False)
    for sign, k in signs(named):
        out = out | ((commodity == k) & F.contains(text, F.lit(sign)))
    return F.coalesce(out, F.lit(False))


def bare_number(units: Column, seed: str, *keys: Column) -> Column:
    """A number in the range of one of the units (an array), with some chance of a fraction."""
    u = F.get(units, R.integer(F.size(units), f"{seed}unit", *keys))
    sign = F.get(F.array(*[F.lit(s) for s in G.SIGNS]), R.integer(len(G.SIGNS), f"{seed}sign", *keys))
    sign = F.when(R.uniform(f"{seed}has", *keys) < G.FRACTION_SHARE, sign)
    return _both(F.concat_ws(" ", (u["low"] + R.integer(u["high"] - u["low"] + 1, f"{seed}n", *keys)).cast("string"), sign))


def simple_amount(units: Column, c_t: Column, c_tr: Column, seed: str, *keys: Column) -> Column:
    """One tier, at most SIMPLE_MOST, no fraction."""
    u = F.get(units, R.integer(F.size(units), f"{seed}unit", *keys))
    n = u["low"] + R.integer(F.least(u["high"], F.lit(SIMPLE_MOST)) - u["low"] + 1, f"{seed}n", *keys)
    single = u["u_tr"]
    for plural, s in G.SINGULAR.items():
        single = F.when((u["u_tr"] == plural) & (n == 1), s).otherwise(single)
    some = lambda c: F.when(c != "", c)
    n = n.cast("string")
    t = F.concat_ws(" ", n, some(u["u_t"]), some(c_t))
    return F.struct(t.alias("t"), F.concat_ws(" ", n, some(single), F.concat(F.lit("of "), some(c_tr))).alias("tr"))


def deadline_number(unit: Column, seed: str, *keys: Column) -> Column:
    """A number in the range of a unit of time; of a drawn one where it is null or unknown."""
    names = F.array(*[F.lit(u) for u in DEADLINES])
    unit = F.when(unit.isin(*DEADLINES), unit).otherwise(F.get(names, R.integer(len(DEADLINES), f"{seed}unit", *keys)))
    n = F.coalesce(*[F.when(unit == u, R.integer(b - a + 1, f"{seed}n", *keys) + a) for u, (a, b) in DEADLINES.items()])
    return _both(n.cast("string"))


def rate_number(seed: str, *keys: Column) -> Column:
    """A rate of interest without its unit, by weight."""
    return _both(F.trim(F.replace(R.weighted(G.RATES, f"{seed}rate", *keys), F.lit("GÍN.TA"), F.lit(""))))


def from_values(values: Column, lone: Column, seed: str, *keys: Column) -> Column:
    """One of 'source/target' values; one without a slash is both sides where ``lone``, and raises elsewhere."""
    pick = F.get(values, R.integer(F.size(values), f"{seed}value", *keys))
    at = F.locate("/", pick)
    two = F.struct(F.trim(F.substr(pick, F.lit(1), at - 1)).alias("t"), F.trim(F.substr(pick, at + 1)).alias("tr"))
    return F.when(at > 0, two).when(lone, _both(pick)).otherwise(F.raise_error(F.concat(F.lit("value without a slash: "), pick)))


def resolve(slots: DataFrame, pools: DataFrame, unit_table: DataFrame, seed: int) -> DataFrame:
    """draw, name, t, tr of every slot, for ``generation.fill``.

    ``slots``: draw, name, type, options (map of strings), values (array of strings or
    null), template (source text) and types (of all slots of the template).
    """
    order = {u[0]: k for k, u in reversed(list(enumerate(G.UNITS)))}
    known = sorted((tuple(r) for r in unit_table.select("commodity", "c_t", "c_tr").distinct().collect()), key=lambda x: (order.get(x[0], len(order) * 9), x[0]))
    keys, named = [k for k, *_ in known], [(k, t) for k, t, _ in known]
    k, option = F.col("_k"), lambda name: F.col("options")[name]
    yes = lambda c: F.coalesce((c != "") & (F.lower(c) != "false"), F.lit(False))
    s = str(seed)
    rows = slots.withColumns({"_k": F.concat_ws("/", "draw", "name"), "_plain": plain(F.coalesce("template", F.lit("")))})
    has = F.coalesce(F.size("values") > 0, F.lit(False)) & F.col("type").isin("commodity", "place", "occupation")
    number = F.col("name").isin("NUM", "N")
    kind = F.when((F.col("type") == "amount") & number, "number").when((F.col("type") == "amount") & yes(option("bare_number")), "bare")
    rows = rows.withColumn("_kind", kind.when(has, "values").otherwise(F.col("type")))
    # The commodity of an amount, and whether its text names it.
    want, label = option("commodity"), F.array_contains("types", "commodity")
    label = F.coalesce(label, F.lit(False))
    found = F.when(label, "silver").otherwise(detected(F.col("_plain"), named))
    drawn = F.get(F.array(*[F.lit(x) for x in keys]), R.integer(len(keys), f"{s}commodity", k))
    valid = F.coalesce(want.isin(*keys), F.lit(False))
    own = option("commodity_key")
    rows = rows.withColumns({
        "_found": found, "commodity": F.when(F.col("_kind") == "bare", F.when(own.isin(*keys), own).otherwise("silver")).when(valid, want).when(yes(want), "silver").otherwise(F.coalesce(found, drawn)),
        "_names": F.when(valid, ~(label | embedded(F.col("_plain"), want, named))).otherwise(~yes(want) & found.isNull()),
    })
    out = ["draw", "name", "t", "tr"]
    parts = []
    for names in (True, False):
        asked = rows.where((F.col("_kind") == "amount") & (F.col("_names") == names)).select("draw", "name", "_k", "commodity")
        parts.append(G.amounts(asked, seed, unit_table, names, "_k").select(out))
    # Rows of a pool by number: neither side is sent whole.
    by = Window.partitionBy("type").orderBy("t", "tr")
    sizes = F.broadcast(pools.groupBy("type").agg(F.count("*").alias("_size")))  # a row a type
    asked = rows.where(F.col("_kind").isin(*POOLED)).join(sizes, "type", "left")
    asked = asked.withColumn("_at", F.floor(R.uniform(f"{s}pool", k) * F.col("_size")).cast("int"))
    picked = asked.join(pools.select("type", "t", "tr", (F.row_number().over(by) - 1).alias("_at")), ["type", "_at"], "left")
    none = F.raise_error(F.concat(F.lit("no rows in the pool of slot type "), F.col("type"))).cast("string")
    t = F.when(F.col("_size").isNull(), none).when(F.col("type") == "name", X.name_case(F.col("t"))).otherwise(F.col("t"))
    parts.append(picked.select("draw", "name", t.alias("t"), "tr"))
    # The rest needs no table but the units.
    listed = unit_table.groupBy("commodity").agg(F.sort_array(F.collect_list(F.struct("low", "high", "u_t", "u_tr"))).alias("_units"))
    rest = rows.where(~F.col("_kind").isin("amount", *POOLED)).join(F.broadcast(listed), "commodity", "left")
    labels = F.filter(
        F.array(*[F.struct(F.lit(a).alias("k"), F.lit(b).alias("t"), F.lit(c).alias("tr")) for a, b, c in known]),
        lambda x: (~yes(option("weight_only")) | x["k"].isin(*WEIGHED)) & (~yes(option("exclude_silver")) | (x["k"] != "silver")),
    )
    one = F.get(labels, R.integer(F.size(labels), f"{s}label", k))
    is_ = lambda name: F.col("_kind") == name
    small = _both((R.integer(12, f"{s}n", k) + 1).cast("string"))
    value = (
        F.when(is_("number"), F.when(yes(option("unit")), deadline_number(option("unit"), s, k)).otherwise(small))
        .when(is_("bare"), bare_number(F.col("_units"), s, k)).when(is_("values"), from_values(F.col("values"), F.col("type") == "occupation", s, k))
        .when(is_("deadline"), deadline_number(option("unit"), s, k)).when(is_("rate"), rate_number(s, k))
        .when(is_("commodity"), F.struct(one["t"].alias("t"), one["tr"].alias("tr")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown slot type: "), F.coalesce("type", F.lit("null")))))
    )
    parts.append(rest.withColumn("_v", value).select("draw", "name", "_v.t", "_v.tr"))
    first, *others = parts
    for p in others:
        first = first.unionByName(p)
    return first
