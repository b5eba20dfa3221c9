"""Seeds, drawn amounts and names, template filling.

Pools and commodity units are rows, so a caller's tables replace the small ones here.
All choices are hash draws: the same seed gives the same rows on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws as R

# Commodity, source, target; unit source, unit target, range, unit of the second tier.
UNITS = [
    ("silver", "KÙ.BABBAR", "silver", "GÍN", "shekels", 1, 60, None), ("silver", "KÙ.BABBAR", "silver", "ma-na", "minas", 1, 50, "GÍN"),
    ("silver", "KÙ.BABBAR", "silver", "GÚ", "talents", 1, 5, "ma-na"), ("tin", "AN.NA", "tin", "GÍN", "shekels", 1, 60, None),
    ("tin", "AN.NA", "tin", "ma-na", "minas", 1, 60, "GÍN"), ("tin", "AN.NA", "tin", "GÚ", "talents", 1, 10, "ma-na"),
    ("copper", "URUDU", "copper", "ma-na", "minas", 1, 300, None), ("copper", "URUDU", "copper", "GÚ", "talents", 1, 20, "ma-na"),
    ("gold", "KÙ.GI", "gold", "GÍN", "shekels", 1, 30, None), ("gold", "KÙ.GI", "gold", "ma-na", "minas", 1, 10, "GÍN"),
    ("iron", "KÙ.AN", "meteoric iron", "GÍN", "shekels", 1, 30, None), ("iron", "KÙ.AN", "meteoric iron", "ma-na", "minas", 1, 5, "GÍN"),
    ("wool", "SÍG.HI.A", "wool", "ma-na", "minas", 1, 60, None), ("wool", "SÍG.HI.A", "wool", "GÚ", "talents", 1, 30, "ma-na"),
    ("barley", "ŠE-am", "barley", "na-ru-uq", "sacks", 1, 50, None), ("barley", "ŠE-am", "barley", "DUG", "jars", 1, 10, None),
    ("wheat", "GIG", "wheat", "na-ru-uq", "sacks", 1, 50, None), ("wheat", "GIG", "wheat", "DUG", "jars", 1, 10, None),
    ("textiles", "TÚG", "textiles", "", "", 1, 300, None), ("kutanu", "ku-ta-nu", "kutānu-textiles", "", "", 1, 200, None),
    ("donkeys", "ANŠE", "donkeys", "", "", 1, 30, None), ("sheep", "UDU", "sheep", "", "", 1, 25, None),
    ("bread", "NINDA", "loaves of bread", "", "", 1, 100, None), ("hides", "maš-ku", "hides", "", "", 1, 200, None),
    ("lapis_lazuli", "hu-sà-ri-im", "lapis lazuli", "GÍN", "shekels", 1, 30, None), ("lapis_lazuli", "hu-sà-ri-im", "lapis lazuli", "ma-na", "minas", 1, 20, "GÍN"),
]
# Qualifiers of commodities; none is always possible too.
QUALIFIERS = {
    "silver": [("ṣa-ru-pá-am", "refined"), ("SIG5", "good"), ("li-ti", "tested")], "tin": [("qá-tim", "loose")],
    "copper": [("SIG5", "good"), ("ma-sí-am", "washed"), ("ší-ku-um", "šikku-"), ("lá-mu-nam", "bad"), ("ša-bu-ra-am", "broken"), ("ṣa-la-mì-im", "black")],
    "gold": [("pá-ša-lam", "pašallum")], "textiles": [("SIG5", "good"), ("ra-qá-tim", "thin"), ("ša qá-tim", "ordinary")],
    "kutanu": [("SIG5", "fine"), ("šu-ru-tum", "dark"), ("a-bar-ni-am", "Abarnian")], "donkeys": [("ṣa-lá-mu", "black")],
}
# Fraction signs, singulars, rates of interest with their weights.
SIGNS = ["½", "⅓", "⅔", "¼", "⅙", "⅚"]
SINGULAR = {"shekels": "shekel", "minas": "mina", "talents": "talent", "sacks": "sack", "jars": "jar", "grains": "grain"}
RATES = {
    "½ GÍN.TA": 5, "1 GÍN.TA": 12, "1 ½ GÍN.TA": 51, "2 GÍN.TA": 6, "3 GÍN.TA": 9, "⅓ GÍN.TA": 2,
    "¼ GÍN.TA": 2, "⅚ GÍN.TA": 1, "1 ⅓ GÍN.TA": 2, "1 ¼ GÍN.TA": 1, "⅔ GÍN.TA": 1, "1 ⅙ GÍN.TA": 2,
}
COMPOUND_SHARE, FRACTION_SHARE, RANGES = 0.35, 0.4, 64


def units(spark: SparkSession) -> DataFrame:
    schema = "commodity string, c_t string, c_tr string, u_t string, u_tr string, low int, high int, sub string"
    return spark.createDataFrame(UNITS, schema)


def few_shot(pool: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """One row: a random n rows of the pool as JSON text, in hash order."""
    order = R.order_key(seed, *[F.col(k) for k in keys])
    picked = pool.withColumn("_o", order).orderBy("_o", *keys).limit(n)
    body = F.struct(*[c for c in pool.columns])
    return picked.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_o", body.alias("r")))), lambda x: x["r"])).alias("examples"))


def targets(pool: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, available, target: proportional shares with a floor of a third of an equal share.

    What the shares leave over goes to the largest strata, as far as they have rows.
    """
    counts = pool.groupBy(stratum).agg(F.count("*").alias("available"))
    whole = F.broadcast(counts.agg(F.sum("available").alias("_all"), F.count("*").alias("_strata")))  # one row
    n_ = F.least(F.lit(n), F.col("_all"))
    floor = F.greatest(F.lit(1), F.floor(n_ / (F.col("_strata") * 3)))
    first = F.least(F.col("available"), F.greatest(floor, F.floor(n_ * F.col("available") / F.col("_all"))))
    rows = counts.join(whole).select(stratum, "available", first.alias("_t"), n_.alias("_n"))
    all_ = Window.partitionBy(F.lit(0))  # one row a stratum
    left = F.greatest(F.lit(0), F.col("_n") - F.sum("_t").over(all_))
    room = F.col("available") - F.col("_t")
    before = F.coalesce(F.sum(room).over(Window.orderBy(F.desc("available"), stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_left": left, "_before": before, "_room": room})
    extra = F.least("_room", F.greatest(F.lit(0), F.col("_left") - F.col("_before")))
    return rows.select(stratum, "available", (F.col("_t") + extra).cast("int").alias("target"))


def stratified(pool: DataFrame, stratum: str, document: str, key: str, n: int, seed: int, per_document: int = 2) -> DataFrame:
    """About n rows by ``targets``; at most ``per_document`` of a document where that leaves enough."""
    goal = targets(pool, stratum, n)
    rows = pool.withColumn("_o", R.order_key(seed, F.col(key)))
    rank = lambda *by: Window.partitionBy(*by)
    rows = rows.withColumn("_d", F.row_number().over(rank(stratum, document).orderBy("_o", key)))
    diverse = rows.groupBy(stratum).agg(F.sum((F.col("_d") <= per_document).cast("int")).alias("_diverse"))
    goal = goal.join(diverse, stratum)
    rows = rows.join(goal, stratum)
    within = (F.col("_d") <= per_document) | (F.col("_diverse") < F.col("target")) | (F.col("target") >= F.col("available"))
    rows = rows.where(within).withColumn("_r", F.row_number().over(rank(stratum).orderBy("_o", key)))
    return rows.where("_r <= target").select(pool.columns)


def amounts(draws: DataFrame, seed: int, unit_table: DataFrame, include: bool = True, key: str = "draw") -> DataFrame:
    """``draws`` (key, commodity) with an amount's source and target text.

    A unit is drawn; with some chance a second tier of its sub-unit; each number may
    carry a fraction; a unit of exactly one is singular.
    """
    k = F.col(key)
    listed = unit_table.groupBy("commodity", "c_t", "c_tr").agg(F.sort_array(F.collect_list(F.struct("low", "high", "u_t", "u_tr", "sub"))).alias("_units"))
    rows = draws.join(listed, "commodity")
    rows = rows.withColumn("_u", F.get("_units", R.integer(F.size("_units"), f"{seed}unit", k)))
    rows = rows.withColumn("_s", F.get(F.filter("_units", lambda u: u["u_t"] == F.col("_u.sub")), F.lit(0)))
    rows = rows.withColumn("_two", F.col("_s").isNotNull() & (R.uniform(f"{seed}two", k) < COMPOUND_SHARE))

    def number(tag: str, low: Column, high: Column) -> tuple[Column, Column]:
        n = low + R.integer(F.greatest(high - low + 1, F.lit(1)), f"{seed}{tag}", k)
        sign = F.get(F.array(*[F.lit(s) for s in SIGNS]), R.integer(len(SIGNS), f"{seed}{tag}sign", k))
        sign = F.when(R.uniform(f"{seed}{tag}has", k) < FRACTION_SHARE, sign)
        return F.concat_ws(" ", n.cast("string"), sign), (n == 1) & sign.isNull()

    def named(unit: Column, one: Column) -> Column:
        single = unit
        for plural, s in SINGULAR.items():
            single = F.when(unit == plural, s).otherwise(single)
        return F.when(one, single).otherwise(unit)

    u, s = F.col("_u"), F.col("_s")
    main, main_one = number("main", u["low"], F.when(F.col("_two"), F.greatest(F.floor(u["high"] / 2), F.lit(1)).cast("int")).otherwise(u["high"]))
    sub, sub_one = number("sub", F.lit(1), F.least(s["high"], F.lit(59)))
    filled = lambda c: F.when(c != "", c)
    q = F.lit(None).cast("struct<t:string,tr:string>")
    for name, options in QUALIFIERS.items():
        pool = F.array(F.lit(None).cast("struct<t:string,tr:string>"), *[F.struct(F.lit(a).alias("t"), F.lit(b).alias("tr")) for a, b in options])
        q = F.when(F.col("commodity") == name, F.get(pool, R.integer(len(options) + 1, f"{seed}qual", k))).otherwise(q)
    tier2 = lambda unit: F.when(F.col("_two"), F.concat_ws(" ", sub, filled(unit)))
    with_ = F.lit(include)
    t = F.concat_ws(" ", main, filled(u["u_t"]), tier2(s["u_t"]), F.when(with_, filled(F.col("c_t"))), F.when(with_, q["t"]))
    of = F.when(with_, F.concat(F.lit("of "), F.concat_ws(" ", q["tr"], F.col("c_tr"))))
    tr = F.concat_ws(" ", main, filled(named(u["u_tr"], main_one)), tier2(named(s["u_tr"], sub_one)), of)
    return rows.select(*draws.columns, t.alias("t"), tr.alias("tr"))


def from_pool(draws: DataFrame, pool: DataFrame, seed: int, key: str = "draw") -> DataFrame:
    """``draws`` with a row of a pool (t, tr, weight) each, in proportion to the weights.

    Weights are added up inside ranges of the pool and over the ranges, so no task holds all
    of a large pool; a draw finds its range by number, and its row among those of the range.
    """
    ranged = _in_ranges(pool.select("t", "tr", "weight"))
    ends = F.broadcast(ranged.groupBy("_p").agg(F.max("_b").alias("_end")).agg(F.sort_array(F.collect_list(F.struct("_end", "_p"))).alias("_ends")))  # RANGES numbers, one row
    rows = draws.join(ends).withColumn("_x", R.uniform(seed, F.col(key)) * F.element_at("_ends", -1)["_end"])
    rows = rows.withColumn("_p", F.get(F.filter("_ends", lambda e: e["_end"] > F.col("_x")), F.lit(0))["_p"]).drop("_ends")
    return rows.join(ranged, (rows["_p"] == ranged["_p"]) & (F.col("_x") >= F.col("_a")) & (F.col("_x") < F.col("_b"))).select(*draws.columns, "t", "tr")


def _in_ranges(pool: DataFrame) -> DataFrame:
    """``pool`` with its range ``_p`` in order of (t, tr) and the sum of weights before and with each row."""
    rows = pool.repartitionByRange(RANGES, "t", "tr").withColumn("_p", F.spark_partition_id())
    inside = F.sum("weight").over(Window.partitionBy("_p").orderBy("t", "tr", "weight").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside)
    sums = rows.groupBy("_p").agg(F.sum("weight").alias("_w"))
    before = sums.select("_p", (F.sum("_w").over(Window.orderBy("_p")) - F.col("_w")).alias("_before"))  # a row a range
    rows = rows.join(F.broadcast(before), "_p")
    return rows.select("t", "tr", "_p", (F.col("_before") + F.col("_in") - F.col("weight")).alias("_a"), (F.col("_before") + F.col("_in")).alias("_b"))


def fill(templates: DataFrame, values: DataFrame) -> DataFrame:
    """``templates`` (draw, t, tr) with slots {name_TL} and {name_TR} replaced by ``values`` (draw, name, t, tr).

    A value that ends in the enclitic loses it where the template adds its own.
    """
    got = values.groupBy("draw").agg(F.sort_array(F.collect_list(F.struct("name", F.col("t").alias("vt"), F.col("tr").alias("vtr")))).alias("_v"))
    rows = templates.join(got, "draw", "left").withColumn("_v", F.coalesce("_v", F.array().cast("array<struct<name:string,vt:string,vtr:string>>")))

    def source(a: Column, v: Column) -> Column:
        slot = F.concat(F.lit("{"), v["name"], F.lit("_TL}"))
        bare = F.when(v["vt"].endswith("-ma"), F.left(v["vt"], F.char_length(v["vt"]) - 3)).otherwise(v["vt"])
        a = F.replace(a, F.concat(slot, F.lit("-ma")), F.concat(bare, F.lit("-ma")))
        return F.replace(a, slot, v["vt"])

    target = lambda a, v: F.replace(a, F.concat(F.lit("{"), v["name"], F.lit("_TR}")), v["vtr"])
    return rows.withColumns({"t": F.aggregate("_v", F.col("t"), source), "tr": F.aggregate("_v", F.col("tr"), target)}).drop("_v")


def file_key(*parts: Column) -> Column:
    """A key that can be a file name."""
    return F.regexp_replace(F.concat_ws("_", *parts), r"[^\w.\-]+", "_")


def prompt(template: str, **fields: Column) -> Column:
    """A prompt text from a template with {name} places."""
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out
