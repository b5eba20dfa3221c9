"""Pools that templates draw from, which of their rows go together, and draws from them.

A draw is a hash pick from an array of constants, so it is one expression without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws as R
from . import generation as G

# Source and target text of each row of a pool.
POOLS: dict[str, list[tuple[str, str]]] = {
    "place": [
        ("a-lim{ki}", "the City"), ("Kà-ni-iš", "Kaneš"), ("Wa-ah-šu-ša-na", "Wahšušana"), ("Za-al-pa", "Zalpa"), ("Pu-ru-uš-ha-dim", "Purušhaddum"),
        ("Hu-ra-ma", "hurama"), ("Ku-bu-ur-na-at", "Kuburnat"), ("Dur4-hu-mì-it", "Durhumit"), ("Ha-ah-hu-um", "hahhum"), ("Ti-mì-il5-ki-a", "Timilkiya"),
        ("Ša-la-tù-ar", "Šalatuar"), ("Ma-ma", "Mamma"), ("Ku-sà-ra", "Kuššara"), ("Wa-áš-ha-ni-a", "Wašhaniya"), ("Bu-ru-ul-lim", "Burullum"),
        ("Ša-mu-ha", "Samuha"), ("Ne-na-ša", "Nenaša"), ("Ha-tu-uš", "Hattuš"), ("Am-ku-wa", "Amkuwa"), ("Lu-hu-za-di-a", "Luhusaddiya"),
        ("Te-ga-ra-ma", "Tegarama"), ("Ha-na-ak-na-ak", "Hanaknak"), ("Ti-iš-mur-na", "Tišmurna"), ("Ta-wi-ni-a", "Tawiniya"), ("Ba-ad-na", "Badna"),
    ],
    "month": [
        ("be-el-tí-É.GAL-lim", "Bēlat-ekallim"), ("ša sá-ra-tim", "Ša-sarrātim"), ("ša sà-ra-tim", "Ša-sarrātim"), ("ke-na-tim", "Kēnātim"), ("ša ke-na-tim", "Ša-kēnātim"),
        ("ma-hu-ur-DINGIR", "Mahhur-ilī"), ("ma-hu-ur-ì-lí", "Mahhur-ilī"), ("áb-ša-ra-ni", "Ab-šarrāni"), ("áb ša-ra-ni", "Ab-šarrāni"), ("áb-ša-ra-nu", "Ab-šarrāni"),
        ("hu-bu-ur", "Hubur"), ("ṣí-ip-im", "Ṣip'um"), ("qá-ra-a-tim", "Qarra'ātum"), ("qá-ra-a-tí", "Qarra'ātum"), ("kán-wár-ta", "Kanwarta"), ("kán-bar-ta", "Tanbarta"),
        ("Kà-an-ma-ar-ta", "Kanwarta"), ("té-i-na-tim", "Te'inātum"), ("ku-zal-li", "Kuzallu"), ("ku-zal-lu", "Kuzallu"), ("a-lá-na-tim", "Allanātum"), ("a-lá-na-tum", "Allanātum"),
    ],
    "occupation": [
        ("DAM.GÀR", "merchant"), ("DUB.SAR", "scribe"), ("um-me-a-ni", "investor"), ("ra-bi-ṣú-um", "representative"), ("kà-ṣa-ru-um", "packer"), ("ṣú-ha-ru-um", "servant"),
        ("ša-qí-il5 da-tim", "datu-payer"), ("sa-hi-ir", "junior merchant"), ("ma-lá-hi-im", "skipper"), ("aš-kà-pí-im", "leatherworker"), ("a-lá-hi-nim", "miller"),
        ("sà-an-gu-um", "priest"), ("lá-ki-dí-im", "runner"), ("NU.BANDA", "overseer"),
    ],
    "kinship": [
        ("DUMU", "son"), ("a-hi", "brother"), ("a-bi", "father"), ("be-lí", "lord"), ("a-ha-tí", "sister"), ("um-mì", "mother"), ("DAM", "wife"), ("DUMU.MÍ", "daughter"),
    ],
    "kinship_possessive": [
        ("DUMU-a", "my son"), ("a-hu-a", "my brother"), ("a-bi-a", "my father"), ("be-lí-a", "my lord"), ("a-ha-tí-a", "my sister"), ("um-mì-a", "my mother"),
        ("a-ša-tí-a", "my wife"), ("DUMU.MÍ-a", "my daughter"),
    ],
    "festival": [
        ("ha-ar-pé-e", "harvest"), ("bu-qú-nim", "shearing"), ("pa-ha-ar ad-ri-im", "gathering of the threshing floor"), ("Ni-pá-as", "Nipais festival"),
        ("ú-sú-me-e", "Usmue festival"), ("pá-ar-kà", "Parka festival"), ("A-na-a", "Anna festival"),
    ],
    "expense": [
        ("tí-ib-nim", "straw"), ("ú-ku-ul-tim", "food/provisions"), ("É wa-áb-ri", "the inn"), ("e-ri-qí-im", "the wagon"), ("ig-ri-im", "hire"), ("ni-qí-i-šu", "his sacrifices"),
        ("ik-ri-bi", "votive offerings"), ("bu-sà-lim", "cooking"), ("e-re-qí-im qá-nu-e", "a wagonload of reeds"), ("ša-du-a-sú", "transport tariff"), ("ni-is-ha-tim", "import tax"),
        ("lu-bu-ší", "clothing"), ("be-ú-lá-at", "working capital"), ("da-a-sú", "road tax"),
    ],
    "item": [
        ("É-tim", "house"), ("A.ŠÀ", "field"), ("SAG.GÉME", "slave girl"), ("SAG.ÌR", "slave"), ("e-ri-qí-im", "wagon"), ("ANŠE", "donkey"), ("TÚG.HI.A", "textiles"),
        ("KÙ.BABBAR", "silver"), ("AN.NA", "tin"), ("URUDU", "copper"),
    ],
    # By rule: so many minas of a metal.
    "penalty": [
        (f"{n} ma-na {sign}", f"{n} mina{'s' * (n > 1)} of {metal}")
        for sign, metal, counts in (("KÙ.GI", "gold", (1, 2, 3, 5, 6, 10)), ("KÙ.BABBAR", "silver", (1, 2, 3, 5, 10))) for n in counts
    ],
}
# Institutions, and the places (by their target text) where each is found.
INSTITUTIONS = {
    "colony": ("kà-ri-im", "colony", "Kaneš Wahšušana Durhumit hahhum Zalpa Purušhaddum hurama Timilkiya Kuburnat Tegarama Tawiniya Hattuš"),
    "trading_station": ("wa-bar-tim", "trading station", "Zalpa Kuburnat Šalatuar Mamma Wašhaniya Badna"),
    "palace": ("É.GAL-lim", "palace", "Kaneš Wahšušana Purušhaddum Burušhaddum"),
    "city": ("a-lim{ki}", "the City", "Aššur"),
    "colony_office": ("É kà-ri-im", "the office of the colony", "Kaneš Wahšušana Durhumit Purušhaddum"),
    "inn": ("É wa-áb-ri", "the inn", "hurama hahhum Timilkiya Burullum Šalatuar Samuha Wašhaniya Kuššara Hanaknak"),
}
# Places of institutions that are not in the pool of places.
OTHER_PLACES = {"Burušhaddum": "Bu-ru-uš-ha-dim", "Aššur": "A-šùr"}
# Taxes and the commodities they apply to.
TAXES = [
    ("import_transport", "ni-is-ha-sú DIRI ša-du-a-sú ša-bu", "its import duty added, its transport tariff paid", "silver tin gold copper"),
    ("import_only", "ni-is-ha-tum", "import duty", "textiles kutanu tin donkeys"), ("export_tax", "wa-ṣí-tám", "export duty", "silver gold"),
    ("tithe", "10-tum", "tithe", "silver tin copper iron textiles"), ("five_percent", "me-tum 5", "5 percent tax", "textiles kutanu"),
    ("entrance_tax", "e-ri-ib-tum", "entrance tax", "tin silver copper"),
]
# Containers, their plurals and contents.
CONTAINERS = [
    ("na-ru-uq", "sack", "sacks", "textiles barley wheat tin"), ("né-pí-šu-um", "package", "packages", "silver gold"), ("ri-ik-sú-um", "bundle", "bundles", "silver tin"),
    ("ta-ma-lá-ku", "tablet container", "tablet containers", "tablets"), ("DUG", "jar", "jars", "barley wheat beer oil malt"), ("i-lá-tim", "container", "containers", "copper"),
]
# Units of weight from large to small, how many of the next make one, and which may stand together.
TIERS = [("talent", "GÚ", "talents", 60), ("mina", "ma-na", "minas", 60), ("shekel", "GÍN", "shekels", 180), ("grain", "ŠE", "grains", None)]
TIER_CHAINS = ["talent mina", "talent mina shekel", "mina shekel", "shekel grain", "mina shekel grain", "talent mina shekel grain"]
# Rates at which metals are exchanged for silver.
EXCHANGE = {
    "tin": ["8", "14 ½", "15", "15 ⅔", "16", "16 ½", "17"], "gold": ["8", "9 ⅓"], "copper": ["60", "65", "70", "75"],
}
# Units of time limits, least and most.
DEADLINE_UNITS = [("ha-am-ša-tim", "weeks", 2, 70), ("ITU.KAM", "months", 1, 12), ("u4-me-e", "days", 2, 30), ("ša-na-at", "year(s)", 1, 5)]


def table(spark: SparkSession) -> DataFrame:
    """type, t, tr of all pools, as ``slots.resolve`` takes them."""
    return spark.createDataFrame([(kind, t, tr) for kind, rows in POOLS.items() for t, tr in rows], "type string, t string, tr string")


def _rows(rows: list[tuple], *names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])


def _one(rows: Column, n: Column | int, seed: str, *keys: Column) -> Column:
    return F.get(rows, R.integer(n, seed, *keys))


def pick(kind: str, seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr): a row of a pool for each key."""
    return _one(_rows(POOLS[kind], "t", "tr"), len(POOLS[kind]), f"{seed}{kind}", *keys)


def from_rows(rows: Column, fallback: Column, seed: int | str, *keys: Column) -> Column:
    """An element of a caller's pool (an array), or the fallback where it is empty: eponyms, week officials."""
    return F.when(F.size(rows) > 0, _one(rows, F.size(rows), f"{seed}own", *keys)).otherwise(fallback)


def officials(a: Column, b: Column) -> Column:
    """Two names as the officials of a week."""
    return F.struct(F.concat_ws(" ù ", a["t"], b["t"]).alias("t"), F.concat_ws(" and ", a["tr"], b["tr"]).alias("tr"))


def container(commodity: Column, seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr, plural): a container that holds the commodity, any where none does."""
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(tr).alias("tr"), F.lit(pl).alias("plural"), F.array(*map(F.lit, held.split())).alias("held")) for t, tr, pl, held in CONTAINERS])
    fits = F.filter(every, lambda c: F.coalesce(F.array_contains(c["held"], commodity), F.lit(False)))
    able = F.when(F.size(fits) > 0, fits).otherwise(every)
    got = _one(able, F.size(able), f"{seed}container", *keys)
    return F.struct(got["t"].alias("t"), got["tr"].alias("tr"), got["plural"].alias("plural"))


def institution(seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr, place_t, place_tr): an institution and a place that has one."""
    signs = {tr: t for t, tr in POOLS["place"]} | OTHER_PLACES
    rows = F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(tr).alias("tr"), _rows([(signs[p], p) for p in places.split()], "t", "tr").alias("at")) for t, tr, places in INSTITUTIONS.values()
    ])
    got = _one(rows, len(INSTITUTIONS), f"{seed}institution", *keys)
    at = _one(got["at"], F.size(got["at"]), f"{seed}at", *keys)
    return F.struct(got["t"].alias("t"), got["tr"].alias("tr"), at["t"].alias("place_t"), at["tr"].alias("place_tr"))


def tax(commodity: Column, seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr): one of the taxes that apply to the commodity, or null."""
    every = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(tr).alias("tr"), F.array(*map(F.lit, on.split())).alias("on")) for _, t, tr, on in TAXES])
    fits = F.filter(every, lambda x: F.coalesce(F.array_contains(x["on"], commodity), F.lit(False)))
    got = _one(fits, F.size(fits), f"{seed}tax", *keys)
    return F.when(got.isNotNull(), F.struct(got["t"].alias("t"), got["tr"].alias("tr")))


def interest(seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr): a rate of interest, by weight; more than one of a unit is plural."""
    t = R.weighted(G.RATES, f"{seed}interest", *keys)
    n = F.replace(t, F.lit(" GÍN.TA"), F.lit(""))
    unit = F.when(n.isin("1", *G.SIGNS), " shekel").otherwise(" shekels")
    return F.struct(t.alias("t"), F.concat(n, unit).alias("tr"))


def exchange(metal: Column, seed: int | str, *keys: Column) -> Column:
    """A struct (t, tr): a rate of exchange of tin, gold or copper for silver, or null."""
    out = F.lit(None).cast("struct<t:string,tr:string>")
    for name, rates in EXCHANGE.items():
        rows = [(f"{n} GÍN.TA", f"at a rate of {n} to 1" if name == "copper" else f"at a rate of {n} shekels each") for n in rates]
        out = F.when(metal == name, _one(_rows(rows, "t", "tr"), len(rows), f"{seed}exchange", *keys)).otherwise(out)
    return out


def deadline(seed: int | str, *keys: Column) -> Column:
    """A struct (n, t, tr): a number in the range of a drawn unit of time, with the unit."""
    u = _one(_rows(DEADLINE_UNITS, "t", "tr", "low", "high"), len(DEADLINE_UNITS), f"{seed}unit", *keys)
    n = u["low"] + R.integer(u["high"] - u["low"] + 1, f"{seed}n", *keys)
    return F.struct(n.alias("n"), F.concat_ws(" ", n.cast("string"), u["t"]).alias("t"), F.concat_ws(" ", n.cast("string"), u["tr"]).alias("tr"))


def small_h(name: Column) -> Column:
    """A target name with a small first h."""
    return F.when(name.startswith("H"), F.concat(F.lit("h"), F.substr(name, F.lit(2)))).otherwise(name)


def generate(templates: DataFrame, n: int, seed: int, pools: DataFrame, unit_table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The first n different filled pairs of 3 n draws: draw, template_id, category, t, tr.

    ``templates``: id, category, t, tr, slots (name, type, options, values).  A draw takes a
    category by weight and one of its templates, any template where there are no weights
    or the category has none.
    """
    from . import dedup, slots

    spark, draw = templates.sparkSession, F.col("draw")
    by = templates.groupBy("category").agg(F.sort_array(F.collect_list("id")).alias("_ids"))
    every = templates.agg(F.sort_array(F.collect_list("id")).alias("_every"))  # ids of templates, one row
    rows = spark.range(3 * n).withColumnRenamed("id", "draw")
    rows = rows.withColumn("category", R.weighted(weights, f"{seed}category", draw) if weights else F.lit(None).cast("string"))
    rows = rows.join(by, "category", "left").join(F.broadcast(every)).withColumn("_ids", F.coalesce("_ids", "_every"))
    rows = rows.select("draw", F.get("_ids", R.integer(F.size("_ids"), f"{seed}template", draw)).alias("template_id"))
    rows = rows.join(templates.withColumnRenamed("id", "template_id"), "template_id")
    asked = rows.select("draw", F.col("t").alias("template"), F.col("slots.type").alias("types"), F.inline("slots"))
    asked = asked.select("draw", "name", "type", "options", "values", "template", "types")
    filled = G.fill(rows.drop("slots"), slots.resolve(asked, pools, unit_table, seed))
    return dedup.generated(filled.select("draw", "template_id", "category", "t", "tr"), n)
