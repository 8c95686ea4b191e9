"""Column expressions that several operators share. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Event weights by type.
EVENT_WEIGHTS = {"view": 0.2, "cart": 0.6, "favorite": 0.8, "purchase": 1.0, "return": -1.0}
OTHER_EVENT_WEIGHT = 0.1
#: The shop-log variant, by order status event.
STATUS_WEIGHTS = {"cancel": -0.4}
# Upper bounds of the age bands.
AGE_BANDS = [(17, "0-17"), (24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (120, "65+")]
# Category lists of the derived gender and season flags.
FEMALE_CATEGORIES = [
    "Bra", "Underwear Tights", "Leggings/Tights", "Hair clip", "Hair string", "Hair/alice band", "Bikini top", "Skirt",
    "Dress", "Earring", "Alice band", "Straw hat", "Necklace", "Ballerinas", "Blouse", "Beanie", "Giftbox", "Pumps",
    "Bootie", "Heeled sandals", "Nipple covers", "Hair ties", "Underwear corset", "Bra extender", "Underdress",
    "Underwear set", "Sarong", "Leg warmers", "Hairband", "Tote bag", "Earrings", "Flat shoes", "Heels", "Cap",
    "Shoulder bag", "Headband", "Baby Bib", "Cross-body bag", "Bumbag",
]
SUMMER_CATEGORIES = [
    "Sunglasses", "Hat/brim", "Sandals", "Flat shoe", "Heeled sandals", "Polo shirt", "Dress", "T-shirt", "Skirt",
    "Vest top", "Swimwear top", "Swimsuit", "Swimwear bottom", "Bikini top", "Shorts",
]
WINTER_CATEGORIES = [
    "Beanie", "Felt hat", "Outdoor overall", "Long John", "Pyjama bottom", "Hat/beanie", "Leggings/Tights", "Hoodie",
    "Underwear Tights", "Pyjama set", "Boots", "Cardigan", "Sweater", "Jacket", "Scarf", "Coat", "Gloves",
    "Outdoor Waistcoat",
]


def padded_id(c: Column) -> Column:
    """Ids of digits alone get their leading zeros back, up to ten places; longer ones stay."""
    return F.when(c.rlike("^[0-9]+$"), F.lpad(c, F.greatest(F.length(c), F.lit(10)), F.lit("0"))).otherwise(c)


def searchable(*cols: Column) -> Column:
    """All columns joined by a space; a null column is an empty word."""
    return F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))


def event_weight(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EVENT_WEIGHTS.items() for x in kv))
    return F.coalesce(F.element_at(table, kind), F.lit(OTHER_EVENT_WEIGHT))


def status_event(status: Column) -> Column:
    s = F.lower(F.trim(status))
    return F.when(s == "returned", "return").when(s == "cancelled", "cancel").when(s == "processing", "cart").otherwise("purchase")


def tags(c: Column) -> Column:
    """The distinct lower-case tags of a list with , or ; between."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def first_present(*cols: Column, default: str) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(default))


def distinct_join(*cols: Column) -> Column:
    """The distinct non-empty values in order, joined by a comma."""
    return F.array_join(F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))), ",")


def age_band(age: Column) -> Column:
    out = F.when(age.isNull() | (age <= 0) | (age > 120), "nan")
    for top, name in AGE_BANDS:
        out = out.when(age <= top, name)
    return out


def average_rank(order: WindowSpec, same: WindowSpec) -> Column:
    """Mean rank of ties: the first rank of the value plus half of the others."""
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0)


def quantile_bin(position: Column, n: Column, bins: int) -> Column:
    """Bin 0.. of rank ``position`` (from 1) of n, for 3 or 5 bins cut at interpolated quantiles."""
    last = F.greatest(n - 1, F.lit(1))
    if bins == 3:
        return F.least(F.floor(F.lit(3) * (position - 1) / last), F.lit(2)).cast("int")
    if bins == 5:
        return F.greatest(F.ceil(F.lit(5) * (position - 1) / last) - 1, F.lit(0)).cast("int")
    raise ValueError("3 or 5 bins")


def gender_code(category: Column, style: Column) -> Column:
    female = F.coalesce(F.lower(style).contains("ladieswear"), F.lit(False)) | F.coalesce(category.isin(FEMALE_CATEGORIES), F.lit(False))
    return F.when(female, 2).when(F.lower(style).contains("menswear"), 1).otherwise(0)


def season_code(category: Column) -> Column:
    return F.when(category.isin(WINTER_CATEGORIES), 2).when(category.isin(SUMMER_CATEGORIES), 1).otherwise(0)


def ratio(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return a / (b + F.lit(eps))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, summed from the first component on."""
    z = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v)


def r6(c: Column) -> Column:
    """Six decimals, no negative zero."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)
