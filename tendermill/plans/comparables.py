"""Comparable products: similar names, and what different suppliers ask for them.

Names are compared, not rows: features are read once per distinct name, and offers
are folded to one row per (name, supplier) before any join, so copies never meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendermill.functions import attributes, pairs, text
from tendermill.functions import offers as offer_blocks
from tendermill.functions.penalties import critical_attributes, critical_penalty
from tendermill.operators import blocks, grouping
from tendermill.session import checkpointed

# Weights of the feature similarity.
WEIGHTS = {"category": 0.25, "type": 0.25, "size": 0.20, "material": 0.10, "standard": 0.10, "string": 0.10}
DIMENSIONS = ["diameter", "thickness", "length", "width", "height", "number"]
COMPARED = ["type", "category", "diameter", "thickness", "length", "width", "height", "material", "standard", "model", "brand"]
# Weights and bonuses of the quick text score.
QUICK_WEIGHTS = {"jaro_winkler": 0.30, "levenshtein": 0.25, "token": 0.25, "blocks": 0.20}
QUICK_BONUS = {"diameter": 0.1, "number": 0.1, "standard": 0.05, "material": 0.05}


# ---------------------------------------------------------------- features


def named_features(df: DataFrame, name: str) -> DataFrame:
    """One row per distinct name with its features, critical attributes and comparison text.

    Reading a name costs hundreds of patterns and every later step uses the result, so
    it is written once to the checkpoint folder instead of being read again per step.
    """
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return checkpointed(names.select(
        "name", attributes.full_features("name").alias("f"), critical_attributes("name").alias("critical"),
        text.match_text("name").alias("flat")))


def size_similarity(a: Column, b: Column) -> Column:
    """Share of the dimensions both state that agree within 5 % or 1 unit; 0.7 when they share none."""
    shared, matched = F.lit(0), F.lit(0)
    for d in DIMENSIONS:
        x, y = a[d], b[d]
        both = x.isNotNull() & y.isNotNull()
        gap, mean = F.abs(x - y), (x + y) / 2
        close = both & (((mean > 0) & (gap <= mean * 0.05)) | (gap <= 1))
        shared = shared + F.when(both, 1).otherwise(0)
        matched = matched + F.when(close, 1).otherwise(0)
    return F.when(shared == 0, 0.7).otherwise(F.try_divide(matched, shared))


def _stated(x: Column, y: Column, differ: float) -> Column:
    return F.when(x.isNull() | y.isNull(), 0.7).when(x == y, 1.0).otherwise(differ)


def feature_base(a: Column, b: Column) -> Column:
    """Weighted similarity without the text part, for names of one category and type."""
    return (
        WEIGHTS["category"] + WEIGHTS["type"] + WEIGHTS["size"] * size_similarity(a, b)
        + WEIGHTS["material"] * _stated(a["material"], b["material"], 0.5)
        + WEIGHTS["standard"] * _stated(a["standard"], b["standard"], 0.3)
    )


def scored_pairs(candidates: DataFrame, threshold: float) -> DataFrame:
    """Score candidate pairs of one category and type; keep those at or above the threshold.

    The text ratio needs Python, so it only runs where the other parts leave the
    threshold within reach.
    """
    penalty = critical_penalty(F.col("critical1"), F.col("critical2"))
    based = candidates.withColumn("penalty", penalty).where(F.col("penalty") >= 0.5).withColumn(
        "base", feature_base(F.col("f1"), F.col("f2")))
    reachable = based.where((F.col("base") + WEIGHTS["string"]) * F.col("penalty") >= threshold)
    ratio = pairs.blocks_similarity(F.col("flat1"), F.col("flat2"))
    scored = reachable.withColumn("ratio", ratio)
    total = F.least(F.lit(1.0), (F.col("base") + WEIGHTS["string"] * F.col("ratio")) * F.col("penalty"))
    return scored.withColumn("similarity", total).where(F.col("similarity") >= threshold)


def any_pair_similarity(pair: DataFrame) -> DataFrame:
    """Similarity of arbitrary pairs, other categories and types included."""
    a, b = F.col("f1"), F.col("f2")
    same_category = (a["category"].eqNullSafe(b["category"])) & a["category"].isNotNull()
    scored = pair.withColumns({
        "penalty": critical_penalty(F.col("critical1"), F.col("critical2")),
        "ratio": pairs.blocks_similarity(F.col("flat1"), F.col("flat2")),
        "type_ratio": pairs.blocks_similarity(F.coalesce(a["type"], F.lit("")), F.coalesce(b["type"], F.lit(""))),
    })
    kind = F.when(a["type"].isNull() | b["type"].isNull(), 0.0).otherwise(F.col("type_ratio"))
    base = feature_base(a, b) - WEIGHTS["category"] - WEIGHTS["type"]
    total = (WEIGHTS["category"] * F.when(same_category, 1.0).otherwise(0.0) + WEIGHTS["type"] * kind + base
             + WEIGHTS["string"] * F.col("ratio"))
    both_categories = a["category"].isNotNull() & b["category"].isNotNull()
    total = total * F.when(both_categories & ~same_category, 0.6).otherwise(1.0) * F.when(kind < 0.5, 0.8).otherwise(1.0)
    similarity = F.when(F.col("penalty") < 0.5, F.col("penalty")).otherwise(F.least(F.lit(1.0), total * F.col("penalty")))
    return scored.withColumn("similarity", similarity).drop("type_ratio")


# ---------------------------------------------------------------- candidate pairs


def _side(features: DataFrame, i: int) -> DataFrame:
    return features.select(F.col("f.category").alias("category"), F.col("f.type").alias("type"),
                           *(F.col(c).alias(f"{c}{i}") for c in ("name", "f", "critical", "flat")))


def _size_cell(value: Column) -> Column:
    """Values that agree within 5 % or 1 unit lie in the same cell or in neighbours."""
    return F.floor(F.log(value + 20) / math.log(1.06))


def size_candidates(features: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """Pairs of one category and type that agree in at least one dimension.

    A value meets those of its own cell and of the next one; a crowded cell is cut into a matrix of blocks.
    """
    stated = F.filter(F.array(*(F.struct(F.lit(d).alias("dim"), _size_cell(F.col(f"f.{d}")).alias("cell"))
                                for d in DIMENSIONS)), lambda e: e["cell"].isNotNull())
    keyed = features.where(F.col("f.category").isNotNull()).select(
        "name", F.col("f.category").alias("category"), F.col("f.type").alias("type"), F.explode(stated).alias("k"))
    # a cell as the lower one of two neighbours, and as the upper one
    sides = F.explode(F.array(F.struct(F.col("k.cell").alias("lower"), F.lit(0).alias("up")), F.struct((F.col("k.cell") - 1).alias("lower"), F.lit(1).alias("up"))))
    met = keyed.select("category", "type", "k.dim", "name", sides.alias("s")).select("category", "type", "dim", "name", "s.lower", "s.up")
    found = blocks.pairs(met, ["category", "type", "dim", "lower"], "name", ["up"], block)
    # both in the lower cell, or one in each; two in the upper cell meet again in theirs
    return found.where("up1 = 0 OR up2 = 0").select("name1", "name2").distinct()


def _mask(f: Column) -> Column:
    return F.concat(*(F.when(f[d].isNull(), "0").otherwise("1") for d in DIMENSIONS))


def _apart(a: str, b: str) -> Column:
    """No dimension is stated by both."""
    apart = F.lit(True)
    for i in range(1, len(DIMENSIONS) + 1):
        apart = apart & ~((F.substring(a, i, 1) == "1") & (F.substring(b, i, 1) == "1"))
    return apart


def unsized_candidates(features: DataFrame, threshold: float = 0.85, block: int = blocks.BLOCK) -> DataFrame:
    """Pairs of one category and type that state no dimension in common, where the rest can still reach the threshold.

    Their size counts as neutral, so material, standard and text must add up to ten times what the threshold exceeds 0.64 by.
    A category that holds most names is cut into as many blocks as its size asks for.
    """
    small = features.where(F.col("f.category").isNotNull()).select(
        "name", F.col("f.category").alias("category"), F.col("f.type").alias("type"), F.col("f.material").alias("material"),
        F.col("f.standard").alias("standard"), F.length("flat").alias("len"), _mask(F.col("f")).alias("mask"))
    found = blocks.pairs(small, ["category", "type"], "name", ["material", "standard", "len", "mask"], block)
    rest = _stated(F.col("material1"), F.col("material2"), 0.5) + _stated(F.col("standard1"), F.col("standard2"), 0.3)
    # no text ratio exceeds twice the shorter length over both lengths
    most = 2 * F.least("len1", "len2") / (F.col("len1") + F.col("len2"))
    return found.where(_apart("mask1", "mask2") & (rest + most >= (threshold - 0.64) * 10 - 1e-9)).select("name1", "name2")


def similar_names(features: DataFrame, threshold: float = 0.85) -> DataFrame:
    """All pairs of distinct names at or above the threshold.

    Without any size agreement the weights give at most 0.8, so from 0.81 on the two
    candidate sets hold every pair that can pass.
    """
    if threshold < 0.81:
        raise ValueError("below 0.81 pairs without size agreement can pass")
    candidates = size_candidates(features).unionByName(unsized_candidates(features, threshold)).distinct()
    slim1, slim2 = (_side(features, i) for i in (1, 2))
    full = candidates.join(slim1.drop("category", "type"), "name1").join(slim2, "name2")
    return scored_pairs(full, threshold).select("category", "type", "name1", "name2", "similarity")


# ---------------------------------------------------------------- classes of names


def name_classes(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that agree in category, type, dimensions, material, standard and critical attributes are one class.

    (name, f, critical, names) with the first name standing for its class, and the members (class, name, flat).
    """
    stated = F.struct("f.category", "f.type", *(f"f.{d}" for d in DIMENSIONS), "f.material", "f.standard", "critical")
    keyed = features.where(F.col("f.category").isNotNull() & F.col("f.type").isNotNull()).withColumn("print", F.sha2(F.to_json(stated), 256))
    classes = checkpointed(keyed.groupBy("print").agg(
        F.min("name").alias("name"), F.min_by("f", "name").alias("f"), F.min_by("critical", "name").alias("critical"), F.count("*").alias("names")))
    members = keyed.join(classes.select("print", F.col("name").alias("class")), "print").select("class", "name", "flat")
    return classes.drop("print"), checkpointed(members)


def class_candidates(classes: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """All pairs of classes that can reach 0.75: they agree in a dimension, state none in common, or share material or standard.

    With no dimension in agreement the weights give 0.5 and the text 0.1, so material and standard must add 0.15,
    which they only do where one of the two is stated alike.
    """
    known = classes.select("name", F.col("f.category").alias("category"), F.col("f.type").alias("type"), F.col("f.material").alias("material"),
                           F.col("f.standard").alias("standard"), _mask(F.col("f")).alias("mask"))
    found = [size_candidates(classes, block)]
    for shared in ("material", "standard"):
        found.append(blocks.pairs(known, ["category", "type", shared], "name", [], block).select("name1", "name2"))
    # a class meets those of every set of dimensions that is apart from its own, itself included if it states none
    masks = [format(m, f"0{len(DIMENSIONS)}b") for m in range(1 << len(DIMENSIONS))]
    apart = {m: [x for x in masks if not int(m, 2) & int(x, 2)] for m in masks}
    partners = F.create_map(*(x for m in masks for x in (F.lit(m), F.array(*map(F.lit, apart[m])))))
    theirs = known.select("name", "category", "type", F.explode(F.element_at(partners, F.col("mask"))).alias("mask"))
    found.append(blocks.between(known, theirs, ["category", "type", "mask"], ["name"], block).where("name1 < name2").select("name1", "name2"))
    return grouping.stacked(*found).distinct()


def similar_classes(features: DataFrame, threshold: float = 0.75, block: int = blocks.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes with the number of their pairs of names at or above the threshold, and the members of classes.

    All but the text ratio is the same for all names of two classes. Where it leaves the threshold passed or out of reach,
    the pair is settled as a whole; texts are only read in the band between, each distinct text of a class once.
    """
    if threshold < 0.75:
        raise ValueError("below 0.75 classes without anything in common can pass")
    classes, members = name_classes(features)
    own = classes.where("names > 1").select(F.col("name").alias("name1"), F.col("name").alias("name2"))
    sides = [classes.select(*(F.col(c).alias(f"{c}{i}") for c in ("name", "f", "critical", "names"))) for i in (1, 2)]
    met = class_candidates(classes, block).unionByName(own).join(sides[0], "name1").join(sides[1], "name2")
    scored = met.withColumn("penalty", critical_penalty(F.col("critical1"), F.col("critical2"))).where("penalty >= 0.5")
    scored = scored.withColumn("base", feature_base(F.col("f1"), F.col("f2"))).where((F.col("base") + WEIGHTS["string"]) * F.col("penalty") >= threshold)
    scored = checkpointed(scored.select(
        F.col("f1.category").alias("category"), F.col("f1.type").alias("type"), F.col("name1").alias("class1"), F.col("name2").alias("class2"),
        "names1", "names2", "base", "penalty", (F.col("base") * F.col("penalty") >= threshold).alias("settled")))
    every = F.when(F.col("class1") == F.col("class2"), F.col("names1") * (F.col("names1") - 1) / 2).otherwise(F.col("names1") * F.col("names2"))
    settled = scored.where("settled").withColumn("pairs", every.cast("long"))
    texts = checkpointed(members.groupBy("class", "flat").agg(F.count("*").alias("n")))
    left, right = (texts.select(*(F.col(c).alias(f"{c}{i}") for c in ("class", "flat", "n"))) for i in (1, 2))
    band = scored.where("NOT settled").join(left, "class1").join(right, "class2")
    band = band.where((F.col("class1") != F.col("class2")) | (F.col("flat1") <= F.col("flat2")))
    most = 2 * F.least(F.length("flat1"), F.length("flat2")) / (F.length("flat1") + F.length("flat2"))
    band = band.where((F.col("base") + WEIGHTS["string"] * most) * F.col("penalty") >= threshold - 1e-9)
    band = band.withColumn("ratio", pairs.blocks_similarity(F.col("flat1"), F.col("flat2")))
    band = band.where((F.col("base") + WEIGHTS["string"] * F.col("ratio")) * F.col("penalty") >= threshold)
    within = (F.col("class1") == F.col("class2")) & (F.col("flat1") == F.col("flat2"))
    weight = F.when(within, F.col("n1") * (F.col("n1") - 1) / 2).otherwise(F.col("n1") * F.col("n2")).cast("long")
    read = band.groupBy("category", "type", "class1", "class2", "names1", "names2").agg(F.sum(weight).alias("pairs"))
    kept = ["category", "type", "class1", "class2", "names1", "names2", "pairs"]
    return settled.select(*kept).unionByName(read.select(*kept)).where("pairs > 0"), members


def own_similarity(features: DataFrame) -> DataFrame:
    """A name against itself: text, category and type agree, unstated parts stay neutral."""
    known = features.where(F.col("f.category").isNotNull())
    base = feature_base(F.col("f"), F.col("f")) + WEIGHTS["string"]
    return known.select(F.col("f.category").alias("category"), F.col("f.type").alias("type"), F.col("name").alias("name1"),
                        F.col("name").alias("name2"), F.least(F.lit(1.0), base).alias("similarity"))


# ---------------------------------------------------------------- prices


def offers(contracts: DataFrame, name: str = "product_name") -> DataFrame:
    """One row per name and supplier: mean, least and most unit price."""
    return contracts.groupBy(F.col(name).alias("name"), F.col("counterparty_name").alias("supplier")).agg(
        (grouping.exact_sum("unit_price_eur", 12) / F.count("*")).alias("price"), F.count("*").alias("contracts"))


def _extremes(per_offer: DataFrame) -> DataFrame:
    """Two cheapest and two dearest offers of each name: enough to answer for any supplier of it."""
    best = grouping.top_in_group(per_offer, ["name"], 2, F.asc("price"), "supplier").withColumn("side", F.lit("cheapest"))
    worst = grouping.top_in_group(per_offer, ["name"], 2, F.desc("price"), "supplier").withColumn("side", F.lit("dearest"))
    return best.unionByName(worst).select(F.col("name").alias("name2"), F.col("supplier").alias("supplier2"),
                                          F.col("price").alias("price2"), "side")


def related_names(contracts: DataFrame, threshold: float, name: str) -> DataFrame:
    """(category, type, name1, name2, similarity) in both directions, each name with itself included."""
    features = named_features(contracts, name)
    similar = similar_names(features, threshold)
    swapped = similar.select("category", "type", F.col("name2").alias("name1"), F.col("name1").alias("name2"), "similarity")
    return similar.unionByName(swapped).unionByName(own_similarity(features))


def comparable_offers(contracts: DataFrame, threshold: float = 0.85, name: str = "product_name") -> DataFrame:
    """Every offer against the cheapest and the dearest comparable offer of another supplier.

    Two rows per offer, not one per pair: the work is linear in offers times similar
    names, and the largest gaps are all there. Counts and means over all matches: :func:`match_statistics`.
    """
    related = related_names(contracts, threshold, name)
    per_offer = offers(contracts, name)
    # For each name the best comparable offer, and the best of any other supplier: whoever is not the first's supplier
    # meets the first, and that one the second. Offers are joined once and never grouped.
    sides = related.join(_extremes(per_offer), "name2").where(F.col("supplier2").isNotNull())
    order = F.struct(F.when(F.col("side") == "cheapest", F.col("price2")).otherwise(-F.col("price2")), "name2", "supplier2")
    found = F.struct("name2", "supplier2", "price2", "similarity")
    of_name = ["category", "type", "name1", "side"]
    sides = sides.withColumn("first", F.min_by(found, order).over(Window.partitionBy(*of_name)))
    second = F.when(F.col("supplier2") != F.col("first.supplier2"), order)
    best = sides.groupBy(*of_name).agg(F.any_value("first").alias("first"), F.min_by(found, second).alias("second"))
    mine = per_offer.select(F.col("name").alias("name1"), F.col("supplier").alias("supplier1"), F.col("price").alias("price1"))
    met = mine.where(F.col("supplier1").isNotNull()).join(best, "name1")
    picked = met.withColumn("p", F.when(F.col("supplier1") != F.col("first.supplier2"), F.col("first")).otherwise(F.col("second"))).where("p IS NOT NULL")
    gap = F.abs(F.col("p.price2") - F.col("price1"))
    cheaper = F.col("price1") < F.col("p.price2")
    return picked.select(
        "category", "type", "name1", "supplier1", "price1", "side", "p.*", gap.alias("price_diff"),
        F.when(F.col("price1") > 0, gap / F.col("price1") * 100).otherwise(0.0).alias("price_diff_pct"),
        F.when(cheaper, F.col("supplier1")).otherwise(F.col("p.supplier2")).alias("cheaper_supplier"),
        F.when(cheaper, F.col("p.supplier2")).otherwise(F.col("supplier1")).alias("expensive_supplier"))


def comparable_pairs(contracts: DataFrame, threshold: float = 0.85, name: str = "product_name") -> DataFrame:
    """All pairs of comparable offers of different suppliers, for a chosen set of products.

    The result itself grows with the square of the suppliers of a product; use
    :func:`comparable_offers` over whole tables.
    """
    features = named_features(contracts, name)
    related = similar_names(features, threshold).unionByName(own_similarity(features))
    per_offer = offers(contracts, name)
    sides = [per_offer.select(F.col("name").alias(f"name{i}"), F.col("supplier").alias(f"supplier{i}"),
                              F.col("price").alias(f"price{i}")) for i in (1, 2)]
    met = related.join(sides[0], "name1").join(sides[1], "name2").where(
        (F.col("supplier1") != F.col("supplier2"))
        & ((F.col("name1") < F.col("name2")) | (F.col("supplier1") < F.col("supplier2"))))
    gap = F.abs(F.col("price2") - F.col("price1"))
    return met.withColumns({"price_diff": gap, "price_diff_pct": F.when(F.col("price1") > 0, gap / F.col("price1") * 100)
                            .otherwise(0.0)})


def match_statistics(contracts: DataFrame, threshold: float = 0.85, name: str = "product_name", block: int = blocks.SORTED) -> DataFrame:
    """Every offer against all comparable offers of other suppliers, one row per offer and comparable name.

    ``matches``; ``within10``, ``within20`` and ``within30`` of them with a gap of at most so many % of the own price; how many are
    ``dearer`` and ``cheaper`` and by how much in sum (``more``, ``less``). No pair of offers is listed: the offers of two names meet
    in blocks, and ranks in the sorted prices give the figures, which add up over blocks. Offers of the own supplier are taken
    off. A pair counts once from either side. From an own price of 0 or less every gap counts as 0 %, as in
    :func:`comparable_offers`; offers without a price have no gap.
    """
    related = related_names(contracts, threshold, name).select("category", "type", "name1", "name2")
    per_offer = checkpointed(offers(contracts, name).where(F.col("price").isNotNull()).select("name", "supplier", "price"))
    cut = blocks.cut_pairs(related, per_offer, block)
    met = blocks.met_pairs(cut, per_offer, ["supplier", "price"], ["columns"], block).applyInArrow(
        offer_blocks.statistics, "pair long, columns int, supplier1 string, price1 double, matches long, within10 long, within20 long, within30 long, "
                                 "dearer long, cheaper long, more double, less double")
    if not cut.where("columns > 1").isEmpty():
        met = met.groupBy("pair", "supplier1", "price1").agg(*(
            F.sum(c).alias(c) for c in ("matches", "within10", "within20", "within30", "dearer", "cheaper", "more", "less")))
    return met.where("matches > 0").join(cut.select("pair", "category", "type", "name1", "name2"), "pair").select(
        "category", "type", "name1", "supplier1", "price1", "name2", "matches", "within10", "within20", "within30", "dearer", "cheaper", "more", "less")


def critical_gaps(statistics: DataFrame) -> DataFrame:
    """Gaps of more than 30 % for each pair of comparable names."""
    return statistics.groupBy("category", "type", "name1", "name2").agg(
        F.sum("matches").alias("matches"), F.sum(F.col("matches") - F.col("within30")).alias("critical")).where("critical > 0")


# ---------------------------------------------------------------- report over matches

def _share(gap):
    """Of the own price; 0 where that is 0 or less."""
    return F.when(F.col("price1") > 0, gap / F.col("price1")).otherwise(0.0)


def category_report(statistics: DataFrame, extremes: DataFrame) -> DataFrame:
    """Matches, mean gap, the bucket that holds the median gap, and money; the largest gap comes from the extremes of each offer."""
    gap = F.col("more") + F.col("less")
    found = statistics.groupBy("category").agg(
        *(F.sum(c).alias(c) for c in ("matches", "within10", "within20", "within30")),
        (F.sum(_share(gap)) * 100).alias("gap"), F.sum(gap).alias("value"))
    half = F.col("matches") / 2
    median = F.when(F.col("within10") >= half, "0-10").when(F.col("within20") >= half, "10-20").when(F.col("within30") >= half, "20-30").otherwise(">30")
    most = extremes.groupBy("category").agg(F.max("price_diff_pct").alias("max_gap"))
    return found.select("category", "matches", (F.col("gap") / F.col("matches")).alias("mean_gap"), median.alias("median_gap"), "value",
                        (F.col("value") / F.col("matches")).alias("mean_value")).join(most, "category")


def supplier_ratings(statistics: DataFrame) -> DataFrame:
    """How often each supplier is the cheaper and the dearer side, with the mean gap in % of its own price."""
    sides = (("cheaper", "dearer", "more"), ("expensive", "cheaper", "less"))
    total = statistics.groupBy(F.col("supplier1").alias("supplier")).agg(
        *(F.sum(n).alias(f"_{n}") for _, n, _ in sides), *((F.sum(_share(F.col(gap))) * 100).alias(f"_{gap}") for *_, gap in sides))
    rows = F.array(*(F.struct(F.col(f"_{n}").alias("matches"), F.col(f"_{gap}").alias("gap"), F.lit(side).alias("side")) for side, n, gap in sides))
    return total.select("supplier", F.explode(rows).alias("r")).where("r.matches > 0").select(
        "supplier", "r.matches", (F.col("r.gap") / F.col("r.matches")).alias("mean_gap"), "r.side")


def gap_buckets(statistics: DataFrame) -> DataFrame:
    counts = [F.col("within10"), F.col("within20") - F.col("within10"), F.col("within30") - F.col("within20"), F.col("matches") - F.col("within30")]
    rows = F.array(*(F.struct(F.lit(b).alias("bucket"), n.alias("n")) for b, n in zip(("0-10", "10-20", "20-30", ">30"), counts)))
    return statistics.select(F.explode(rows).alias("r")).groupBy("r.bucket").agg(F.sum("r.n").alias("matches"))


def largest_gaps(matches: DataFrame, k: int = 20) -> DataFrame:
    return grouping.top(matches, k, F.desc("price_diff"), "name1", "supplier1", "side")


# ---------------------------------------------------------------- text scores and single targets


def text_pairs(df: DataFrame, name: str) -> DataFrame:
    """Distinct names that share their first word and leading number, each pair once."""
    names = df.select(F.col(name).alias("name")).distinct()
    keyed = names.select("name", text.first_word(F.lower("name")).alias("word"),
                         attributes.found(F.col("name"), r"(\d+)").alias("lead"))
    left = keyed.withColumnRenamed("name", "name1")
    return left.join(keyed.withColumnRenamed("name", "name2"), ["word", "lead"]).where("name1 < name2").select("name1", "name2")


def text_scores(candidates: DataFrame) -> DataFrame:
    a, b = (text.normalised_product(n) for n in ("name1", "name2"))
    return candidates.withColumns({
        "levenshtein": pairs.levenshtein_similarity(a, b), "token": pairs.token_similarity(a, b)})


def quick_scores(candidates: DataFrame) -> DataFrame:
    """Combined text score with bonuses for equal characteristics; 0 for different known types."""
    flat = candidates.withColumns({f"n{i}": text.normalised_product(f"name{i}") for i in (1, 2)})
    flat = flat.withColumns({f"q{i}": attributes.quick_features(f"name{i}") for i in (1, 2)})
    a, b = F.col("n1"), F.col("n2")
    scored = flat.withColumns({
        "levenshtein": pairs.levenshtein_similarity(a, b), "token": pairs.token_similarity(a, b),
        "jaro": pairs.jaro_similarity(a, b), "jaro_winkler": pairs.jaro_winkler_similarity(a, b),
        "blocks": pairs.blocks_similarity(a, b)})
    total = sum((w * F.col(c) for c, w in QUICK_WEIGHTS.items()), F.lit(0.0))
    for c, bonus in QUICK_BONUS.items():
        x, y = F.col(f"q1.{c}"), F.col(f"q2.{c}")
        same = F.abs(x - y) < 0.1 if c == "number" else x == y
        total = total + F.when(F.coalesce(same, F.lit(False)), bonus).otherwise(0.0)
    other_type = F.coalesce(F.col("q1.type") != F.col("q2.type"), F.lit(False))
    return scored.withColumn("score", F.when(other_type, 0.0).otherwise(F.least(F.lit(1.0), total)))


def quick_matches(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    return quick_scores(candidates).where(F.col("score") >= threshold)


def matches_of(target: str, df: DataFrame, name: str, threshold: float = 0.85) -> DataFrame:
    """Names of a table similar to one target, best first."""
    wanted = df.sparkSession.range(1).select(F.lit(target).alias("name"))
    features = named_features(df.select(F.col(name).alias("name")).unionByName(wanted), "name")
    row = features.where(F.col("name") == target).withColumnsRenamed(
        {"name": "name1", "f": "f1", "critical": "critical1", "flat": "flat1"})
    rows = grouping.with_row(features, row, "_target").where(F.col("name") != target)
    pair = rows.select("_target.*", *(F.col(c).alias(f"{c}2") for c in ("name", "f", "critical", "flat")))
    return any_pair_similarity(pair).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "name2")


def compared(pair: DataFrame) -> DataFrame:
    """Similarity and, per feature both names state, the equal value or the two differing ones."""
    def value(side: str, c: str) -> Column:
        return F.col(f"{side}.{c}").cast("string")

    equal = F.array_compact(F.array(*(F.when(value("f1", c) == value("f2", c), F.struct(F.lit(c), value("f1", c)))
                                      for c in COMPARED)))
    differ = F.array_compact(F.array(*(F.when(value("f1", c) != value("f2", c), F.struct(
        F.lit(c), F.struct(value("f1", c).alias("product1"), value("f2", c).alias("product2")))) for c in COMPARED)))
    return any_pair_similarity(pair).withColumns({
        "matches": F.map_from_entries(equal), "differences": F.map_from_entries(differ)})


def lots_mentioning(lots: DataFrame, goods: list[str]) -> DataFrame:
    """Lots whose good name contains a chosen good in any letter case: one row per good and lot."""
    chosen = F.array(*(F.lit(g) for g in goods))
    hits = F.filter(chosen, lambda g: F.lower(F.col("good_name")).contains(F.lower(g)))
    return lots.select(F.explode(hits).alias("good"), "lot_number").distinct()
