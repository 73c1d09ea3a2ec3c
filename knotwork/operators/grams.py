"""Texts found by what they contain: postings of three-character substrings over the text columns of entities."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.model import Graph
from knotwork.session import cut, sized

#: Length of the substrings that stand for a text.
GRAM = 3

#: Substrings of a wanted text whose postings are met before texts are read: its rarest ones.
MEET = 3

#: Postings of one substring that lie together; more are spread over slots.
SLOT_ROWS = 200_000

#: Pairs of wanted texts and postings that one substring may lead to; beyond it texts are met by equality.
GRAM_PAIRS = 2_000_000

#: Up to so many parts or ids are named in a filter, so that stored tables are read in their buckets only.
FEW = 256

FIELDS = ("name", "description", "entity_type")


@dataclasses.dataclass(frozen=True)
class GramIndex:
    """``terms(field, gram, n, slots)``, ``postings(part, id)`` and ``texts(id, …)`` with the indexed fields.

    ``part`` is a field, a slot and a substring. Substrings are lower case; a text shorter than ``GRAM`` stands for itself.
    """

    terms: DataFrame
    postings: DataFrame
    texts: DataFrame
    fields: tuple[str, ...] = FIELDS
    stored: bool = False


def substrings(c: Column, sizes) -> Column:
    """Distinct substrings of the given lengths; a shorter text gives itself, an empty one nothing."""
    of = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)
    )
    return F.array_distinct(F.filter(F.flatten(F.array(*map(of, sizes))), lambda x: x != ""))


def folded(column: str) -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def _part(field: Column, slot: Column, gram: Column) -> Column:
    return F.concat_ws(":", field, slot.cast("string"), gram)


def gram_parts(entities: DataFrame, fields=FIELDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``terms``, ``postings`` and ``texts`` of the index; only ``terms`` is written yet.

    Counts are combined before they are shuffled; just the substrings with several slots are joined back.
    """
    texts = entities.select("id", *fields)
    each = F.array(*(F.struct(F.lit(f).alias("field"), substrings(folded(f), [GRAM]).alias("grams")) for f in fields))
    raw = texts.select("id", F.explode(each).alias("held")).select("id", "held.field", F.explode("held.grams").alias("gram"))
    terms = cut(
        raw.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("slots", F.ceil(F.col("n") / F.lit(SLOT_ROWS)).cast("int"))
    )
    spread = sized(terms.filter("slots > 1").select("field", "gram", "slots"))
    slot = F.coalesce(F.pmod(F.xxhash64("id"), F.col("slots")), F.lit(0))
    postings = raw.join(spread, ["field", "gram"], "left").select(_part(F.col("field"), slot, F.col("gram")).alias("part"), "id")
    return terms, postings, texts


def build_gram_index(g: Graph, fields=FIELDS) -> GramIndex:
    """An index for this session."""
    terms, postings, texts = gram_parts(g.entities, fields)
    return GramIndex(terms, cut(postings), texts, tuple(fields))


def _only(df: DataFrame, column: str, values: DataFrame, stored: bool) -> DataFrame:
    """Stored rows whose ``column`` is among a few ``values``, read from their buckets; all rows where these are many."""
    if not stored:
        return df
    few = [r[0] for r in values.select(column).distinct().limit(FEW + 1).collect()]
    return df.filter(F.col(column).isin(few)) if len(few) <= FEW else df


def containing(index: GramIndex, wanted: DataFrame, fields=None) -> DataFrame:
    """``(want, id, …)``: the texts that contain ``wanted(want)`` in one of ``fields``, case ignored.

    A text that contains a longer one contains all its substrings: the ids of the ``MEET`` rarest are met, and the
    remaining texts are read and checked. Substrings that many ask for and many have are left out of that; a wanted
    text with no other takes :func:`_met_whole`. A text shorter than ``GRAM`` lies in substrings that the list of
    substrings names. Wildcards are plain text; a null or empty text is contained in none.
    """
    fields = tuple(fields or index.fields)
    if not set(fields) <= set(index.fields):
        raise ValueError(f"the index holds {index.fields}")
    asked = cut(wanted.select("want", F.lower("want").alias("folded")).distinct().filter("folded <> ''"))
    terms = index.terms.filter(F.col("field").isin(*fields))
    names = F.explode(F.array(*map(F.lit, fields))).alias("field")
    long = asked.filter(F.length("folded") >= GRAM).select("want", F.explode(substrings(F.col("folded"), [GRAM])).alias("gram"))
    long = cut(long.select("want", "gram", names))
    asked_for = sized(long.groupBy("field", "gram").agg(F.count(F.lit(1)).alias("askers")))
    known = terms.join(asked_for, ["field", "gram"]).withColumn("much", F.col("n") * F.col("askers") > GRAM_PAIRS)
    picked = F.struct("much", "n", "gram", "slots")
    pick = F.slice(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), picked))), 1, MEET)
    picks = cut(
        long.join(known, ["field", "gram"], "left").groupBy("want", "field")
        .agg(pick.alias("pick"), F.count(F.when(F.col("n").isNull(), 1)).alias("unknown"))
        .filter("unknown = 0")
    )
    few = F.filter("pick", lambda p: ~p["much"])
    rare = (
        picks.select("want", "field", few.alias("pick"))
        .select("want", "field", F.size("pick").alias("need"), F.explode("pick").alias("p"))
        .select("want", "field", "need", "p.gram", "p.slots")
    )
    broad = cut(picks.filter(F.size(few) == 0).select("want", "field", F.col("pick")[0].alias("p")).join(asked, "want"))
    inner = terms.select("field", "gram", "slots", F.explode(substrings(F.col("gram"), range(1, GRAM))).alias("folded"))
    short = (
        inner.join(sized(asked.filter(F.length("folded") < GRAM)), "folded")
        .select("want", "field", F.lit(1).alias("need"), "gram", "slots").distinct()
    )
    slots = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")
    parts = rare.unionByName(short).select("want", "field", "need", "gram", slots)
    parts = sized(parts.select("want", "field", "need", _part(F.col("field"), F.col("slot"), F.col("gram")).alias("part")))
    postings = _only(index.postings, "part", parts, index.stored)
    met = (
        postings.join(parts, "part").groupBy("want", "field", "id")
        .agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
    )
    met = sized(met.select("want", "field", "id"))
    texts = _only(index.texts, "id", met, index.stored).join(met, "id")
    inside = F.lit(False)
    for f in fields:
        inside = inside | ((F.col("field") == f) & folded(f).contains(F.lower("want")))
    columns = ["want", *index.texts.columns]
    found = texts.filter(inside).select(columns)
    return (found if broad.isEmpty() else found.unionAll(_met_whole(index, broad, fields).select(columns))).distinct()


def _met_whole(index: GramIndex, broad: DataFrame, fields) -> DataFrame:
    """Texts that contain ``broad(want, field, p, folded)``, of which ``p`` is a substring that many ask for.

    The texts that have such a substring are read once for all, and their pieces of the lengths that are asked for with
    it meet the wanted texts by equality, so the work follows the texts and not their pairs with wanted ones.
    """
    slots = F.explode(F.sequence(F.lit(0), F.col("p.slots") - 1)).alias("slot")
    asked = broad.select("field", "p.gram", F.length("folded").alias("size"), slots).distinct()
    parts = sized(
        asked.groupBy("field", _part(F.col("field"), F.col("slot"), F.col("gram")).alias("part")).agg(F.collect_set("size").alias("sizes"))
    )
    near = _only(index.postings, "part", parts, index.stored).join(parts, "part")
    near = near.groupBy("id", "field").agg(F.array_distinct(F.flatten(F.collect_list("sizes"))).alias("sizes"))
    value = F.coalesce(*(F.when(F.col("field") == f, folded(f)) for f in fields))
    cuts = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("value") - n + 1, F.lit(1))), lambda i: F.col("value").substr(i, n)
    )
    read = index.texts.join(near, "id").withColumn("value", value)
    pieces = read.select("*", F.explode(F.array_distinct(F.flatten(F.transform("sizes", cuts)))).alias("folded"))
    return pieces.join(sized(broad.select("want", "field", "folded").distinct()), ["field", "folded"])


def first_names(index: GramIndex, wanted: DataFrame, k: int) -> DataFrame:
    """``(want, name, rank)``: the first ``k`` names, in order, that contain ``wanted(want)``."""
    found = containing(index, wanted, ["name"]).select("want", "name").distinct()
    in_order = Window.partitionBy("want").orderBy("name")
    return found.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= k)
