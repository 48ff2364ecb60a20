"""Substring search over an inverted index of trigrams (D10 without a product of queries and texts).

The index holds, per user and gram, where the gram stands in which distinct stored text. A word is looked
up by the two of its trigrams that stand in the fewest places: both must stand at the distance they have in
the word, and only the texts left are compared with the word itself. Words of one or two letters are grams
of their own, each text listed once. Grams in very many places are dealt to several parts of their own.
Nothing but the places of two rare grams is ever paired, and each word's answer is its first ``limit`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRAM = 3
# A gram in more places than this is dealt to parts.
PART_PLACES = 1 << 16
# Up to so many asked words, and WORD_LETTERS times as many letters, travel to the texts (a few MB with their
# grams, all of which the driver holds); more meet them by shuffles.
CARRIED_WORDS = 1 << 12
WORD_LETTERS = 8


def distinct_words(text: Column) -> Column:
    """The lower-cased words of a query, each once."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"(?U)\s+")), lambda w: w != "")


def _grams(text: Column, size: int) -> Column:
    """All grams of a text with their places; a split into letters first, so no place is searched for."""
    letters = F.split(text, "")
    count = F.size(letters) - (size - 1)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.concat(*[F.get(letters, i + j) for j in range(size)]).alias("gram"), i.alias("at")))


def stored_texts(history: DataFrame, limit: int, user: Column, text_col: str = "query") -> DataFrame:
    """``(_u, _t, _seqs, _id)``: the distinct lower-cased texts of each user, their first ``limit`` rows,
    and the first row as their number."""
    rows = history.select(user.alias("_u"), F.lower(text_col).alias("_t"), "seq").where(F.col("_t").isNotNull() & F.col("_u").isNotNull())
    first = F.row_number().over(Window.partitionBy("_u", "_t").orderBy("seq"))
    held = rows.withColumn("_r", first).where(F.col("_r") <= limit).groupBy("_u", "_t").agg(F.array_sort(F.collect_list("seq")).alias("_seqs"))
    return held.withColumn("_id", F.get("_seqs", F.lit(0)))


def postings(texts: DataFrame) -> DataFrame:
    """``(_u, gram, _id, at)``: the places of all trigrams."""
    return texts.select("_u", "_id", F.explode(_grams(F.col("_t"), GRAM)).alias("g")).select("_u", "g.gram", "_id", "g.at")


def short_postings(texts: DataFrame) -> DataFrame:
    """``(_u, gram, _id)``: the letters and pairs of letters of each text, once."""
    both = [F.array_distinct(F.transform(_grams(F.col("_t"), n), lambda g: g["gram"])) for n in range(1, GRAM)]
    return texts.select("_u", "_id", F.explode(F.concat(*both)).alias("gram")).select("_u", "gram", "_id")


def _few(words: DataFrame) -> bool:
    """Whether the words and their grams, one per letter, are few enough for the driver."""
    n, letters = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_w")), F.lit(0))).first()
    return n <= CARRIED_WORDS and letters <= WORD_LETTERS * CARRIED_WORDS


def _carried(side: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(side) if few else _dealt(side)


def _dealt(side: DataFrame) -> DataFrame:
    """A side that grows with the tables: it never travels through the driver, however small Spark finds its shuffle files."""
    return side.hint("merge")


def _long_candidates(words: DataFrame, places: DataFrame, few: bool = False) -> DataFrame:
    """``(_u, _w, _id)`` for words of three letters or more; ``few`` says that the words were counted and are few."""
    asked = words.select("_u", "_w", F.explode(_grams(F.col("_w"), GRAM)).alias("g")).select("_u", "_w", "g.gram", F.col("g.at").alias("_o"))
    # only the places of grams that some word has
    places = places.join(_carried(asked.select("_u", "gram").distinct(), few), ["_u", "gram"], "left_semi").checkpoint()
    counts = places.groupBy("_u", "gram").agg(F.count(F.lit(1)).alias("_places"))
    known = asked.join(_dealt(counts), ["_u", "gram"])
    ranked = F.array_sort(F.collect_list(F.struct("_places", "gram", "_o"))).alias("_g")
    # a word one of whose grams stands nowhere has no answer
    plan = known.groupBy("_u", "_w").agg(ranked).where(F.size("_g") == F.size(F.split("_w", "")) - (GRAM - 1))
    rarest = F.get("_g", F.lit(0))
    second = F.get(F.filter("_g", lambda g: g["gram"] != rarest["gram"]), F.lit(0))
    # a word of one kind of gram is looked up by that alone
    picked = F.filter(F.array(rarest, second), lambda g: g.isNotNull())
    parts = F.ceil(F.col("_p._places") / PART_PLACES).cast("long")
    want = plan.select("_u", "_w", F.size(picked).alias("_need"), F.explode(picked).alias("_p")).select(
        "_u", "_w", "_need", F.col("_p.gram").alias("gram"), F.col("_p._o").alias("_o"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    hot = counts.where(F.col("_places") > PART_PLACES).select("_u", "gram", F.ceil(F.col("_places") / PART_PLACES).cast("long").alias("_parts"))
    dealt = places.join(_dealt(hot), ["_u", "gram"], "left").withColumn("_part", F.pmod(F.xxhash64("_id"), F.coalesce("_parts", F.lit(1).cast("long")))).drop("_parts")
    # where each word would have to begin for its grams to stand where they stand: all must agree
    standing = dealt.join(_carried(want, few), ["_u", "gram", "_part"]).withColumn("_begin", F.col("at") - F.col("_o")).where("_begin >= 0")
    met = standing.groupBy("_u", "_w", "_id", "_begin").agg(F.max("_need").alias("_need"), F.countDistinct("gram").alias("_have"))
    return met.where("_have = _need").select("_u", "_w", "_id").distinct()


def matches(words: DataFrame, texts: DataFrame, limit: int, few: bool = False) -> DataFrame:
    """``(_u, _w, seq)``: for each word of a user the first ``limit`` rows whose text contains it."""
    # the number of letters as the index counts them
    letters = F.size(F.split("_w", ""))
    short = short_postings(texts).withColumnRenamed("gram", "_w").join(_carried(words.where(letters < GRAM), few), ["_u", "_w"])
    found = _long_candidates(words.where(letters >= GRAM), postings(texts), few).unionByName(short.select("_u", "_w", "_id"))
    rows = found.join(_dealt(texts), ["_u", "_id"]).where(F.col("_t").contains(F.col("_w"))).select("_u", "_w", F.explode("_seqs").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("_u", "_w").orderBy("seq"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def search(queries: DataFrame, history: DataFrame, limit: int, filter_col: str | None, text_col: str) -> DataFrame:
    """``(query_id, seq)``: per query the first ``limit`` rows that contain one of its words."""
    user = F.col(filter_col).cast("string") if filter_col else F.lit("")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), user.alias("_u"), F.explode(distinct_words(F.col(text_col))).alias("_w"))
    words = asked.select("_u", "_w").where("_u is not null").distinct().checkpoint()
    found = matches(words, stored_texts(history, limit, user).checkpoint(), limit, _few(words))
    hits = asked.join(_dealt(found), ["_u", "_w"]).select("query_id", "seq").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit)
