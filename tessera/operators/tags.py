"""Part-of-speech tags: reduced sets, ignored tags, and dictionaries of the states a word may take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normal_number, normal_trimmed

# Reduced tags and the full tags of the Penn treebank that they stand for.
PENN = {
    "ADJ": "CD JJ JJR JJS PRP$",
    "CONJ": "CC",
    "ENDPUNC": ".",
    "LPUNC": "-LRB- `` $",
    "POS": "POS",
    "PRT": "RP",
    "TO": "TO",
    "V": "MD VBD VBP VB VBZ",
    "VBG": "VBG",
    "ADV": "RB RBR RBS",
    "DET": "DT PDT",
    "INPUNC": ", : LS SYM UH",
    "N": "EX FW NN NNP NNPS NNS PRP",
    "PREP": "IN",
    "RPUNC": "-RRB- ''",
    "W": "WDT WP$ WP WRB",
    "VBN": "VBN",
}
PENN_FULL = {full: reduced for reduced, tags in PENN.items() for full in tags.split()}


def reduced(tag: Column, names: dict[str, str] | None = PENN_FULL) -> Column:
    """The reduced tag of a full one; null if the set has none. Without `names` tags are reduced already."""
    return tag if names is None else F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[tag]


def without(tokens: DataFrame, ignored: list[str], tag: str = "tag") -> DataFrame:
    """Tokens whose tag is not ignored; those without a tag go as well."""
    return tokens.where(F.col(tag).isNotNull() & ~F.col(tag).isin(ignored))


def normalized(tokens: DataFrame, tag_set: str) -> DataFrame:
    """Words in the form their tag set asks for: penn and brown are trimmed, numbered gives # for numbers, plain stays, others are lower-cased. Tokens whose word is empty then go."""
    word = F.col("word")
    form = {"penn": normal_trimmed(word), "brown": normal_trimmed(word), "numbered": normal_number(word), "plain": word}.get(tag_set, F.lower(word))
    return tokens.withColumn("word", form).where("word <> ''")


def tag_numbers(tokens: DataFrame, tag: str = "tag") -> DataFrame:
    """tag, tag_id: the tags that occur, numbered by name."""
    names = tokens.where(F.col(tag).isNotNull()).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    return names.groupBy().agg(F.sort_array(F.collect_list("tag")).alias("t")).select(F.posexplode("t").alias("tag_id", "tag"))  # a row a tag


def dictionary(tokens: DataFrame, least: int) -> DataFrame:
    """word, states of words seen `least` times or more: the states they had twice or more."""
    per = tokens.groupBy("word", "state").agg(F.count("*").alias("n"))
    got = per.groupBy("word").agg(F.sum("n").alias("freq"), F.sort_array(F.collect_list(F.when(F.col("n") >= 2, F.col("state")))).alias("states"))
    return got.where((F.col("freq") >= least) & (F.size("states") > 0)).select("word", "states")


def allowed(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Adds `allowed`: a state is if its word is not in the dictionary or lists it."""
    got = tokens.join(words.select(F.col("word").alias("of_word"), "states"), F.col("word") == F.col("of_word"), "left")
    return got.withColumn("allowed", F.col("states").isNull() | F.array_contains("states", F.col("state"))).drop("of_word")
