"""Full-text search: words, phrases, alternatives and exclusions from one string; rank. No stemming, no stop words.

`search` reads every text: a document's words are one string with a space around each, so that words
and phrases are substrings. `text_index` finds the same rows from lists of the words asked for.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def parts(asked: str) -> list[list[tuple[bool, list[str]]]]:
    """What a web-search string asks for: alternatives, each a list of (wanted, words of a word or phrase).

    `or` parts alternatives, a dash in front excludes, quotes make a phrase; parts without words and
    alternatives without parts go.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for dash, phrase, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', asked):
        own = re.findall(r"[^\W_]+", (phrase or plain).lower())
        if plain.lower() == "or" and not dash:
            out.append([])
        elif own:
            out[-1].append((not dash, own))
    return [x for x in out if x]


def holds(spaced: Column, alternatives: list[list[tuple[bool, list[str]]]]) -> Column:
    """Whether words with a space around each meet one of the alternatives."""

    def one(wanted: bool, own: list[str]) -> Column:
        there = spaced.contains(f" {' '.join(own)} ")
        return there if wanted else ~there

    return reduce(Column.__or__, [reduce(Column.__and__, [one(*x) for x in own]) for own in alternatives], F.lit(False))


def search(docs: DataFrame, asked: str) -> DataFrame:
    """(id, hits, words): the documents (id, text) that `asked` finds; hits are words that it wants."""
    alternatives = parts(asked)
    sought = sorted({w for own in alternatives for wanted, x in own if wanted for w in x})
    # from a generator, through which no filter is pushed: each text is cut once
    own = docs.select("id", F.explode(F.array(words(F.col("text")))).alias("own"))
    found = own.where(holds(F.concat(F.lit(" "), F.array_join("own", " "), F.lit(" ")), alternatives))
    hits = F.size(F.filter("own", lambda w: w.isin(sought)))
    return found.select("id", hits.cast("long").alias("hits"), F.size("own").cast("long").alias("words"))


def ranked(found: DataFrame, most: int = 20) -> DataFrame:
    """The `most` best: hits over the document's words; ties by id."""
    rank = F.coalesce(F.try_divide("hits", "words"), F.lit(0.0))
    return found.select("id", "hits", rank.alias("rank")).orderBy(F.col("rank").desc(), "id").limit(most)
