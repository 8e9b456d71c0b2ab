"""Posting lists: which rows hold which query words, the first rows of every word only.

A word has no white space, so it lies within one token of a text. The distinct tokens
of all texts, far fewer than the texts have words, are matched with the words as substrings;
rows then meet words by equal tokens, and texts themselves never move. Lists are ordered by what does
not depend on the query. Of a list that is cut after k rows every task passes on k rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.matching import words_within


def token_rows(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """(keep..., token): the distinct tokens of every text that can hold a word of three characters."""
    return rows.select(*keep, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias("token")).filter(F.length("token") > 2)


def words_in_tokens(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word) for every distinct token that contains a word."""
    return words_within(tokens.select("token").distinct(), "token", words, "word")


def rows_of_words(rows: DataFrame, text: Column, words: DataFrame, keep: list[str]) -> DataFrame:
    """(word, keep...) for rows whose text contains the word, once per token that does.

    A text has many tokens, but Spark sizes them by the texts; both sides are shuffled, so that tokens are never broadcast.
    """
    tokens = token_rows(rows, text, keep)
    return tokens.hint("merge").join(words_in_tokens(tokens, words), "token").select("word", *keep)


def posting_lists(
    rows: DataFrame, text: Column, words: DataFrame, keep: list[str], order: list[Column] | None = None, k: int | None = None
) -> DataFrame:
    """(word, keep...) for rows whose text contains the word; with ``k`` the first k rows of each word.

    ``keep`` includes the id, and ``order`` is total on it. A row may come more than once for one word.
    """
    lists = rows_of_words(rows, text, words, keep)
    return lists if k is None else first_of(lists, ["word"], order, k).drop("place")


def first_of(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k different rows per key with their place; repeats of a row share a place."""
    place = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= k).distinct()


def rows_of_queries(
    rows: DataFrame, text: Column, words: DataFrame, keep: list[str], order: list[Column] | None = None, k: int | None = None, by: list[str] | None = None
) -> DataFrame:
    """(query_id, keep...) for rows whose text contains any word of the query; with ``k`` the first k rows per query and their place.

    The first k rows of a query are among the first k rows of its words. ``words`` has (query_id, word). ``by``, a part of
    ``keep``, tells kinds of rows apart that have first rows of their own.
    """
    by = by or []
    lists = rows_of_words(rows, text, words, keep)
    asked = words.select("query_id", "word").distinct()
    if k is None:
        return lists.join(asked, "word").select("query_id", *keep).distinct()
    lists = first_of(lists, ["word", *by], order, k).drop("place")
    return first_of(lists.join(asked, "word").drop("word"), ["query_id", *by], order, k)
