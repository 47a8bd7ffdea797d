"""Names found inside texts through the different words of all texts, and inside these by an index of grams, each by its rarest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillage.session import work_folder

#: Characters of a gram; shorter names are grams of their own.
SIZE = 4
#: Bytes of words, with the pieces in them, that go to all tasks; if there are more, texts' words are shuffled to them.
SENT = 32 << 20


def grams(text: Column, size: int) -> Column:
    """The distinct runs of so many characters of a text; none if it is shorter. The time is linear in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def _words(text: Column, blanks: bool) -> Column:
    """The distinct words of a text between blanks and, if asked for, its runs of blanks."""
    words = F.array_remove(F.array_distinct(F.split(text, " ")), "")
    return F.array_union(words, F.regexp_extract_all(text, F.lit(" +"), F.lit(0))) if blanks else words


def _saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read from there."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _rarest(parts: DataFrame, postings: DataFrame, whole: str, part: str) -> DataFrame:
    """Each whole of parts(whole, part) with the part that has the fewest postings; none where a part has no posting."""
    spread = postings.groupBy(part).agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), part)).alias("best")
    return parts.join(spread, part, "left").groupBy(whole).agg(best).where("best.n > 0").select(whole, f"best.{part}")


def _words_with(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """(word, pieces) of the words of words(word) that hold some of pieces(piece), each word once; both distinct. A word's grams that some piece has are its postings."""
    short = [r[0] for r in pieces.where(F.length("piece") < SIZE).select(F.length("piece")).distinct().collect()]  # three lengths at most
    parts = pieces.select("piece", F.explode(F.when(F.length("piece") < SIZE, F.array("piece")).otherwise(grams(F.col("piece"), SIZE))).alias("gram"))
    words = _saved(words.select("word", F.monotonically_increasing_id().alias("number")), "words")
    own = F.flatten(F.array(*(grams(F.col("word"), k) for k in sorted({SIZE, *short}))))
    postings = _saved(words.select("number", F.explode(own).alias("gram")).join(parts.select("gram").distinct(), "gram", "left_semi"), "grams")
    found = postings.join(_rarest(parts, postings, "piece", "gram"), "gram").groupBy("number").agg(F.collect_list("piece").alias("near"))
    return words.join(found, "number").select("word", F.filter("near", lambda p: F.contains("word", p)).alias("pieces")).where(F.size("pieces") > 0)


def names_inside(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) for each text of texts(id, text) that holds a name of names(name) as a part, to the letter; each pair once.

    A name's pieces are its runs without blanks (a name of blanks is one piece), and a text that holds a name has each piece inside a word. Pieces are
    looked for once in each different word of all texts, by grams; a name without blanks is in the texts that have such a word, another one's candidates
    are the texts that have its rarest piece, which are then looked at in whole. A name with a piece that no text has is in none. A text gives no more
    rows than it has words with a piece, times the pieces in these, and its grams count only where a word is new; texts without blanks are words of their own.
    Empty names and null texts or names find nothing; ids that repeat stand for all their texts.
    """
    known = names.where("name <> ''").select("name").distinct()
    blanks = not known.where(F.trim("name") == "").isEmpty()
    pieces = F.array_remove(F.array_distinct(F.split("name", " ")), "")
    parts = known.select("name", F.explode(F.when(F.trim("name") == "", F.array("name")).otherwise(pieces)).alias("piece"))
    given = texts.where("id is not null and text is not null").select("id", "text")
    words = given.select("id", F.explode(_words(F.col("text"), blanks)).alias("word"))
    holding = _saved(_words_with(words.select("word").distinct(), parts.select("piece").distinct()), "holding")
    if (holding.agg(F.sum(F.octet_length("word") + F.octet_length(F.array_join("pieces", "")) + 64)).first()[0] or 0) <= SENT:
        holding = F.broadcast(holding)
    postings = _saved(words.join(holding, "word").select("id", F.explode("pieces").alias("piece")).distinct(), "pieces")
    found = postings.join(_rarest(parts, postings, "name", "piece"), "piece")
    looked = found.where("name <> piece").select("id", "name").join(given, "id").where(F.contains("text", "name"))
    return found.where("name = piece").select("id", "name").union(looked.select("id", "name").distinct())
