"""Spelling variants by a variable-length gram index.

1. *Words* are the letter runs of all texts, counted.
2. *Dictionary.*  A word is read as a ring: its letters, an end mark, and round again.
   Grams of ``SHORT`` letters are in the dictionary; a gram that more than ``FREQUENT``
   positions of all words read is extended by one letter, up to ``LONG`` letters.
   The dictionary is thus pruned to rare grams and their frequent beginnings.  Each
   length takes one count over the positions whose gram was frequent before.
3. *Decomposition.*  From each position of the ring a word has the shortest gram that is
   no frequent beginning: one gram per position, which depends on its own letters alone.
   Equal grams of a word are numbered.
4. *Affected grams.*  One inserted, deleted or replaced letter changes only grams that read
   its place, at most the largest number of grams over one place.  With g grams and
   that bound a, a near word shares at least g - a of them; a word of six
   letters has seven grams and a is at most five, so the bound never vanishes.
5. *Merging.*  Of each word only its a + 1 rarest grams open lists (a near word shares one
   of those, rarest of its own).  Two words that meet must share g - a grams of
   each in all, and are then verified by edit distance.

Rows: null and empty texts have no words.  A null doc_id is read as '' where the
contract's deletions ask for it.  Repeated rows count each.  Of near words of equal
count the first in code-point order is the form.  Very long texts are read whole.
An empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.session import cut_lineage, release

LETTER = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"
SHORT, LONG = 2, 5
FREQUENT = 64


def runs_of(documents: DataFrame, least_length: int = 6, thinned: int | None = None) -> DataFrame:
    """(word): the lower-cased runs of ``least_length`` letters or more of all texts, one
    row each.  ``thinned`` deletes a letter of the runs whose crc32 with the doc_id it divides."""
    # a run is read whole or, if it is too short, not at all
    runs = F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))
    rows = (documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                             F.explode(runs).alias("run"))
            .select("id", F.translate("run", UPPER, LOWER).alias("word")))
    if not thinned:
        return rows.select("word")
    h = F.crc32(F.concat("id", F.lit(":"), "word"))
    at = (h % F.length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return rows.select(F.when(h % thinned == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(runs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words of enough letters and occurrences."""
    return (runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= least_count))


def decompose(words: DataFrame) -> DataFrame:
    """(word, pos, gram): the variable-length gram of every ring position."""
    ring = F.concat("word", F.lit(END), F.substring("word", 1, LONG - 1))
    spot = words.select("word", ring.alias("ring"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("pos"))
    open_, done, spent = spot, [], []
    for length in range(SHORT, LONG):
        read = open_.withColumn("gram", F.substring("ring", F.col("pos"), F.lit(length)))
        often = read.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > FREQUENT).select("gram")
        marked = cut_lineage(read.join(often.withColumn("longer", F.lit(True)), "gram", "left"))
        done.append(marked.where("longer IS NULL").select("word", "pos", "gram"))
        open_ = marked.where("longer").drop("gram", "longer")
        spent.append(marked)
    done.append(open_.select("word", "pos", F.substring("ring", F.col("pos"), F.lit(LONG)).alias("gram")))
    out = cut_lineage(reduce(DataFrame.unionByName, done))
    release(*spent)
    return out


def _affected(grams: Column, letters: Column) -> Column:
    """The largest number of grams over one place of the ring.  ``grams`` are
    (pos, gram); positions and places run from 1 to letters + 1."""
    ring = letters + 1
    over = lambda place: F.size(F.filter(grams, lambda g: (
        F.pmod(place - g["pos"], ring) < F.length(g["gram"]))))
    return F.array_max(F.transform(F.sequence(F.lit(1), ring), over))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): both directions of every two words of ``words`` (word, n) that differ
    by one inserted, deleted or replaced letter.  Words have LONG + 1 letters or more."""
    pieces = decompose(words.select("word"))
    again = Window.partitionBy("word", "gram").orderBy("pos")
    named = cut_lineage(pieces.withColumn("again", F.row_number().over(again))
                        .withColumn("token", F.concat_ws("\u0000", "gram", "again")))
    lists = named.groupBy("token").agg(F.count("*").alias("c"))
    entry = F.struct("c", "token", "pos", "gram")
    index = (named.join(lists, "token").groupBy("word").agg(F.array_sort(F.collect_list(entry)).alias("e"))
             .withColumn("a", _affected(F.col("e"), F.length("word"))))
    index = cut_lineage(index.select("word", "a", F.col("e.token").alias("tokens"), F.col("e.c").alias("counts")))
    release(pieces, named)
    # a token of one word alone opens no list
    heads = (index.select("word", "a", "tokens", F.explode(F.arrays_zip(
                 F.slice("tokens", F.lit(1), F.col("a") + 1).alias("token"),
                 F.slice("counts", F.lit(1), F.col("a") + 1).alias("c"))).alias("x"))
             .where("x.c > 1").select("word", "a", F.col("x.token").alias("token")))
    left = heads.select("token", F.col("word").alias("u"), F.length("word").alias("l_u"))
    right = heads.select("token", F.col("word").alias("v"), F.length("word").alias("l_v"))
    met = (left.join(right, "token").where((F.col("u") < F.col("v")) & (F.abs(F.col("l_u") - F.col("l_v")) <= 1))
           .select("u", "v").distinct())
    side = lambda s: index.select(F.col("word").alias(s), F.col("tokens").alias(f"t_{s}"),
                                  (F.size("tokens") - F.col("a")).alias(f"least_{s}"))
    merged = (met.join(side("u"), "u").join(side("v"), "v")
              .where(F.size(F.array_intersect("t_u", "t_v")) >= F.greatest("least_u", "least_v"))
              .where(F.levenshtein("u", "v", 1) == 1))
    found = cut_lineage(merged.select("u", "v"))
    release(index)
    return found.select(F.col("u").alias("word"), F.col("v").alias("near")).unionByName(
        found.select(F.col("v").alias("word"), F.col("u").alias("near")))


def variant_groups(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n).

    ``form`` is the most frequent near word if it has ``times`` the occurrences;
    ``root`` is where the forms lead to.  n grows along forms, so chains end;
    their length is at most log(largest n) / log(times), and each round halves it.
    """
    words = cut_lineage(words)
    near = near_words(words)
    best = (near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count("*").alias("n_near"),
                                 F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")))
    row = (words.join(best, "word", "left")
           .withColumn("form_n", F.when(-F.col("b.m") >= times * F.col("n"), -F.col("b.m")))
           .select("word", F.when(F.col("form_n").isNotNull(), F.col("b.near")).alias("form"), "n",
                   F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    row = cut_lineage(row)
    root = cut_lineage(row.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        onward = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(root.join(onward, "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root"),
                                   F.col("next").isNotNull().alias("moved")))
        release(root)
        root = step
        if step.where("moved").isEmpty():
            break
        root = step.drop("moved")
        root._citeweave_path = step.__dict__.pop("_citeweave_path")
    return (row.join(root.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
