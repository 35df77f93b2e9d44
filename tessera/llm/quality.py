r"""Quality rules: within-document base counts and cross-document line frequency.

Base counts are array expressions over the words ``[^\x20\x09-\x0D]+`` of one text. For the
cross-document rule every line with a word is normalised (lower case, single blanks,
trimmed) and hashed; for each host the distinct documents holding a line are counted, and
lines held by more than ``max_docs`` are removed. A document is rejected if what remains of
its distinct lines has fewer than ``min_words`` words or less than ``min_share`` of them.

Texts are read once: the counts and the hashes, lengths and word counts of lines are
written as a table, and only these are shuffled. Counting is pre-aggregated, so a very common line
costs a row a task; the removed lines are broadcast if few, else joined back under ``SALTS``
salts, so it is not one task's work either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, key_text, spaced, words, written

SYMBOLS = "#*$%&|<>"
SALTS = 32
#: Removed lines that are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bits of a packed window that hold its place; texts with more windows are sorted unpacked.
PLACE = 24


def _window_hash(w: Column, x: Column, i: Column) -> Column:
    return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))


def packed_windows(w: Column) -> Column:
    """The 3-word windows of ``w`` as sorted longs: high bits of the hash, then the place."""
    place = F.lit((1 << PLACE) - 1)
    first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return F.sort_array(F.transform(first, lambda x, i: _window_hash(w, x, i).bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long").bitwiseAND(place))))


def repeated(w: Column, s: Column) -> Column:
    """The places, ascending, of the windows of ``w`` found twice or more; ``s`` is ``packed_windows(w)``.

    Windows count as equal by the high bits of their hashes; ``base`` compares the whole ones, and where
    they differ (hardly ever) sorts all windows of the text by whole hashes instead. Null for too many windows.
    """
    high = lambda k: F.shiftright(F.get(s, k), PLACE)
    close = F.filter(s, lambda x, k: (F.shiftright(x, PLACE) == high(k + 1)) | (F.shiftright(x, PLACE) == high(k - 1)))
    at = F.transform(F.filter(close, lambda x: x.isNotNull()), lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    return F.when(F.size(s) < (1 << PLACE), at)


def _unpacked(w: Column) -> Column:
    """``repeated`` by sorting whole hashes with their places."""
    first = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    pairs = F.sort_array(F.transform(first, lambda x, i: F.struct(_window_hash(w, x, i).alias("h"), i.alias("i"))))
    near = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))
    # one-element arrays name the sorted pairs, which are used three times
    return F.sort_array(F.transform(F.flatten(F.transform(F.array(pairs), near)), lambda x: x["i"]))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and empty texts have no words and fail. Columns of these names are replaced.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    out = docs.drop(*[c for c in docs.columns if c.lower() in (*new, "w_", "s_", "p_", "h_", "l_")])
    t = F.coalesce(F.col(text), F.lit(""))
    bare = t
    for c in SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    out = out.withColumns({
        "w_": words(F.col(text)),
        "n_symbols": (F.length(t) - F.length(bare)).cast("long"),
        "l_": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" " + SPACES))) > 0),
    })
    out = out.withColumns({
        "n_words": F.size("w_").cast("long"),
        "word_chars": F.length(F.array_join("w_", "")).cast("long"),
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        "s_": packed_windows(F.col("w_")),
    }).drop("l_")
    out = out.withColumn("p_", repeated(F.col("w_"), F.col("s_"))).drop("s_")
    out = out.withColumn("h_", F.array_distinct(F.transform("p_", lambda i: _window_hash(F.col("w_"), F.get("w_", i), i))))
    # as many whole hashes as high bits: the places are right
    sure = F.size("h_") == F.size(F.array_distinct(F.transform("h_", lambda x: F.shiftright(x, PLACE))))
    out = out.withColumn("p_", F.when(F.col("p_").isNotNull() & sure, F.sort_array("p_")).otherwise(_unpacked(F.col("w_")))).drop("w_", "h_")
    gaps = F.transform("p_", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p_", i + 1) - x, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, b: a + b).cast("long")).drop("p_")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normalised(text: Column) -> Column:
    """The distinct lines with a word, in lower case, with single blanks, trimmed."""
    t = spaced(F.lower(F.coalesce(text, F.lit(""))), SPACES.replace("\n", ""))
    norm = F.transform(F.split(t, "\n"), lambda x: F.concat_ws(" ", F.array_remove(F.split(x, " "), "")))
    return F.array_distinct(F.array_remove(norm, ""))


def lines(text: Column) -> Column:
    """(line, chars, n) of each of a text's distinct normalised lines: hash, length, number of words."""
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return F.transform(normalised(text), lambda x: F.struct(F.xxhash64(x).alias("line"), F.length(x).alias("chars"), (blanks(x) + 1).alias("n")))


def judge(docs: DataFrame, max_docs: int = 20, min_words: int = 50, min_share: float = 0.3, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, base columns, line_words, removed_words, kept) of each row of ``docs``.

    ``line_words`` counts the words of distinct lines, ``removed_words`` those in lines above the
    limit. Distinct documents are told apart by id, host and text; a null id is an id, a null host a
    host. Repeated rows have one verdict. An empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), key_text(F.col(host)).alias("host"))
    slim = slim.withColumns({"same": F.xxhash64("host", F.col("text").isNull(), "text"), "lines": lines(F.col("text"))})
    rows = written(base(slim).drop("text"))
    each = rows.select("doc_id", "same", "host", F.explode("lines").alias("x")).select("doc_id", "same", "host", "x.*")
    holders = each.groupBy("host", "line", "chars", "doc_id", "same").agg(F.first("n").alias("n"))
    frequent = written(holders.groupBy("host", "line", "chars").count().where(F.col("count") > max_docs).drop("count"))
    if frequent.count() <= BROADCAST_ROWS:
        hits = each.join(F.broadcast(frequent), ["host", "line", "chars"], "left_semi")
    else:
        salt = F.pmod(F.xxhash64("doc_id", "same"), F.lit(SALTS)).cast("int")
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("salt", salt).join(salted, ["host", "line", "chars", "salt"], "left_semi")
    hits = hits.dropDuplicates(["doc_id", "same", "line", "chars"])
    removed = hits.groupBy(F.col("doc_id").alias("of"), F.col("same").alias("same_")).agg(F.sum("n").alias("removed_words"))
    rows = rows.withColumn("line_words", F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).cast("long")).drop("lines", "host")
    rows = rows.join(removed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("same_")), "left").drop("of", "same", "same_")
    rows = rows.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    left = F.col("line_words") - F.col("removed_words")
    whole = (F.col("removed_words") == 0) | ((left >= min_words) & (left >= min_share * F.col("line_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & whole)
