"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

A document is a weighted set of words (lower case, split at white space; the weight is how often a word occurs). For
each of the ``samples`` places of a signature and each word with weight S, r and c are gamma(2, 1) variates and b a
uniform one, all drawn from hashes of the word and the place; t = floor(ln S / r + b), y = exp(r (t - b)), and the
place holds the word, with its t, of least c / (y exp r). Two signatures agree at a place with the probability of the
documents' generalised Jaccard similarity (the sum of the lesser weights over that of the greater), so the share of
equal places estimates it with a standard error of sqrt(J (1 - J) / samples), 0.09 at most for 32 samples.

How it runs. Words are exploded within the task that holds their document, their draws are generated code (``LANES``
places in a row), and the least draw of each place is an ordinary hash aggregate. Nothing but documents is shuffled,
once: they are dealt by ranges of their place in the order of ids, and the first document of a range also goes, as a
guest, to the range above, whose last document it follows. The ranges' bounds are a table of one row with an entry for
each range, and documents are placed by a binary search in it, so neither plan nor driver grows with the documents.
Documents with one id, or without any, are dealt by their texts.

Defined results: a null text is an empty one; texts without a word have an empty signature, likeness 1 to each other
and 0 to others; null ids count as the least; equal ids go by their first 64 characters, then by a hash of the text;
repeated rows (of one id and one text) follow each other and have one row each; the only document is its own next; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .op4_quality import words_of

#: places of a signature, and how many of them are drawn in one row
SAMPLES, LANES = 32, 8
#: characters of text in a range at most, unless the session asks for more partitions
RANGE = 1 << 28
_NO_ID = -(1 << 63)
_LOW, _SPAN = -60.0, 80.0  # the logarithms of ranks


def _gamma(u: Column) -> Column:
    """A gamma(2, 1) variate: minus the logarithm of two uniform ones, each of 16 of the 32 bits of u."""
    high, low = F.shiftright(u, 16).cast("double") + 0.5, u.bitwiseAND(F.lit(0xFFFF)).cast("double") + 0.5
    return F.lit(32 * math.log(2)) - F.log(high * low)


def sample(word: Column, log_weight: Column, place: Column | int) -> Column:
    """Of a word at a place: 31 bits of the logarithm of its rank, and 32 bits that identify (word, t), as one long."""
    place = F.lit(place) if isinstance(place, int) else place
    x = F.xxhash64(word, place)
    y = F.xxhash64(x, place)
    r, log_c = _gamma(F.shiftrightunsigned(x, 32)), F.log(_gamma(x.bitwiseAND(F.lit(0xFFFFFFFF))))
    b = (F.shiftrightunsigned(y, 32).cast("double") + 0.5) * 2.0**-32
    t = F.floor(log_weight / r + b)
    rank = log_c - r * (t - b + 1)  # the logarithm of c / (y exp r), in the same order; with 32 bits for each variate it is above _LOW
    step = ((rank - _LOW) * (float((1 << 31) - 1) / _SPAN)).cast("long")
    return F.shiftleft(step, 32).bitwiseOR((y.bitwiseAND(F.lit(0xFFFFFFFF)) + t).bitwiseAND(F.lit(0xFFFFFFFF)))


def weighted_words(text: Column) -> dict[str, Column]:
    """Steps to an array of (word's hash, how often it occurs); each uses the columns of those before."""
    hashes = F.sort_array(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))
    h, at = F.col("f_hashes"), F.col("f_at")
    places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    # where each distinct word begins among the sorted hashes
    begins = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, F.greatest(i - 1, F.lit(0)))))
    words = F.transform(at, lambda i, j: F.struct(F.get(h, i).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(h)) - i).alias("n")))
    return {"f_hashes": hashes, "f_at": begins, "f_words": words}


def signatures(df: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, signature_0, signature_1, ...) of the columns texts: array<long> with an entry for each place, empty for a
    text without words, null for a null text. Rows whose texts are all null have no row.

    keys tell the rows of df apart. If df is dealt by some of them, nothing is shuffled."""
    if samples % LANES:
        raise ValueError(f"samples must be a multiple of {LANES}")
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(t).alias("said")) for i, t in enumerate(texts))))
    df = df.select(*keys, sides.alias("s")).select(*keys, "s.side", "s.said").where("said IS NOT NULL")
    for name, step in weighted_words(F.col("said")).items():
        df = df.withColumn(name, step)
    by = [*keys, "side"]
    words = df.select(*by, F.explode_outer("f_words").alias("w")).select(*by, F.col("w.word").alias("word"), F.log(F.col("w.n").cast("double")).alias("log_n"))
    rows = words.select(*by, "word", "log_n", F.explode(F.array(*map(F.lit, range(samples // LANES)))).alias("part"))
    seed = F.xxhash64("word", "part")  # without a word log_n is null, and so is the sample
    least = rows.groupBy(*by, "part").agg(*(F.min(sample(seed, F.col("log_n"), j)).alias(f"m{j}") for j in range(LANES)))
    whole = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("side", "part", F.array(*(F.col(f"m{j}") for j in range(LANES))).alias("m")))).alias("parts"))

    def signature(k: int) -> Column:
        own = F.filter("parts", lambda p: p["side"] == k)
        filled = F.filter(F.flatten(F.transform(own, lambda p: p["m"])), lambda m: m.isNotNull())
        return F.when(F.size(own) > 0, F.transform(filled, lambda m: m.bitwiseAND(F.lit(0xFFFFFFFF))))

    return whole.select(*keys, *(signature(k).alias(f"signature_{k}") for k in range(len(texts))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places; 1 if both signatures are empty, 0 if one is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(same / F.greatest(F.size(a), F.size(b), F.lit(1)).cast("double"))


def bounds(keyed: DataFrame, chars: int) -> tuple[DataFrame, int, bool]:
    """A table of one row with the greatest key of each range of about so many characters, how many ranges there are, and
    whether rows are repeated. keyed: key, n_chars."""
    order = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("n_chars")), "order")
    total, most = order.agg(F.sum(F.col("n_chars") * F.col("n")), F.max("n")).first()
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // chars))
    tops = order.repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("top"))
    table = stored(tops.agg(F.sort_array(F.collect_list("top")).alias("tops")), "bounds")
    return table, table.select(F.size("tops")).first()[0], (most or 0) > 1


def _ranged(docs: DataFrame, table: DataFrame, ranges: int) -> DataFrame:
    """docs with the number of tops below their keys as home: a binary search, a step for each doubling of the ranges."""
    tops = table.select("tops").scalar()
    docs = docs.withColumn("home", F.lit(0))
    for k in reversed(range(max(0, ranges - 1).bit_length())):
        beyond = F.get(tops, F.col("home") + ((1 << k) - 1)) < F.col("key")  # null past the end
        docs = docs.withColumn("home", F.col("home") + F.when(beyond, 1 << k).otherwise(0))
    return docs.withColumn("is_top", F.get(tops, F.col("home")) == F.col("key"))


def compare_edits(
    df: DataFrame, chars: int = RANGE, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", of_edited: Callable[[Column], dict[str, Column]] | None = None
) -> DataFrame:
    """doc_id, n_chars, edited_text, both signatures and near_edited, near_next: one row for each row of df.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document
    in descending order of ids; the first follows the last. of_edited gives columns to return instead of the edited
    text, which then isn't shuffled again."""
    of_edited = of_edited or (lambda text: {"edited_text": text})
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    key = F.struct(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.substring(text, 1, 64).alias("head"), F.xxhash64(text).alias("mark"))
    docs = df.select(key.alias("key"), text)
    table, ranges, repeated = bounds(docs.select("key", F.length("text").cast("long").alias("n_chars")), chars)
    copies = F.lit(1).cast("long")
    if repeated:  # rows that follow themselves: one stands for all
        docs, copies = docs.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), F.col("copies")
    # the greatest key of a range is its first document, which follows the last of the range above; the greatest of all follows the least
    at = [F.struct(F.col("home").alias("range"), F.lit(0).alias("guest")), F.struct(((F.col("home") + 1) % max(1, ranges)).alias("range"), F.lit(1).alias("guest"))]
    placed = _ranged(docs, table, ranges).select("key", "text", copies.alias("copies"), F.explode(F.when(F.col("is_top"), F.array(*at)).otherwise(F.array(at[0]))).alias("p"))
    placed = placed.select("p.range", "p.guest", "key", "text", "copies").repartition(max(1, ranges), "range")
    order = W.partitionBy("range").orderBy("guest", F.desc("key"))
    rows = placed.withColumns({"row": F.row_number().over(order), "after": F.lead("text").over(order)})
    half = F.floor(F.length("text") / 2).cast("int")

    def edited(after: str) -> Column:
        return F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce(after, F.lit("")), F.lit(1), half))

    home = F.col("guest") == 0
    texts = rows.select("range", "row", "text", F.when(home, edited("after")).alias("edited"), F.when(home & (F.col("copies") > 1), edited("text")).alias("own"))
    signed = signatures(texts, ["range", "row"], ["text", "edited", *["own"] * repeated], samples)
    signed = signed.withColumn("next", F.lead("signature_0").over(W.partitionBy("range").orderBy("row"))).hint("shuffle_hash")

    def following(after: str) -> Column:
        return F.struct(*(c.alias(name) for name, c in of_edited(edited(after)).items()))

    out = rows.where(home).select(
        "range", "row", F.when(F.col("key.known"), F.col("key.id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), following("after").alias("last"), *([following("text").alias("own"), "copies"] if repeated else [])
    )
    out = out.join(signed, ["range", "row"])
    last = F.struct("last.*", F.col("signature_1").alias("edited_signature"), "next")
    if repeated:  # the last copy has the next document, the others the copy after them
        others = F.array_repeat(F.struct("own.*", F.col("signature_2").alias("edited_signature"), F.col("signature_0").alias("next")), (F.col("copies") - 1).cast("int"))
        found = F.explode(F.when(F.col("copies") > 1, F.concat(F.array(last), others)).otherwise(F.array(last)))
        out = out.select("doc_id", "n_chars", "signature_0", found.alias("x")).select("doc_id", "n_chars", "signature_0", "x.*")
    else:
        out = out.select("doc_id", "n_chars", "signature_0", "last.*", F.col("signature_1").alias("edited_signature"), "next")
    names = [c for c in out.columns if c not in ("doc_id", "n_chars", "signature_0", "edited_signature", "next")]
    near = [likeness(F.col("signature_0"), F.col(c)).alias(name) for c, name in (("edited_signature", "near_edited"), ("next", "near_next"))]
    return out.select("doc_id", "n_chars", *names, F.col("signature_0").alias("signature"), "edited_signature", *near)
