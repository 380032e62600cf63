"""Benchmark decontamination: a broadcast hash set of test n-grams over token windows.

DataFrame operations only.  A document row is exploded into its windows inside one
generated-code stage (word list -> windows -> hash probe), so only hits are
shuffled; a sentinel row per document carries its word count through the same scan.
The set is broadcast only while its bytes are within MAX_BROADCAST.  A larger one meets
the windows in a shuffle of bare keys; only candidates fetch their words for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepwell.llm.common import checked_broadcast, documents, materialise, row_uid

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bytes of n-grams and item names that may be broadcast.
MAX_BROADCAST = 64 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() where the text holds no other capital letter."""
    other = text.rlike("[[\\p{IsUppercase}\\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _key(n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(F.col("w"), F.col("i") + j) for j in range(n)])


def benchmark_grams(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(item, m, gram): windows of n words; all words of an item that has 1 to n-1."""
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), words(benchmark[text_col]).alias("w"))
    m = F.least(F.size("w"), F.lit(n))
    return (
        items.filter(F.size("w") > 0)
        .select("item", "w", m.alias("m"), F.explode(F.sequence(F.lit(0), F.size("w") - m)).alias("i"))
        .select("item", "m", F.array_join(F.expr("slice(w, i + 1, m)"), " ").alias("gram"))
        .distinct()
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    n: int = 10,
) -> DataFrame:
    """Per document: doc_id, uid, n_rows, n_words, spans, items.

    spans: array of (start, length) of the windows hit, in words; items: sorted item
    ids as strings.  Documents with equal id and text are one row with n_rows > 1.
    Null texts have no words; items without words or with a null id are never hit
    (a null id cannot be named).  Either table may be empty.
    """
    grams = benchmark_grams(benchmark.filter(benchmark[item_col].isNotNull()), item_col, item_text, n)
    grams = materialise(grams, "grams")
    size = F.octet_length("gram") + F.octet_length("item") + 64
    lengths = sorted(r.m for r in grams.select("m").distinct().collect())  # at most n values
    small = (grams.agg(F.sum(size)).first()[0] or 0) <= MAX_BROADCAST
    base = documents(docs, id_col, text_col)
    return _by_broadcast(base, grams, lengths) if small or not lengths else _by_shuffle(base, grams, lengths)


def _cut(base: DataFrame, *more: str) -> DataFrame:
    """The documents as words; no sort should hold these, which take several times the room of the text."""
    return base.select("doc_id", "uid", words(F.col("text")).alias("w"), *more)


def _probe(grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The n-grams with the keys of their words."""
    key = F.lit(None).cast("long")
    for m in lengths:
        key = F.when(F.col("m") == m, F.xxhash64(F.lit(m), *[F.get("w", F.lit(j)) for j in range(m)])).otherwise(key)
    return grams.withColumn("w", F.split("gram", " ")).withColumn("probe_key", key).withColumnRenamed("m", "length").drop("w")


def _by_broadcast(base: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    texts = grams.groupBy("m", "gram").agg(F.collect_set("item").alias("owners"))
    probe = F.broadcast(_probe(texts, lengths))
    windows = _cut(base).select("doc_id", "uid", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("i"))
    keys = [F.when((F.col("i") >= 0) & (F.col("i") + m <= F.size("w")), _key(m)) for m in lengths]
    if len(keys) > 1:
        windows = windows.select("doc_id", "uid", "w", "i", F.explode(F.array(*keys)).alias("key"))
    else:
        windows = windows.withColumn("key", keys[0] if keys else F.lit(None).cast("long"))
    same = F.expr("key = probe_key AND gram = array_join(slice(w, i + 1, length), ' ')")
    found = windows.join(probe, same, "left").filter("length IS NOT NULL OR i < 0")
    span = F.when(F.col("i") >= 0, F.struct(F.col("i").alias("start"), "length")).alias("span")
    # the aggregate sorts its rows beyond a few groups, so no words go there
    found = found.select("doc_id", "uid", F.when(F.col("i") < 0, F.size("w")).alias("size"), span, "owners")
    return (
        found.groupBy("doc_id", "uid")
        .agg(
            F.max("size").cast("long").alias("n_words"),
            (F.count("size") / F.lit(max(1, len(keys)))).cast("int").alias("n_rows"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"),
        )
        .select("doc_id", "uid", "n_rows", "n_words", "spans", "items")
    )


def _by_shuffle(base: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """Keys without words meet first; candidates are confirmed on their words, and only then named."""
    probe = materialise(_probe(grams.select("m", "gram").distinct(), lengths), "probe")
    keys = F.array(*[F.when(F.col("i") + m <= F.size("w"), F.struct(F.lit(m).alias("length"), _key(m).alias("key"))) for m in lengths])
    windows = _cut(base).filter(F.size("w") > 0).select("uid", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    windows = windows.select("uid", "i", F.explode(keys).alias("x")).filter("x IS NOT NULL").select("uid", "i", "x.*")
    known = probe.select(F.col("probe_key").alias("key"), "length").distinct()
    found = materialise(windows.join(materialise(known, "keys"), ["key", "length"]).select("uid", "i", "length"), "candidates")
    places = materialise(found.groupBy("uid").agg(F.collect_set(F.struct("i", "length")).alias("at")), "places")
    said = lambda x: F.array_join(F.slice("w", x["i"] + 1, x["length"]), " ")
    at = F.transform("at", lambda x: F.struct(x["i"].alias("i"), x["length"].alias("length"), said(x).alias("gram")))
    texts = _cut(base.join(places, "uid"), "at").select("uid", F.explode(at).alias("x")).select("uid", "x.*")
    sure = materialise(texts.join(probe.select("length", "gram"), ["length", "gram"]).distinct(), "confirmed")
    spans = sure.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct(F.col("i").alias("start"), "length"))).alias("spans"))
    named = sure.select("uid", "length", "gram").distinct().join(grams.withColumnRenamed("m", "length"), ["length", "gram"])
    items = named.select("uid", "item").distinct().groupBy("uid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    counts = _cut(base).groupBy("doc_id", "uid").agg(F.max(F.size("w")).cast("long").alias("n_words"), F.count("*").cast("int").alias("n_rows"))
    out = counts.join(spans, "uid", "left").join(items, "uid", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return out.select(
        "doc_id", "uid", "n_rows", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def step(acc: Column, x: Column) -> Column:
        end = x.start + x.length
        fresh = F.greatest(F.lit(0), end - F.greatest(acc.reach, x.start))
        return F.struct((acc.n + fresh).alias("n"), F.greatest(acc.reach, end).alias("reach"))

    return F.aggregate(spans, start, step, lambda acc: acc.n).cast("long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text holds no benchmark window.

    Rows with null or empty texts, and repeated rows without a window, stay; null ids are
    ids like any other; either table may be empty.
    """
    hits = find_hits(docs, benchmark, n=n).filter(F.size("spans") > 0).select("uid").distinct()
    hits = checked_broadcast(materialise(hits, "hits"))
    # the table's own columns travel in one struct, so that no name can clash
    held = docs.select(F.struct("*").alias("row"), row_uid(docs).alias("uid"))
    return held.join(hits, "uid", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
