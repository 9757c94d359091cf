"""Quality rules: counts per text, and a log-likelihood ratio of hashed n-grams between trusted texts and the whole corpus.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: hashed n-grams; their table is broadcast, so its size is fixed
BUCKETS = 1 << 18
#: share of the corpus in the trusted multinomial, so that what trusted texts lack has a bounded ratio at every size
MIX = 0.2
#: texts whose mean ratio (natural logarithm) is below it are not kept
THRESHOLD = -0.4
#: trusted ids up to this number are broadcast (about 32 MB); more are joined by a shuffle, with the same result
_BROADCAST = 1_000_000
#: bytes of a text above which it is taken apart before anything of it becomes an array
_LONG = 1 << 20
#: values that are looked up one by one; more are found by sorting
_FEW = 64
_UNIT = 1_000_000

_BLANK = r"\x20\x09-\x0D"
_WORD = rf"[^{_BLANK}]+"
_SYMBOLS = r"[#*$%&|<>]"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), 0)


def _units(docs: DataFrame, ahead: int) -> DataFrame:
    """(rid, doc_id, th, dups, at, w, all): whole texts, long ones in runs of up to 256 words.

    ``w`` are the words of the run, ``all`` also the first ``ahead`` words after it, ``at`` the number of the run. rid tells rows apart within
    one plan. Short texts have the number of their repeated lines in ``dups``, long ones a hash of the text in ``th``.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("long", F.coalesce(F.octet_length("text") > _LONG, F.lit(False)))
    runs = F.regexp_extract_all("text", F.lit(rf"(?:[^{_BLANK}]++[{_BLANK}]*+){{1,256}}"), 0)
    start = rf"^(?:[^{_BLANK}]++[{_BLANK}]*+){{0,{ahead}}}"
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^{_BLANK}]"))
    rows = rows.select("rid", "doc_id", F.when(F.col("long"), F.xxhash64("text")).alias("th"), F.when(~F.col("long"), lines).alias("lines"),
                       F.when(F.col("long"), runs).otherwise(F.array("text")).alias("runs"))
    cut = F.transform("runs", lambda x, i: F.struct(x.alias("run"), F.regexp_extract(F.get("runs", i + 1), start, 0).alias("more")))
    dups = F.size("lines") - F.size(F.array_distinct("lines"))
    units = rows.select("rid", "doc_id", "th", F.when(F.col("lines").isNotNull(), dups).alias("dups"), F.posexplode_outer(cut).alias("at", "u"))
    none = F.array().cast("array<string>")
    return units.select("rid", "doc_id", "th", "dups", "at", F.coalesce(_words(F.col("u.run")), none).alias("w"), F.coalesce(
        _words(F.col("u.more")), none).alias("more")).select(
        "rid", "doc_id", "th", "dups", "at", "w", F.when(F.size("more") > 0, F.concat("w", "more")).otherwise(F.col("w")).alias("all"))


def _runs_of(size: int, join) -> Column:
    """``join(i)`` for the place i of every run of ``size`` words that begins in ``w``."""
    last = F.least(F.size("w"), F.size("all") - (size - 1))
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), join)).otherwise(F.array())


def _grams(longest: int) -> Column:
    """The n-grams of 1 to ``longest`` words that begin in ``w``, joined by a space."""
    def joined(n):
        return _runs_of(n, lambda i: F.array_join(F.slice("all", i + 1, n), " "))

    more = [joined(n) for n in range(2, longest + 1)]
    return F.concat("w", *more) if more else F.col("w")


def _bucket(gram: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def gains(docs: DataFrame, trusted: DataFrame, longest: int, buckets: int, mix: float) -> DataFrame:
    """(bucket, gain) in millionths: ln((1 - mix) * trusted share / corpus share + mix) of every bucket that occurs.

    Counted over all texts, and over all of trusted documents; tasks send one row a bucket.
    """
    known = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    if known.count() <= _BROADCAST:
        known = F.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id", "left")
    flagged = rows.select(F.coalesce("good", F.lit(False)).cast("long").alias("doc_id"), "text")  # the id is not needed any more
    counts = stored(_units(flagged, longest - 1).select("doc_id", F.explode(_grams(longest)).alias("gram")).groupBy(
        _bucket("gram", buckets).alias("bucket")).agg(F.count("*").alias("s"), F.sum("doc_id").alias("t")), "gram-counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    if not total.t:
        return counts.select("bucket", F.lit(0).cast("long").alias("gain"))
    share = (F.col("t") / F.lit(float(total.t))) / (F.col("s") / F.lit(float(total.s)))
    return counts.select("bucket", F.round(_UNIT * F.log(share * (1 - mix) + mix)).cast("long").alias("gain"))


def _window() -> Column:
    return _runs_of(3, lambda i: F.xxhash64(F.get("all", i), F.get("all", i + 1), F.get("all", i + 2)))


def base_counts(docs: DataFrame, ahead: int) -> DataFrame:
    """(rid, doc_id, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, w, all): a row a unit; the last two counts are NULL
    for the units of long texts."""
    own = _units(docs, ahead).select("*", F.size("w").alias("n_words"), F.array_join("w", "").alias("_chars"), F.when(F.col("th").isNull(), _window()).alias("_h"))
    # what occurs twice is found by sorting the hashes; without a repeat nothing is sorted
    own = own.select("*", F.char_length("_chars").alias("word_chars"), F.regexp_count("_chars", F.lit(_SYMBOLS)).alias("n_symbols"), F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")).alias("_sorted"))
    own = own.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, i: x == F.get("_sorted", i - 1))))
    few = F.size("_twice") <= _FEW
    own = own.withColumn("_places", F.when(~few, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    hits = F.when(few, F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_twice", F.get("_h", i)))).otherwise(
        F.transform(F.filter("_places", lambda y, i: (y["x"] == F.get("_places", i - 1)["x"]) | (y["x"] == F.get("_places", i + 1)["x"])),
                    lambda y: y["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.array(p, p + 1, p + 2)))))
    repeat = F.when(F.col("_h").isNull(), None).when(F.col("_sorted").isNull(), 0).otherwise(covered)
    return own.select("rid", "doc_id", "th", "n_words", "word_chars", "n_symbols", F.col("dups").alias("n_dup_lines"), repeat.alias("n_repeat_words"), "w", "all")


def _long_counts(docs: DataFrame) -> DataFrame:
    """(th, n_dup_lines, n_repeat_words) of the distinct long texts: lines and windows are grouped by shuffles."""
    text = F.col("text").cast("string")
    texts = docs.where(F.octet_length(text) > _LONG).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text")).dropDuplicates(["text"])
    parts = texts.select(F.xxhash64("text").alias("th"), F.explode(F.regexp_extract_all(
        "text", F.lit(r"(?:[^\n]*+\n){1,256}|[^\n]++"), 0)).alias("part"))
    lines = parts.select("th", F.explode(F.split("part", "\n")).alias("line")).where(F.col("line").rlike(rf"[^{_BLANK}]")).groupBy(
        "th", F.sha2("line", 256).alias("line")).agg((F.count("*") - 1).alias("more")).groupBy("th").agg(F.sum("more").alias("n_dup_lines"))
    rows = _units(texts, 2).select("th", "at", F.posexplode(_window()).alias("k", "h")).select("th", (F.col("at") * 256 + F.col("k")).alias("p"), "h")
    twice = rows.groupBy("th", "h").count().where("count > 1").select("th", "h")
    repeats = rows.join(twice, ["th", "h"], "left_semi").select("th", F.explode(F.array("p", F.col("p") + 1, F.col("p") + 2)).alias("p")).distinct(
        ).groupBy("th").agg(F.count("*").alias("n_repeat_words"))
    return lines.join(repeats, "th", "full")


def judged(docs: DataFrame, trusted: DataFrame, longest: int = 1, buckets: int = BUCKETS, mix: float = MIX, threshold: float = THRESHOLD,
           least_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) for every row of documents.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. word_chars: code points in words; n_symbols: characters of ``[#*$%&|<>]``; n_dup_lines:
    lines (split at \\n) with a word that equal an earlier one; n_repeat_words: words in 3-word windows that the text has
    twice or more. base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` percent of them repeated.

    llr is the mean, over a text's n-grams of 1 to ``longest`` words, of ln((1 - mix) * p / q + mix): p and q are the shares of the
    n-gram's bucket (XXH64 of its UTF-8 with seed 42, modulo ``buckets``) in the documents whose id is in ``trusted`` and in all
    documents. Gains are whole millionths, so sums and the comparison with ``threshold`` are exact and every run decides alike.
    kept: not base_failed and llr >= threshold.

    NULL and empty texts have no words: base_failed, llr 0. A NULL doc_id is judged and never trusted. Repeated rows are judged one by one and
    counted as often. Without trusted documents llr is 0 everywhere. Windows count as equal if their 64-bit hashes are. Other columns are not
    read. Empty input: empty. Texts above 1 MiB are taken apart and grouped by shuffles, with the same result.
    """
    table = F.broadcast(stored(gains(docs, trusted, longest, buckets, mix), "gains"))
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    grams = base_counts(docs, longest - 1).select("rid", "doc_id", "th", *counted, F.posexplode_outer(_grams(longest)).alias("pos", "gram"))
    scored = grams.withColumn("bucket", _bucket("gram", buckets)).join(table, "bucket", "left")
    once = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = stored(scored.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("th").alias("th"), *[F.coalesce(F.sum(F.when(once, F.col(c))), F.lit(0)).alias(c) for c in counted],
        F.count("gram").alias("n_grams"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain")), "quality")
    long = rows.where("th is not null").drop("n_dup_lines", "n_repeat_words").join(_long_counts(docs), "th", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_dup_lines", "n_repeat_words")})
    rows = rows.where("th is null").unionByName(long)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    good = F.col("gain") >= F.lit(round(threshold * _UNIT)) * F.col("n_grams")
    llr = F.when(F.col("n_grams") > 0, F.col("gain") / F.col("n_grams") / _UNIT).otherwise(0.0)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       llr.alias("llr"), (~failed & good).alias("kept"))
