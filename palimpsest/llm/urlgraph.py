"""URL filters: rules by host and path, and trust propagated over the graph of hosts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

#: the share that is passed on, and the relative change of a rank below which it counts as settled
DAMPING, TOLERANCE = 0.85, 1e-7
#: rounds between two looks at the change, and rounds after which something must be wrong
_ROUNDS, _MOST_ROUNDS = 10, 10_000
#: links and ranks that one task of a round works on: small graphs need few tasks, and rounds are many
_ROWS = 100_000
#: a host is blocked if its distrust exceeds its trust by more than this factor
FACTOR = 1.000001
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as a struct (rule, verdict), or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, hierarchy: bool = True) -> DataFrame:
    """(src, dst, n): links between different hosts; pages has host and html.

    Absolute links in href attributes count once for each time they occur. With ``hierarchy`` each host and its parent
    domain point at each other once, so hosts that link nowhere still belong to their domain; a parent is a host of two
    labels or more. Links are counted inside each partition before they are shuffled.
    """
    links = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""), 1)
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("dst")).select(
        "src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    edges = found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    if hierarchy:
        hosts = pages.where("host <> ''").select("host").distinct()
        parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
        up = hosts.select("host", parent.alias("parent")).where("parent <> ''")
        both = up.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")),
                                           F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.*")
        edges = edges.unionByName(both.withColumn("n", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return edges


def _rounds_session(spark: SparkSession, parts: int) -> SparkSession:
    """A session for rounds whose size is known. Adaptive plans are made anew after every stage, each time for all rounds that are
    left, and the driver keeps them; here a plan of several rounds is made once."""
    rounds = spark.newSession()
    rounds.conf.set("spark.sql.adaptive.enabled", "false")
    rounds.conf.set("spark.sql.shuffle.partitions", str(parts))
    return rounds


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust: weights).

    Personalised PageRank: trust starts at the trusted seeds and follows links, distrust starts at the blocked ones and
    follows them backwards, both in one join a round. Weights are shares of their sum; what a host without onward links
    holds is not passed on. Rounds go on until no rank changes by more than ``tolerance`` of itself, so a host is reached however far
    it is from a seed; the change is one number, looked at every few rounds, when the ranks become a table in the shared folder. With
    damping d that takes about log(tolerance) / log(d) rounds more than the longest way from a seed.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    parts = max(1, -(-edges.count() // _ROWS))
    spark = edges.sparkSession
    rounds = _rounds_session(spark, parts)
    steps = stored(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("share")).coalesce(parts), "steps", rounds)
    mass = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    start = seeds.select("host", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), (F.col(k) / F.lit(float(mass[k] or 1))).alias("rank")) for k in ("trust", "distrust")])).alias("s"))
    start = stored(start.select("host", "s.kind", "s.rank").where("rank > 0").coalesce(parts), "seeds", rounds)
    links = steps.select("kind", F.col("src").alias("host"), "dst", "share")
    base = start.select("host", "kind", (F.col("rank") * (1 - damping)).alias("rank"), F.lit(0.0).alias("before"))

    def moved(now: DataFrame, compared: bool) -> DataFrame:
        rows = links.join(now.select("host", "kind", "rank"), ["kind", "host"]).select(
            F.col("dst").alias("host"), "kind", (F.col("rank") * F.col("share") * damping).alias("rank"), F.lit(0.0).alias("before")).unionByName(base)
        if compared:
            rows = rows.unionByName(now.select("host", "kind", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
        return rows.groupBy("host", "kind").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")).coalesce(parts)

    now = start
    for _ in range(0, _MOST_ROUNDS, _ROUNDS):
        for i in range(_ROUNDS):
            now = moved(now, i == _ROUNDS - 1)
        now = stored(now, "ranks", rounds, spark)
        if now.where(F.abs(F.col("rank") - F.col("before")) > tolerance * F.col("rank")).isEmpty():
            break
    else:
        raise RuntimeError(f"ranks still change after {_MOST_ROUNDS} rounds")
    now = spark.read.schema(now.schema).parquet(*now.inputFiles())
    return now.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], tolerance: float = TOLERANCE, damping: float = DAMPING,
           factor: float = FACTOR, hierarchy: bool = True) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row.

    The longest rule that fits decides. Where none fits, the host's distrust and trust do: it is blocked if distrust
    exceeds ``factor`` times trust, else allowed; so a host that neither reaches is allowed. Scores are those of the settled graph, up
    to a ``tolerance``. Seeds are the hosts of pages
    with a rule, weighted by their number. A NULL url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed. NULL html has no links. Repeated rows are judged one by one and count as often. Empty input: empty.
    Other columns are not read.
    """
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = rows.where(F.col("hit").isNotNull()).groupBy("host").agg(*[
        F.count(F.when(F.col("hit.verdict") == v, 1)).cast("double").alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))])
    scores = propagate(stored(host_edges(rows, hierarchy), "edges"), stored(seeds, "weights"), tolerance, damping)
    judged = rows.select("page_id", "host", "path", "hit").join(scores, "host", "left")
    none = F.lit(0.0)
    trust, distrust = F.coalesce("trust", none), F.coalesce("distrust", none)
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(
        F.col("hit.verdict"), F.when(distrust > trust * factor, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"))
