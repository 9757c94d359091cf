"""Change-log tables derived from the driver's base tables.

``VIEW_SQL`` holds portable SQL projections, the same text on Spark and on the oracle's
engine. The order-dependent table, ``value_change``, is built here with the library's
skew-safe operators and kept as a parquet table in the shared folder, as is its join with
the revisions, ``edits``.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.ordered import adjacent, with_chunk
from palimpsest.session import shared_dir

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

CHAIN_SQL = """
select event_id as revision_id, user_id % 20 as entity_id, k % 5 as property_id, cast(k % 2 as string) as value_id,
  case when k % 10 = 9 then 'rank' else '' end as change_target, cast(ts as timestamp) as ts, st,
  case when st = 0 then '' else concat('h', cast(st as string)) end as new_hash
from (select event_id, user_id, ts, cast(floor(value) as int) % 4 as st,
        cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e
"""

# Oracle-side text of the table `value_change` below.
VALUE_CHANGE_SQL = """
with c as (select *, lag(new_hash, 1, '') over (partition by entity_id, property_id, value_id, change_target
             order by ts, revision_id) as old_hash from {chain}),
a as (select *, case when old_hash = '' then 'CREATE' when new_hash = '' then 'DELETE' else 'UPDATE' end as action,
    lead(new_hash) over w as nn, lead(old_hash) over w as nold, lag(old_hash) over w as po, lag(new_hash) over w as pn,
    lead(ts) over w as next_ts, lead(revision_id) over w as next_rev
  from c where old_hash <> new_hash
  window w as (partition by entity_id, property_id, value_id, change_target order by ts, revision_id)),
f as (select *, case when (old_hash <> '' and old_hash = nn) or (old_hash = '' and nn = '' and new_hash = nold)
        then 1 else 0 end as is_reverted,
    case when (po <> '' and po = new_hash) or (po = '' and new_hash = '' and pn = old_hash)
        then 1 else 0 end as reversion from a)
select revision_id, entity_id, property_id, concat('prop ', cast(property_id as string)) as property_label, value_id,
  change_target, action,
  case when change_target = 'rank' then
         case when action = 'CREATE' then 'soft_insertion' when action = 'DELETE' then 'soft_deletion' else 'rank_change' end
       when action = 'CREATE' then case when st = 1 then 'value_insertion' else 'statement_insertion' end
       when action = 'DELETE' then 'statement_deletion' else 'value_update' end as label,
  is_reverted, reversion, old_hash, new_hash, concat('"', old_hash, '"') as old_value,
  case when st = 3 then concat('"+', cast(1900 + entity_id as string), '-00-00T00:00:00Z"')
       when st = 2 then concat('"+', cast(1900 + entity_id as string), '-05-00T00:00:00Z"')
       else concat('"', new_hash, '"') end as new_value,
  case when st >= 2 then 'time' else 'string' end as new_datatype, ts as timestamp,
  case when is_reverted = 1 then next_ts end as reversion_timestamp,
  case when is_reverted = 1 then next_rev end as revision_id_reversion from f
"""

VIEW_SQL = {
    "revision": """
select event_id as revision_id, case when event_id < 50 then 500 + event_id % 25 else user_id % 20 end as entity_id,
  cast(ts as timestamp) as timestamp, 2012 + cast(event_id % 14 as int) as year,
  case when user_id % 10 = 0 then '' when user_id % 10 < 3 then concat('Bot', cast(user_id as string))
       else concat('User', cast(user_id as string)) end as username,
  case when user_id % 10 = 0 then 'anonymous' when user_id % 10 < 3 then 'bot' else 'human' end as user_type,
  case when event_id % 7 = 0 then 'Undo revision' when event_id % 7 = 1 then 'Reverted: non-WP source(s)'
    when event_id % 7 = 2 then 'plain edit'
    when event_id % 7 = 3 then concat('set ', cast(event_id % 60 as string), '°', cast(event_id % 59 as string), '''',
      cast(event_id % 53 as string), '"N ', cast(event_id % 120 as string), '°', cast(event_id % 47 as string), '''',
      cast(event_id % 31 as string), '.5"E')
    when event_id % 7 = 4 then null when event_id % 7 = 5 then 'RVV vandalism' else '' end as comment,
  case when event_id < 25 then event_id % 5 = 0 when event_id < 50 then event_id % 5 <> 0 else false end as redirect,
  case when event_id < 50 then (event_id + 7) % 25 end as q_id_redirect from {events}
""",
    "qualifier_change": """
select event_id as revision_id, user_id % 20 as entity_id, k % 5 as property_id, cast(k % 2 as string) as value_id,
  case when event_id % 4 = 0 then 7452 when event_id % 4 = 1 then 580 when event_id % 4 = 2 then 2241 else 582 end
    as qual_property_id,
  case when event_id % 4 = 1 then concat('"+', cast(2000 + cast(floor(value) as int) % 20 as string), '-00-00T00:00:00Z"')
       else concat('"Q', cast(cast(floor(value) as int) % 6 as string), '"') end as new_value,
  case when event_type = 'error' then 'DELETE' else 'CREATE' end as action,
  case when event_id % 4 = 3 and event_type <> 'error' then 'soft_deletion' else '' end as label,
  cast(ts as timestamp) as timestamp
from (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k from {events}) e
""",
    "reference_change": """
select l_orderkey as revision_id, l_suppkey % 20 as entity_id, l_linenumber as property_id,
  case when l_returnflag = 'N' then 'CREATE' else 'DELETE' end as action from {lineitem}
""",
    "features_text": """
select p_partkey as revision_id, case when p_partkey % 3 = 0 then 2035 when p_partkey % 3 = 1 then -1 else -2 end as property_id,
  concat('prop ', cast(p_partkey % 3 as string)) as property_label, cast(p_partkey % 2 as string) as value_id,
  '' as change_target, p_partkey % 20 as entity_id, concat('"', p_name, '"') as old_value,
  case when p_partkey % 8 = 0 then concat('"', upper(p_name), '"')
    when p_partkey % 8 = 1 then concat('"', p_name, ' of ', p_brand, '"')
    when p_partkey % 8 = 2 then concat('"', replace(p_name, ' ', '-'), '"')
    when p_partkey % 8 = 3 then concat('"', substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1), substr(p_name, 5), '"')
    when p_partkey % 8 = 4 then concat('"', substr(p_name, 1, length(p_name) - 1), '"')
    when p_partkey % 8 = 5 then concat('"', p_type, '"')
    when p_partkey % 8 = 6 then concat('"', p_name, '/"') else '{{}}' end as new_value,
  case when p_partkey % 8 = 0 then 're_formatting' when p_partkey % 8 = 1 then 'refinement'
    when p_partkey % 8 = 2 then 're_formatting, textual_change' when p_partkey % 8 = 3 then 'textual_change'
    when p_partkey % 8 = 4 then 'textual_change, unrefinement' when p_partkey % 8 = 5 then 'property_value_update'
    when p_partkey % 8 = 6 then '' end as label,
  case when p_partkey % 11 = 0 then 1 else 0 end as is_reverted, case when p_partkey % 13 = 0 then 1 else 0 end as reversion
from {part}
""",
    "features_time": """
select cast(floor(o_orderkey / 2.0) as bigint) as revision_id, case when o_orderkey % 2 = 0 then 569 else 570 end as property_id,
  concat('prop ', cast(o_orderkey % 2 as string)) as property_label,
  cast(o_orderkey as string) as value_id, '' as change_target,
  case when t in (0, 2) then concat('"+', y, '-00-00T00:00:00Z"') when t = 1 then concat('"+', y, '-', m, '-00T00:00:00Z"')
    when t = 7 then concat('"+', y, '-01-01T00:00:00Z"') when t = 8 then '"somevalue"'
    else concat('"+', y, '-', m, '-', d, 'T00:00:00Z"') end as old_value,
  case when t in (0, 3) then concat('"+', y, '-', m, '-00T00:00:00Z"') when t = 4 then concat('"+', y, '-00-00T00:00:00Z"')
    when t = 5 then concat('"+1', substr(y, 2), '-', d, '-', m, 'T00:00:00Z"')
    when t = 6 then concat('"-', y, '-', m, '-', d, 'T00:00:00Z"')
    else concat('"+', y, '-', m, '-', d, 'T00:00:00Z"') end as new_value,
  case when t in (0, 1, 2, 7) then 'refinement' when t in (3, 4) then 'unrefinement' when t = 6 then ''
    else 'property_value_update' end as label,
  case when o_orderkey % 5 = 0 then 1 else 0 end as is_reverted, case when o_orderkey % 7 = 0 then 1 else 0 end as reversion,
  case when o_orderkey % 5 = 0 then cast(floor(o_orderkey / 2.0) as bigint) + 3 end as revision_id_reversion
from (select o_orderkey, o_orderkey % 9 as t, cast(year(o_orderdate) as string) as y,
        lpad(cast(month(o_orderdate) as string), 2, '0') as m, lpad(cast(day(o_orderdate) as string), 2, '0') as d
      from {orders}) o
""",
    "features_quantity": """
select cast(floor(l_orderkey / 2.0) as bigint) as revision_id, l_linenumber as property_id,
  concat('prop ', cast(l_linenumber as string)) as property_label,
  concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-',
    cast(l_suppkey as string)) as value_id, '' as change_target,
  concat('"', case when t in (0, 4, 5) then concat('+', a) when t = 1 then concat('+', a, '.', b)
    when t = 2 then concat('+', a, '.50') when t = 3 then concat('+', a, '.333333333333')
    else concat('+', a, '.25') end, '"') as old_value,
  concat('"', case when t = 0 then concat('+', a, '.', b) when t = 1 then concat('+', a) when t = 2 then concat('+', a, '.5')
    when t = 3 then concat('+', a, '.33') when t = 4 then concat('-', a) when t = 5 then concat('+', a, '7')
    else concat('+', a, '.2') end, '"') as new_value,
  case when t = 0 then 'refinement' when t in (1, 3, 6) then 'unrefinement' when t = 2 then 're_formatting'
    when t = 4 then '' else 'property_value_update' end as label,
  case when l_suppkey % 9 = 0 then 1 else 0 end as is_reverted, case when l_suppkey % 8 = 0 then 1 else 0 end as reversion
from (select *, (l_orderkey + l_linenumber) % 7 as t, cast(l_partkey + 1 as string) as a,
        cast(l_linenumber as string) as b from {lineitem}) l
""",
    "features_globecoordinate": """
select c_custkey as revision_id, 625 as property_id, 'coordinate location' as property_label,
  cast(c_custkey as string) as value_id, '' as change_target,
  concat('{{"latitude": ', lo, ', "longitude": ', go, '}}') as old_value,
  concat('{{"latitude": ', ln, ', "longitude": ', gn, '}}') as new_value,
  lo as latitude_old, ln as latitude_new, go as longitude_old, gn as longitude_new,
  case when lo = ln then null when c_custkey % 4 = 3 then 'property_value_update' else 'refinement' end as label_latitude,
  case when go = gn then null when c_custkey % 4 = 2 then 'unrefinement' else 'refinement' end as label_longitude,
  case when c_custkey % 6 = 0 then 1 else 0 end as is_reverted, case when c_custkey % 10 = 0 then 1 else 0 end as reversion
from (select c_custkey,
   case when c_custkey % 20 = 18 then concat(cast(c_custkey % 60 as string), '.123456') else cast(c_custkey % 60 as string) end as lo,
   case when c_custkey % 20 = 18 then concat(cast(c_custkey % 60 as string), '.12')
     when c_custkey % 20 = 6 then cast(c_custkey % 60 + 7 as string) when c_custkey % 4 = 3 then concat('-', cast(c_custkey % 60 as string), '.5')
     when c_custkey % 4 = 1 then cast(c_custkey % 60 as string)
     else concat(cast(c_custkey % 60 as string), '.', lpad(cast(am as string), 6, '0')) end as ln,
   concat(cast(c_custkey % 120 as string), '.25') as go,
   case when c_custkey % 20 = 10 then concat('-', cast(c_custkey % 120 as string), '.25')
     when c_custkey % 20 = 14 then concat(cast(c_custkey % 120 + 3 as string), '.25')
     when c_custkey % 4 = 2 then cast(c_custkey % 120 as string)
     when c_custkey % 4 = 0 then concat(cast(c_custkey % 120 as string), '.25')
     else concat(cast(c_custkey % 120 as string), '.', lpad(cast(gm as string), 6, '0')) end as gn
   from (select c_custkey,
       cast(floor(cast((c_custkey % 59) * 60 + c_custkey % 53 as double) * 1000000 / 3600) as bigint) as am,
       cast(floor(cast((c_custkey % 47) * 120 + (c_custkey % 31) * 2 + 1 as double) * 1000000 / 7200) as bigint) as gm
     from {customer}) m) c
""",
    "features_entity": """
select event_id as revision_id, cast(k % 5 as int) as property_id, concat('prop ', cast(k % 5 as string)) as property_label,
  cast(k % 2 as string) as value_id, '' as change_target,
  case when event_id % 40 = 0 then concat('Q', cast((a + 7) % 25 as string)) else concat('Q', cast(a as string)) end as old_value,
  case when event_id % 40 = 0 then concat('Q', cast(500 + a as string)) else concat('Q', cast(b as string)) end as new_value,
  concat('NATION ', cast(a % 20 as string)) as old_value_label,
  case when k % 17 = 0 then '' when event_id % 9 = 4 and a % 20 <> b % 20 then concat('LAND ', cast(b % 20 as string))
    else concat('NATION ', cast(b % 20 as string)) end as new_value_label,
  case when a % 20 = b % 20 or event_id % 40 = 0 then 'link_change' when k % 4 < 2 then 'refinement'
    when k % 4 = 2 then 'unrefinement' else 'property_value_update, refinement' end as label,
  case when event_id % 6 = 0 then 1 else 0 end as is_reverted, case when event_id % 8 = 0 then 1 else 0 end as reversion,
  case when event_id % 6 = 0 then event_id + 1 end as revision_id_reversion, event_id as change_id
from (select event_id, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, user_id % 25 as a,
        case when cast(floor(value) as int) % 3 = 0 then 100 + user_id % 5
             else (user_id + cast(floor(value) as int) * 5) % 25 end as b from {events}) e where a <> b
""",
    "edges": """
select relation, src, dst from (
  select 'subclass' as relation, concat('Q', cast(n_nationkey as string)) as src, concat('Q', cast(100 + n_regionkey as string)) as dst from {nation}
  union all select 'subclass', concat('Q', cast(100 + r_regionkey as string)), 'Q200' from {region}
  union all select 'part_of', concat('Q', cast(n_nationkey as string)), concat('Q', cast((n_nationkey + 1) % 25 as string)) from {nation} where n_nationkey % 5 <> 4
  union all select 'located_in', concat('Q', cast(100 + r_regionkey as string)), concat('Q', cast(100 + (r_regionkey + 1) % 5 as string)) from {region}
  union all select 'subclass', concat('Q', cast(n_nationkey as string)), concat('Q', cast(n_nationkey + 5 as string)) from {nation} where n_nationkey < 20 and n_nationkey % 5 in (0, 1)
  union all select 'part_of', concat('Q', cast(n_nationkey as string)), concat('Q', cast(n_nationkey + 5 as string)) from {nation} where n_nationkey < 20 and n_nationkey % 5 in (1, 2)
  union all select 'metaclass', concat('Q', cast(n_nationkey as string)), concat('Q', cast(n_nationkey + 5 as string)) from {nation} where n_nationkey < 20 and n_nationkey % 5 = 2
  union all select 'has_part', concat('Q', cast(n_nationkey as string)), concat('Q', cast(n_nationkey + 5 as string)) from {nation} where n_nationkey < 20 and n_nationkey % 5 = 3
  union all select 'located_in', concat('Q', cast(n_nationkey as string)), concat('Q', cast(n_nationkey + 5 as string)) from {nation} where n_nationkey < 20 and n_nationkey % 5 = 4
  union all select 'instance_of', concat('Q', cast(n_nationkey as string)), concat('Q', cast(100 + n_regionkey as string)) from {nation}
  union all select 'subclass', concat('P', cast(p_partkey as string)), concat('Q', cast(p_partkey % 25 as string)) from {part}) u
""",
}

STATEMENT = ["entity_id", "property_id", "value_id", "change_target"]


def build_value_change(chain: DataFrame) -> DataFrame:
    """Turn a chain of statement states into a value-change log with adjacent reversions marked."""
    order, ties = "us", ["revision_id"]
    chain, split = with_chunk(chain.withColumn("us", F.unix_micros("ts")), STATEMENT, order)
    changes = (
        adjacent(chain, STATEMENT, order, ties, {"old_hash": (-1, "new_hash")}, split)
        .fillna("", ["old_hash"])
        .where(F.col("old_hash") != F.col("new_hash"))
    )
    around = adjacent(changes, STATEMENT, order, ties, {
        "nn": (1, "new_hash"), "nold": (1, "old_hash"), "next_ts": (1, "ts"), "next_rev": (1, "revision_id"),
        "po": (-1, "old_hash"), "pn": (-1, "new_hash"),
    }, split)
    old, new = F.col("old_hash"), F.col("new_hash")
    action = F.when(old == "", "CREATE").when(new == "", "DELETE").otherwise("UPDATE")
    undone = ((old != "") & (old == F.col("nn"))) | ((old == "") & (F.col("nn") == "") & (new == F.col("nold")))
    undoes = ((F.col("po") != "") & (F.col("po") == new)) | ((F.col("po") == "") & (new == "") & (F.col("pn") == old))
    year = (F.lit(1900) + F.col("entity_id")).cast("string")
    marked = around.withColumn("action", action).withColumn("is_reverted", F.when(undone, 1).otherwise(0))
    act = F.col("action")
    return marked.select(
        "revision_id", "entity_id", "property_id", F.concat(F.lit("prop "), F.col("property_id").cast("string")).alias("property_label"),
        "value_id", "change_target", "action",
        F.when(F.col("change_target") == "rank",
               F.when(act == "CREATE", "soft_insertion").when(act == "DELETE", "soft_deletion").otherwise("rank_change"))
        .when(act == "CREATE", F.when(F.col("st") == 1, "value_insertion").otherwise("statement_insertion"))
        .when(act == "DELETE", "statement_deletion").otherwise("value_update").alias("label"),
        "is_reverted", F.when(undoes, 1).otherwise(0).alias("reversion"), "old_hash", "new_hash",
        F.concat(F.lit('"'), old, F.lit('"')).alias("old_value"),
        F.when(F.col("st") == 3, F.concat(F.lit('"+'), year, F.lit('-00-00T00:00:00Z"')))
        .when(F.col("st") == 2, F.concat(F.lit('"+'), year, F.lit('-05-00T00:00:00Z"')))
        .otherwise(F.concat(F.lit('"'), new, F.lit('"'))).alias("new_value"),
        F.when(F.col("st") >= 2, "time").otherwise("string").alias("new_datatype"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("is_reverted") == 1, F.col("next_ts")).alias("reversion_timestamp"),
        F.when(F.col("is_reverted") == 1, F.col("next_rev")).alias("revision_id_reversion"),
    )


def build_edits(value_change: DataFrame, revision: DataFrame) -> DataFrame:
    """The log with editor and comment of each revision, and the first revision of its property as anchor."""
    joined = value_change.join(revision.select("revision_id", "username", "comment"), "revision_id")
    anchors = value_change.join(revision.select("revision_id"), "revision_id").groupBy("entity_id", "property_id").agg(
        F.min_by("revision_id", F.struct("timestamp", "revision_id")).alias("anchor_revision_id"))
    return joined.join(anchors, ["entity_id", "property_id"])


class ChangeLog:
    """Named change-log DataFrames over one folder of base tables."""

    _written: dict = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name == "value_change":
            return self._stored(name, lambda: build_value_change(self._view(CHAIN_SQL)))
        if name == "edits":
            return self._stored(name, lambda: build_edits(self.value_change, self.revision))
        if name in VIEW_SQL:
            return self._view(VIEW_SQL[name])
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    def _view(self, text: str) -> DataFrame:
        used = {t: self.base(t) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def scratch(self, name: str) -> str:
        """A path in the shared folder, private to this application and input folder."""
        mark = hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        return f"{shared_dir(self.spark)}/palimpsest/{self.spark.sparkContext.applicationId}/{mark}/{name}"

    def _stored(self, name: str, build) -> DataFrame:
        """Build once per application; later queries scan the table with pruning and pushdown."""
        path = self.scratch(name)
        if path not in self._written:
            build().write.mode("overwrite").parquet(path)
            self._written[path] = True
        return self.spark.read.parquet(path)


def oracle_ctes(*names: str) -> str:
    """A leading WITH clause defining ``fx_<name>`` for the oracle's engine."""
    wanted = []
    for name in names:
        if name == "value_change":
            wanted.append(("chain", CHAIN_SQL))
        wanted.append((name, VALUE_CHANGE_SQL if name == "value_change" else VIEW_SQL[name]))
    tables = {t: t for t in BASE_TABLES} | {"chain": "fx_chain"}
    return ", ".join(f"fx_{name} as ({text.strip().format(**tables)})" for name, text in wanted)
