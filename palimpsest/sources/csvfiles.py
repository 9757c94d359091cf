"""CSV sources with declared schemas.

Quoted fields may span lines, so by default a file is read by one task and files run in
parallel; ``multiline=False`` also splits large files, where no field holds a line break.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.domain import GOLD_SCHEMA
from palimpsest.operators.latest import keep_last

# Text columns whose NULL means '' (fixed values).
BLANK_COLUMNS = ("change_target", "new_value", "old_value", "new_value_label", "old_value_label")


def labelled_csv(spark: SparkSession, path: str, schema: T.StructType = GOLD_SCHEMA, sep: str = ",",
                 multiline: bool = True) -> DataFrame:
    """Hand-labelled changes; quotes inside quoted fields are doubled."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=multiline)


def normalise_csv(spark: SparkSession, src: str, dst: str, sep: str = ";", multiline: bool = True) -> None:
    """Rewrite a mixed-quoting file with commas and quotes only where needed; all fields stay text."""
    df = spark.read.csv(src, header=True, sep=sep, quote='"', escape='"', multiLine=multiline)
    df.write.mode("overwrite").csv(dst, header=True, quote='"', escape='"', quoteAll=False, emptyValue="")


def load_clean(spark: SparkSession, path: str, columns, keys, order, sep: str = ",", null_token: str = "NULL",
               multiline: bool = True) -> DataFrame:
    """All columns as text, the token as NULL, blanks filled in, exact duplicates and older rows of a key dropped.

    ``order`` names the columns that decide which row of a key is the last; a distributed
    file has no row order of its own.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, sep=sep, quote='"', escape='"', nullValue=null_token,
                                       emptyValue="", multiLine=multiline)
    df = df.fillna("", [c for c in BLANK_COLUMNS if c in columns])
    if not keys:
        return df.distinct()
    return keep_last(df, keys, [*order, *[c for c in columns if c not in (*keys, *order)]])
