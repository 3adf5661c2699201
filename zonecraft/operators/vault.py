"""Data Vault hubs, links and satellites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecraft.functions.exprs import null_safe_join
from zonecraft.functions.hashing import hash_diff, hash_key
from zonecraft.operators import privacy as P
from zonecraft.operators.dims import versioned
from zonecraft.operators.window import framed

HK = "hub_hash_key"


def _new_keys(source: DataFrame, existing: DataFrame | None, keys, name: str, recipe: str = "vault") -> DataFrame:
    """The hash of the keys, as column `name`, and the keys, for every hash that is not known yet.

    Rows are grouped and matched by the bytes of the hash, half as long as its text, in one exchange."""
    x = source.select(F.unhex(hash_key(keys, recipe)).alias("_h"), F.struct(*keys).alias("_k"))
    x = x.groupBy("_h").agg(F.min("_k").alias("_k"))  # one of the spellings of a normalised key
    if existing is not None:
        known = F.col(name)  # hashes are lower-case text; unhex would take other cases for the same
        x = x.join(existing.select(F.when(known == F.lower(known), F.unhex(known)).alias("_h")), "_h", "left_anti")
    return x.select(F.lower(F.hex("_h")).alias(name), "_k.*")


def hub(source: DataFrame, existing: DataFrame | None, keys, record_source: str, load_date: str | None = None, recipe: str = "vault") -> DataFrame:
    """New hub rows: one for each hash of the keys that is not known yet."""
    h = _new_keys(source, existing, keys, HK, recipe)
    when = F.lit(load_date).cast("timestamp") if load_date else F.current_timestamp()
    return h.withColumns({"load_date": when, "record_source": F.lit(record_source)})


def private_hub(source: DataFrame, existing: DataFrame | None, keys, record_source: str, load_date: str | None = None) -> DataFrame:
    """Hub over pseudonymised business keys."""
    return hub(source.withColumns({k: P.pseudonym(k, "fpe") for k in keys}), existing, keys, record_source, load_date)


def link(source: DataFrame, existing: DataFrame | None, keys, record_source: str, load_date: str | None = None) -> DataFrame:
    """Distinct relationships with one hash per hub and one for the link.

    The hubs' hashes are taken of the keys at the end, so that no exchange carries them."""
    x = _new_keys(source, existing, keys, "link_hash_key")
    x = x.select("link_hash_key", *[hash_key([k]).alias(f"hub_{i}_hash_key") for i, k in enumerate(keys)], *keys)
    when = F.lit(load_date).cast("timestamp") if load_date else F.current_timestamp()
    return x.withColumns({"load_date": when, "record_source": F.lit(record_source)})


def satellite(incoming: DataFrame, existing: DataFrame, columns, load_date: str, record_source: str, key: str = HK) -> DataFrame:
    """Satellite after a load: changed open rows closed, new versions added."""
    inc = incoming.select(key, *columns).distinct().withColumn("hash_diff", hash_diff(columns))
    return versioned(inc, existing, [key], list(columns), load_date, start="load_date", end="load_end_date", current=None,
                     stamp={"record_source": record_source})


def satellite_inserts(incoming: DataFrame, existing: DataFrame, columns, load_date: str, record_source: str, key: str = HK) -> DataFrame:
    """Insert-only form: rows whose key and columns are not among the open rows."""
    inc = incoming.select(key, *columns).distinct().withColumn("hash_diff", hash_diff(columns))
    known = existing.filter(F.col("load_end_date").isNull()).select(key, *columns)
    return null_safe_join(inc, known, [key, *columns], "left_anti").withColumns({
        "load_date": F.lit(load_date).cast("timestamp"), "load_end_date": F.lit(None).cast("timestamp"), "record_source": F.lit(record_source)})


def private_satellite(incoming: DataFrame, existing: DataFrame, columns, protect: dict, load_date: str, record_source: str, key: str = HK) -> DataFrame:
    """Satellite whose annotated columns are pseudonymised first (column -> method)."""
    return satellite(incoming.withColumns({c: P.pseudonym(c, m) for c, m in protect.items()}), existing, columns, load_date, record_source, key)


def effectivity(versions: DataFrame, keys, valid_from: str, bucket: Column, tie=()) -> DataFrame:
    """valid_to and is_current of insert-only versions from the next version's start."""
    x = framed(versions, keys, [valid_from, *tie], bucket, 0, 1, {"valid_to": lambda w: F.lead(valid_from).over(w)})
    return x.withColumn("is_current", F.col("valid_to").isNull())


def integrity(hubs: DataFrame, links: DataFrame, satellites: DataFrame, link_column: str, keys=(HK, "link_hash_key")) -> DataFrame:
    """Violations: hub uniqueness, link references, satellite (key, diff) among open rows, record source."""
    def check(name, x):
        return x.select(F.lit(name).alias("check"), "violations")

    rep = lambda x, cols: x.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    lost = (links.groupBy(link_column).agg(F.count(F.lit(1)).alias("n"))
            .join(hubs.select(F.col(HK).alias("_h")).distinct(), F.col(link_column) == F.col("_h"), "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")))
    blank = hubs.select("record_source").unionByName(links.select("record_source")).unionByName(satellites.select("record_source"))
    src = blank.agg(F.count_if(F.col("record_source").isNull() | (F.col("record_source") == "")).alias("violations"))
    out = (check("hub_uniqueness", rep(hubs, [HK])).unionByName(check("link_references", lost))
           .unionByName(check("satellite_uniqueness", rep(satellites.filter(F.col("load_end_date").isNull()), [HK, "hash_diff"])))
           .unionByName(check("record_source_present", src)))
    return out.withColumn("passed", F.col("violations") == 0)
